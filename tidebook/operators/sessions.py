"""Sessions, continuity segments and gap diagnostics of irregular timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.schema import micros

from . import ordered

#: Fixed value: a longer gap, in seconds, breaks continuity.
MAX_GAP_SECONDS = 1.5


def infer_sessions(df: DataFrame, max_gap_seconds: float = MAX_GAP_SECONDS, name: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """Number sessions from 1 by gaps over the whole timeline.  Where ``name``
    exists and isn't null, it stays.  Rows without a time go."""
    timed = df.withColumn("inferred_us", micros()).where("inferred_us is not null")
    timed = ordered.gap_runs(timed, "inferred_us", int(max_gap_seconds * 1_000_000), order=order, run="inferred")
    inferred = (F.col("inferred") + 1).cast("long")
    given = F.coalesce(F.col(name).cast("long"), inferred) if name in df.columns else inferred
    return timed.withColumn(name, given).drop("inferred_us", "before_us", "inferred")


def continuity_segments(df: DataFrame, max_gap_seconds: float = MAX_GAP_SECONDS, session: str = "session_id", name: str = "segment", order: list[str] | None = None) -> DataFrame:
    """Number the stretches of a session without a break from 0.  A null session
    is a session; without the column the whole table is one.  Rows without a time
    go.  A session, too, is walked in buckets of time."""
    if session not in df.columns:
        return infer_sessions(df, max_gap_seconds, name, order).withColumn(name, F.col(name) - 1)
    timed = df.drop(name).withColumn("segment_us", micros()).where("segment_us is not null")
    timed = ordered.gap_runs(timed, "segment_us", int(max_gap_seconds * 1_000_000), order=order, by=[session], run=name)
    return timed.withColumn(name, F.col(name).cast("long")).drop("segment_us", "before_us")


def gap_diagnostics(df: DataFrame) -> DataFrame:
    """One row: largest gap and counts of gaps beyond 1.5, 5 and 60 seconds over
    the whole timeline; zeros for fewer than two rows."""
    timed = df.select(micros().alias("us")).where("us is not null")
    timed = ordered.gap_runs(timed, "us", int(MAX_GAP_SECONDS * 1_000_000))
    gap = (F.col("us") - F.col("before_us")) / 1e6
    return timed.agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_timestamp_gap_seconds"),
        *(F.count_if(gap > float(limit)).alias(f"gaps_gt_{str(limit).replace('.', '_')}_seconds") for limit in (1.5, 5, 60)),
    )


def session_count(df: DataFrame, session: str = "session_id", segment: str = "segment") -> DataFrame:
    """Number of distinct continuous stretches."""
    return df.select(session, segment).distinct().agg(F.count(F.lit(1)).alias("session_count"))
