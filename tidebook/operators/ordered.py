"""Running values over a whole timeline, without putting it in one task.

A window without partitions orders every row in a single task.  Here rows are
windowed within time buckets; one summary row per bucket carries what the
earlier buckets add.  ``by`` are keys with a timeline each, ``order`` the columns
that order rows within a bucket, and ``bucket`` must not decrease with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in microseconds: an hour.
BUCKET = 3_600_000_000


def with_bucket(df: DataFrame, us: Column, width: int = BUCKET, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, F.floor(us / F.lit(width)).cast("long"))


def with_halo(df: DataFrame, us: Column, before_us: int = 0, after_us: int = 0, width: int = BUCKET, name: str = "chunk", own: str = "own") -> DataFrame:
    """Rows in their bucket of time (``own`` true), and once more in a
    neighbouring bucket from whose rows they are at most ``before_us`` earlier or
    ``after_us`` later.  A window within buckets then sees what it would see of
    the whole timeline; rows that aren't ``own`` go after it."""
    width = max(width, before_us, after_us)
    here = F.floor(us / F.lit(width)).cast("long")
    copy = lambda n, flag: F.struct(n.alias(name), F.lit(flag).alias(own))
    later = F.when((here + 1) * width - us <= before_us, copy(here + 1, False))
    earlier = F.when(us - here * width < after_us, copy(here - 1, False))
    return df.select("*", F.inline(F.array_compact(F.array(copy(here, True), later, earlier))))


def _within(by: list[str], bucket: str, order: list[str]):
    return Window.partitionBy(*by, bucket).orderBy(*order)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _timeline(by: list[str], bucket: str):
    """Windows over the summary rows of a timeline: in order, up to and
    including this bucket, and before it."""
    along = Window.partitionBy(*by).orderBy(bucket)
    return along, _upto(along), along.rowsBetween(Window.unboundedPreceding, -1)


def joined(df: DataFrame, summary: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Summary columns beside the rows; null keys are keys."""
    keys = [*by, bucket]
    own = summary.withColumnsRenamed({k: f"own_{k}" for k in keys})
    condition = F.col(bucket) == F.col(f"own_{bucket}")
    for k in by:
        condition = condition & F.col(k).eqNullSafe(F.col(f"own_{k}"))
    return df.join(own, condition).drop(*(f"own_{k}" for k in keys))


def running_sums(df: DataFrame, values: dict[str, Column], order: list[str], by: list[str] | None = None, bucket: str = "bucket") -> DataFrame:
    """Running sums by name, found together: rows are read for the buckets' totals
    and once more for what is within."""
    by = by or []
    df = df.withColumns({f"running_{name}": value for name, value in values.items()})
    _, _, before = _timeline(by, bucket)
    totals = df.groupBy(*by, bucket).agg(*(F.sum(f"running_{name}").alias(f"carried_{name}") for name in values))
    totals = totals.withColumns({f"carried_{name}": F.sum(f"carried_{name}").over(before) for name in values})
    upto = _upto(_within(by, bucket, order))
    df = joined(df, totals, by, bucket)
    found = {name: F.coalesce(f"carried_{name}", F.lit(0)) + F.coalesce(F.sum(f"running_{name}").over(upto), F.lit(0)) for name in values}
    return df.withColumns(found).drop(*(f"{kind}_{name}" for kind in ("carried", "running") for name in values))


def running_sum(df: DataFrame, name: str, value: Column, order: list[str], by: list[str] | None = None, bucket: str = "bucket") -> DataFrame:
    return running_sums(df, {name: value}, order, by, bucket)


def row_index(df: DataFrame, name: str, order: list[str], by: list[str] | None = None, bucket: str = "bucket") -> DataFrame:
    """0, 1, 2, ... in order."""
    df = running_sum(df, name, F.lit(1), order, by, bucket)
    return df.withColumn(name, (F.col(name) - 1).cast("long"))


def gap_runs(df: DataFrame, us: str, gap_us: int, inclusive: bool = False, order: list[str] | None = None, by: list[str] | None = None, bucket_us: int = BUCKET, run: str = "run", before: str = "before_us") -> DataFrame:
    """``before``: the time of the row before (null in the first), and ``run``:
    how many gaps beyond ``gap_us`` (or of it, if ``inclusive``) came up to the
    row.  Column ``us`` holds microseconds and no null."""
    by, order = by or [], [us, *(order or [])]
    broken = lambda gap: F.coalesce((gap >= gap_us) if inclusive else (gap > gap_us), F.lit(False)).cast("long")
    df = with_bucket(df, F.col(us), bucket_us, "run_bucket")
    within = _within(by, "run_bucket", order)
    df = df.withColumn(before, F.lag(us).over(within))
    df = df.withColumn(run, F.sum(broken(F.col(us) - F.col(before))).over(_upto(within)))
    along, upto, earlier = _timeline(by, "run_bucket")
    parts = df.groupBy(*by, "run_bucket").agg(F.min(us).alias("first"), F.max(us).alias("last"), F.max(run).alias("breaks"))
    parts = parts.withColumn("carried_us", F.lag("last").over(along)).withColumn("opens", broken(F.col("first") - F.col("carried_us")))
    offset = F.coalesce(F.sum("breaks").over(earlier), F.lit(0)) + F.sum("opens").over(upto)
    parts = parts.select(*by, "run_bucket", "carried_us", offset.alias("offset_runs"))
    df = joined(df, parts, by, "run_bucket")
    found = {before: F.coalesce(before, "carried_us"), run: F.col(run) + F.col("offset_runs")}
    return df.withColumns(found).drop("run_bucket", "carried_us", "offset_runs")


def running_peak(df: DataFrame, value: Column, order: list[str], by: list[str] | None = None, bucket: str = "bucket", total: str = "total", peak: str = "peak") -> DataFrame:
    """``total``: the running sum of ``value``, and ``peak``: the largest total
    up to the row."""
    by = by or []
    df = df.withColumn("running_value", value)
    upto = _upto(_within(by, bucket, order))
    df = df.withColumn(total, F.sum("running_value").over(upto))
    df = df.withColumn(peak, F.max(total).over(upto))
    _, _, earlier = _timeline(by, bucket)
    parts = df.groupBy(*by, bucket).agg(F.sum("running_value").alias("sum"), F.max(total).alias("top"))
    parts = parts.withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)))
    parts = parts.withColumn("peak_before", F.max(F.col("offset") + F.col("top")).over(earlier))
    df = joined(df, parts.select(*by, bucket, "offset", "peak_before"), by, bucket)
    found = {total: F.col("offset") + F.col(total), peak: F.greatest("peak_before", F.col("offset") + F.col(peak))}
    return df.withColumns(found).drop("offset", "peak_before", "running_value")
