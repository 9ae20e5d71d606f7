"""Column families of order-book tables, and the fixed schema of raw snapshots."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 20
METADATA = ["timestamp", "event_time", "exchange", "symbol", "session_id"]
#: Metadata that validation and cleaning ask for; session_id is optional there.
REQUIRED_METADATA = METADATA[:4]


def level_columns(levels: int = LEVELS) -> list[str]:
    return [f"{side}_{kind}_{i}" for side in ("bid", "ask") for kind in ("price", "size") for i in range(1, levels + 1)]


def price_columns(levels: int = LEVELS) -> list[str]:
    return [c for c in level_columns(levels) if "_price_" in c]


def size_columns(levels: int = LEVELS) -> list[str]:
    return [c for c in level_columns(levels) if "_size_" in c]


def required_columns(levels: int = LEVELS) -> list[str]:
    return [*REQUIRED_METADATA, *level_columns(levels)]


def raw_schema(levels: int = LEVELS) -> T.StructType:
    kinds = [T.TimestampType(), T.TimestampType(), T.StringType(), T.StringType(), T.LongType()]
    return T.StructType([*map(T.StructField, METADATA, kinds), *(T.StructField(c, T.DoubleType()) for c in level_columns(levels))])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return sorted(set(wanted) - set(df.columns))


def require_columns(df: DataFrame, wanted: list[str], what: str = "input") -> None:
    if missing := missing_columns(df, wanted):
        raise ValueError(f"{what} lacks columns: {missing}")


def complete(columns: list[str]) -> Column:
    """True where no column is null: one count, which the optimizer does not
    take apart into a constraint per column (those multiply with aliases)."""
    return reduce(add, (F.col(c).isNull().cast("int") for c in columns)) == 0


def preferred_order(df: DataFrame) -> DataFrame:
    """Metadata first, other columns as they are."""
    first = [c for c in METADATA if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def number(name: str) -> Column:
    """A number or null: bad text and NaN become null."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def instant(name: str) -> Column:
    """A timestamp or null."""
    return F.col(name).try_cast("timestamp")


def micros(name: str = "timestamp") -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def coerce(df: DataFrame, levels: int = LEVELS, extra: list[str] | None = None) -> DataFrame:
    """Times as timestamps and book columns as doubles, bad values null."""
    out = {c: instant(c) for c in ("timestamp", "event_time") if c in df.columns}
    out |= {c: number(c) for c in [*level_columns(levels), *(extra or [])] if c in df.columns}
    return df.withColumns(out)
