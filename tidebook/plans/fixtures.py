"""Deterministic book, dirty-book, feature and prediction views over the events
table, as SQL text that Spark and DuckDB both run (integers inside, so that both
give the same values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import ordered
from tidebook.session import for_wide_rows
from tidebook.storage import left, new_path, written

LEVELS = 20
#: Rows between two gaps; rows of the fixture for horizons of up to two minutes.
STRETCH, LONG_STRETCH = 97, 400
#: Microseconds of a day, the bucket in which events are numbered.
DAY = 24 * 3_600_000_000


def _level(l: int) -> str:
    return (
        f"cast(mid_t - half_t - {l - 1} as double) / 10 as bid_price_{l}, cast(mid_t + half_t + {l - 1} as double) / 10 as ask_price_{l}, "
        f"cast((event_id * 7919 + user_id * 31 + {l} * 104729) % 1000 as double) / 100 as bid_size_{l}, "
        f"cast((event_id * 6101 + user_id * 17 + {l} * 13007) % 1000 as double) / 100 as ask_size_{l}"
    )


#: Events in order of time: their number, and a mid price that walks with them.
NUMBERED = """(
  select *, 600000 + sum(cast(floor(value * 100 + 0.5) as bigint) % 21 - 10)
           over (order by rn rows between unbounded preceding and current row) as mid_t
  from (select event_id, user_id, value, row_number() over (order by ts, event_id) - 1 as rn from events) o)"""


def numbered(events: DataFrame) -> DataFrame:
    """The rows of :data:`NUMBERED`, without putting all events in one task."""
    rows = events.select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = ordered.with_bucket(rows, F.col("us"), DAY)
    step = F.floor(F.col("value") * 100 + 0.5).cast("long") % 21 - 10
    rows = ordered.running_sums(rows, {"rn": F.lit(1), "mid_t": step}, ["us", "event_id"])
    return rows.withColumns({"rn": F.col("rn") - 1, "mid_t": F.col("mid_t") + 600_000}).drop("us", "bucket")


def book_sql(levels: int = LEVELS, every: int = STRETCH) -> str:
    """One row a second with a 4 s step every ``every`` rows and a session every
    400."""
    return f"""
select event_id, rn, ts_sec, session_id, {", ".join(_level(i) for i in range(1, levels + 1))}
from (
  select *, rn + 3 * cast(floor(rn / {every}.0) as bigint) as ts_sec,
         cast(floor(rn / 400.0) as bigint) + 1 as session_id,
         1 + (event_id % 3) as half_t
  from {NUMBERED} n) w"""


def dirty_sql(levels: int = LEVELS) -> str:
    """The book with repeated times, nulls, crossed and wide prices, and negative
    sizes."""
    kept = [f"{side}_{kind}_{i}" for side in ("bid", "ask") for kind in ("price", "size") for i in range(1, levels + 1) if f"{side}_{kind}_{i}" not in ("bid_price_1", "ask_price_1", "bid_size_1")]
    return f"""
select event_id, rn, session_id,
       case when event_id % 50 = 0 and rn > 0 then ts_sec - 1 else ts_sec end as ts_sec,
       case when event_id % 71 = 0 then null else bid_price_1 end as bid_price_1,
       case when event_id % 83 = 0 then bid_price_1 - 0.1 when event_id % 101 = 0 then ask_price_1 + 2 else ask_price_1 end as ask_price_1,
       case when event_id % 89 = 0 then -1.0 else bid_size_1 end as bid_size_1,
       {", ".join(kept)}
from ({book_sql(levels)}) b"""


def predictions_sql(a: tuple[int, int] = (37, 11), b: tuple[int, int] = (53, 29), c: tuple[int, int] = (71, 5)) -> str:
    """Class probabilities cubed from linear congruences, the class of the
    largest, and a truth and a split that do not depend on them."""
    cube = lambda x: f"{x} * {x} * {x}"
    total = f"({cube('a')} + {cube('b')} + {cube('c')})"
    return f"""
select event_id, ts_sec, session_id, y_true, split,
       {cube("a")} / {total} as prob_up, {cube("b")} / {total} as prob_down, {cube("c")} / {total} as prob_neutral,
       case when a >= b and a >= c then 1 when b >= c then -1 else 0 end as y_pred
from (
  select event_id, rn, ts_sec, session_id, cast((event_id * 29 + 3) % 3 as int) - 1 as y_true,
         case when rn % 10 < 7 then 'train' when rn % 10 < 9 then 'validation' else 'test' end as split,
         cast((event_id * {a[0]} + {a[1]}) % 997 + 1 as double) as a,
         cast((event_id * {b[0]} + {b[1]}) % 991 + 1 as double) as b,
         cast((event_id * {c[0]} + {c[1]}) % 499 + 1 as double) as c
  from ({book_sql(1)}) book) p"""


#: A second model's constants.
SECOND = {"a": (41, 7), "b": (59, 13), "c": (67, 19)}


_written: dict[tuple[str, str], str] = {}


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number and price, written when they are first asked for:
    queries time their operators on a table, not the numbering of all events.
    Only these four narrow columns are shuffled and written; whatever a view
    derives from them is computed by the tasks that read it."""
    for_wide_rows(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if not left(spark, _written.get(key)):
        path = new_path(spark, "view")
        rows = numbered(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "user_id", "rn", "mid_t")
        # A number of parts that stays: each is small, but what is read of it isn't.
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        written(rows.repartition(parts, "rn"), "view", path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # The dealt rows are narrow; a view widens them by up to ninety columns where
    # it is read.  The explode of a one-element array keeps their formulas from
    # being copied into every column and filter above, which did not end.
    rows = spark.sql(sql.replace(NUMBERED, "{numbered}"), numbered=_numbers(spark, sf_dir))
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _timed(df: DataFrame) -> DataFrame:
    extra = {"timestamp": F.timestamp_seconds("ts_sec"), "event_time": F.timestamp_seconds("ts_sec"), "exchange": F.lit("simulated"), "symbol": F.lit("AAA")}
    return df.withColumns(extra)


def book(spark: SparkSession, sf_dir: str, levels: int = LEVELS, every: int = STRETCH) -> DataFrame:
    return _timed(_run(spark, sf_dir, book_sql(levels, every)))


def dirty(spark: SparkSession, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    return _timed(_run(spark, sf_dir, dirty_sql(levels))).withColumn("raw_order", F.col("rn"))


def predictions(spark: SparkSession, sf_dir: str, **constants) -> DataFrame:
    return _timed(_run(spark, sf_dir, predictions_sql(**constants)))
