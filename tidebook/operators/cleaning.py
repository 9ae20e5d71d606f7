"""Validation, merging, cleaning and inspection of raw book tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import book
from tidebook.schema import LEVELS, coerce, complete, instant, level_columns, missing_columns, number, preferred_order, require_columns, required_columns, size_columns
from tidebook.storage import ship, written

from . import ranks


@dataclass(frozen=True)
class CleaningConfig:
    spread_upper_quantile: float = 0.99
    max_allowed_spread: float = 1.0
    winsorize_sizes: bool = True
    winsor_lower_quantile: float = 0.001
    winsor_upper_quantile: float = 0.99
    #: Quantiles by sketch, where an exact value-count map would be too large.
    approximate: bool = False

    def __post_init__(self):
        if not 0 < self.spread_upper_quantile <= 1:
            raise ValueError("spread_upper_quantile lies in (0, 1]")
        if self.max_allowed_spread <= 0:
            raise ValueError("max_allowed_spread is positive")
        if not 0 <= self.winsor_lower_quantile < self.winsor_upper_quantile <= 1:
            raise ValueError("winsor quantiles are ordered within [0, 1]")


def validate(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row of data-quality counts and the verdict, in a single pass over the
    data besides the count of distinct times."""
    missing = missing_columns(df, required_columns(levels))
    none = F.lit(None).cast("double")
    time = instant("timestamp") if "timestamp" in df.columns else F.lit(None).cast("timestamp")
    has_spread = {"bid_price_1", "ask_price_1"} <= set(df.columns)
    spread = number("ask_price_1") - number("bid_price_1") if has_spread else none
    sizes = [c for c in size_columns(levels) if c in df.columns]
    nulls = [F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull() for c, kind in df.dtypes]
    flat = df.select(
        time.alias("ts"),
        spread.alias("spread"),
        reduce(add, (n.cast("long") for n in nulls), F.lit(0)).alias("nulls"),
        reduce(add, (F.coalesce((number(c) < 0).cast("long"), F.lit(0)) for c in sizes), F.lit(0)).alias("negative"),
    )
    report = flat.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("nulls").alias("nulls"),
        F.sum("negative").alias("negative"),
        F.count_if(F.col("spread") <= 0).alias("invalid"),
        F.min("spread").alias("lowest"),
        F.sum("spread").alias("total"),
        F.count("spread").alias("spreads"),
        F.max("spread").alias("highest"),
    )
    zero = F.lit(0)
    report = report.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_timestamps"),
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("n"))), zero).alias("unparseable"),
        F.coalesce(F.sum("nulls"), zero).alias("missing_values"),
        F.coalesce(F.sum("invalid"), zero).alias("invalid_spreads"),
        F.coalesce(F.sum("negative"), zero).alias("negative_sizes"),
        F.min("ts").alias("start_timestamp"),
        F.max("ts").alias("end_timestamp"),
        F.min("lowest").alias("min_spread"),
        F.try_divide(F.sum("total"), F.sum("spreads")).alias("mean_spread"),
        F.max("highest").alias("max_spread"),
    )
    parseable = (F.col("unparseable") == 0) & F.lit("timestamp" in df.columns)
    clean = reduce(and_, (F.col(c) == 0 for c in ("duplicate_timestamps", "missing_values", "invalid_spreads", "negative_sizes")))
    return report.select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(required_columns(levels))).alias("required_column_count"),
        F.lit(",".join(missing)).alias("missing_required_columns"),
        parseable.alias("timestamp_parseable"),
        *("start_timestamp", "end_timestamp", "duplicate_timestamps", "missing_values", "invalid_spreads", "negative_sizes", "min_spread", "mean_spread", "max_spread"),
        ((F.col("row_count") > 0) & F.lit(not missing) & parseable & clean).alias("passed"),
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (a later ordinal wins)."""
    latest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("keep_rank", F.row_number().over(latest)).where("keep_rank = 1").drop("keep_rank")


def merge(frames: list[DataFrame], order: list[str] | None = None, by_symbol: bool = False) -> DataFrame:
    """Union by name, then the last row of each time: later frames win, within a
    frame ``order`` does.  A time that cannot be read raises."""
    if not frames:
        raise ValueError("nothing to merge")
    tagged = [f.withColumn("merge_file", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    read = instant("timestamp")
    checked = F.when(read.isNotNull(), read).otherwise(F.raise_error(F.lit("a timestamp cannot be read")).cast("timestamp"))
    both = both.withColumn("timestamp", checked)
    keys = ["timestamp", "symbol"] if by_symbol else ["timestamp"]
    return preferred_order(keep_last(both, keys, ["merge_file", *(order or [])]).drop("merge_file"))


def winsor_columns(df: DataFrame, levels: int = LEVELS) -> list[str]:
    """Sizes, and depth columns if any are there; never prices."""
    derived = [c for c in df.columns if c.startswith(("bid_depth_", "ask_depth_")) or c in ("weighted_bid_depth", "weighted_ask_depth")]
    return [*(c for c in size_columns(levels) if c in df.columns), *derived]


def _brackets(rows: DataFrame, n_columns: int, points: list[float]) -> list[tuple[int, int, float, float, float]]:
    """``column, point, least, most, at``: for each column with values and each
    point, values between which the quantile lies for certain, and its place
    among all.  Tasks summarise what they sort; summaries are merged by
    neighbours, level by level, until a column has one."""
    ship(rows.sparkSession)
    parts = written(rows.mapInArrow(ranks.summarised, ranks.SUMMARY), "summaries")
    most = parts.agg(F.max("part")).head()[0] or 0
    while most > 0:
        most //= ranks.FAN_IN
        merged = parts.withColumn("part", F.floor(F.col("part") / ranks.FAN_IN).cast("long")).groupBy("column", "part").applyInArrow(ranks.merged, ranks.SUMMARY)
        parts = written(merged, "summaries")
    found = parts.where(F.col("column") < n_columns).groupBy("column").applyInArrow(lambda table: ranks.brackets(table, points), ranks.BRACKET)
    return sorted(tuple(r) for r in found.collect())  # a row for each column and point


def quantile_rows(df: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """``column, point, value``: exact linear-interpolated quantiles of each
    column's values (null values are none).

    Summaries of what tasks sort bracket every quantile.  One pass then counts the
    values below each bracket, and only values inside leave the rows: some
    thousandths of them.  These are counted once each, dealt out by ranges and
    counted up, within a range and over ranges, so no task holds a column's
    values, however many differ.
    """
    spark = df.sparkSession
    # Read twice: what is upstream runs once.
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"v{j}") for j, c in enumerate(columns))).persist(StorageLevel.DISK_ONLY)
    brackets = _brackets(rows, len(columns), points)
    if not brackets:
        return spark.createDataFrame([], "column string, point double, value double")
    limits = [(j, low, high) for j, _, low, high, _ in brackets]
    held = written(rows.mapInArrow(lambda batches: ranks.inside(batches, limits), ranks.HELD), "inside")
    below = dict(held.where("below").groupBy("key").agg(F.sum("n")).collect())  # a row for each column and point
    asked = [(k, columns[j], points[i], below.get(k, 0), at) for k, (j, i, _, _, at) in enumerate(brackets)]
    asked = F.broadcast(spark.createDataFrame(asked, "key int, column string, point double, below long, at double"))  # a row for each column and point
    counts = held.where("not below").groupBy("key", "value").agg(F.sum("n").alias("n"))
    counts = counts.repartitionByRange("key", "value").withColumn("range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    by_range = Window.partitionBy("key").orderBy("range")
    ranges = counts.groupBy("key", "range").agg(F.sum("n").alias("held"))
    ranges = ranges.withColumn("offset", F.sum("held").over(by_range) - F.col("held")).drop("held")
    within = Window.partitionBy("key", "range").orderBy("value")
    counted = counts.withColumn("upto", F.sum("n").over(within)).join(ranges, ["key", "range"]).join(asked, "key")
    # Places of a value are low, ..., low + n - 1.
    counted = counted.withColumn("low", F.col("below") + F.col("offset") + F.col("upto") - F.col("n"))
    holds = lambda place: (F.col("low") <= place) & (place < F.col("low") + F.col("n"))
    found = counted.where(holds(F.floor("at")) | holds(F.ceil("at"))).groupBy("column", "point").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.max(F.col("at") - F.floor("at")).alias("f"))
    return found.select("column", "point", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("value"))


def quantiles(df: DataFrame, columns: list[str], points: list[float], approximate: bool = False) -> DataFrame:
    """One row: an array of quantiles for each column; exact unless
    ``approximate``, null without values."""
    if approximate:
        return df.agg(*(F.percentile_approx(c, points, 100_000).alias(c) for c in columns))
    rows = quantile_rows(df, columns, points)
    pick = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("point") == p), F.col("value")))
    return rows.agg(*(F.array(*(pick(c, p) for p in points)).alias(c) for c in columns))


def _staged(df: DataFrame, config: CleaningConfig, levels: int, order: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of all rows with ``stage``: 0 for those that pass all,
    else the step that stops them (1 missing value, 2 duplicate, 3 spread, 4
    spread outlier, 5 size).

    Steps look only at rows that passed the steps before, so duplicates are
    ranked among complete rows and the spread quantile is taken of what is left.
    """
    require_columns(df, required_columns(levels), "the book")
    rows = coerce(df, levels, winsor_columns(df, levels))
    rows = rows.withColumn("complete", complete(["timestamp", "event_time", *level_columns(levels)]))
    rows = rows.withColumn("spread_now", book.spread())
    # What the steps ask of a row's levels is found before rows travel, which
    # then have only these answers and the columns to keep.
    negative = reduce(add, (F.coalesce((F.col(c) < 0).cast("int"), F.lit(0)) for c in size_columns(levels))) > 0
    rows = rows.withColumn("negative_size", negative)
    # Rows that go anyway are not ranked with those of their time, which may be
    # no time at all: they are spread by their place.
    own = F.when(F.col("complete"), F.unix_micros("timestamp")).otherwise(F.xxhash64(*order))
    rows = rows.select(*dict.fromkeys([*keep, *order]), "complete", "spread_now", "negative_size", own.alias("own_place"))
    latest = Window.partitionBy("complete", "own_place").orderBy(*(F.col(c).desc() for c in order))
    rows = rows.withColumn("clean_rank", F.row_number().over(latest))
    stage = F.when(~F.col("complete"), 1).when(F.col("clean_rank") > 1, 2).when(F.col("spread_now") <= 0, 3).otherwise(0)
    # Ranked once: the cut, the caps and the rows themselves are all read from it.
    rows = rows.withColumn("stage", stage).drop("clean_rank", "complete", "own_place").persist(StorageLevel.DISK_ONLY)
    cut = quantiles(rows.where("stage = 0"), ["spread_now"], [config.spread_upper_quantile], config.approximate).select(F.col("spread_now")[0].alias("spread_cut"))
    rows = rows.crossJoin(F.broadcast(cut))  # one row
    outlier = (F.col("spread_now") > F.col("spread_cut")) | (F.col("spread_now") > config.max_allowed_spread)
    late = F.when(F.col("stage") > 0, F.col("stage")).when(outlier, 4).when(F.col("negative_size"), 5).otherwise(0)
    return rows.withColumn("stage", late)


def winsor_caps(df: DataFrame, columns: list[str], config: CleaningConfig) -> DataFrame:
    """One row with ``<column>_caps``: lower and upper cap of each column."""
    points = [config.winsor_lower_quantile, config.winsor_upper_quantile]
    return quantiles(df, columns, points, config.approximate).select(*(F.col(c).alias(f"{c}_caps") for c in columns))


def winsorize(df: DataFrame, columns: list[str], config: CleaningConfig) -> DataFrame:
    if not columns:
        return df
    capped = df.crossJoin(F.broadcast(winsor_caps(df, columns, config)))  # one row
    clip = {c: F.greatest(F.col(f"{c}_caps")[0], F.least(F.col(f"{c}_caps")[1], F.col(c))) for c in columns}
    return capped.withColumns(clip).drop(*(f"{c}_caps" for c in columns))


def winsor_report(df: DataFrame, columns: list[str], config: CleaningConfig) -> DataFrame:
    """``column, lower_cap, upper_cap, capped_lower, capped_upper``."""
    capped = df.select(*columns).crossJoin(F.broadcast(winsor_caps(df, columns, config)))
    parts = []
    for c in columns:
        lo, hi = F.col(f"{c}_caps")[0], F.col(f"{c}_caps")[1]
        parts += [F.struct(F.lit(c).alias("column"), F.max(lo).alias("lower_cap"), F.max(hi).alias("upper_cap"), F.count_if(F.col(c) < lo).alias("capped_lower"), F.count_if(F.col(c) > hi).alias("capped_upper"))]
    return capped.agg(F.array(*parts).alias("each")).select(F.inline("each"))


def clean(df: DataFrame, config: CleaningConfig | None = None, levels: int = LEVELS, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Complete rows, the last of each time, with a positive and ordinary spread
    and no negative size; sizes winsorized by what is left.  With ``keep`` only
    these columns travel, and of sizes only those among them are winsorized."""
    config, keep = config or CleaningConfig(), keep or df.columns
    kept = _staged(df, config, levels, order or ["raw_order"], keep).where("stage = 0").select(*keep)
    return winsorize(kept, winsor_columns(kept, levels), config) if config.winsorize_sizes else kept


def clean_counts(df: DataFrame, config: CleaningConfig | None = None, levels: int = LEVELS, order: list[str] | None = None) -> DataFrame:
    """One row: rows removed by each step, and the spread cut."""
    staged = _staged(df, config or CleaningConfig(), levels, order or ["raw_order"], [])
    names = {1: "missing_required_values_removed", 2: "duplicate_timestamps_removed", 3: "invalid_spread_rows_removed", 4: "spread_outlier_rows_removed", 5: "negative_size_rows_removed"}
    counts = staged.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("stage") == 0).alias("cleaned_rows"),
        *(F.count_if(F.col("stage") == k).alias(v) for k, v in names.items()),
        F.coalesce(F.max("spread_cut"), F.lit(0.0)).alias("spread_99_percentile"),
    )
    removed = F.col("raw_rows") - F.col("cleaned_rows")
    share = F.coalesce(F.try_divide(removed.cast("double"), F.col("raw_rows")) * 100, F.lit(0.0))
    return counts.withColumns({"removed_rows": removed, "removed_percentage": share})


def plot_rows(df: DataFrame) -> DataFrame:
    """``timestamp, mid_price, spread`` (4 places, half to even) of readable
    rows, for inspection and plots."""
    rows = df.select(instant("timestamp").alias("timestamp"), number("bid_price_1").alias("bid_price_1"), number("ask_price_1").alias("ask_price_1")).dropna()
    return rows.select("timestamp", book.mid_price().alias("mid_price"), F.bround(book.spread(), 4).alias("spread"))


def inspect(df: DataFrame) -> DataFrame:
    """One row: time range, and least, mean and largest mid price and spread."""
    stats = [f(c).alias(f"{c}_{name}") for c in ("mid_price", "spread") for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return plot_rows(df).agg(F.count(F.lit(1)).alias("row_count"), F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"), *stats)
