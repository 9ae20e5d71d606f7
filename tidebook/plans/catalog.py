"""Queries over the fixtures, one per operator, each with its DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import book as bk
from tidebook.functions.labels import SignalRule
from tidebook.operators import backtest as bt
from tidebook.operators import cleaning, evaluation, experiment, features, models, sessions, targets
from tidebook.schema import level_columns, required_columns
from tidebook.sources.messages import normalise_schema as normalise
from tidebook.sources.messages import parse_messages
from tidebook.storage import written
from tidebook.streaming import collector

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def half_up(c: Column | str, digits: int) -> Column:
    """``round`` of doubles as DuckDB has it, by arithmetic: Spark's goes through a
    decimal, which for 80 columns a row took longer than finding their values.
    Numbers too large to be scaled are whole as they are."""
    value = F.col(c) if isinstance(c, str) else c
    scaled = value * 10.0**digits
    near = F.rint(scaled)
    near = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.abs(scaled) < 2.0**52, near / 10.0**digits + 0.0).otherwise(value)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t in ("double", "float") else F.col(c).cast("int").alias(c) if t == "tinyint" else F.col(c) for c, t in df.dtypes))


# ---- shared SQL -------------------------------------------------------------

BOOK = f"book as ({fx.book_sql()})"
DIRTY = f"dirty as ({fx.dirty_sql()})"
SEGMENT = """
gaps as (select *, case when ts_sec - lag(ts_sec) over (partition by session_id order by ts_sec) > 1.5 then 1 else 0 end as brk from {t}),
seg as (select *, sum(brk) over (partition by session_id order by ts_sec rows unbounded preceding)::bigint as segment from gaps)"""


def _depth(side: str, k: int) -> str:
    return " + ".join(f"{side}_size_{i}" for i in range(1, k + 1))


def _weighted(side: str) -> str:
    return " + ".join(f"{side}_size_{i} / {i}" for i in range(1, 21))


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


_MID, _SPREAD = "((bid_price_1 + ask_price_1) / 2)", "(ask_price_1 - bid_price_1)"
BASE = {"mid_price": _MID, "spread": _SPREAD, "relative_spread": _div(_SPREAD, _MID)}
for _k in bk.DEPTHS:
    BASE |= {f"bid_depth_{_k}": f"({_depth('bid', _k)})", f"ask_depth_{_k}": f"({_depth('ask', _k)})"}
    BASE[f"imbalance_{_k}"] = _div(f"({_depth('bid', _k)}) - ({_depth('ask', _k)})", f"({_depth('bid', _k)}) + ({_depth('ask', _k)})")
BASE |= {"weighted_bid_depth": f"({_weighted('bid')})", "weighted_ask_depth": f"({_weighted('ask')})"}
BASE["weighted_imbalance"] = _div(f"({_weighted('bid')}) - ({_weighted('ask')})", f"({_weighted('bid')}) + ({_weighted('ask')})")
BASE["microprice"] = _div("ask_price_1 * bid_size_1 + bid_price_1 * ask_size_1", "bid_size_1 + ask_size_1")
BASE["microprice_minus_mid"] = f"({BASE['microprice']} - {_MID})"
SEGMENTED = f"{BOOK}, {SEGMENT.format(t='book')}, base as (select event_id, ts_sec, session_id, segment, {', '.join(f'{v} as {k}' for k, v in BASE.items())} from seg)"
_W = "(partition by session_id, segment order by ts_sec"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over {_W})"


def _roll(f: str, x: str, n: int) -> str:
    frame = f"{_W} rows between {n - 1} preceding and current row)"
    return f"(case when count({x}) over {frame} = {n} then {f}({x}) over {frame} end)"


HISTORY = {f"delta_{x}": f"{x} - {_lag(x, 1)}" for x in features.DELTAS}
HISTORY |= {f"{x}_lag_{n}": _lag(x, n) for x, ns in features.LAGS.items() for n in ns}
HISTORY |= {f"{x}_roll_mean_{n}": _roll("avg", x, n) for x, ns in features.ROLLING_MEANS.items() for n in ns}
HISTORY |= {f"{x}_roll_std_{n}": _roll("stddev_samp", x, n) for x, ns in features.ROLLING_STDS.items() if x != "mid_return" for n in ns}
HISTORY |= {f"{x}_change_{n}": f"{x} - {_lag(x, n)}" for x, ns in features.CHANGES.items() for n in ns}
HISTORY |= {f"mid_return_{n}": f"{_div('mid_price', _lag('mid_price', n))} - 1" for n in features.RETURNS}
SECOND = {f"mid_return_roll_std_{n}": _roll("stddev_samp", "mid_return_1", n) for n in features.ROLLING_STDS["mid_return"]}
FEATURES = f"""{SEGMENTED},
hist1 as (select *, {", ".join(f"{v} as {k}" for k, v in HISTORY.items())} from base),
hist as (select *, {", ".join(f"{v} as {k}" for k, v in SECOND.items())} from hist1)"""


def _round(names, digits: int = 6) -> str:
    # Adding zero turns a rounded -0.0 into 0.0.
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


def _digits(name: str) -> int:
    """Plain arithmetic gives both engines the same doubles; at six digits some
    are ties, which they round apart.  Rolling values differ in the last bits."""
    return 6 if "_roll_" in name else 10


def _family(names: list[str]) -> str:
    return f"with {FEATURES} select event_id, " + ", ".join(_round([n], _digits(n)) for n in names) + " from hist"


def _history(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    rows = features.build_features(fx.book(spark, sf_dir), keep_levels=False, keep_warmup=True)
    return rows.select("event_id", *(half_up(n, _digits(n)).alias(n) for n in names))


# ---- raw data: validate, merge, clean, inspect --------------------------------

_CELLS = " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in level_columns())
_NEGATIVE = " + ".join(f"(case when {c} < 0 then 1 else 0 end)" for c in level_columns() if "_size_" in c)


@query(f"""with {DIRTY},
r as (
  select count(*) as row_count, {len(level_columns()) + 9} as column_count, {len(required_columns())} as required_column_count, '' as missing_required_columns,
         count(ts_sec) = count(*) as timestamp_parseable, min(ts_sec) as start_sec, max(ts_sec) as end_sec,
         count(*) - count(distinct ts_sec) as duplicate_timestamps, sum({_CELLS})::bigint as missing_values,
         count(*) filter ({_SPREAD} <= 0) as invalid_spreads, sum({_NEGATIVE})::bigint as negative_sizes,
         round(min({_SPREAD}), 6) as min_spread, round(avg({_SPREAD}), 6) as mean_spread, round(max({_SPREAD}), 6) as max_spread from dirty)
select *, row_count > 0 and timestamp_parseable and duplicate_timestamps + missing_values + invalid_spreads + negative_sizes = 0 as passed from r""")
def validate_report(spark, sf_dir):
    report = cleaning.validate(fx.dirty(spark, sf_dir))
    seconds = {f"{end}_sec": F.unix_seconds(f"{end}_timestamp") for end in ("start", "end")}
    return _rounded(report.withColumns(seconds).drop("start_timestamp", "end_timestamp"))


@query(f"with {DIRTY} select ts_sec, max(rn) as rn, arg_max(event_id, rn) as event_id from dirty group by ts_sec")
def merge_keep_last(spark, sf_dir):
    rows = fx.dirty(spark, sf_dir)
    halves = [rows.where("rn % 400 < 200"), rows.where("rn % 400 >= 200")]
    # Each half holds whole stretches of time but for repeats across the cut.
    merged = cleaning.keep_last(halves[0].unionByName(halves[1]), ["timestamp"], ["rn"])
    return merged.select("ts_sec", "rn", "event_id")


@query(f"with {DIRTY} select ts_sec, arg_max(event_id, (rn % 400 >= 200)::int * 1000000000000 + rn) as event_id, arg_max(session_id, (rn % 400 >= 200)::int * 1000000000000 + rn) as session_id from dirty group by ts_sec")
def merge_files(spark, sf_dir):
    rows = fx.dirty(spark, sf_dir)
    merged = cleaning.merge([rows.where("rn % 400 < 200"), rows.where("rn % 400 >= 200").drop("bid_size_20")], ["rn"])
    return merged.select("ts_sec", "event_id", "session_id")


_PARTS = f"""
d as (select *, {_SPREAD} as spread_now from dirty),
c1 as (select * from d where bid_price_1 is not null),
c2 as (select * from c1 qualify row_number() over (partition by ts_sec order by rn desc) = 1),
c3 as (select * from c2 where spread_now > 0),
q as (select quantile_cont(spread_now, 0.99) as cut from c3),
c4 as (select c3.*, cut from c3, q where spread_now <= cut and spread_now <= 1.0),
c5 as (select * from c4 where bid_size_1 >= 0)"""


@query(f"with {DIRTY}, {_PARTS} select ts_sec, event_id, round(bid_price_1, 6) as bid_price_1, round(ask_price_1, 6) as ask_price_1 from c5")
def clean_rows(spark, sf_dir):
    cleaned = cleaning.clean(fx.dirty(spark, sf_dir), cleaning.CleaningConfig(winsorize_sizes=False))
    return _rounded(cleaned.select("ts_sec", "event_id", "bid_price_1", "ask_price_1"))


@query(f"""with {DIRTY}, {_PARTS},
n as (select (select count(*) from d) as n0, (select count(*) from c1) as n1, (select count(*) from c2) as n2,
             (select count(*) from c3) as n3, (select count(*) from c4) as n4, (select count(*) from c5) as n5)
select n0 as raw_rows, n5 as cleaned_rows, n0 - n1 as missing_required_values_removed, n1 - n2 as duplicate_timestamps_removed,
       n2 - n3 as invalid_spread_rows_removed, n3 - n4 as spread_outlier_rows_removed, n4 - n5 as negative_size_rows_removed,
       round((select cut from q), 6) as spread_99_percentile, n0 - n5 as removed_rows, round((n0 - n5) * 100.0::double / n0, 6) as removed_percentage
from n""")
def clean_counts(spark, sf_dir):
    return _rounded(cleaning.clean_counts(fx.dirty(spark, sf_dir)))


@query(f"with {BOOK} select round(quantile_cont({_SPREAD}, 0.99), 6) as spread_99 from book")
def spread_quantile(spark, sf_dir):
    rows = fx.book(spark, sf_dir, 1).select(bk.spread().alias("spread"))
    return _rounded(cleaning.quantiles(rows, ["spread"], [0.99]).select(F.col("spread")[0].alias("spread_99")))


_SIZES = [c for c in level_columns() if "_size_" in c]


@query(
    f"with {DIRTY}, {_PARTS}, caps as (select "
    + ", ".join(f"quantile_cont({c}, 0.001) as lo_{c}, quantile_cont({c}, 0.99) as hi_{c}" for c in _SIZES)
    + " from c5) "
    + " union all ".join(f"select '{c}' as \"column\", round(max(lo_{c}), 6) as lower_cap, round(max(hi_{c}), 6) as upper_cap, count(*) filter ({c} < lo_{c}) as capped_lower, count(*) filter ({c} > hi_{c}) as capped_upper from c5, caps" for c in _SIZES)
)
def winsor_caps(spark, sf_dir):
    config = cleaning.CleaningConfig(winsorize_sizes=False)
    cleaned = cleaning.clean(fx.dirty(spark, sf_dir), config, keep=_SIZES)
    return _rounded(cleaning.winsor_report(cleaned, cleaning.winsor_columns(cleaned), cleaning.CleaningConfig()))


@query(
    f"with {DIRTY}, {_PARTS}, caps as (select " + ", ".join(f"quantile_cont({c}, 0.001) as lo_{c}, quantile_cont({c}, 0.99) as hi_{c}" for c in _SIZES) + " from c5) "
    "select ts_sec, " + ", ".join(f"round(greatest(lo_{c}, least(hi_{c}, {c})), 6) as {c}" for c in _SIZES) + " from c5, caps"
)
def winsor_sizes(spark, sf_dir):
    rows = cleaning.clean(fx.dirty(spark, sf_dir), keep=["ts_sec", *_SIZES])
    return rows.select("ts_sec", *(half_up(c, 6).alias(c) for c in _SIZES))


@query(f"with {BOOK} select ts_sec, round({_MID}, 6) as mid_price, round_even({_SPREAD}, 4) as spread from book")
def inspect_rows(spark, sf_dir):
    rows = cleaning.plot_rows(fx.book(spark, sf_dir))
    return _rounded(rows.select(F.unix_seconds("timestamp").alias("ts_sec"), "mid_price", "spread"))


@query(f"""with {BOOK}, p as (select ts_sec, {_MID} as mid_price, round_even({_SPREAD}, 4) as spread from book)
select count(*) as row_count, min(ts_sec) as start_sec, max(ts_sec) as end_sec, round(min(mid_price), 6) as mid_price_min, round(avg(mid_price), 6) as mid_price_mean,
       round(max(mid_price), 6) as mid_price_max, round(min(spread), 6) as spread_min, round(avg(spread), 6) as spread_mean, round(max(spread), 6) as spread_max from p""")
def inspect_summary(spark, sf_dir):
    out = cleaning.inspect(fx.book(spark, sf_dir))
    return _rounded(out.withColumns({"start_sec": F.unix_seconds("start_timestamp"), "end_sec": F.unix_seconds("end_timestamp")}).drop("start_timestamp", "end_timestamp"))


# ---- sessions -----------------------------------------------------------------


@query(f"""with {BOOK}, g as (select ts_sec - lag(ts_sec) over (order by ts_sec) as gap from book)
select coalesce(max(gap), 0)::double as largest_timestamp_gap_seconds, count(*) filter (gap > 1.5) as gaps_gt_1_5_seconds,
       count(*) filter (gap > 5) as gaps_gt_5_seconds, count(*) filter (gap > 60) as gaps_gt_60_seconds from g""")
def gap_diagnostics(spark, sf_dir):
    return sessions.gap_diagnostics(fx.book(spark, sf_dir, 1))


@query(f"""with {BOOK}, g as (select event_id, ts_sec, case when ts_sec - lag(ts_sec) over (order by ts_sec) > 1.5 then 1 else 0 end as brk from book)
select event_id, 1 + sum(brk) over (order by ts_sec rows unbounded preceding)::bigint as session_id from g""")
def session_infer(spark, sf_dir):
    return sessions.infer_sessions(fx.book(spark, sf_dir, 1).drop("session_id")).select("event_id", "session_id")


@query(f"with {BOOK}, {SEGMENT.format(t='book')} select event_id, session_id, segment from seg")
def continuity_segments(spark, sf_dir):
    return sessions.continuity_segments(fx.book(spark, sf_dir, 1)).select("event_id", "session_id", "segment")


@query(f"with {BOOK}, {SEGMENT.format(t='book')} select count(*) as session_count from (select distinct session_id, segment from seg)")
def session_count(spark, sf_dir):
    return sessions.session_count(sessions.continuity_segments(fx.book(spark, sf_dir, 1)))


# ---- instantaneous and history features ------------------------------------------


def _instant(spark, sf_dir, names: list[str]) -> DataFrame:
    columns = bk.instantaneous()
    return fx.book(spark, sf_dir).select("event_id", *(F.round(columns[n], 10).alias(n) for n in names))


def _instant_sql(names: list[str]) -> str:
    return f"with {BOOK} select event_id, " + ", ".join(f"round({BASE[n]}, 10) + 0.0 as {n}" for n in names) + " from book"


_GROUPS = {
    "mid_spread": ["mid_price", "spread", "relative_spread"],
    "depth_imbalance": [n for k in bk.DEPTHS for n in (f"bid_depth_{k}", f"ask_depth_{k}", f"imbalance_{k}")],
    "weighted_imbalance": ["weighted_bid_depth", "weighted_ask_depth", "weighted_imbalance"],
    "microprice": ["microprice", "microprice_minus_mid"],
}
for _name, _columns in _GROUPS.items():
    QUERIES[_name] = lambda spark, sf_dir, names=_columns: _instant(spark, sf_dir, names)
    SQL[_name] = _instant_sql(_columns)

_NAMES = features.history_names()
_FAMILIES = {
    "delta_features": [n for n in _NAMES if n.startswith("delta_")],
    "lag_features": [n for n in _NAMES if "_lag_" in n],
    "rolling_mean": [n for n in _NAMES if "_roll_mean_" in n],
    "rolling_std": [n for n in _NAMES if "_roll_std_" in n],
    "change_features": [n for n in _NAMES if "_change_" in n],
    "mid_returns": ["mid_return_1", "mid_return_5", "mid_return_10"],
}
for _name, _columns in _FAMILIES.items():
    QUERIES[_name] = lambda spark, sf_dir, names=_columns: _history(spark, sf_dir, names)
    SQL[_name] = _family(_columns)

_COMPLETE = " and ".join(f"{n} is not null" for n in _NAMES)


@query(f"with {FEATURES} select event_id, session_id, segment, " + ", ".join(_round([n], _digits(n)) for n in _NAMES) + f" from hist where {_COMPLETE}")
def warmup_drop(spark, sf_dir):
    rows = features.build_features(fx.book(spark, sf_dir), keep_levels=False)
    return rows.select("event_id", "session_id", "segment", *(half_up(n, _digits(n)).alias(n) for n in _NAMES))


@query(f"""with {FEATURES}, k as (select *, {_COMPLETE} as whole from hist)
select session_id, segment, count(*) as rows, count(*) filter (whole) as kept_rows, min(ts_sec) as first_sec, min(case when whole then ts_sec end) as first_kept_sec,
       bool_or(whole and ts_sec = (select min(ts_sec) from k o where o.session_id = k.session_id and o.segment = k.segment)) as violated from k group by session_id, segment""")
def warmup_check(spark, sf_dir):
    report = features.warmup_summary(fx.book(spark, sf_dir))
    seconds = {"first_sec": F.unix_seconds("first_timestamp"), "first_kept_sec": F.unix_seconds("first_kept_timestamp")}
    return report.withColumns(seconds).drop("first_timestamp", "first_kept_timestamp")


# ---- targets ---------------------------------------------------------------------


def _future_sql(h: int, tol: float = 0.5, table: str = "seg", us: str = "ts_sec * 1000000", mid: str = _MID) -> str:
    return f"""
m as (select event_id, session_id, segment, {us} as us, {mid} as mid_price from {table}),
pairs as (
  select a.event_id, b.us as fus, b.mid_price as future_mid_price,
         row_number() over (partition by a.event_id order by abs(b.us - a.us - {h * 1000000}), b.us) as k
  from m a join m b on a.session_id = b.session_id and a.segment = b.segment
   and b.us between a.us + {int(h * 1000000 - tol * 1000000)} and a.us + {int(h * 1000000 + tol * 1000000)}),
fut as (
  select m.*, fus, future_mid_price, future_mid_price - mid_price as future_price_change,
         (future_mid_price - mid_price) / nullif(mid_price, 0) as future_return, (future_mid_price - mid_price) / nullif(mid_price, 0) * 10000 as future_return_bps
  from m left join (select * from pairs where k = 1) using (event_id))"""


FUTURE = f"{BOOK}, {SEGMENT.format(t='book')}, {_future_sql(5)}"


def _market(spark, sf_dir) -> DataFrame:
    return fx.book(spark, sf_dir, 1).withColumns({"mid_price": bk.mid_price(), "spread": bk.spread()})


def _future(spark, sf_dir, h: int = 5) -> DataFrame:
    return targets.attach_future(_market(spark, sf_dir), h)


@query(f"""with {FUTURE} select event_id, coalesce(fus, -1) as future_us, {_round(["future_mid_price", "future_price_change", "future_return", "future_return_bps"])} from fut""")
def asof_nearest_future(spark, sf_dir):
    rows = _future(spark, sf_dir).withColumn("future_us", F.coalesce(F.unix_micros("future_timestamp"), F.lit(-1)))
    return _rounded(rows.select("event_id", "future_us", "future_mid_price", "future_price_change", "future_return", "future_return_bps"))


_SHIFT = "case event_id % 5 when 1 then 500000 when 2 then -500000 when 3 then 600000 when 4 then -600000 else 0 end"


@query(f"""with {BOOK}, shifted as (select *, ts_sec * 2000000 + {_SHIFT} as us2, session_id as sess, 0 as segment from book),
s as (select event_id, sess as session_id, segment, us2, bid_price_1, ask_price_1 from shifted), {_future_sql(6, 1.0, "s", "us2")}
select event_id, coalesce(fus, -1) as future_us, round(future_mid_price, 6) as future_mid_price from fut""")
def asof_tolerance_tie(spark, sf_dir):
    us = F.col("ts_sec") * 2_000_000 + F.expr(_SHIFT)
    rows = targets.attach_future(_market(spark, sf_dir).withColumn("timestamp", F.timestamp_micros(us)), 6, 1.0, max_gap_seconds=60)
    return rows.select("event_id", F.coalesce(F.unix_micros("future_timestamp"), F.lit(-1)).alias("future_us"), r6("future_mid_price").alias("future_mid_price"))


def _label_sql(value: str, thr: str) -> str:
    return f"case when {value} > {thr} then 1 when {value} < -({thr}) then -1 else 0 end"


@query(f"with {FUTURE} select event_id, {_label_sql('future_price_change', '0.5')} as target from fut where future_mid_price is not null")
def target_absolute(spark, sf_dir):
    return _rounded(targets.build_targets(_market(spark, sf_dir)).select("event_id", "target"))


@query(f"with {FUTURE} select event_id, {_label_sql('future_return_bps', '0.05 + 0.01')} as target, 0.06::double as total from fut where future_mid_price is not null")
def target_cost_aware(spark, sf_dir):
    config = targets.TargetConfig(mode="cost_aware", cost_threshold_bps=0.05, cost_buffer_bps=0.01)
    rows = targets.build_targets(_market(spark, sf_dir), config)
    return _rounded(rows.select("event_id", "target", F.round("total_cost_aware_threshold_bps", 6).alias("total")))


def _shares_sql(label: str) -> str:
    pick = lambda v: f"count(*) filter ({label} = {v})"
    return "count(*) as rows, " + ", ".join(f"{pick(v)} as {n}_count, round({pick(v)} * 100.0::double / count(*), 6) as {n}_percentage" for n, v in (("down", -1), ("neutral", 0), ("up", 1)))


@query(f"with {FUTURE}, t as (select {_label_sql('future_price_change', '0.5')} as target from fut where future_mid_price is not null) select {_shares_sql('target')} from t")
def target_distribution(spark, sf_dir):
    return _rounded(targets.target_distribution(targets.build_targets(_market(spark, sf_dir))))


@query(f"""with {FUTURE} select count(future_return_bps) as "count", round(avg(future_return_bps), 6) as mean, round(stddev_samp(future_return_bps), 6) as std, round(min(future_return_bps), 6) as "min",
round(quantile_cont(future_return_bps, 0.25), 6) as p25, round(quantile_cont(future_return_bps, 0.5), 6) as p50, round(quantile_cont(future_return_bps, 0.75), 6) as p75, round(max(future_return_bps), 6) as "max" from fut""")
def describe_future_return(spark, sf_dir):
    return _rounded(targets.describe(_future(spark, sf_dir), "future_return_bps"))


@query(f"""with {FUTURE}, thr(threshold_abs) as (values (0.1::double), (0.2), (0.3), (0.5), (0.7), (1.0)),
t as (select threshold_abs, {_label_sql('future_price_change', 'threshold_abs')} as target from fut, thr where future_price_change is not null)
select threshold_abs, {_shares_sql('target')} from t group by threshold_abs""")
def threshold_diagnostics(spark, sf_dir):
    return _rounded(targets.threshold_diagnostics(_future(spark, sf_dir)))


#: Prices so low that returns reach the thresholds.
_LOW = f"({_MID} - 59000)"
_VALUES = lambda name, vs: f"{name} as (values " + ", ".join(f"({v}::double)" for v in vs) + ")"
_STATS = {"count": "count(r)", "mean": "round(avg(r), 6)", "std": "round(stddev_samp(r), 6)", "min": "round(min(r), 6)", "p25": "round(quantile_cont(r, 0.25), 6)", "p50": "round(quantile_cont(r, 0.5), 6)", "p75": "round(quantile_cont(r, 0.75), 6)", "max": "round(max(r), 6)"}


@query(f"""with {BOOK}, {SEGMENT.format(t='book')}, {_future_sql(5, mid=_LOW)}, {_VALUES('a(cost_threshold_bps)', targets.COST_THRESHOLDS_BPS)}, {_VALUES('b(cost_buffer_bps)', targets.COST_BUFFERS_BPS)},
t as (select cost_threshold_bps, cost_buffer_bps, {_label_sql('future_return_bps', 'cost_threshold_bps + cost_buffer_bps')} as target from fut, a, b where future_return_bps is not null),
d as (select {", ".join(f"{v} as future_return_bps_{k}" for k, v in _STATS.items())} from (select future_return_bps as r from fut where future_return_bps is not null)),
n as (select count(*) as input_rows, count(*) - count(future_return_bps) as dropped_rows from fut)
select *, 5 as horizon_seconds from (
  select cost_threshold_bps, cost_buffer_bps, {_shares_sql('target')}, cost_threshold_bps + cost_buffer_bps as total_cost_aware_threshold_bps from t group by 1, 2), n, d""")
def cost_aware_diagnostics(spark, sf_dir):
    market = _market(spark, sf_dir).withColumn("mid_price", F.col("mid_price") - 59_000)
    return _rounded(targets.cost_aware_diagnostics(targets.attach_future(market, 5), horizon_seconds=5))


# ---- splits and metrics -----------------------------------------------------------


@query(f"""with {BOOK}, n as (select count(*) as n from book), o as (select event_id, row_number() over (order by ts_sec) - 1 as i from book)
select event_id, case when i < floor(n * 0.70::double) then 'train' when i < floor(n * (0.70::double + 0.15::double)) then 'validation' else 'test' end as split from o, n""")
def chrono_split(spark, sf_dir):
    return evaluation.chronological_split(fx.book(spark, sf_dir, 1)).select("event_id", "split")


PREDICTIONS = f"pred as ({fx.predictions_sql()})"
PREDICTIONS_2 = f"pred2 as ({fx.predictions_sql(**fx.SECOND)})"


@query(f"with {PREDICTIONS} select split, y_true, count(*) as \"count\" from pred group by 1, 2")
def class_balance(spark, sf_dir):
    return evaluation.class_balance(fx.predictions(spark, sf_dir), "y_true", ["split"])


@query(f"""with {PREDICTIONS} select split, y_true, count(*) filter (y_pred = -1) as pred_down, count(*) filter (y_pred = 0) as pred_neutral, count(*) filter (y_pred = 1) as pred_up from pred group by 1, 2""")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(fx.predictions(spark, sf_dir), ["split"])


def _metrics_sql(source: str) -> str:
    cls = [("down", -1), ("neutral", 0), ("up", 1)]
    counts = ", ".join(f"count(*) filter (y_true = {v}) as {n}_s, count(*) filter (y_pred = {v}) as {n}_p, count(*) filter (y_true = {v} and y_pred = {v}) as {n}_h" for n, v in cls)
    rates = ", ".join(f"coalesce({n}_h::double / nullif({n}_p, 0), 0) as {n}_pr, coalesce({n}_h::double / nullif({n}_s, 0), 0) as {n}_re" for n, _ in cls)
    f1 = ", ".join(f"coalesce(2 * {n}_pr * {n}_re / nullif({n}_pr + {n}_re, 0), 0) as {n}_f" for n, _ in cls)
    present = " + ".join(f"({n}_s + {n}_p > 0)::int" for n, _ in cls)
    out = []
    for m, s in (("precision", "pr"), ("recall", "re"), ("f1", "f")):
        out.append(f"round(({' + '.join(f'{n}_{s}' for n, _ in cls)}) / ({present}), 6) as {m}_macro")
        out.append(f"round(({' + '.join(f'{n}_{s} * {n}_s' for n, _ in cls)}) / rows, 6) as {m}_weighted")
    for n, _ in cls:
        out += [f"{n}_s as {n}_support", f"round({n}_pr, 6) as {n}_precision", f"round({n}_re, 6) as {n}_recall", f"round({n}_f, 6) as {n}_f1"]
    return f"""select split, rows, round(hits::double / rows, 6) as accuracy, {", ".join(out)}
from (select *, {f1} from (select *, {rates} from (select split, count(*) as rows, count(*) filter (y_true = y_pred) as hits, {counts} from {source} group by split)))"""


@query(f"with {PREDICTIONS} {_metrics_sql('pred')}")
def classification_metrics(spark, sf_dir):
    return _rounded(evaluation.classification_metrics(fx.predictions(spark, sf_dir), ["split"]))


@query(f"with {PREDICTIONS} select split, " + ", ".join(f"round({f}(prob_{n}), 6) as prob_{n}_{k}" for n in ("down", "neutral", "up") for k, f in (("min", "min"), ("mean", "avg"), ("max", "max"))) + " from pred group by split")
def probability_summary(spark, sf_dir):
    return _rounded(evaluation.probability_summary(fx.predictions(spark, sf_dir), ["split"]))


@query(f"""with {PREDICTIONS}, {PREDICTIONS_2},
b as (select p.split, p.y_true, p.y_pred as a, q.y_pred as b from pred p join pred2 q on p.ts_sec = q.ts_sec and p.split = q.split and p.y_true = q.y_true)
select split, count(*) as rows, round(avg((a = b)::int), 6) as agreement_rate, round(avg((a = y_true)::int), 6) as logistic_accuracy_on_overlap,
       round(avg((b = y_true)::int), 6) as boosted_accuracy_on_overlap, count(*) filter (a = y_true and b = y_true) as both_correct,
       count(*) filter (a <> y_true and b <> y_true) as both_wrong, count(*) filter (a = y_true and b <> y_true) as logistic_only_correct,
       count(*) filter (a <> y_true and b = y_true) as boosted_only_correct from b group by split""")
def model_agreement(spark, sf_dir):
    return _rounded(evaluation.model_agreement(fx.predictions(spark, sf_dir), fx.predictions(spark, sf_dir, **fx.SECOND)))


_COMPARED = ["rows", "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]


@query(
    f"with {PREDICTIONS}, {PREDICTIONS_2}, a as ({_metrics_sql('pred')}), b as ({_metrics_sql('pred2')}) select a.split, "
    + ", ".join(f"{t}.{c} as {n}_{c}" for t, n in (("a", "logistic"), ("b", "boosted")) for c in _COMPARED)
    + ", round((select count(*) filter (y_true = y_pred) * 1.0::double / count(*) from pred2 where pred2.split = a.split) - (select count(*) filter (y_true = y_pred) * 1.0::double / count(*) from pred where pred.split = a.split), 6) as accuracy_delta from a join b using (split)"
)
def metric_comparison(spark, sf_dir):
    return _rounded(evaluation.compare_metrics(fx.predictions(spark, sf_dir), fx.predictions(spark, sf_dir, **fx.SECOND)))


# ---- backtest ----------------------------------------------------------------------

#: Costs and rule of the backtest queries.
_RULE = SignalRule(0.6, 0.05, 0.4)
_CONFIG = bt.BacktestConfig(_RULE, 5, 0.01, 0.01)
MARKET = f"market as (select ts_sec, {_MID} as mid, {_SPREAD} as spread, {_SPREAD} / {_MID} * 10000 as spread_bps from ({fx.book_sql(1)}) b)"


def _signal_sql(t: str, m: str, n: str) -> str:
    return f"case when prob_down >= {t} and prob_down - prob_up >= {m} and prob_neutral <= {n} then -1 when prob_up >= {t} and prob_up - prob_down >= {m} and prob_neutral <= {n} then 1 else 0 end"


SIGNALS = f"{PREDICTIONS}, sig as (select *, {_signal_sql('0.6', '0.05', '0.4')} as signal from pred)"
PRICED = f"""{MARKET}, priced as (
  select s.*, e.mid as entry_mid_price, e.spread as entry_spread, e.spread_bps as entry_spread_bps, x.mid as exit_mid_price
  from {{sig}} s join market e using (ts_sec) join market x on x.ts_sec = s.ts_sec + 5)"""
HELD = """
cand as (select {keys}ts_sec from priced where signal <> 0),
nxt as (select *, min(ts_sec) over ({part}order by ts_sec range between 5 following and unbounded following) as nts from cand),
taken as (
  select {keys}min(ts_sec) as ts_sec from cand {group}
  union all select {tkeys}n.nts from taken t join nxt n on {match}n.ts_sec = t.ts_sec where n.nts is not null)"""
ONE = {"keys": "", "part": "", "group": "", "tkeys": "", "match": ""}
BACKTEST = f"""{SIGNALS}, {PRICED.format(sig='sig')}, {HELD.format(**ONE)},
rows1 as (
  select p.*, t.ts_sec is not null as trade_taken,
         case when t.ts_sec is not null then signal * (exit_mid_price / entry_mid_price - 1) * 10000 else 0 end as gross_return_bps,
         case when t.ts_sec is not null then 0.04::double else 0 end as total_cost_bps
  from priced p left join taken t using (ts_sec)),
rows2 as (select *, case when trade_taken then gross_return_bps - total_cost_bps else 0 end as net_return_bps from rows1),
rows3 as (select *, sum(net_return_bps) over (order by ts_sec rows unbounded preceding) as equity_curve_bps from rows2),
rows4 as (select *, equity_curve_bps - max(equity_curve_bps) over (order by ts_sec rows unbounded preceding) as drawdown_bps from rows3)"""


def _backtest(spark, sf_dir) -> DataFrame:
    return bt.run_backtest(fx.predictions(spark, sf_dir), bt.prepare_market(_market(spark, sf_dir)), _CONFIG)


@query(f"with {SIGNALS} select event_id, signal from sig")
def signals(spark, sf_dir):
    return bt.create_signals(fx.predictions(spark, sf_dir), _RULE).select("event_id", "signal")


@query(f"with {MARKET} select ts_sec, {_round(['mid', 'spread', 'spread_bps'])} from market")
def market_prep(spark, sf_dir):
    rows = bt.prepare_market(_market(spark, sf_dir))
    return rows.select(F.unix_seconds("timestamp").alias("ts_sec"), r6("entry_mid_price").alias("mid"), r6("entry_spread").alias("spread"), r6("entry_spread_bps").alias("spread_bps"))


@query(f"with {SIGNALS}, {PRICED.format(sig='sig')} select event_id, signal, {_round(['entry_mid_price', 'entry_spread_bps', 'exit_mid_price'])} from priced")
def entry_exit_join(spark, sf_dir):
    rows = bt.attach_prices(bt.create_signals(fx.predictions(spark, sf_dir), _RULE), bt.prepare_market(_market(spark, sf_dir)), 5)
    return _rounded(rows.select("event_id", "signal", "entry_mid_price", "entry_spread_bps", "exit_mid_price"))


@query(f"with recursive {SIGNALS}, {PRICED.format(sig='sig')}, {HELD.format(**ONE)} select ts_sec from taken")
def hold_rule(spark, sf_dir):
    return bt.trades(_backtest(spark, sf_dir)).select("ts_sec")


@query(f"with recursive {BACKTEST} select event_id, signal, trade_taken, {_round(['gross_return_bps', 'total_cost_bps', 'net_return_bps'])} from rows2")
def backtest_rows(spark, sf_dir):
    return _rounded(_backtest(spark, sf_dir).select("event_id", "signal", "trade_taken", "gross_return_bps", "total_cost_bps", "net_return_bps"))


@query(f"with recursive {BACKTEST} select event_id, {_round(['equity_curve_bps'])} from rows3")
def equity_curve(spark, sf_dir):
    return _rounded(_backtest(spark, sf_dir).select("event_id", "equity_curve_bps"))


@query(f"with recursive {BACKTEST} select event_id, {_round(['drawdown_bps'])} from rows4")
def drawdown(spark, sf_dir):
    return _rounded(_backtest(spark, sf_dir).select("event_id", "drawdown_bps"))


def _trade_stats(taken: str) -> dict[str, str]:
    of = lambda f, c: f"coalesce({f}(case when {taken} then {c} end), 0)"
    return {
        "number_of_trades": f"count(*) filter ({taken})",
        "long_trades": f"count(*) filter ({taken} and signal = 1)",
        "short_trades": f"count(*) filter ({taken} and signal = -1)",
        "turnover": f"count(*) filter ({taken})",
        "total_gross_return_bps": of("sum", "gross_return_bps"),
        "total_net_return_bps": of("sum", "net_return_bps"),
        "total_cost_bps": of("sum", "total_cost_bps"),
        "average_gross_return_bps": of("avg", "gross_return_bps"),
        "average_net_return_bps": of("avg", "net_return_bps"),
        "average_cost_per_trade_bps": of("avg", "total_cost_bps"),
        "gross_return_per_trade_minus_cost_per_trade_bps": f"{of('avg', 'gross_return_bps')} - {of('avg', 'total_cost_bps')}",
        "hit_rate": of("avg", "(net_return_bps > 0)::int"),
    }


_COUNTS = ("number_of_trades", "long_trades", "short_trades", "turnover")


def _stats_sql(taken: str) -> str:
    return ", ".join(f"{v} as {k}" if k in _COUNTS else f"round({v}, 6) + 0.0 as {k}" for k, v in _trade_stats(taken).items())


@query(f"""with recursive {BACKTEST} select count(*) as rows, count(*) filter (signal = 0) as no_trade_rows, round(count(*) filter (signal = 0) * 100.0::double / count(*), 6) as no_trade_percentage,
{_stats_sql("trade_taken")}, round(min(drawdown_bps), 6) + 0.0 as max_drawdown_bps from rows4""")
def backtest_summary(spark, sf_dir):
    return _rounded(bt.report(fx.predictions(spark, sf_dir), bt.prepare_market(_market(spark, sf_dir)), _CONFIG))


def _grid_sql() -> str:
    values = lambda name, vs: f"{name}(v) as (values " + ", ".join(f"({v}::double)" for v in vs) + ")"
    lists = ", ".join(values(n, v) for n, v in (("g1", bt.SIGNAL_THRESHOLDS), ("g2", bt.DIRECTION_MARGINS), ("g3", bt.NEUTRAL_LIMITS)))
    return f"{lists}, grid as (select row_number() over () as cfg, g1.v as st, g2.v as dm, g3.v as nm from g1, g2, g3)"


_KEYED = {"keys": "cfg, ", "part": "partition by cfg ", "group": "group by cfg", "tkeys": "t.cfg, ", "match": "n.cfg = t.cfg and "}
SWEEP = f"""{PREDICTIONS}, {_grid_sql()}, {PRICED.format(sig='pred').replace('priced as', 'base as')},
priced as (select base.*, cfg, {_signal_sql('st', 'dm', 'nm')} as signal from base, grid),
{HELD.format(**_KEYED)},
r1 as (select p.cfg, p.ts_sec, signal, signal * (exit_mid_price / entry_mid_price - 1) * 10000 as gross_return_bps, entry_spread_bps + 4.0::double as total_cost_bps
       from priced p join taken t on p.cfg = t.cfg and p.ts_sec = t.ts_sec),
r2 as (select *, gross_return_bps - total_cost_bps as net_return_bps from r1),
first as (select min(ts_sec) as t0, count(*) as n from base),
r3 as (select r2.*, sum(net_return_bps) over (partition by cfg order by ts_sec rows unbounded preceding) as eq from r2),
r4 as (select r3.*, eq - greatest(max(eq) over (partition by cfg order by ts_sec rows unbounded preceding),
              case when min(ts_sec) over (partition by cfg) = t0 then -1e300::double else 0 end) as dd from r3, first),
s as (select cfg, {_stats_sql("true")}, round(least(min(dd), 0), 6) + 0.0 as max_drawdown_bps from r4 group by cfg),
idle as (select cfg, count(*) filter (signal = 0) as no_trade_rows, round(count(*) filter (signal = 0) * 100.0::double / count(*), 6) as no_trade_percentage from priced group by cfg),
results as (
  select 'all' as split, st as signal_threshold, dm as direction_margin, nm as neutral_max_probability, no_trade_rows, no_trade_percentage,
         {", ".join(f"coalesce({k}, 0) as {k}" for k in [*_trade_stats("true"), "max_drawdown_bps"])}
  from grid left join s using (cfg) left join idle using (cfg))"""


def _sweep(spark, sf_dir) -> DataFrame:
    return bt.sweep(fx.predictions(spark, sf_dir), bt.prepare_market(_market(spark, sf_dir)))


@query(f"with recursive {SWEEP} select * from results")
def sweep_results(spark, sf_dir):
    return _rounded(_sweep(spark, sf_dir))


@query(f"with recursive {SWEEP} select * from results order by total_net_return_bps desc, total_gross_return_bps desc, number_of_trades, signal_threshold, direction_margin, neutral_max_probability limit 10")
def sweep_top10(spark, sf_dir):
    return bt.top(_rounded(_sweep(spark, sf_dir)))


# ---- experiments --------------------------------------------------------------------

_CASES = [(h, cost) for h in experiment.HORIZONS for cost in (0.0, 0.01)]


def _case_sql(h: int, cost: float, x: str) -> str:
    """A validation backtest, its table names ending in ``x``."""
    return f"""
priced{x} as (
  select s.*, e.mid as entry_mid_price, q.mid as exit_mid_price from sig s join market e using (ts_sec) join market q on q.ts_sec = s.ts_sec + {h} where split = 'validation'),
cand{x} as (select ts_sec from priced{x} where signal <> 0),
nxt{x} as (select *, min(ts_sec) over (order by ts_sec range between {h} following and unbounded following) as nts from cand{x}),
taken{x} as (select min(ts_sec) as ts_sec from cand{x} union all select n.nts from taken{x} t join nxt{x} n on n.ts_sec = t.ts_sec where n.nts is not null),
rows1{x} as (
  select p.*, t.ts_sec is not null as trade_taken, case when t.ts_sec is not null then signal * (exit_mid_price / entry_mid_price - 1) * 10000 else 0 end as gross_return_bps,
         case when t.ts_sec is not null then {4 * cost}::double else 0 end as total_cost_bps from priced{x} p left join taken{x} t using (ts_sec)),
rows2{x} as (select *, case when trade_taken then gross_return_bps - total_cost_bps else 0 end as net_return_bps from rows1{x}),
rows3{x} as (select *, sum(net_return_bps) over (order by ts_sec rows unbounded preceding) as equity from rows2{x}),
rows4{x} as (select *, equity - max(equity) over (order by ts_sec rows unbounded preceding) as drawdown_bps from rows3{x}),
case{x} as (
  select {h} as horizon_seconds, 0.5::double as threshold_abs, 'validation' as split, '{"zero_cost" if cost == 0 else "cost_adjusted"}' as cost_mode, '' as model_dataset_path, '' as predictions_path,
         count(*) filter (signal = 0) as no_trade_rows, round(count(*) filter (signal = 0) * 100.0::double / count(*), 6) as no_trade_percentage,
         {_stats_sql("trade_taken")}, round(min(drawdown_bps), 6) + 0.0 as max_drawdown_bps from rows4{x})"""


_HORIZONS = f"""{SIGNALS}, {MARKET}, {", ".join(_case_sql(h, c, f"_{i}") for i, (h, c) in enumerate(_CASES))},
m as (select accuracy as validation_accuracy, f1_macro as validation_macro_f1, neutral_recall as validation_neutral_recall, up_precision as validation_up_precision, down_precision as validation_down_precision
      from ({_metrics_sql("pred")}) where split = 'validation'),
summary as (select * from ({" union all ".join(f"select * from case_{i}" for i in range(len(_CASES)))}), m)"""


def _horizons(spark, sf_dir) -> DataFrame:
    """One model's predictions taken for those of every horizon."""
    market = bt.prepare_market(_market(spark, sf_dir))
    horizons, costs = sorted({h for h, _ in _CASES}), sorted({(c, c) for _, c in _CASES})
    predicted = fx.predictions(spark, sf_dir).withColumn("horizon_seconds", F.explode(F.array(*map(F.lit, horizons))))
    return _rounded(experiment.summaries(predicted, market, _RULE, tuple(horizons), costs, 0.5, "validation"))


@query(f"with recursive {_HORIZONS} select * from summary")
def horizon_summary(spark, sf_dir):
    return _horizons(spark, sf_dir)


def _best_sql(name: str, column: str, mode: str, least: int = 0) -> str:
    return f"(select '{name}' as criterion, * from summary where cost_mode = '{mode}' and number_of_trades >= {least} order by {column} desc, horizon_seconds limit 1)"


_RANKINGS = [
    ("net_with_costs", "average_net_return_bps", "cost_adjusted"),
    ("gross_without_costs", "average_gross_return_bps", "zero_cost"),
    ("gross_less_cost", "gross_return_per_trade_minus_cost_per_trade_bps", "cost_adjusted"),
    ("net_with_50_trades", "average_net_return_bps", "cost_adjusted", 50),
]


@query(f"with recursive {_HORIZONS} " + " union all ".join(_best_sql(*r) for r in _RANKINGS))
def best_horizon(spark, sf_dir):
    summary = written(_horizons(spark, sf_dir), "summary")
    best = [rows.withColumn("criterion", F.lit(name)) for name, rows in experiment.rankings(summary).items()]
    return functools.reduce(DataFrame.unionByName, best)


@query(f"with {PREDICTIONS} select event_id, split, round(prob_up, 6) as prob_up, case when split = 'test' then round(prob_down, 6) end as prob_down from pred where split <> 'train'")
def union_by_name(spark, sf_dir):
    rows = _rounded(fx.predictions(spark, sf_dir).select("event_id", "split", "prob_up", "prob_down"))
    parts = [rows.where("split = 'validation'").drop("prob_down"), rows.where("split = 'test'")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


# ---- messages and collection -----------------------------------------------------------


def _messages(spark, sf_dir) -> DataFrame:
    """The book as depth messages: every third wrapped, every seventh short of a
    level, long names in every fifth."""
    rows = fx.book(spark, sf_dir)
    side = lambda name: F.array(*(F.array(F.col(f"{name}_price_{i}").cast("string"), F.col(f"{name}_size_{i}").cast("string")) for i in range(1, 21)))
    cut = lambda c: F.when(F.col("event_id") % 7 == 0, F.slice(c, 1, 19)).otherwise(c)
    short = F.struct((F.col("ts_sec") * 1000).alias("E"), F.lit("aaa").alias("s"), cut(side("bid")).alias("b"), side("ask").alias("a"))
    long = F.struct((F.col("ts_sec") * 1000).alias("E"), F.lit("aaa").alias("s"), cut(side("bid")).alias("bids"), side("ask").alias("asks"))
    body = F.when(F.col("event_id") % 5 == 0, F.to_json(long)).otherwise(F.to_json(short))
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"stream": "x", "data": '), body, F.lit("}"))).otherwise(body)
    return rows.select(value.alias("value"), (F.col("timestamp") + F.expr("interval 250 milliseconds")).alias("timestamp"))


_BOOK_COLUMNS = ", ".join(level_columns())


@query(f"with {BOOK} select ts_sec, ts_sec * 1000 as event_ms, 'AAA' as symbol, {_BOOK_COLUMNS} from book where event_id % 7 <> 0")
def json_levels_parse(spark, sf_dir):
    rows = parse_messages(_messages(spark, sf_dir))
    return rows.select(F.unix_seconds("timestamp").alias("ts_sec"), F.unix_millis("event_time").alias("event_ms"), "symbol", *level_columns())


@query(f"""with {BOOK}, k as (select ts_sec, bid_price_1 from book where event_id % 7 <> 0),
n as (select *, lead(ts_sec) over (order by ts_sec) - ts_sec as ahead from k)
select ts_sec + unnest(range(case when ahead >= 2 then ahead else 1 end)) as ts_sec, bid_price_1 from n""")
def sampler_carry_forward(spark, sf_dir):
    # Filling reads its rows twice: messages are parsed once.
    sampled = collector.sample_seconds(parse_messages(_messages(spark, sf_dir))).select("timestamp", "symbol", "bid_price_1").persist()
    rows = collector.carry_forward(sampled)
    return rows.select(F.unix_seconds("timestamp").alias("ts_sec"), "bid_price_1")


@query(f"""with {BOOK}, k as (select * from book where event_id % 7 <> 0),
g as (select *, case when ts_sec - lag(ts_sec) over (order by ts_sec) > 1.5 then 1 else 0 end as brk from k)
select ts_sec, 3 + sum(brk) over (order by ts_sec rows unbounded preceding)::bigint as session_id, {_BOOK_COLUMNS} from g""")
def session_tracker(spark, sf_dir):
    # Numbering reads its rows twice: messages are parsed once.
    sampled = collector.sample_seconds(parse_messages(_messages(spark, sf_dir))).persist()
    rows = collector.assign_sessions(sampled, session=3)
    return rows.select(F.unix_seconds("timestamp").alias("ts_sec"), "session_id", *level_columns())


@query(f"""with {BOOK}, g as (select *, case when ts_sec - lag(ts_sec) over (order by ts_sec) > 1.5 then 1 else 0 end as brk from book)
select ts_sec, null as symbol, case when event_id % 4 = 0 then session_id else 1 + sum(brk) over (order by ts_sec rows unbounded preceding)::bigint end as session_id,
       case when event_id % 9 = 0 then null else bid_price_1 end as bid_price_1, null::double as ask_size_20 from g""")
def normalise_schema(spark, sf_dir):
    """A table of another shape: text for numbers, columns lacking and to spare."""
    rows = fx.book(spark, sf_dir).drop("symbol", "ask_size_20").withColumn("other", F.lit("x"))
    rows = rows.withColumn("bid_price_1", F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("bid_price_1").cast("string")))
    rows = rows.withColumn("session_id", F.when(F.col("event_id") % 4 == 0, F.col("session_id")))
    return normalise(rows).select(F.unix_seconds("timestamp").alias("ts_sec"), "symbol", "session_id", "bid_price_1", "ask_size_20")


# ---- models (no SQL but for the policy) ---------------------------------------------------


def _dataset(spark, sf_dir) -> DataFrame:
    """Labelled rows.  Labels and splits read their rows more than once, so what
    they read are tables, of the columns that a model is trained on."""
    rows = features.build_features(fx.book(spark, sf_dir), keep_levels=False)
    chosen = models.select_features(rows).selected
    rows = written(rows.select("timestamp", "session_id", "segment", "mid_price", *chosen), "features")
    return written(targets.build_targets(rows).select("timestamp", "target", *chosen), "dataset")


#: The policy as it is stated, apart from the table that the code has.
_KINDS = r"""case
  when feature in ('session_id', 'target', 'timestamp', 'split') then 'never'
  when feature in ('mid_price', 'microprice') then 'raw_prices'
  when feature in ('spread', 'relative_spread', 'weighted_bid_depth', 'weighted_ask_depth', 'weighted_imbalance', 'microprice_minus_mid', 'delta_mid_price', 'delta_spread')
    or regexp_matches(feature, '^(bid_size_|ask_size_|bid_depth_|ask_depth_|imbalance_|delta_imbalance_)') then 'selected'
  else 'other' end"""
_FILLED = ", ".join(f"count({n}) as {n}" for n in ["event_id", "session_id", *BASE, *HISTORY, *SECOND])


@query(f"with {FEATURES}, filled as (unpivot (select {_FILLED} from hist) on columns(*) into name feature value filled) select {_KINDS} as kind, feature, filled from filled")
def feature_selection(spark, sf_dir):
    """What the policy calls each column, and how many rows have a value."""
    counts = features.filled_counts(fx.book(spark, sf_dir), ["event_id", "session_id", *BASE, *HISTORY, *SECOND])
    report = models.select_features(counts)  # columns that are all numbers, as their counts are
    kinds = {n: kind for kind in ("selected", "raw_prices", "never", "other") for n in getattr(report, kind)}
    each = F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("feature"), F.col(n).alias("filled")) for n, kind in kinds.items())))
    return counts.select(each)


def _prepared(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    rows, report = models.prepare(_dataset(spark, sf_dir))
    # Training reads its rows again and again: from a table, not from the plan.
    return written(rows.select("timestamp", "split", "target", *report.selected), "prepared").persist(), report.selected


@query()
def logistic_predictions(spark, sf_dir):
    rows, chosen = _prepared(spark, sf_dir)
    return models.predict(models.train_logistic(rows, chosen), rows)


@query()
def boosted_predictions(spark, sf_dir):
    rows, chosen = _prepared(spark, sf_dir)
    return models.predict(models.train_boosted(rows, chosen), rows)


@query()
def feature_importance(spark, sf_dir):
    rows, chosen = _prepared(spark, sf_dir)
    found = models.train_boosted(rows, chosen).importance()
    rows = spark.createDataFrame(found, "feature string, importance_split long, importance_gain double")
    return rows.orderBy(F.desc("importance_gain"), F.desc("importance_split"), "feature").limit(20)


@query()
def horizon_experiment(spark, sf_dir):
    """All horizons end to end: label, split, train, predict, backtest, with the
    boosted model and all its rounds."""
    rows = written(features.build_features(fx.book(spark, sf_dir, every=fx.LONG_STRETCH), keep_levels=False), "features")
    return experiment.run_horizons(rows, rule=SignalRule(0.4, 0.0, 0.6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and mean imbalance by session."""
    rows = fx.book(spark, sf_dir, 1).withColumns({"mid_price": bk.mid_price(), "imbalance_1": bk.imbalance(1)})
    labelled = targets.build_targets(rows)
    return labelled.groupBy("session_id").agg(*(c for c in targets.class_shares(F.col("target"))), r6(F.avg("imbalance_1")).alias("mean_imbalance_1"))
