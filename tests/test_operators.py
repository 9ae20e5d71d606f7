"""Edges of single operators, against plain Python."""

import math
import random
import types
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.labels import SignalRule, signal, three_way
from tidebook.operators import backtest, boosting, cleaning, evaluation, experiment, features, models, ordered, ranks, sessions, targets
from tidebook.plans import catalog, fixtures
from tidebook.storage import written


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_micros("us"))


def test_running_values_cross_buckets(spark):
    rng = random.Random(3)
    rows, us = [], 0
    for i in range(300):
        us += rng.choice([1, 2, 5, 40]) * 1_000_000
        rows.append((us, float(rng.randint(-5, 5)), i % 2))
    df = ordered.with_bucket(spark.createDataFrame(rows, "us long, v double, k int"), F.col("us"), 30_000_000)
    got = {(r["k"], r["us"]): r for r in ordered.running_peak(df, F.col("v"), ["us"], ["k"]).collect()}
    for k in (0, 1):
        total, peak = 0.0, None
        for u, v, own in rows:
            if own == k:
                total += v
                peak = total if peak is None else max(peak, total)
                assert (got[k, u]["total"], got[k, u]["peak"]) == (total, peak)
    runs = {r["us"]: r for r in ordered.gap_runs(df, "us", 4_000_000, bucket_us=30_000_000).collect()}
    before, run = None, 0
    for u, _, _ in rows:
        run += before is not None and u - before > 4_000_000
        assert (runs[u]["before_us"], runs[u]["run"]) == (before, run)
        before = u
    index = {r["us"]: r["i"] for r in ordered.row_index(df, "i", ["us"]).collect()}
    assert [index[u] for u, _, _ in rows] == list(range(300))


def test_gap_of_the_threshold_does_not_break(spark):
    df = timed(spark, [(0,), (1_500_000,), (3_000_001,)], "us long")
    assert [r["session_id"] for r in sessions.infer_sessions(df).orderBy("us").collect()] == [1, 1, 2]
    assert sessions.gap_diagnostics(df.limit(1)).head().asDict() == {"largest_timestamp_gap_seconds": 0.0, "gaps_gt_1_5_seconds": 0, "gaps_gt_5_seconds": 0, "gaps_gt_60_seconds": 0}


def test_null_sessions_are_filled_and_given_ones_stay(spark):
    df = timed(spark, [(0, 7), (1_000_000, None), (9_000_000, None)], "us long, session_id long")
    assert [r["session_id"] for r in sessions.infer_sessions(df).orderBy("us").collect()] == [7, 1, 2]


def test_asof_ties_take_the_earlier_row(spark):
    rows = [(0, 1.0), (4_500_000, 2.0), (5_500_000, 3.0), (20_000_000, 4.0)]
    df = timed(spark, [(u, p, 1) for u, p in rows], "us long, mid_price double, session_id long")
    got = targets.attach_future(df, 5, 0.5, max_gap_seconds=100).orderBy("timestamp").collect()
    assert [r["future_mid_price"] for r in got] == [2.0, None, None, None]


def test_labels_are_strict_and_null_stays_null(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (-0.5,), (-0.51,), (None,)], "v double")
    assert [r[0] for r in df.select(three_way(F.col("v"), 0.5)).collect()] == [0, 1, 0, -1, None]


def test_a_short_wins_a_double_match(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.5), (0.75, 0.0, 0.25), (0.2, 0.35, 0.45)], "prob_down double, prob_neutral double, prob_up double")
    assert [r[0] for r in df.select(signal(*SignalRule(0.5, 0.0, 0.3).columns())).collect()] == [-1, -1, 0]


@pytest.mark.parametrize("density", [0.02, 0.3, 0.9])
def test_hold_rule_is_the_greedy_scan(spark, density):
    rng = random.Random(int(density * 100))
    times = [i for i in range(4000) if rng.random() < density]
    df = spark.createDataFrame([(t * 1_000_000, c) for t in times for c in (1, 2)], "us long, cfg int")
    got = backtest.taken_times(df, 5_000_000, ["cfg"], bucket_us=60_000_000)
    wanted, last = [], None
    for t in times:
        if last is None or t >= last + 5:
            wanted.append(t)
            last = t
    for c in (1, 2):
        assert sorted(r["us"] // 1_000_000 for r in got.where(F.col("cfg") == c).collect()) == wanted


def test_no_trades_give_zeros(spark):
    predictions = timed(spark, [(i * 1_000_000, 0.3, 0.4, 0.3) for i in range(20)], "us long, prob_down double, prob_neutral double, prob_up double")
    market = backtest.prepare_market(predictions.withColumns({"mid_price": F.lit(10.0), "spread": F.lit(0.1)}))
    row = backtest.summarize(backtest.run_backtest(predictions, market)).head()
    assert (row["rows"], row["number_of_trades"], row["total_net_return_bps"], row["max_drawdown_bps"], row["no_trade_percentage"]) == (15, 0, 0.0, 0.0, 100.0)


def test_zero_depth_gives_nulls_and_no_window_over_them(spark):
    rows = [(i * 1_000_000, 1, 10.0, 10.2, 0.0 if i == 40 else 1.0, 0.0 if i == 40 else 2.0) for i in range(80)]
    df = timed(spark, rows, "us long, session_id long, bid_price_1 double, ask_price_1 double, bid_size_1 double, ask_size_1 double").withColumns({"exchange": F.lit("x"), "symbol": F.lit("y")})
    rows = features.continuity_segments(features.with_instantaneous(df, 1))
    along = features.stretch(rows)
    got = {r["us"] // 1_000_000: r for r in rows.select("us", "imbalance_1", features.rolling_mean("imbalance_1", 5, along).alias("m")).collect()}
    assert got[40]["imbalance_1"] is None
    assert [i for i in range(80) if got[i]["m"] is None] == [0, 1, 2, 3, 40, 41, 42, 43, 44]


def test_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=501), 1), rng.random(501)
    rows = [(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    points = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    row = cleaning.quantiles(df, ["a", "b"], points).head()
    assert row["a"] == pytest.approx(list(np.quantile(a, points)))
    assert row["b"] == pytest.approx(list(np.quantile([y for _, y in rows if y is not None], points)))
    assert cleaning.quantiles(df.where("a > 100"), ["a"], [0.5]).head()["a"] == [None]


def test_histories_and_futures_look_across_buckets(spark, monkeypatch):
    rng = random.Random(1)
    us, rows = 0, []
    for i in range(400):
        us += rng.choice([1_000_000, 1_500_000, 1_000_000, 2_000_000 if i % 90 == 0 else 500_000])
        rows.append((us, 1, 100 + rng.random(), 101 + rng.random(), rng.random(), rng.random()))
    df = timed(spark, rows, "us long, session_id long, bid_price_1 double, ask_price_1 double, bid_size_1 double, ask_size_1 double").withColumns({"exchange": F.lit("x"), "symbol": F.lit("y")})
    quantities = [*(f"imbalance_{k}" for k in (5, 10, 20)), *(f"{side}_depth_{k}" for side in ("bid", "ask") for k in (5, 20))]

    def built():
        one = features.with_instantaneous
        monkeypatch.setattr(features, "with_instantaneous", lambda d, levels: one(d, levels).withColumns({q: F.col("bid_size_1") for q in quantities}))
        out = features.build_features(df, 1, keep_warmup=True)
        monkeypatch.setattr(features, "with_instantaneous", one)
        future = targets.attach_future(out, 5, 0.5).select("timestamp", "future_mid_price", "future_timestamp")
        return {r["us"]: tuple(r) for r in out.select("us", "segment", *features.history_names()).collect()}, {r["timestamp"]: tuple(r) for r in future.collect()}

    whole = built()
    original = ordered.with_halo
    monkeypatch.setattr(ordered, "with_halo", lambda d, us, before_us=0, after_us=0, **names: original(d, us, before_us, after_us, width=1, **names))
    cut = built()
    assert len(whole[0]) == len(cut[0]) == 400
    for us in whole[0]:
        assert [v is None for v in whole[0][us]] == [v is None for v in cut[0][us]]
        assert [v or 0.0 for v in whole[0][us]] == pytest.approx([v or 0.0 for v in cut[0][us]], rel=1e-9, abs=1e-12)
    assert whole[1] == cut[1]


def test_a_history_from_beyond_a_break_is_seen(spark):
    names = features.history_names()
    rows = [(i * 1_000_000, 1, s, 1.0 if k > 0 else None) for s in (0, 1) for k, i in enumerate(range(s * 100, s * 100 + 5))]
    df = timed(spark, rows, "us long, session_id long, segment long, v double")
    good = features.warmup_report(df.select("*", *(F.col("v").alias(n) for n in names)))
    assert [(r["rows"], r["kept_rows"], r["violated"]) for r in good.collect()] == [(5, 4, False)] * 2
    bad = features.warmup_report(df.select("*", *(F.coalesce("v", (F.col("segment") == 1).cast("double")).alias(n) for n in names)))
    assert sorted((r["segment"], r["violated"]) for r in bad.collect()) == [(0, True), (1, True)]


def test_horizon_runs_reach_every_step(spark):
    """Labels, predictions and backtests as written, against the steps by
    themselves; a horizon beyond every stretch has an empty row."""
    rows = written(features.build_features(fixtures.book(spark, "/root/testdata/sf0.001"), keep_levels=False), "features")
    growth, rule = boosting.Growth(rounds=3), SignalRule(0.35, 0.0, 0.6)
    got = experiment.run_horizons(rows, horizons=(5, 10, 120), rule=rule, growth=growth).collect()
    assert [(r["horizon_seconds"], r["cost_mode"]) for r in got] == [(h, m) for h in (5, 10, 120) for m in ("zero_cost", "cost_adjusted")]
    market = backtest.prepare_market(rows)
    for h, free, paid in zip((5, 10), got[:4:2], got[1:4:2], strict=True):
        labelled = targets.build_targets(rows, targets.TargetConfig(horizon_seconds=h))
        own, report = models.prepare(labelled)
        predicted = spark.read.parquet(free["predictions_path"])
        assert paid["predictions_path"] == free["predictions_path"] and len(report.selected) > 50
        wanted = models.predict(models.train_boosted(own, report.selected, growth), own)
        assert predicted.select(*wanted.columns).exceptAll(wanted).count() == 0 and predicted.count() == wanted.count() > 100
        summary = backtest.summarize(backtest.run_backtest(wanted, market, backtest.BacktestConfig(rule, h, 1.0, 1.0, split="validation"))).head()
        assert paid["number_of_trades"] == free["number_of_trades"] == summary["number_of_trades"] > 0
        for name in ("total_net_return_bps", "max_drawdown_bps", "no_trade_percentage", "hit_rate"):
            assert paid[name] == pytest.approx(summary[name])
        assert free["total_net_return_bps"] == pytest.approx(summary["total_gross_return_bps"])
    for r in got[4:]:
        assert (r["number_of_trades"], r["total_net_return_bps"], r["validation_accuracy"]) == (0, 0.0, None)


def test_horizons_share_one_copy_of_the_features(spark, monkeypatch):
    """What is written has a row of features once, and the rows of each horizon
    are those that it would have by itself."""
    rows = written(features.build_features(fixtures.book(spark, "/root/testdata/sf0.001"), keep_levels=False), "features")
    kept = []
    monkeypatch.setattr(experiment, "written", lambda df, name, path=None: kept.append(written(df, name, path)) or kept[-1])
    got = experiment.run_horizons(rows, horizons=(5, 10), growth=boosting.Growth(rounds=1)).collect()
    wide = [df for df in kept if "spread" in df.columns]
    assert len(wide) == 1 and wide[0].count() == rows.count()
    dataset = targets.by_horizon(spark.read.parquet(got[0]["model_dataset_path"]))
    for h in (5, 10):
        want = targets.build_targets(rows, targets.TargetConfig(horizon_seconds=h))
        assert set(dataset.columns) == set(want.columns)
        own = dataset.where(F.col("horizon_seconds") == h).select(*want.columns)
        assert want.count() == own.count() > 100 and own.exceptAll(want).count() == 0


def test_splits_by_key_are_cut_within_a_time(spark):
    """Ten rows at a time, told apart by a second column; a key with few rows."""
    rows = spark.range(530).select(F.timestamp_seconds(F.floor(F.col("id") / 10) * 1800).alias("timestamp"), (F.col("id") % 10 * 7 % 10).alias("s"), F.when(F.col("id") < 9, 3).otherwise(F.col("id") % 2).alias("h"))
    got = evaluation.chronological_splits(rows.repartition(5), "h", ["s"]).collect()
    for h in (0, 1):
        own = sorted((r["timestamp"], r["s"], r["split"]) for r in got if r["h"] == h)
        a, b = evaluation.split_cuts(len(own))
        assert [split for *_, split in own] == ["train"] * a + ["validation"] * (b - a) + ["test"] * (len(own) - b)
    assert {r["h"] for r in got} == {0, 1} and len(got) == 521


def plain_boosting(x, labels, weights, classes, growth):
    """Trees found by trying every cut of every feature on the rows themselves."""
    scores, trees = np.zeros((len(x), classes)), []
    for _ in range(growth.rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        for c in range(classes):
            g, h = weights * (p[:, c] - (labels == c)), weights * classes / (classes - 1) * p[:, c] * (1 - p[:, c])

            def best(rows, g=g, h=h):
                out = (0.0, None, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[rows, f])[:-1]:
                        a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if min(len(a), len(b)) >= growth.least_rows and min(h[a].sum(), h[b].sum()) >= growth.least_hessian:
                            gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                            if gain > max(out[0] + 1e-9, 1e-8):
                                out = (gain, f, cut)
                return out

            leaves, splits = [(np.arange(len(x)), best(np.arange(len(x))))], []
            while len(leaves) < growth.leaves and max(s[0] for _, s in leaves) > 0:
                at = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
                rows, (gain, f, cut) = leaves.pop(at)
                splits.append((f, len(rows)))
                leaves += [(part, best(part)) for part in (rows[x[rows, f] <= cut], rows[x[rows, f] > cut])]
            for rows, _ in leaves if splits else []:
                scores[rows, c] -= growth.rate * g[rows].sum() / h[rows].sum()
            trees.append(sorted(splits))
    return trees, np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def boosted_rows(spark, n, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.random(), rng.random(), float(rng.randrange(4))) for i in range(n)]
    return timed(spark, [(i * 1_000_000, a, b, c, (a + 0.1 * c > 0.7) - (a * b < 0.15)) for i, a, b, c in rows], "us long, a double, b double, c double, target int").withColumn("split", F.lit("train"))


def test_boosted_trees_against_every_cut(spark):
    growth, names = boosting.Growth(rounds=4, leaves=7), ["a", "b", "c"]
    df = boosted_rows(spark, 200).repartition(3)
    forest = models.train_boosted(df, names, growth)
    got = df.withColumn("p", boosting.probabilities(df, {None: forest})).orderBy("us").collect()
    x, y = np.array([[r[n] for n in names] for r in got]), np.array([r["target"] for r in got])
    labels = np.searchsorted(forest.classes, y)
    counts = np.bincount(labels)
    trees, p = plain_boosting(x, labels, (len(y) / (len(counts) * counts))[labels], len(counts), growth)
    made = [sorted((f, n) for f, n in zip(r["feature"], r["rows"], strict=True) if f >= 0) for r in forest.trees.to_pylist()]
    assert made == trees and len(made) == 12
    assert np.allclose(np.array([r["p"] for r in got]), p, atol=1e-9)


def test_a_team_grows_the_trees_of_all_rows(spark, monkeypatch):
    """Several tasks, one of them without a feature and without rows, against
    every cut tried on the rows themselves; two models, one after the other."""
    monkeypatch.setattr(boosting, "team_size", lambda spark, rows, models: 4)
    growth, names = boosting.Growth(rounds=3, leaves=6), ["a", "b", "c"]
    df, other = boosted_rows(spark, 200).coalesce(1), boosted_rows(spark, 230, 9).coalesce(1)
    both = df.withColumn("h", F.lit(5)).unionByName(other.withColumn("h", F.lit(10)))
    forests = models.train_boosted_each(both, names, "h", growth)
    for k, rows in ((5, df), (10, other)):
        got = rows.withColumn("p", boosting.probabilities(rows, {None: forests[k]})).orderBy("us").collect()
        x, y = np.array([[r[n] for n in names] for r in got]), np.array([r["target"] for r in got])
        labels = np.searchsorted(forests[k].classes, y)
        counts = np.bincount(labels)
        trees, p = plain_boosting(x, labels, (len(y) / (len(counts) * counts))[labels], len(counts), growth)
        assert [sorted((f, n) for f, n in zip(r["feature"], r["rows"], strict=True) if f >= 0) for r in forests[k].trees.to_pylist()] == trees
        assert np.allclose(np.array([r["p"] for r in got]), p, atol=1e-9)


def many_rows(spark, n):
    """Rows of which twenty, the fewest that a leaf may have, are told by ``b``."""
    rare = F.col("id") % F.lit(n // 20) == 7
    rows = spark.range(0, n, 1, 6).select(F.timestamp_seconds("id").alias("timestamp"), F.when(rare, 1).otherwise(-(F.col("id") % 2)).cast("int").alias("target"), (F.col("id") % 3).cast("double").alias("a"), rare.cast("double").alias("b"))
    return rows.withColumn("split", F.lit("train"))


def test_a_boosted_model_sees_every_row(spark):
    n = 300_000
    forest = models.train_boosted(many_rows(spark, n), ["a", "b"], boosting.Growth(rounds=1, leaves=3))
    assert [r[0] for r in forest.trees.column("rows").to_pylist()] == [n] * 3
    assert 20 in forest.trees.column("rows").to_pylist()[2]


def test_importance_is_that_of_every_row(spark, monkeypatch):
    """A split on ``b`` is allowed only where all of its twenty rows are."""
    monkeypatch.setattr(boosting, "Growth", partial(boosting.Growth, rounds=1, leaves=3))
    monkeypatch.setattr(catalog, "_prepared", lambda spark, sf_dir: (many_rows(spark, 300_000), ["a", "b"]))
    found = {r["feature"]: (r["importance_split"], r["importance_gain"]) for r in catalog.feature_importance(spark, "").collect()}
    assert found["b"][0] == 3 and found["b"][1] > 1000


def test_models_by_key_see_every_row(spark):
    n, key = 270_000, F.explode(F.array(F.lit(5), F.lit(10))).alias("h")
    forests = models.train_boosted_each(many_rows(spark, n).select("*", key), ["a", "b"], "h", boosting.Growth(rounds=1, leaves=3))
    assert sorted(forests) == [5, 10]
    for forest in forests.values():
        assert [r[0] for r in forest.trees.column("rows").to_pylist()] == [n] * 3


def test_boosted_importance_counts_splits(spark, tmp_path):
    df = boosted_rows(spark, 300)
    model = models.train_boosted(df, ["a", "b", "c"], boosting.Growth(rounds=2, leaves=5))
    found = model.importance()
    assert found[0][0] == "a" and found[0][2] > found[-1][2] >= 0
    assert sum(n for _, n, _ in found) == sum(sum(f >= 0 for f in r["feature"]) for r in model.trees.to_pylist())
    models.save(model, str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)
    assert again.importance() == found and again.trees.equals(model.trees)


def test_boosted_models_by_key_and_sample(spark):
    """Each key's model is the one of its rows alone; one class has none; a
    sample is about as large as asked, and repeated rows don't go together."""
    growth, names = boosting.Growth(rounds=2, leaves=4), ["a", "b", "c"]
    first, second = boosted_rows(spark, 150), boosted_rows(spark, 180, 9)
    third = first.withColumn("target", F.lit(1))
    both = reduce(DataFrame.unionByName, [df.withColumn("h", F.lit(k)) for k, df in ((5, first), (10, second), (60, third))])
    forests = models.train_boosted_each(both, names, "h", growth)
    assert sorted(forests) == [5, 10]
    for k, df in ((5, first), (10, second)):
        alone = models.train_boosted(df, names, growth)
        assert forests[k].trees.drop_columns("model").equals(alone.trees.drop_columns("model"))
    same = spark.range(4000).select((F.col("id") % 2 - F.col("id") % 3).cast("int").alias("target"), F.lit(1.0).alias("a"), (F.col("id") % 2).cast("double").alias("b"), F.lit(0.0).alias("c"))
    sampled = boosting.fit(same.where("target <> 1 or b = 1"), names, growth, most_rows=1000)[None]
    n = sampled.trees.column("rows").to_pylist()[0][0]
    assert 800 < n < 1200


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_holds_are_composed_over_buckets(spark, fan_in):
    """Against a scan one by one: several timelines, each with its own horizon,
    dense, sparse and with empty buckets."""
    rng = random.Random(fan_in)
    lines = {7: sorted(rng.sample(range(0, 4_000), 900)), 13: sorted(rng.sample(range(0, 90_000), 60)), 40: [5], None: [1, 2, 30_000, 30_001]}
    rows = [(h, t * 100_000) for h, ts in lines.items() for t in ts for _ in range(2)]
    df = spark.createDataFrame(rows, "h int, us long").where("h is not null").repartition(5)
    got = backtest.taken_times(df, 40_000_000, ["h"], bucket_us=50_000_000, horizon_by="h", fan_in=fan_in)
    wanted = []
    for h, ts in lines.items():
        last = -math.inf
        for t in ts if h else []:
            if t * 100_000 >= last + h * 1_000_000:
                last = t * 100_000
                wanted.append((h, last))
    assert sorted((r["h"], r["us"]) for r in got.collect()) == wanted


def test_histories_have_the_stated_names():
    """The windows as they are stated, apart from the tables in the code."""
    names = """
    delta_mid_price delta_spread delta_imbalance_1 delta_imbalance_5 delta_imbalance_10 delta_imbalance_20
    imbalance_1_lag_1 imbalance_1_lag_5 imbalance_1_lag_10 imbalance_5_lag_1 imbalance_5_lag_5 imbalance_5_lag_10 imbalance_20_lag_1 imbalance_20_lag_5
    weighted_imbalance_lag_1 weighted_imbalance_lag_5 weighted_imbalance_lag_10 microprice_minus_mid_lag_1 microprice_minus_mid_lag_5 microprice_minus_mid_lag_10
    spread_lag_1 spread_lag_5 relative_spread_lag_1 relative_spread_lag_5
    imbalance_1_roll_mean_5 imbalance_1_roll_mean_10 imbalance_1_roll_mean_30 imbalance_5_roll_mean_5 imbalance_5_roll_mean_10 imbalance_5_roll_mean_30
    imbalance_20_roll_mean_5 imbalance_20_roll_mean_10 imbalance_20_roll_mean_30 weighted_imbalance_roll_mean_5 weighted_imbalance_roll_mean_10 weighted_imbalance_roll_mean_30
    microprice_minus_mid_roll_mean_5 microprice_minus_mid_roll_mean_10 microprice_minus_mid_roll_mean_30 spread_roll_mean_5 spread_roll_mean_10 relative_spread_roll_mean_5 relative_spread_roll_mean_10
    imbalance_1_roll_std_10 imbalance_1_roll_std_30 imbalance_5_roll_std_10 imbalance_5_roll_std_30 weighted_imbalance_roll_std_10 weighted_imbalance_roll_std_30
    microprice_minus_mid_roll_std_10 microprice_minus_mid_roll_std_30 spread_roll_std_10 spread_roll_std_30 relative_spread_roll_std_10 relative_spread_roll_std_30
    mid_return_roll_std_10 mid_return_roll_std_30
    imbalance_1_change_5 imbalance_1_change_10 imbalance_5_change_5 imbalance_5_change_10 imbalance_20_change_5 imbalance_20_change_10
    weighted_imbalance_change_5 weighted_imbalance_change_10 microprice_minus_mid_change_5 microprice_minus_mid_change_10 spread_change_5 relative_spread_change_5
    bid_depth_1_change_5 ask_depth_1_change_5 bid_depth_5_change_5 ask_depth_5_change_5 bid_depth_20_change_5 ask_depth_20_change_5 weighted_bid_depth_change_5 weighted_ask_depth_change_5
    mid_return_1 mid_return_5 mid_return_10""".split()
    assert sorted(names) == sorted(features.history_names()) and len(names) == 80


def test_bracketed_quantiles_are_exact(spark):
    """Beyond the size from which the sketch brackets: many and few different
    values, ties at the cut, a constant and nulls."""
    n, rng = 60_000, np.random.default_rng(6)
    values = {"wide": rng.normal(size=n), "tied": rng.integers(0, 7, n).astype(float), "same": np.full(n, 2.5), "skewed": np.where(rng.random(n) < 0.99, 1.0, rng.exponential(size=n)), "holes": rng.normal(size=n)}
    import pandas as pd

    frame = pd.DataFrame(values)
    frame.loc[::3, "holes"] = np.nan
    df = spark.createDataFrame(frame).withColumn("holes", F.when(~F.isnan("holes"), F.col("holes"))).repartition(5)
    points = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    got = cleaning.quantiles(df, list(values), points).head()
    for c in values:
        assert got[c] == pytest.approx(np.quantile(frame[c].dropna(), points).tolist(), rel=1e-12, abs=1e-12)
    inside = cleaning._brackets(df.select(*(F.col(c).alias(f"v{j}") for j, c in enumerate(values))), 5, points)
    low, high = next((a, b) for j, i, a, b, _ in inside if (j, i) == (0, 3))
    assert 0 < ((values["wide"] >= low) & (values["wide"] <= high)).sum() < n / 500


def test_split_cuts_use_double_products():
    assert evaluation.split_cuts(90) == (62, 76)
    with pytest.raises(ValueError):
        evaluation.split_cuts(9)


def test_feature_policy_counts(spark):
    from tidebook.functions.book import instantaneous
    from tidebook.schema import level_columns

    names = [*level_columns(), *instantaneous(), *features.history_names()]
    df = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    report = models.select_features(df)
    assert (len(names), len(report.selected), len(report.raw_prices), len(report.other)) == (180, 97, 42, 41)


def test_settings_are_checked():
    for bad in (lambda: SignalRule(1.5), lambda: targets.TargetConfig(mode="x"), lambda: cleaning.CleaningConfig(max_allowed_spread=0), lambda: backtest.BacktestConfig(fee_bps=-1)):
        with pytest.raises(ValueError):
            bad()
    assert backtest.BacktestConfig(fee_bps=0, slippage_bps=0).cost_mode == "zero_cost"


def test_validation_counts_repeated_null_times(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.0, 2.0), ("2024-01-01 00:00:00", 3.0, 2.0)], "timestamp string, bid_price_1 double, ask_price_1 double")
    row = cleaning.validate(df, 1).head()
    assert (row["duplicate_timestamps"], row["timestamp_parseable"], row["invalid_spreads"], row["passed"]) == (1, False, 1, False)
    assert "ask_size_1" in row["missing_required_columns"]


def test_merge_raises_on_a_bad_time_and_keeps_the_later_file(spark):
    a = spark.createDataFrame([("2024-01-01 00:00:00", 1)], "timestamp string, v int")
    b = spark.createDataFrame([("2024-01-01 00:00:00", 2)], "timestamp string, v int")
    assert [r["v"] for r in cleaning.merge([a, b]).collect()] == [2]
    with pytest.raises(Exception, match="cannot be read"):
        cleaning.merge([a, spark.createDataFrame([("x", 3)], "timestamp string, v int")]).collect()


def test_logistic_query_runs_until_it_converges(spark, monkeypatch):
    class Stop(Exception):
        pass

    def stop(**given):
        seen.update(given)
        raise Stop

    seen = {}
    monkeypatch.setattr(models, "LogisticRegression", stop)
    with pytest.raises(Stop):
        catalog.QUERIES["logistic_predictions"](spark, "/root/testdata/sf0.001")
    assert seen["maxIter"] == 1000


def test_views_are_written_narrow(spark):
    """What a view derives from an event is computed where it is read, and not
    shuffled and written for each event."""
    from tidebook import storage

    storage.clear(spark) if storage._leftovers(spark) else None
    wide = fixtures.dirty(spark, "/root/testdata/sf0.001")
    folders = storage._leftovers(spark)
    assert len(wide.columns) > 80
    assert [spark.read.parquet(f).columns for f in folders] == [["event_id", "user_id", "rn", "mid_t"]]
    fixtures.book(spark, "/root/testdata/sf0.001")
    assert len(folders) == 1


def test_sweep_repeats_no_row_for_settings(spark, monkeypatch):
    """Over several hours each setting has what its own backtest has, and what is
    kept on the way is at most a row a setting and hour."""
    kept = {}

    def spy(df, name, path=None):
        out = written(df, name, path)
        kept[name] = max(kept.get(name, 0), out.count())
        return out

    n, hours = 2000, 5
    rows = [(i * 9, 600 + (i * 37 % 101) / 10, 0.1 + i % 7 / 100, *(float(x) for x in ((i * 53 % 97 + 1) ** 3, (i * 29 % 89 + 1) ** 3, (i * 71 % 61 + 1) ** 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "t long, mid_price double, spread double, a double, b double, c double").withColumn("timestamp", F.timestamp_seconds("t"))
    market = backtest.prepare_market(df)
    total = F.col("a") + F.col("b") + F.col("c")
    predictions = df.select("timestamp", (F.col("a") / total).alias("prob_down"), (F.col("b") / total).alias("prob_up"), (F.col("c") / total).alias("prob_neutral"))
    monkeypatch.setattr(backtest, "written", spy)
    got = {(r.signal_threshold, r.direction_margin, r.neutral_max_probability): r for r in backtest.sweep(predictions, market, horizon_seconds=27).collect()}
    assert len(got) == 120 and kept["sweep"] <= 120 * hours and kept["passages"] <= 120 * hours
    for setting in ((0.55, 0.0, 0.6), (0.6, 0.1, 0.3), (0.8, 0.2, 0.4)):
        config = backtest.BacktestConfig(SignalRule(*setting), 27, 1.0, 1.0, True)
        want, found = backtest.summarize(backtest.run_backtest(predictions, market, config)).head(), got[setting]
        for name in ("number_of_trades", "long_trades", "no_trade_rows", "total_net_return_bps", "average_gross_return_bps", "hit_rate"):
            assert found[name] == pytest.approx(want[name]), name


@pytest.mark.parametrize("rows", [50, 5000])
def test_histograms_of_many_rows_make_no_wide_copies(rows):
    """The same sums to the last bit, in memory that does not hold every row's
    gradient once for each feature."""
    import tracemalloc

    rng = np.random.default_rng(5)
    codes, g, h = np.asfortranarray(rng.integers(0, 255, (rows, 90)).astype(np.uint8)), rng.normal(size=rows), rng.random(rows)
    node = np.flatnonzero(rng.random(rows) < 0.9)
    tracemalloc.start()
    got = boosting.histogram(codes, node, g, h, 255)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for f in (0, 44, 89):
        want = np.zeros((3, 255))
        for i in node:
            want[:, codes[i, f]] += (g[i], h[i], 1)
        assert np.array_equal(got[:, f], want)
    assert rows < boosting.MANY_ROWS or peak < 8 * rows * 45


def test_counts_of_cleaning_carry_no_levels(spark):
    """Rows are ranked by what the steps found of them, not with their levels."""
    staged = cleaning._staged(fixtures.dirty(spark, "/root/testdata/sf0.001"), cleaning.CleaningConfig(), 20, ["raw_order"], [])
    assert set(staged.columns) == {"raw_order", "spread_now", "negative_size", "stage", "spread_cut"}


def test_histories_are_those_of_windows_but_no_frame_is_added_up_anew(spark):
    """Several sessions, nulls, zero prices and batches smaller than a history."""
    rng = random.Random(8)
    size = lambda: 0.0 if rng.random() < 0.1 else rng.random()
    rows = [(i * 1_000_000 + 3_000_000 * (i // 70), i // 150 if i < 300 else None, *((-1.0, 1.0) if rng.random() < 0.02 else (100 + rng.random(), 101.0)), size(), size()) for i in range(420)]
    df = timed(spark, rows, "us long, session_id long, bid_price_1 double, ask_price_1 double, bid_size_1 double, ask_size_1 double").withColumns({"exchange": F.lit("x"), "symbol": F.lit("y")})
    one, patch = features.with_instantaneous, pytest.MonkeyPatch()
    quantities = {**{f"imbalance_{k}": F.col("imbalance_1") for k in (5, 10, 20)}, **{f"{side}_depth_{k}": F.col("bid_size_1") for side in ("bid", "ask") for k in (5, 20)}}
    with patch.context() as m:
        m.setattr(features, "with_instantaneous", lambda d, levels: one(d, levels).withColumns(quantities))
        wanted = features.continuity_segments(features.with_instantaneous(df, 1))
        built = features.build_features(df, 1, keep_warmup=True)
    along = features.stretch(wanted)
    first, second = features.history_columns(along)
    wanted = wanted.select("*", *(c.alias(k) for k, c in first.items()))
    wanted = wanted.select("*", *(c.alias(k) for k, c in second.items()))
    names = ["us", "session_id", "segment", *features.history_names()]
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -29" not in plan and "RowFrame, -4" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in built.select(names).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(tuple(r) for r in wanted.select(names).collect())
    assert any(v is None for r in got for v in r[40:]) and all(any(r[k] is not None for r in got) for k in range(len(names)))


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    rng = random.Random(9)
    values = [0.0, -0.0, 0.5, -0.5, 0.0000005, -0.0000015, 2.5e-6, 1e300, -4e9, 123456.7890125, *(rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 5) for _ in range(2000)), *(rng.randint(-4000, 4000) / 2.0**7 for _ in range(500))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [tuple(r) for r in df.select(catalog.half_up("v", 6), catalog.half_up("v", 10)).collect()]
    con = duckdb.connect()
    wanted = [con.execute("select round(?::double, 6) + 0.0, round(?::double, 10) + 0.0", [v, v]).fetchone() for v in [*values, None]]
    assert got == wanted
    assert "round(" not in catalog.QUERIES["warmup_drop"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_logistic_regression_is_quick_where_features_nearly_add_up(spark):
    """Sums, near copies and a constant among the features: the solver gets the
    four directions there are, and finds the optimum of Newton's method."""
    rng, n = np.random.default_rng(11), 600
    a, b = rng.normal(size=(2, n))
    x = np.column_stack([a, b, a + b, a + 1e-3 * rng.normal(size=n), b + 1e-2 * rng.normal(size=n), np.full(n, 3.0)])
    y = np.argmax(np.column_stack([a, b, -a]) + rng.gumbel(size=(n, 3)), axis=1)
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = spark.createDataFrame([(i, "train", int(y[i]) - 1, *map(float, x[i])) for i in range(n)], f"id int, split string, target int, {', '.join(f'{c} double' for c in names)}")
    model = models.train_logistic(rows, names)
    assert model.stages[-1].numFeatures == 4 and model.stages[-1].summary.totalIterations <= 100

    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0, ddof=1), 1.0)
    z, w = np.column_stack([z, np.ones(n)]), np.zeros((3, 7))
    ridge = np.diag([*np.ones(6), 1e-9])
    for _ in range(30):
        p = np.exp(z @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - np.eye(3)[y]).T @ z + w @ ridge).ravel()
        bend = np.block([[(z * (p[:, [i]] * ((i == j) - p[:, [j]]))).T @ z + (i == j) * ridge for j in range(3)] for i in range(3)])
        w -= np.linalg.solve(bend, slope).reshape(3, 7)
    scored = models.predict(model, rows.withColumn("split", F.lit("test")).withColumn("timestamp", F.timestamp_seconds("id"))).orderBy("timestamp").collect()
    assert np.abs(np.array([[r[c] for c in models.PROBABILITY_OF.values()] for r in scored]) - p).max() < 2e-3


def test_a_model_reads_tables_and_its_features_once(spark, monkeypatch):
    built = []
    monkeypatch.setattr(catalog, "written", lambda df, name: built.append(name) or written(df, name))
    catalog._prepared(spark, "/root/testdata/sf0.001")
    assert built == ["features", "dataset", "prepared"]


def test_summaries_bracket_over_all_levels(spark, monkeypatch):
    """Many small summaries, merged in several levels; no sketch is merged in one
    task for all columns."""
    for name, value in (("CHUNK", 64), ("POINTS", 16), ("FAN_IN", 2)):
        monkeypatch.setattr(ranks, name, value)
    rng = np.random.default_rng(12)
    values = np.sort(np.concatenate([rng.normal(size=900), np.repeat(0.5, 300), [1e300, -1e300, np.inf]]))
    tables = [pa.table({"v0": values[k::7], "v1": pa.array(values[k::7], mask=rng.random(len(values[k::7])) < 0.5)}) for k in range(7)]
    monkeypatch.setattr(ranks, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    parts = [t for table in tables for t in ranks.summarised(iter(table.to_batches(max_chunksize=10)))]
    mine = pa.Table.from_batches(parts).filter(pc.equal(pa.Table.from_batches(parts)["column"], 0)).combine_chunks()
    while len(mine) > 1:
        mine = pa.concat_tables([ranks.merged(mine.slice(k, 2)) for k in range(0, len(mine), 2)])
    points = [0.0, 0.001, 0.3, 0.5, 0.9, 0.99, 1.0]
    for row in ranks.brackets(mine, points).to_pylist():
        at = (len(values) - 1) * points[row["i"]]
        assert row["at"] == at and (values < row["low"]).sum() <= np.floor(at) and (values <= row["high"]).sum() >= np.ceil(at) + 1


def test_caps_carry_sizes_only(spark):
    """Winsorized sizes need no price to travel, and no sketch of 40 columns."""
    plan = catalog.QUERIES["winsor_sizes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "percentile_approx" not in plan.toString() and "round(" not in plan.optimizedPlan().toString()
    kept = cleaning.clean(fixtures.dirty(spark, "/root/testdata/sf0.001"), cleaning.CleaningConfig(winsorize_sizes=False), keep=["ts_sec", "bid_size_1"])
    assert kept.columns == ["ts_sec", "bid_size_1"]
    stored = kept._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in stored and "bid_price_7" not in stored.split("InMemoryRelation")[1].split("]")[0]


@pytest.mark.parametrize("session", [True, False])
def test_counts_and_warmups_are_those_of_the_features(spark, monkeypatch, session):
    """Sessions with and without a number over many buckets and batches, with
    nulls and breaks at and beyond the allowed gap."""
    rng = random.Random(12)
    us, rows = 0, []
    for i in range(500):
        us += 1_000_000 if i % 47 else rng.choice([1_500_000, 1_500_001, 90_000_000, 7_300_000_000])
        rows.append((us, (i // 150 if i < 350 else None), *((-1.0, 1.0) if rng.random() < 0.01 else (100 + rng.random(), 101.0)), *(0.0 if rng.random() < 0.01 else rng.random() for _ in range(2))))
    df = timed(spark, rows, "us long, session_id long, bid_price_1 double, ask_price_1 double, bid_size_1 double, ask_size_1 double").withColumns({"exchange": F.lit("x"), "symbol": F.lit("y")})
    df = df if session else df.drop("session_id")
    one, halo = features.with_instantaneous, ordered.with_halo
    quantities = {**{f"imbalance_{k}": F.col("imbalance_1") for k in (5, 10, 20)}, **{f"{side}_depth_{k}": F.col("bid_size_1") for side in ("bid", "ask") for k in (5, 20)}}
    monkeypatch.setattr(features, "with_instantaneous", lambda d, levels: one(d, levels).withColumns(quantities))
    parts = features.continuity_segments(df)
    names = ["us", "microprice", *features.history_names()]
    monkeypatch.setattr(ordered, "with_halo", lambda d, us, before_us=0, after_us=0, **names: halo(d, us, before_us, after_us, width=1, **names))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        built = written(features.build_features(df, 1, keep_warmup=True), "built")
        counts = features.filled_counts(df, names, 1).collect()
        found = features.warmup_summary(df, 1)
        wanted = features.warmup_report(built)
        assert found.dtypes == wanted.select(*found.columns).dtypes
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.select(*found.columns).collect()))
        nothing = features.filled_counts(df.where("us < 0"), names, 1).head()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in built.select("us", "segment").collect()} == {tuple(r) for r in parts.select("us", "segment").collect()}
    assert counts == built.agg(*(F.count(n).alias(n) for n in names)).collect() and set(nothing) == {0}
    assert found.count() > 5 and found.where("kept_rows > 0").count() > 3


def test_history_rows_travel_once(spark):
    """One exchange deals them; no join numbers their stretches, and tasks count."""
    plans = {q: catalog.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for q in ("feature_selection", "warmup_drop")}
    assert "Window" not in plans["feature_selection"] and plans["feature_selection"].count("RepartitionByExpression") == 1
    assert all("Join" not in p and p.count("RepartitionByExpression") == 1 for p in plans.values())


def test_a_backtest_is_reported_without_its_rows(spark, monkeypatch):
    """Over several hours and splits, with rows repeated in time, times without a
    price, a price of zero, no trade and no row."""
    n = 1500
    rows = [(i * 9, "test" if i % 5 else "train", 0.0 if i == 700 else 600 + (i * 37 % 101) / 10, 0.1 + i % 7 / 100, *(float(x) for x in ((i * 53 % 97 + 1) ** 3, (i * 29 % 89 + 1) ** 3, (i * 71 % 61 + 1) ** 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "t long, split string, mid_price double, spread double, a double, b double, c double").withColumn("timestamp", F.timestamp_seconds("t"))
    market = backtest.prepare_market(df.where("t % 11 <> 0"))
    total = F.col("a") + F.col("b") + F.col("c")
    predictions = df.select("timestamp", "split", (F.col("a") / total).alias("prob_down"), (F.col("b") / total).alias("prob_up"), (F.col("c") / total).alias("prob_neutral"))
    predictions = predictions.unionByName(predictions.where("second(timestamp) % 4 = 0").withColumns({"prob_down": F.col("prob_up"), "prob_up": F.col("prob_down")}))
    rule, strict = SignalRule(0.55, 0.05, 0.5), SignalRule(1.0, 1.0, 0.0)
    config = backtest.BacktestConfig
    for own, some in ((config(rule, 27, 0.3, 0.2), predictions), (config(rule, 18, 0.1, 0.1, True, "test"), predictions), (config(strict, 27), predictions), (config(rule, 27), predictions.where("prob_up < 0"))):
        want, got = backtest.summarize(backtest.run_backtest(some, market, own)), backtest.report(some, market, own)
        assert got.dtypes == want.dtypes
        want, got = want.head().asDict(), got.head().asDict()
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert backtest.report(predictions, market, config(rule, 27)).head()["number_of_trades"] > 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priced = backtest.attach_prices(predictions, market, 27)
        plan = priced._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(exit_timestamp" not in plan and "hashpartitioning(timestamp" in plan
    by_column = backtest.attach_prices(predictions.withColumn("h", F.lit(27)), market, "h").drop("h")
    assert priced.columns == by_column.columns
    assert priced.count() == by_column.count() > 500 and priced.exceptAll(by_column).count() == 0


def test_events_are_numbered_and_priced_together(spark):
    """One reading for the buckets' totals and one for what is within."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    numbered = fixtures.numbered(events)
    assert numbered._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    price, wanted = 600_000, []
    for i, r in enumerate(events.orderBy("ts", "event_id").collect()):
        price += int(math.fmod(math.floor(r["value"] * 100 + 0.5), 21)) - 10
        wanted.append((r["event_id"], r["user_id"], i, price))
    assert [tuple(r) for r in numbered.select("event_id", "user_id", "rn", "mid_t").orderBy("rn").collect()] == wanted
