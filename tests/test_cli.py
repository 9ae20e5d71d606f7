"""The commands end to end on the smallest tables, and names and settings."""

import pytest
from pyspark.sql import functions as F

from tidebook import cli, config, naming, reports
from tidebook.operators import models
from tidebook.plans import fixtures

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert naming.target_name("absolute", 5, 0.5) == "h5_th0p5"
    assert naming.target_name("cost_aware", 10, 5.0, " a b ") == "h10_costaware_5bps_a_b"
    assert naming.signal_name(0.75, 0.0, 0.3) == "threshold075_margin000_neutral030"
    assert naming.number_token(-1.25) == "m1p25"


def test_settings(tmp_path):
    assert config.read_yaml(tmp_path / "none") == {}
    settings = {"target": {"target_mode": "cost_aware", "horizon_seconds": 30}, "backtest": {"fee_bps": 2, "signal_threshold": 0.6}, "cleaning": {"max_allowed_spread": 2.0}}
    assert config.target(settings).mode == "cost_aware"
    assert (config.backtest(settings).fee_bps, config.backtest(settings).rule.signal_threshold) == (2, 0.6)
    assert config.cleaning(settings).max_allowed_spread == 2.0
    common = {"project": {"symbol": "AAA"}, "exchange": {"depth_levels": 10}, "data": {"raw_orderbook_dir": "raw"}, "target": {"threshold_candidates": [0.1, 1]}}
    assert (config.symbol(common), config.levels(common), config.folder(common, "clean"), config.folder(common, "sweep")) == ("AAA", 10, "raw", None)
    assert config.threshold_candidates(common) == (0.1, 1.0) and config.levels({"features": {"levels": 5}}) == 5 and config.levels({}) == 20
    with pytest.raises(ValueError):
        config.cleaning({"cleaning": {"spread_outlier_method": "clip"}})


def test_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    fixtures.dirty(spark, SMALL).drop("raw_order", "rn", "event_id", "ts_sec").write.parquet(at("raw"))
    run = lambda *a: cli.main([str(x) for x in a])
    run("validate", "--input", at("raw"))
    assert "NO PASS" in capsys.readouterr().out
    run("merge", "--inputs", at("raw"), "--output", at("merged"))
    run("clean", "--input", at("raw"), "--output", at("clean"))
    run("inspect", "--input", at("clean"), "--plots", at("plots"))
    assert (tmp_path / "plots" / "spread.svg").read_text().startswith("<svg")
    run("features", "--input", at("clean"), "--output", at("AAA_features_day.parquet"))
    found = ("--folder", tmp_path, "--symbol", "AAA")
    run("targets", *found, "--dataset-name", "day")
    assert (tmp_path / "AAA_model_dataset_day_h5_th0p5.parquet").exists()
    run("targets", *found, "--diagnostics", "absolute")
    run("targets", *found, "--diagnostics", "cost_aware")
    run("train", *found, "--output", at("AAA_logistic_day_h5_th0p5_predictions.parquet"), "--save", at("logistic"))
    run("train", *found, "--model", "boosted", "--rounds", 2, "--output", at("AAA_boosted_day_h5_th0p5_predictions.parquet"), "--save", at("boosted"))
    run("evaluate", *found)
    out = capsys.readouterr().out
    assert "models of day_h5_th0p5" in out and "agreement_rate" in out and "importance_gain" in out
    first = at("AAA_logistic_day_h5_th0p5_predictions.parquet")
    run("backtest", "--input", first, "--output", at("backtest"), "--plots", at("plots"), "--signal-threshold", "0.4", "--neutral-max-probability", "0.9")
    run("backtest", *found, "--signal-threshold", "0.4")
    named = [p.name for p in tmp_path.iterdir() if p.name.startswith("backtest_AAA")]
    assert len(named) == 1 and named[0].endswith("_all_threshold040_margin000_neutral030_cost_adjusted.parquet")
    (tmp_path / "settings.yaml").write_text(f"project:\n  symbol: AAA\ndata:\n  raw_orderbook_dir: {tmp_path / 'rawdir'}\ntarget:\n  threshold_candidates: [0.2]\n")
    fixtures.dirty(spark, SMALL).drop("raw_order", "rn", "event_id", "ts_sec").write.parquet(at("rawdir/a.parquet"))
    capsys.readouterr()
    run("validate", "--config", at("settings.yaml"))
    assert "NO PASS" in capsys.readouterr().out
    run("targets", "--config", at("settings.yaml"), "--folder", tmp_path, "--dataset-name", "day", "--diagnostics", "absolute")
    out = capsys.readouterr().out
    assert "0.2" in out and "0.7" not in out.split("Thresholds")[1].split("Future")[0]
    run("sweep", *found, "--output", at("sweep"), "--split", "all")
    assert "number_of_trades" in capsys.readouterr().out
    assert (tmp_path / "plots" / "equity_curve_bps.svg").exists()
    rows, report = models.prepare(spark.read.parquet(at("AAA_model_dataset_day_h5_th0p5.parquet")))
    for name in ("logistic", "boosted"):
        wanted = spark.read.parquet(at(f"AAA_{name}_day_h5_th0p5_predictions.parquet"))
        assert models.predict(models.load(at(name), spark), rows).exceptAll(wanted).count() == 0


def test_lines_are_drawn_from_bounded_rows(spark):
    rows = spark.range(5000).select(F.timestamp_seconds("id").alias("timestamp"), F.when(F.col("id") % 7 != 0, F.sin(F.col("id") / 100)).alias("v"))
    drawn = reports.line_svg(rows, "v", "a < b", stretches=50)
    points = drawn.split('points="')[1].split('"')[0].split()
    assert "a &lt; b" in drawn and 90 <= len(points) <= 102
    assert 'points=""' in reports.line_svg(rows.limit(0), "v", "none")
