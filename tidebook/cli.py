"""Commands over Parquet tables: ``python -m tidebook.cli COMMAND --help``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from tidebook import config, naming, reports, storage
from tidebook.functions.labels import SignalRule
from tidebook.operators import backtest, boosting, cleaning, evaluation, experiment, features, models, sessions, targets
from tidebook.session import get_session
from tidebook.sources import discovery, tables, versions, websocket
from tidebook.streaming import collector


def _input(spark, a, kind: str) -> str:
    """The path given, else the file of the dataset, the date, or the newest."""
    return discovery.resolve(spark, a.folder, a.symbol, kind, a.input, a.dataset_name, a.date)


def _newest(spark, a) -> str:
    """The path given, else the newest table of the folder."""
    if not (a.input or a.folder):
        raise ValueError("an input takes a path or a folder")
    return a.input or tables.newest(spark, a.folder)


def _rows(spark, path: str):
    """A table of versions, as ``collect`` writes it, or plain Parquet."""
    collected = versions.read(spark, path)
    return tables.read_parquet(spark, path) if collected is None else collected.drop("dt", "v")


def _validate(spark, a, settings):
    print(reports.verdict(cleaning.validate(_rows(spark, _newest(spark, a)), a.levels)))


def _merge(spark, a, settings):
    files = a.inputs or tables.daily_files(spark, a.folder, a.symbol, a.last, a.by)
    merged = cleaning.merge([tables.read_ordered(spark, f) for f in files], ["raw_order"]).drop("raw_order")
    tables.write_parquet(merged, a.output)


def _clean(spark, a, settings):
    rows, chosen = tables.read_ordered(spark, _newest(spark, a)), config.cleaning(settings)
    tables.write_parquet(cleaning.clean(rows, chosen, a.levels).drop("raw_order"), a.output, a.mode)
    print(reports.facts("Cleaning", cleaning.clean_counts(rows, chosen, a.levels)))


def _inspect(spark, a, settings):
    rows = _rows(spark, _newest(spark, a))
    print(reports.facts("Inspection", cleaning.inspect(rows)))
    if a.plots:
        for y in ("mid_price", "spread"):
            tables.write_text(spark, reports.line_svg(cleaning.plot_rows(rows), y, y), f"{a.plots}/{y}.svg")


def _features(spark, a, settings):
    rows = tables.read_parquet(spark, _newest(spark, a))
    tables.write_parquet(features.build_features(rows, a.levels).drop("segment"), a.output, a.mode)
    print(reports.facts("Gaps", sessions.gap_diagnostics(rows)))


def _targets(spark, a, settings):
    chosen = config.target(settings)
    given = {"horizon_seconds": a.horizon_seconds, "mode": a.target_mode, "threshold_abs": a.threshold_abs, "cost_threshold_bps": a.cost_threshold_bps, "cost_buffer_bps": a.cost_buffer_bps, "tolerance_seconds": a.tolerance_seconds}
    chosen = replace(chosen, **{k: v for k, v in given.items() if v is not None})
    path = _input(spark, a, "features")
    rows = tables.read_parquet(spark, path)
    if a.diagnostics:
        future = targets.attach_future(rows, chosen.horizon_seconds, chosen.tolerance_seconds)
        shown = targets.threshold_diagnostics(future, config.threshold_candidates(settings)).orderBy("threshold_abs") if a.diagnostics == "absolute" else targets.cost_aware_diagnostics(future, horizon_seconds=chosen.horizon_seconds).orderBy("cost_threshold_bps", "cost_buffer_bps")
        print(reports.table("Thresholds", shown))
        print(reports.facts("Future return, bps", targets.describe(future, "future_return_bps")))
        return
    if a.output is None:  # beside its input, named by the settings
        name, threshold = discovery.name_of(path), chosen.threshold_abs if chosen.mode == "absolute" else chosen.cost_threshold_bps + chosen.cost_buffer_bps
        token = name.split("_features_", 1)[-1].removesuffix(".parquet")
        a.output = f"{path.rstrip('/').rpartition('/')[0] or '.'}/{naming.dataset_name(a.symbol, token, naming.target_name(chosen.mode, chosen.horizon_seconds, threshold, a.suffix or ''))}"
    tables.write_parquet(targets.build_targets(rows, chosen), a.output, a.mode)
    print(reports.facts("Targets", targets.target_distribution(tables.read_parquet(spark, a.output))))


def _train(spark, a, settings):
    rows, report = models.prepare(tables.read_parquet(spark, _input(spark, a, "model_dataset")))
    rows = rows.persist()
    model = models.train_boosted(rows, report.selected, boosting.Growth(rounds=a.rounds)) if a.model == "boosted" else models.train_logistic(rows, report.selected)
    tables.write_parquet(models.predict(model, rows), a.output, a.mode)
    if a.save:
        models.save(model, a.save, spark)
    stem = a.output.rstrip("/").removesuffix(discovery.PREDICTIONS)
    predictions = tables.read_parquet(spark, a.output)
    tables.write_json(spark, evaluation.training_record(rows, report, predictions), f"{stem}{discovery.METRICS}")
    if a.model == "boosted":
        importance = spark.createDataFrame(model.importance(), "feature string, importance_split long, importance_gain double")
        tables.write_csv(importance.coalesce(1), f"{stem}{discovery.IMPORTANCE}", a.mode)


def _evaluate(spark, a, settings):
    importance = a.importance
    if not (a.first and a.second):
        if a.first or a.second:
            raise ValueError("give both prediction tables, or a folder")
        token, found = discovery.model_artifacts(spark, a.folder, a.symbol)
        a.first, a.second = found["logistic"]["predictions"], found["boosted"]["predictions"]
        importance = importance or found["boosted"].get("importance")
        print(f"models of {token}")
    first, second = (tables.read_parquet(spark, p) for p in (a.first, a.second))
    print(reports.table("Metrics", evaluation.compare_metrics(first, second).orderBy("split")))
    print(reports.table("Agreement", evaluation.model_agreement(first, second).orderBy("split")))
    print(reports.table("Confusion, first", evaluation.confusion_matrix(first, ["split"]).orderBy("split", "y_true")))
    print(reports.table("Confusion, second", evaluation.confusion_matrix(second, ["split"]).orderBy("split", "y_true")))
    if importance:
        print(reports.table("Importance", tables.read_importance(spark, importance)))


def _rule(a, base: SignalRule) -> SignalRule:
    given = {k: getattr(a, k) for k in ("signal_threshold", "direction_margin", "neutral_max_probability")}
    return replace(base, **{k: v for k, v in given.items() if v is not None})


def _predicted(spark, a):
    """Predictions, by default the newest, and their market, by default the
    dataset that their name tells of."""
    path = a.input or discovery.newest_predictions(spark, a.folder)
    folder = a.folder or path.rstrip("/").rpartition("/")[0] or "."
    market = a.market or discovery.dataset_of(spark, path, folder)
    stem = f"{folder}/{discovery.name_of(path).removesuffix(discovery.PREDICTIONS)}"
    return tables.read_parquet(spark, path), backtest.prepare_market(tables.read_parquet(spark, market)), stem


def _backtest(spark, a, settings):
    chosen = config.backtest(settings)
    given = {k: getattr(a, k) for k in ("horizon_seconds", "fee_bps", "slippage_bps", "split")}
    chosen = replace(chosen, rule=_rule(a, chosen.rule), **{k: v for k, v in given.items() if v is not None})
    predictions, market, stem = _predicted(spark, a)
    rows = backtest.run_backtest(predictions, market, chosen)
    if a.output is None:  # beside the predictions, named by the settings
        rule = chosen.rule
        folder, _, name = stem.rpartition("/")
        a.output = f"{folder}/{naming.backtest_name(name, chosen.split, naming.signal_name(rule.signal_threshold, rule.direction_margin, rule.neutral_max_probability), chosen.cost_mode)}.parquet"
    tables.write_parquet(rows, a.output, a.mode)
    rows = tables.read_parquet(spark, a.output)
    print(reports.facts("Backtest", backtest.summarize(rows)))
    if a.plots:
        tables.write_text(spark, reports.line_svg(rows, "equity_curve_bps", "equity, bps"), f"{a.plots}/equity_curve_bps.svg")


def _sweep(spark, a, settings):
    predictions, market, stem = _predicted(spark, a)
    split = a.split or "validation"
    a.output = a.output or f"{stem}_{split}_threshold_sweep.csv"
    swept = backtest.sweep(predictions, market, split, a.horizon_seconds or 5)
    tables.write_csv(backtest.ranked(swept).coalesce(1), a.output, a.mode)
    print(reports.table("Best settings", backtest.top(swept)))


def _experiment(spark, a, settings):
    growth = boosting.Growth(rounds=a.rounds)
    summary = experiment.run_horizons(tables.read_parquet(spark, _input(spark, a, "features")), tuple(a.horizons), a.threshold_abs or 0.5, a.split or "validation", _rule(a, SignalRule()), growth=growth).persist()
    tables.write_csv(summary.coalesce(1), a.output, a.mode)
    for name, row in experiment.rankings(summary).items():
        print(reports.facts(name, row.select("horizon_seconds", "cost_mode", "number_of_trades", "average_net_return_bps", "average_gross_return_bps")))
    if not experiment.any_profitable(summary).head()["profitable"]:
        print("no horizon earns more than its average cost")


def _collect(spark, a, settings):
    messages = collector.read_folder(spark, a.input, clean=a.clean)
    collector.wait(*collector.collect(messages, a.output, a.checkpoint, a.symbol, levels=a.levels, carry_seconds=a.carry_seconds, once=a.once, limit_samples=a.limit_samples, live=a.live))


def _record(spark, a, settings):
    base = a.base or config.websocket_url(settings)
    websocket.record(websocket.listen(websocket.address(base, a.symbol, a.levels)), a.output)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidebook")
    commands = out.add_subparsers(required=True)

    def command(name, run, *options, output: bool = True, source: bool = True, found: bool = False):
        p = commands.add_parser(name)
        p.set_defaults(run=run, command=name)
        p.add_argument("--config")
        p.add_argument("--levels", type=int)
        if source:
            p.add_argument("--input", required=not found)
        if found:  # inputs found in a folder by their names
            p.add_argument("--folder")
            p.add_argument("--symbol")
            p.add_argument("--dataset-name")
            p.add_argument("--date")
        if output:
            p.add_argument("--output", required=name not in ("targets", "backtest", "sweep"))
            p.add_argument("--mode", default="errorifexists")
        for o, kind in options:
            p.add_argument(f"--{o.replace('_', '-')}", type=kind, default=None)
        return p

    rule = [("signal_threshold", float), ("direction_margin", float), ("neutral_max_probability", float)]
    command("validate", _validate, output=False, found=True)
    p = command("merge", _merge, ("folder", str), ("symbol", str), source=False)
    p.add_argument("--inputs", nargs="*")
    p.add_argument("--last", type=int, default=7)
    p.add_argument("--by", choices=["date", "time"], default="date")
    command("clean", _clean, found=True)
    command("inspect", _inspect, ("plots", str), output=False, found=True)
    command("features", _features, found=True)
    p = command("targets", _targets, ("horizon_seconds", int), ("target_mode", str), ("threshold_abs", float), ("cost_threshold_bps", float), ("cost_buffer_bps", float), ("tolerance_seconds", float), ("suffix", str), found=True)
    p.add_argument("--diagnostics", choices=["absolute", "cost_aware"])
    p = command("train", _train, ("save", str), found=True)
    p.add_argument("--rounds", type=int, default=300)
    p.add_argument("--model", choices=["logistic", "boosted"], default="logistic")
    command("evaluate", _evaluate, ("first", str), ("second", str), ("importance", str), output=False, source=False, found=True)
    command("backtest", _backtest, ("market", str), ("horizon_seconds", int), ("fee_bps", float), ("slippage_bps", float), ("split", str), ("plots", str), *rule, found=True)
    command("sweep", _sweep, ("market", str), ("horizon_seconds", int), ("split", str), found=True)
    p = command("experiment", _experiment, ("threshold_abs", float), ("split", str), *rule, found=True)
    p.add_argument("--rounds", type=int, default=300)
    p.add_argument("--horizons", type=int, nargs="*", default=list(experiment.HORIZONS))
    p = command("collect", _collect, ("checkpoint", str), ("symbol", str))
    p.add_argument("--carry-seconds", type=int)
    p.add_argument("--limit-samples", type=int)
    p.add_argument("--once", action="store_true")
    p.add_argument("--live", action="store_true", help="fill a silence while it lasts")
    p.add_argument("--clean", action="store_true", help="remove segments that are saved")
    p = command("record", _record, ("symbol", str), ("base", str), source=False)
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = get_session("tidebook")
    settings = config.read_yaml(a.config)
    # What isn't given comes from the settings.
    a.levels = config.levels(settings) if a.levels is None else a.levels
    if "symbol" in a and a.symbol is None and a.command != "collect":  # a stream may have several
        a.symbol = config.symbol(settings)
    if "folder" in a and a.folder is None and not getattr(a, "input", None):
        a.folder = config.folder(settings, a.command)
    a.run(spark, a, settings)


if __name__ == "__main__":
    try:
        main()
    finally:
        storage.clear(get_session("tidebook"))
