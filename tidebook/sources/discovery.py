"""Inputs found by their names: which file a command reads, and which belong
together.

Names are ``<SYMBOL>_<kind>_<token><ending>``, as :mod:`tidebook.naming` makes
them; a token is a date or the name of a dataset.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .tables import list_files, newest

PREDICTIONS, METRICS, IMPORTANCE = "_predictions.parquet", "_metrics.json", "_importance.csv"


def name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def tokens(spark: SparkSession, folder: str, symbol: str, kind: str, ending: str = ".parquet") -> dict[str, str]:
    """Token and path of the files of one kind in ``folder``."""
    head = f"{symbol.upper()}_{kind}_"
    found = {name_of(p): p for p, _ in list_files(spark, folder)}
    return {n.removeprefix(head).removesuffix(ending): p for n, p in found.items() if n.startswith(head) and n.endswith(ending)}


def resolve(spark: SparkSession, folder: str | None, symbol: str, kind: str, path: str | None = None, dataset: str | None = None, date: str | None = None) -> str:
    """What a command reads: ``path`` before the file of ``dataset`` before that
    of ``date`` before the newest file of the kind in ``folder``."""
    if path:
        return path
    if not folder:
        raise ValueError("an input takes a path or a folder")
    wanted = dataset or date
    if not wanted:
        known = set(map(name_of, tokens(spark, folder, symbol, kind).values()))
        return newest(spark, folder, only=lambda n: n in known and not n.endswith(PREDICTIONS))
    found = tokens(spark, folder, symbol, kind)
    if wanted not in found:
        raise FileNotFoundError(f"no {kind} of {symbol} named {wanted} in {folder}")
    return found[wanted]


def newest_predictions(spark: SparkSession, folder: str) -> str:
    return newest(spark, folder, PREDICTIONS)


def dataset_of(spark: SparkSession, predictions: str, folder: str) -> str:
    """The model dataset of a predictions file: of the dataset tokens with which
    the file's name ends, the longest."""
    name = name_of(predictions)
    if not name.endswith(PREDICTIONS):
        raise ValueError(f"{name} doesn't end with {PREDICTIONS}")
    stem = name.removesuffix(PREDICTIONS)
    found = tokens(spark, folder, stem.split("_", 1)[0], "model_dataset")
    own = [t for t in found if stem.endswith(f"_{t}")]
    if not own:
        raise FileNotFoundError(f"no model dataset of {name} in {folder}")
    return found[max(own, key=len)]


def model_artifacts(spark: SparkSession, folder: str, symbol: str, models: tuple[str, ...] = ("logistic", "boosted")) -> tuple[str, dict[str, dict[str, str]]]:
    """The last token for which every model has metrics and predictions, and
    their paths by model (and that of its importances, where there is one)."""
    held = {m: {what: tokens(spark, folder, symbol, m, ending) for what, ending in (("metrics", METRICS), ("predictions", PREDICTIONS), ("importance", IMPORTANCE))} for m in models}
    common = set.intersection(*(set(held[m][what]) for m in models for what in ("metrics", "predictions")))
    if not common:
        raise FileNotFoundError(f"no token in {folder} has metrics and predictions of {', '.join(models)}")
    token = max(common)
    return token, {m: {what: found[token] for what, found in held[m].items() if token in found} for m in models}
