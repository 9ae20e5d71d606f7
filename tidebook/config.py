"""Settings from a YAML file, checked by the dataclasses they fill."""

from __future__ import annotations

from dataclasses import fields
from pathlib import Path

from tidebook.functions.labels import SignalRule
from tidebook.operators.backtest import BacktestConfig
from tidebook.operators.cleaning import CleaningConfig
from tidebook.operators.targets import ABSOLUTE_THRESHOLDS, TargetConfig
from tidebook.schema import LEVELS


def read_yaml(path: str | Path | None) -> dict:
    """An absent file is an empty one."""
    if path is None or not Path(path).exists():
        return {}
    import yaml  # asked for only where a file is given

    return yaml.safe_load(Path(path).read_text()) or {}


def _known(kind, given: dict | None, **renamed: str) -> dict:
    given = {renamed.get(k, k): v for k, v in (given or {}).items()}
    return {f.name: given[f.name] for f in fields(kind) if f.name in given}


def cleaning(settings: dict) -> CleaningConfig:
    given = settings.get("cleaning") or {}
    if given.get("spread_outlier_method", "remove") != "remove":
        raise ValueError("spread_outlier_method can only be 'remove'")
    return CleaningConfig(**_known(CleaningConfig, given))


def target(settings: dict) -> TargetConfig:
    return TargetConfig(**_known(TargetConfig, settings.get("target"), target_mode="mode", timestamp_tolerance_seconds="tolerance_seconds"))


def backtest(settings: dict) -> BacktestConfig:
    given = settings.get("backtest") or {}
    return BacktestConfig(rule=SignalRule(**_known(SignalRule, given)), **_known(BacktestConfig, {k: v for k, v in given.items() if k != "rule"}))


#: Where the rows of a command are, by section and name of the setting.
FOLDERS = {"validate": "raw_orderbook_dir", "clean": "raw_orderbook_dir", "inspect": "cleaned_orderbook_dir", "features": "cleaned_orderbook_dir", "targets": "ready_for_features_dir", "experiment": "ready_for_features_dir"}


def symbol(settings: dict) -> str:
    return str((settings.get("project") or {}).get("symbol", "BTCUSDT"))


def levels(settings: dict) -> int:
    """Book levels: of the features, else of the exchange's depth."""
    own = (settings.get("features") or {}).get("levels")
    return int(own if own is not None else (settings.get("exchange") or {}).get("depth_levels", LEVELS))


def folder(settings: dict, command: str) -> str | None:
    return (settings.get("data") or {}).get(FOLDERS.get(command, ""))


def threshold_candidates(settings: dict) -> tuple[float, ...]:
    given = (settings.get("target") or {}).get("threshold_candidates")
    return tuple(map(float, given)) if given else ABSOLUTE_THRESHOLDS


def websocket_url(settings: dict) -> str | None:
    return (settings.get("exchange") or {}).get("websocket_url")
