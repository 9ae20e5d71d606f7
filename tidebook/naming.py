"""Names of datasets by their settings."""

from __future__ import annotations

import re


def number_token(value: float) -> str:
    """A number as part of a name: 0.5 is ``0p5``, -1 is ``m1``."""
    shown = f"{value:.6f}".rstrip("0").rstrip(".") if value else "0"
    return shown.translate(str.maketrans({"-": "m", ".": "p"}))


def clean(text: str) -> str:
    """Only letters, digits, dash and underscore."""
    return re.sub(r"[^A-Za-z0-9_-]+", "_", text).strip("_")


def target_name(mode: str, horizon_seconds: int, threshold: float, suffix: str = "") -> str:
    """``h5_th0p5`` for an absolute threshold, ``h5_costaware_5bps`` for one in
    basis points."""
    kind = f"th{number_token(threshold)}" if mode == "absolute" else f"costaware_{number_token(threshold)}bps"
    return "_".join(x for x in (f"h{horizon_seconds}", kind, clean(suffix.strip())) if x)


def dataset_name(symbol: str, token: str, target: str) -> str:
    return f"{symbol.upper()}_model_dataset_{token}_{target}.parquet"


def signal_name(threshold: float, margin: float, neutral: float) -> str:
    """``threshold075_margin000_neutral030``: hundredths, three digits."""
    part = lambda v: f"{round(v * 100):03d}"
    return f"threshold{part(threshold)}_margin{part(margin)}_neutral{part(neutral)}"


def backtest_name(model: str, split: str, signals: str, cost_mode: str) -> str:
    return f"backtest_{clean(model)}_{clean(split)}_{signals}_{cost_mode}"
