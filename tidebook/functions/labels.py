"""Labels, signals and costs as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def three_way(value: Column, threshold: Column | float) -> Column:
    """1 above the threshold, -1 below its negative, else 0; null stays null."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(value > limit, 1).when(value < -limit, -1).when(value.isNotNull(), 0).cast("tinyint")


@dataclass(frozen=True)
class SignalRule:
    """When a predicted direction is traded."""

    signal_threshold: float = 0.75
    direction_margin: float = 0.0
    neutral_max_probability: float = 0.30

    def __post_init__(self):
        if not 0 <= self.signal_threshold <= 1 or not 0 <= self.neutral_max_probability <= 1:
            raise ValueError("probability limits lie between 0 and 1")
        if self.direction_margin < 0:
            raise ValueError("direction_margin is not negative")

    def columns(self) -> tuple[Column, Column, Column]:
        return F.lit(self.signal_threshold), F.lit(self.direction_margin), F.lit(self.neutral_max_probability)


def signal(threshold: Column, margin: Column, neutral: Column) -> Column:
    """-1, 0 or 1; all limits count inclusively and a short wins a double match."""

    def side(own: str, other: str) -> Column:
        return (F.col(own) >= threshold) & (F.col(own) - F.col(other) >= margin) & (F.col("prob_neutral") <= neutral)

    return F.when(side("prob_down", "prob_up"), -1).when(side("prob_up", "prob_down"), 1).otherwise(0)


def gross_return_bps(direction: Column, entry: Column, exit_: Column) -> Column:
    return direction * (F.try_divide(exit_, entry) - 1) * 10_000


def cost_mode(fee_bps: float, slippage_bps: float) -> str:
    return "zero_cost" if fee_bps == 0 and slippage_bps == 0 else "cost_adjusted"
