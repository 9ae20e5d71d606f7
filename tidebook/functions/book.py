"""Instantaneous order-book quantities as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.schema import LEVELS

#: How many levels each depth sums.
DEPTHS = (1, 5, 10, 20)


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the denominator is zero or null."""
    return F.try_divide(a, b)


def mid_price() -> Column:
    return (F.col("bid_price_1") + F.col("ask_price_1")) / 2


def spread() -> Column:
    return F.col("ask_price_1") - F.col("bid_price_1")


def relative_spread() -> Column:
    return safe_divide(spread(), mid_price())


def spread_bps() -> Column:
    return relative_spread() * 10_000


def depth(side: str, k: int) -> Column:
    return reduce(add, (F.col(f"{side}_size_{i}") for i in range(1, k + 1)))


def balance(bid: Column, ask: Column) -> Column:
    return safe_divide(bid - ask, bid + ask)


def imbalance(k: int) -> Column:
    return balance(depth("bid", k), depth("ask", k))


def weighted_depth(side: str, levels: int = LEVELS) -> Column:
    """Sizes by the reciprocal of their level."""
    return reduce(add, (F.col(f"{side}_size_{i}") / i for i in range(1, levels + 1)))


def weighted_imbalance(levels: int = LEVELS) -> Column:
    return balance(weighted_depth("bid", levels), weighted_depth("ask", levels))


def microprice() -> Column:
    """Best prices, each weighted by the other side's size."""
    bid, ask = F.col("bid_size_1"), F.col("ask_size_1")
    return safe_divide(F.col("ask_price_1") * bid + F.col("bid_price_1") * ask, bid + ask)


def instantaneous(levels: int = LEVELS) -> dict[str, Column]:
    """All quantities of one row, by name; depths beyond ``levels`` are left out."""
    out = {"mid_price": mid_price(), "spread": spread(), "relative_spread": relative_spread()}
    for k in (k for k in DEPTHS if k <= levels):
        out |= {f"bid_depth_{k}": depth("bid", k), f"ask_depth_{k}": depth("ask", k), f"imbalance_{k}": imbalance(k)}
    out |= {f"weighted_{side}_depth": weighted_depth(side, levels) for side in ("bid", "ask")}
    out["weighted_imbalance"] = weighted_imbalance(levels)
    return out | {"microprice": microprice(), "microprice_minus_mid": microprice() - mid_price()}
