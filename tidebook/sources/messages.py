"""Depth messages (JSON) to raw snapshot rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.sessions import infer_sessions
from tidebook.schema import LEVELS, METADATA, coerce, level_columns, raw_schema

_BODY = "E bigint, s string, reconnected boolean, b array<array<string>>, bids array<array<string>>, a array<array<string>>, asks array<array<string>>"
_FIELDS = [field.split(" ", 1) for field in _BODY.split(", ")]
#: A payload wrapped in ``data``, or bare.
_EITHER = "data struct<" + ", ".join(f"{name}: {kind}" for name, kind in _FIELDS) + f">, {_BODY}"


def levels_of(pairs: Column, levels: int = LEVELS) -> Column:
    """The (price, size) pairs of a side, read as doubles as a whole; null for a
    short side or one with a pair that cannot be read."""
    good = F.forall(pairs, lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return F.when(good & (F.size(pairs) >= levels), pairs)


def parse_messages(df: DataFrame, value: str = "value", time: str = "timestamp", exchange: str = "simulated", symbol: str | None = None, levels: int = LEVELS, strict: bool = False, markers: bool = False) -> DataFrame:
    """Raw snapshot columns (without session) of rows with a JSON text and a
    time.  Messages without an event time or with a bad side go; with ``strict``
    they raise.  Empty lists count as absent.  With ``markers``, a column
    ``reconnected`` is true in rows that only say that the connection was made
    anew; they have no levels."""
    pick = lambda a, b: F.when(F.size(F.col(f"message.{a}")) > 0, F.col(f"message.{a}")).otherwise(F.col(f"message.{b}")).try_cast("array<array<double>>")
    # Each explode of a one-element array keeps what is above it from being
    # copied into every column and filter that uses it: a text is read once, and
    # so is each of its numbers.
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    rows = df.select(F.col(time).alias("received"), once(F.from_json(value, _EITHER), "read"))
    rows = rows.select("received", once(F.coalesce("read.data", F.struct(*(F.col(f"read.{name}").alias(name) for name, _ in _FIELDS))), "message"))
    parsed = F.struct(
        F.timestamp_millis("message.E").alias("event_time"),
        F.coalesce("message.reconnected", F.lit(False)).alias("reconnected"),
        F.upper(F.coalesce(F.lit(symbol), F.col("message.s"))).alias("symbol"),
        pick("b", "bids").alias("bid"),
        pick("a", "asks").alias("ask"),
    )
    rows = rows.select("received", once(parsed, "m"))
    checked = F.struct("m.event_time", "m.reconnected", "m.symbol", *(levels_of(F.col(f"m.{side}"), levels).alias(side) for side in ("bid", "ask")))
    rows = rows.select("received", once(checked, "m")).select(F.date_trunc("second", "received").alias("timestamp"), "m.*")
    good = F.col("event_time").isNotNull() & F.col("bid").isNotNull() & F.col("ask").isNotNull()
    if markers:
        good = good | F.col("reconnected")
    if strict:
        rows = rows.withColumn("event_time", F.when(good, F.col("event_time")).otherwise(F.raise_error(F.lit("a depth message lacks its event time or levels")).cast("timestamp")))
    else:
        rows = rows.where(good)
    book = [F.col(side)[i][k].alias(f"{side}_{kind}_{i + 1}") for side in ("bid", "ask") for k, kind in enumerate(("price", "size")) for i in range(levels)]
    marker = ["reconnected"] if markers else []
    return rows.select("timestamp", "event_time", F.lit(exchange).alias("exchange"), "symbol", *book, *marker)


def normalise_schema(df: DataFrame, levels: int = LEVELS, order: list[str] | None = None) -> DataFrame:
    """The fixed raw schema: absent columns null, others dropped, bad values
    null, and null sessions filled by gaps."""
    kinds = {f.name: f.dataType for f in raw_schema(levels)}
    given = df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})
    given = coerce(given, levels).withColumn("session_id", F.col("session_id").try_cast("long"))
    # A session must not be inferred where all are given, but the plan is one.
    return infer_sessions(given, order=order).select(*METADATA, *level_columns(levels))
