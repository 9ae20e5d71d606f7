"""One row a second from a stream of messages, with sessions, as keyed state.

State, by symbol: the last message, the last second with a row, its session, and
where the last sessions began.  It lives in the stream's checkpoint, so a batch
reads nothing that was saved before.  Rows of a batch are handled together, not
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.schema import METADATA, level_columns
from tidebook.storage import ship

#: Beginnings of sessions that are remembered, for rows that come late.
REMEMBERED = 64
SEEDS = "symbol string, session long, second long"


class Sampler(StatefulProcessor):
    """Emits a symbol's sampled rows.

    Of the messages of a second the one of the latest event counts.  A message
    for the last second replaces its row; one for an earlier second (late) gets
    the session of that second.  A silence of two seconds or more repeats the last
    message, unless a reconnect came in between or the silence is longer than
    ``carry_seconds``.  A gap of more than ``max_gap_seconds`` between rows begins
    a session.
    """

    def __init__(self, levels: int, carry_seconds: int | None, max_gap_seconds: float, live: bool):
        self.columns = [*(c for c in METADATA if c not in ("session_id", "timestamp", "symbol")), *level_columns(levels)]
        self.carry, self.gap, self.live = carry_seconds, max_gap_seconds, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ["event_time timestamp" if c == "event_time" else f"{c} string" if c == "exchange" else f"{c} double" for c in self.columns]
        self.place = handle.getValueState("place", "second long, session long, held boolean, seconds array<long>, sessions array<long>")
        self.message = handle.getValueState("message", ", ".join(kinds))

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        second, session = int(row["second"]), int(row["session"])
        self.place.update((second, session, False, [second], [session]))

    def _carried(self, ahead: np.ndarray) -> np.ndarray:
        """How often a row is repeated before the next, ``ahead`` seconds on."""
        return np.where((ahead >= 2) & (ahead <= self.carry if self.carry is not None else True), ahead - 1, 0)

    def _emitted(self, key, rows: pd.DataFrame, second: np.ndarray, session: np.ndarray) -> pd.DataFrame:
        out = rows[self.columns].reset_index(drop=True)
        out.insert(0, "timestamp", pd.to_datetime(second, unit="s"))
        out.insert(1, "symbol", key[0])
        out.insert(2, "session_id", session)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        given["second"] = given["timestamp"].to_numpy().astype("datetime64[s]").astype(np.int64)
        marks = np.sort(given.loc[given["reconnected"], "second"].to_numpy())
        given = given[~given["reconnected"]].sort_values(["second", "event_time"], kind="stable").drop_duplicates("second", keep="last")
        place, held = self.place.get() if self.place.exists() else None, None
        if place is not None:
            last, session, holding, starts, numbers = place[0], place[1], place[2], list(place[3]), list(place[4])
            if holding:
                held = pd.DataFrame([self.message.get()], columns=self.columns)
        else:
            last, session, starts, numbers = None, 1, [], []
        late = given[given["second"] <= last] if last is not None else given.iloc[:0]
        fresh = given[given["second"] > last] if last is not None else given
        if len(late):
            at = np.maximum(np.searchsorted(starts, late["second"].to_numpy(), "right") - 1, 0)
            newer = late[late["second"] == last]
            if len(newer) and (held is None or newer["event_time"].iloc[0] >= held["event_time"].iloc[0]):
                held = newer[self.columns]
            yield self._emitted(key, late, late["second"].to_numpy(), np.array(numbers)[at])
        if len(fresh):
            own = fresh["second"].to_numpy()
            whole = fresh[self.columns] if held is None else pd.concat([held, fresh[self.columns]], ignore_index=True)
            at = own if held is None else np.append(last, own)
            # Repeats of each row before the next; none across a reconnect.
            repeats = np.append(self._carried(np.diff(at)), 0)
            cut = np.searchsorted(marks, at[1:], "right") > np.searchsorted(marks, at[:-1], "right")
            repeats[:-1][cut] = 0
            index = np.repeat(np.arange(len(at)), repeats + 1)
            second = at[index] + np.arange(len(index)) - np.repeat(np.cumsum(repeats + 1) - repeats - 1, repeats + 1)
            if held is not None:
                index, second = index[1:], second[1:]  # the held row was emitted before
            before = np.append(second[0] if last is None else last, second[:-1])
            begins = second - before > self.gap
            numbered = session + np.cumsum(begins)
            yield self._emitted(key, whole.iloc[index], second, numbered)
            opened = begins if last is not None else np.append(True, begins[1:])
            starts, numbers = [*starts, *second[opened].tolist()][-REMEMBERED:], [*numbers, *numbered[opened].tolist()][-REMEMBERED:]
            last, session = int(second[-1]), int(numbered[-1])
            held = fresh[self.columns].iloc[-1:]
        if last is None:
            return
        live = held is not None and not (len(marks) and marks[-1] > int(given["second"].max() if len(given) else last))
        self.place.update((last, session, bool(live), starts, numbers))
        if live:
            value = held.iloc[0]
            self.message.update(tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in value))
        if self.live:
            self._wake(timerValues, live)

    def _wake(self, timerValues, live: bool) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if live:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Quiet seconds up to now; a silence that outlasts ``carry_seconds`` is
        not filled further."""
        last, session, holding, starts, numbers = self.place.get()
        now = timerValues.getCurrentProcessingTimeInMs() // 1000
        if not holding:
            return
        if self.carry is not None and now - last > self.carry:
            self.place.update((last, session, False, starts, numbers))
            return
        second = np.arange(last + 1, now + 1)
        if len(second):
            held = pd.DataFrame([self.message.get()] * len(second), columns=self.columns)
            begins = np.diff(np.append(last, second)) > self.gap
            numbered = session + np.cumsum(begins)
            self.place.update((int(second[-1]), int(numbered[-1]), True, list(starts), list(numbers)))
            yield self._emitted(key, held, second, numbered)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000)


def sampled(parsed: DataFrame, last: dict[str, list[int]], levels: int, carry_seconds: int | None, max_gap_seconds: float, live: bool) -> DataFrame:
    """Rows of the raw schema from messages parsed with markers.  ``last`` has
    the session and time (microseconds) from which each symbol goes on."""
    spark = ship(parsed.sparkSession)
    book = level_columns(levels)
    schema = ", ".join(["timestamp timestamp", "symbol string", "session_id long", "event_time timestamp", "exchange string", *(f"{c} double" for c in book)])
    seeds = spark.createDataFrame([(k, v[0], v[1] // 1_000_000) for k, v in last.items()], SEEDS).groupBy("symbol")
    rows = parsed.where(F.col("symbol").isNotNull()).groupBy("symbol")
    # With timers, a stream that takes what is there would never be at its end.
    processor, mode = Sampler(levels, carry_seconds, max_gap_seconds, live), "processingTime" if live else "none"
    out = rows.transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode=mode, initialState=seeds)
    return out.select(*METADATA, *book)
