"""Depth messages from a websocket, recorded as segments of JSON lines.

A recorder listens and seals a segment every few seconds: it writes under a
temporary name and renames.  What is sealed is durable; the collecting stream
reads the folder (:func:`tidebook.streaming.collector.read_folder`) and keeps in
its checkpoint which segments it has taken.  Needs a network and the
``websockets`` package, which are asked for only when listening starts.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

#: Shape of the stream's address, and delays in seconds.
ADDRESS = "{base}/{symbol}@depth{levels}@100ms"
RECONNECT_SECONDS, PING_SECONDS = 5.0, 20.0
#: Seconds of messages in a segment.
SEGMENT_SECONDS = 5.0
#: What the recorder says after a connection was made anew.
RECONNECTED = json.dumps({"reconnected": True})


def address(base: str, symbol: str, levels: int = 20) -> str:
    return ADDRESS.format(base=base.rstrip("/"), symbol=symbol.lower(), levels=levels)


def listen(url: str, delay: float = RECONNECT_SECONDS) -> Iterator[str | None]:
    """Messages for ever; None when a second passes without one, and a marker
    after each reconnect."""
    from websockets.sync.client import connect

    first = True
    while True:
        try:
            with connect(url, ping_interval=PING_SECONDS) as socket:
                if not first:
                    yield RECONNECTED
                first = False
                while True:
                    try:
                        yield socket.recv(timeout=1)
                    except TimeoutError:
                        yield None
        except OSError:
            time.sleep(delay)


def record(messages: Iterator[str | None], folder: str, seconds: float = SEGMENT_SECONDS, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)) -> int:
    """Write messages to segments of ``folder`` until they end; how many.  A
    segment is sealed by a rename, in order of time; a message is in no segment or
    in one."""
    os.makedirs(folder, exist_ok=True)
    held: list[str] = []
    count, opened = 0, now()

    def seal() -> None:
        nonlocal held
        if held:
            name = f"{opened.strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}.json"
            with open(f"{folder}/.{name}", "w") as out:
                out.write("\n".join(held))
                out.flush()
                os.fsync(out.fileno())
            os.rename(f"{folder}/.{name}", f"{folder}/{name}")
        held = []

    for message in messages:
        at = now()
        if (at - opened).total_seconds() >= seconds:
            seal()
            opened = at
        if message is not None:
            held.append(json.dumps({"received": at.isoformat(), "message": message}))
            count += 1
    seal()
    return count
