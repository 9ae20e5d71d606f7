"""Texts packed in blocks, and dictionaries of blocks that travel by key.

A block is a stretch of one input partition, bounded in bytes.  Its texts are
tokenised once; what a global lookup has to answer is each distinct token of
the block, so a token costs one entry per block and not one row per position.
Entries travel in packed groups by a hash of the token.
"""

from __future__ import annotations

import ctypes
import gc
import inspect
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame


def block_id(sequence: int) -> int:
    """Identifier of a task's ``sequence``-th block; the same when it reruns."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 24) + sequence


def input_splits(df: DataFrame, split_bytes: int = 16 << 20) -> int:
    """About how many splits of ``split_bytes`` the input has, by the optimizer's
    estimate of its size; nothing is run.  Without an estimate, the number of
    shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // split_bytes))


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(array).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def varint(values: np.ndarray) -> bytes:
    """Little-endian base-128 coding of non-negative integers."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        width += values >= np.uint64(1 << bits)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - width
    for i in range(int(width.max()) if len(width) else 0):
        has = width > i
        more = (width[has] > i + 1).astype(np.uint64) << np.uint64(7)
        out[starts[has] + i] = ((values[has] >> np.uint64(7 * i)) & np.uint64(127) | more).astype(np.uint8)
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    within = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.int64) << (7 * within)
    return np.add.reduceat(parts, starts)


def tops(parent: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Roots of members in a forest of parents."""
    while True:
        up = parent[members]
        if np.array_equal(up, members):
            return members
        members = up


def unite(parent: np.ndarray, members: np.ndarray) -> None:
    """Make members one tree; the root of a tree is its smallest member."""
    roots = tops(parent, members)
    parent[roots] = parent[members] = roots.min()


_released = [0.0]


def release() -> None:
    """Give freed memory back to the system.  Python workers live on and are
    used by later stages; what they keep would count against the executor."""
    if time.monotonic() - _released[0] < 0.25:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    _released[0] = time.monotonic()


def tidy(function):
    """``function`` over batches, one table or two tables, which releases memory
    at its end."""
    if inspect.isgeneratorfunction(function):

        def over_batches(batches):
            try:
                yield from function(batches)
            finally:
                release()

        return over_batches
    if len(inspect.signature(function).parameters) == 2:

        def over_two(left, right):
            try:
                return function(left, right)
            finally:
                release()

        return over_two

    def over_one(table):
        try:
            return function(table)
        finally:
            release()

    return over_one
