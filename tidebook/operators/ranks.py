"""Ranks of values with numpy: what :mod:`.cleaning` finds of quantiles in tasks.

A summary of some values has points in order, each with how many values it stands
for: those up to it, and after the point before.  So at least as many values are
at or below a point as all up to it stand for, and at most ``error`` more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Values of a column that are sorted at once, points of a summary, and summaries
#: that are merged to one.
CHUNK, POINTS, FAN_IN = 1 << 17, 2048, 64
SUMMARY = "column int, part long, error long, points array<double>, weights array<long>"
BRACKET = "column int, i int, low double, high double, at double"
HELD = "key int, below boolean, value double, n long"

_SUMMARY = pa.schema([("column", pa.int32()), ("part", pa.int64()), ("error", pa.int64()), ("points", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64()))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to some ``CHUNK`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _thinned(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Some ``POINTS`` of sorted points, and the most that one newly stands for."""
    upto = np.cumsum(weights)
    step = -(-int(upto[-1]) // POINTS)
    last = np.append(np.flatnonzero(upto[1:] // step > upto[:-1] // step) + 1, len(upto) - 1)
    last = np.unique(np.append(last, 0))
    own = np.diff(np.append(0, upto[last]))
    return points[last], own, int(own.max()) - 1


def _rows(found: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_SUMMARY.names, (j, part, error, points.tolist(), weights.tolist()), strict=True)) for j, part, error, points, weights in found], _SUMMARY)


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of each column's values; ``part`` is the task's."""
    part = TaskContext.get().partitionId()
    for table in _chunks(batches):
        found = []
        for j, column in enumerate(table.columns):
            values = np.sort(column.drop_null().to_numpy())
            if len(values):
                points, weights, error = _thinned(values, np.ones(len(values), np.int64))
                found.append((j, part, error, points, weights))
        yield from _rows(found).to_batches()


def _together(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    points, weights = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("points", "weights"))
    order = np.argsort(points, kind="stable")
    return points[order], weights[order], sum(table.column("error").to_pylist())


def merged(table: pa.Table) -> pa.Table:
    """One summary of a column's summaries."""
    points, weights, error = _together(table)
    points, weights, more = _thinned(points, weights)
    return _rows([(table.column("column")[0].as_py(), table.column("part")[0].as_py(), error + more, points, weights)])


def brackets(table: pa.Table, asked: list[float]) -> pa.Table:
    """For each quantile asked of a column: values with at most its place below
    the one and at least its place and the next up to the other."""
    points, weights, error = _together(table)
    upto = np.cumsum(weights)
    # Of equal points all stand below what comes after them, none below their own.
    before = np.append(0, upto)[np.searchsorted(points, points, "left")]
    n, out = int(upto[-1]), []
    for i, p in enumerate(asked):
        at = (n - 1) * p
        fits = np.flatnonzero(before + error <= np.floor(at))
        low = points[fits[-1]] if len(fits) else -np.inf
        high = points[min(int(np.searchsorted(upto, np.ceil(at) + 1, "left")), len(points) - 1)]
        out.append({"column": table.column("column")[0].as_py(), "i": i, "low": float(low), "high": float(high), "at": float(at)})
    return pa.Table.from_pylist(out, pa.schema([("column", pa.int32()), ("i", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("at", pa.float64())]))


def inside(batches: Iterator[pa.RecordBatch], limits: list[tuple[int, float, float]]) -> Iterator[pa.RecordBatch]:
    """For each (column, low, high): how many values are below, and the values
    between with how often each comes."""
    below = np.zeros(len(limits), np.int64)
    pack = lambda keys, under, values, n: pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(np.full(len(n), under)), values, pa.array(n, pa.int64())], ["key", "below", "value", "n"])
    for table in _chunks(batches):
        columns = [c.drop_null().to_numpy() for c in table.columns]
        for k, (j, low, high) in enumerate(limits):
            under = columns[j] < low
            below[k] += int(under.sum())
            values, n = np.unique(columns[j][~under & ~(columns[j] > high)], return_counts=True)
            if len(n):
                yield pack(np.full(len(n), k), False, pa.array(values), n)
    yield pack(np.arange(len(limits)), True, pa.nulls(len(limits), pa.float64()), below)
