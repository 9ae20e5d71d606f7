"""Histories of rows that come in order, with numpy: what :mod:`.features` computes
within tasks.

A window frame of Spark adds up all its rows anew for every row.  Here one step
adds the k-th row before to the sums of all rows of an Arrow batch, in the order
and by the formulas of Spark's aggregates, so values are the same to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Values = tuple[np.ndarray, np.ndarray]  # values, and where there is one


class Stretches:
    """Rows by stretch, in order: ``place`` is how many came before in its own."""

    def __init__(self, begins: np.ndarray):
        index = np.arange(len(begins))
        self.place = index - np.maximum.accumulate(np.where(begins, index, 0))

    def lag(self, x: Values, n: int) -> Values:
        """The value ``n`` rows before, in the same stretch."""
        value, ok = np.zeros(len(self.place)), np.zeros(len(self.place), bool)
        value[n:], ok[n:] = x[0][:-n], x[1][:-n]
        return value, ok & (self.place >= n)

    def change(self, x: Values, n: int) -> Values:
        value, ok = self.lag(x, n)
        return x[0] - value, x[1] & ok

    def simple_return(self, x: Values, n: int) -> Values:
        value, ok = self.lag(x, n)
        ok = x[1] & ok & (value != 0)
        return np.divide(x[0], value, out=np.zeros(len(value)), where=ok) - 1, ok

    def _last(self, x: Values, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The values of the last ``n`` rows, oldest first, as views of equal
        length, and which rows have all of them."""
        rows = len(self.place)
        held = np.concatenate([np.zeros(n - 1), x[0]])
        counts = np.concatenate([np.zeros(n, int), np.cumsum(x[1])])
        ok = (self.place >= n - 1) & (counts[n:] - counts[:-n] == n)
        return [held[k : k + rows] for k in range(n)], ok

    def rolling_mean(self, x: Values, n: int) -> Values:
        views, ok = self._last(x, n)
        total = np.zeros(len(ok))
        for own in views:
            total += own
        return total / n, ok

    def rolling_std(self, x: Values, n: int) -> Values:
        views, ok = self._last(x, n)
        mean, squares = np.zeros(len(ok)), np.zeros(len(ok))
        for k, own in enumerate(views, 1):
            delta = own - mean
            part = delta / k
            mean += part
            squares += delta * (delta - part)
        return np.sqrt(squares / (n - 1)), ok


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a key differs from the row before; null keys are keys."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for key in keys:
        a, b = rows[key].slice(1), rows[key].slice(0, max(0, len(rows) - 1))
        differs = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differs.to_numpy(zero_copy_only=False) if isinstance(differs, pa.Array) else differs.to_numpy()
    return out


def _values(column: pa.ChunkedArray) -> Values:
    return pc.fill_null(column, 0.0).to_numpy(), pc.is_valid(column).to_numpy()


@dataclass(frozen=True)
class Dealt:
    """How rows are dealt: sorted by ``keys`` (the last is a bucket of time) and
    time ``us``, with ``inputs``, rows of the bucket ``own`` and others before
    them.  A gap beyond ``gap_us`` ends a stretch, and ``reach`` rows of history
    are looked at.  A row without a time says in ``before`` how many stretches
    begin in earlier buckets of its keys."""

    keys: list[str]
    inputs: list[str]
    gap_us: int
    reach: int
    us: str = "history_us"
    own: str = "history_own"
    before: str = "history_before"


def along(batches: Iterator[pa.RecordBatch], formulas, dealt: Dealt) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, dict[str, Values]]]:
    """By batch: its rows, which are own, the number of each one's stretch, which
    ones begin a stretch, and the features that ``formulas`` (stretches and columns
    to features) gives them.  The last rows of a batch are seen by the next.
    Numbers count within a bucket, from ``before`` where that is given, less 1."""
    tail, offset, begun = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        seen = pa.Table.from_batches([batch]).select([*dealt.keys, dealt.us, *dealt.inputs])
        if tail is not None:
            seen = pa.concat_tables([tail, seen])
        timed = pc.is_valid(seen[dealt.us]).to_numpy()
        us = pc.fill_null(seen[dealt.us], 0).to_numpy()
        changes = _changes(seen, dealt.keys)
        begins = changes.copy()
        begins[1:] |= (np.diff(us) > dealt.gap_us) | ~timed[:-1]
        with np.errstate(all="ignore"):
            found = formulas(Stretches(begins), {c: _values(seen[c]) for c in dealt.inputs})
        here = len(seen) - batch.num_rows
        own = batch.column(batch.schema.get_field_index(dealt.own)).to_numpy(zero_copy_only=False) & timed[here:]
        opens, fresh = begins[here:] & own, changes[here:]
        # Of each bucket in the batch: what comes before its first row here.
        counts, place = np.cumsum(opens), np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
        said = pc.fill_null(batch.column(batch.schema.get_field_index(dealt.before)), 0).to_numpy() if dealt.before in batch.schema.names else np.zeros(len(fresh), np.int64)
        inside = place >= 0
        at = place[inside]
        number = counts + begun + offset
        number[inside] = counts[inside] - counts[at] + opens[at] + said[at]
        yield batch, own, number - 1, opens, {name: (value[here:], ok[here:]) for name, (value, ok) in found.items()}
        offset, begun = (offset, begun + int(counts[-1])) if place[-1] < 0 else (int(said[place[-1]]), int(number[-1] - said[place[-1]]))
        tail = seen.slice(max(0, len(seen) - max(1, dealt.reach))).combine_chunks()


def rows(batches: Iterator[pa.RecordBatch], formulas, dealt: Dealt, kept: list[str], segment: str) -> Iterator[pa.RecordBatch]:
    """``kept`` columns of the own rows, the number of their stretch, and features."""
    for batch, own, number, _, found in along(batches, formulas, dealt):
        features = {name: pa.array(value, pa.float64(), mask=~ok) for name, (value, ok) in found.items()}
        columns = [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(number), *features.values()]
        yield pa.RecordBatch.from_arrays(columns, [*kept, segment, *features]).filter(pa.array(own))


def filled(batches: Iterator[pa.RecordBatch], formulas, dealt: Dealt, names: list[str]) -> Iterator[pa.RecordBatch]:
    """How many of a task's own rows have a value in each of ``names``."""
    counts = np.zeros(len(names), np.int64)
    for batch, own, _, _, found in along(batches, formulas, dealt):
        valid = lambda n: found[n][1] if n in found else batch.column(batch.schema.get_field_index(n)).is_valid().to_numpy(zero_copy_only=False)  # noqa: E731, B023
        counts += [int((valid(n) & own).sum()) for n in names]
    yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64()))], ["filled"])


def warmups(batches: Iterator[pa.RecordBatch], formulas, dealt: Dealt) -> Iterator[pa.RecordBatch]:
    """Of each stretch's own rows within a bucket and batch: ``number`` as of
    :func:`along`, ``opens`` (1 if the stretch begins here), how many rows there
    are and have all features, when either begin, and whether the first has them."""
    for batch, own, number, opens, found in along(batches, formulas, dealt):
        at = np.flatnonzero(own)
        if not len(at):
            continue
        full = np.logical_and.reduce([ok for _, ok in found.values()])[at]
        us, n = batch.column(batch.schema.get_field_index(dealt.us)).to_numpy(zero_copy_only=False)[at].astype(np.int64), number[at]
        keys = pa.Table.from_batches([batch]).select(dealt.keys).take(pa.array(at)).combine_chunks()
        first = np.flatnonzero(_changes(keys, dealt.keys) | np.append(True, n[1:] != n[:-1]))
        least = np.minimum.reduceat(np.where(full, us, np.iinfo(np.int64).max), first)
        kept = np.add.reduceat(full.astype(np.int64), first)
        columns = {"number": n[first], "opens": np.add.reduceat(opens[at].astype(np.int64), first), "rows": np.diff(np.append(first, len(at))), "kept_rows": kept, "first_us": us[first]}
        arrays = [*(keys[k].take(pa.array(first)).combine_chunks() for k in dealt.keys), *(pa.array(v, pa.int64()) for v in columns.values()), pa.array(least, pa.int64(), mask=kept == 0), pa.array(full[first])]
        yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], [*dealt.keys, *columns, "first_kept_us", "violated"])
