"""Vectorised word and n-gram hashing over Arrow string columns.

Words are cut at byte level: all separators used here are ASCII, so UTF-8 text
can be cut without decoding it.  A word's hash is a polynomial over random
per-byte values, taken from prefix sums modulo 2**64; the cost is a few
nanoseconds per byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled on its own.
CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_PLAIN_VALUE = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_MIX = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_MIX[0])
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words: anything but ASCII white space, and ASCII letters, digits
#: and bytes of non-ASCII characters.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, CHUNK + 1), (_BASE, _BASE_INVERSE)[which], np.uint64)
        base[0] = 1
        _powers[which] = np.multiply.accumulate(base)
    return _powers[which][:n]


def string_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first_row, rows, bytes, offsets`` for pieces of about CHUNK bytes.
    Null counts as the empty text."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for array in arrays:
        array = pc.fill_null(array.cast(pa.large_string()), "")
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, np.int64, len(array) + 1 + array.offset)[array.offset :]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            j = min(j, len(array))
            yield first + i, j - i, data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        first += len(array)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text where its words begin in
    these arrays (one more than texts)."""
    n = len(data)
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words; ``fold`` lower-cases A-Z."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_VALUE if fold else _PLAIN_VALUE)[data] * _power(0, n), out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * _power(1, n + 1)[starts])


def combined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (``len - k + 1`` of them)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * _MIX[1]
    for j in range(1, k):
        out += hashes[j : j + m] * _MIX[1 + j]
    return mixed(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text, sorted, and where each text's
    begin.  A text of 1 to k-1 words has the whole sequence as its shingle."""
    starts, stops, at = word_spans(data, offsets)
    h = word_hashes(data, starts, stops)
    counts = np.diff(at)
    rows = len(counts)
    every = combined(h, k)
    doc = np.repeat(np.arange(rows), counts)
    every = every[doc[: len(every)] == doc[k - 1 :]] if len(every) else every
    few = (counts > 0) & (counts < k)
    each = np.where(few, 1, np.maximum(counts - k + 1, 0))
    at_run = np.concatenate([[0], np.cumsum(each)])
    runs = np.empty(at_run[-1], np.uint64)
    runs[np.repeat(~few, each)] = every
    for i in np.flatnonzero(few):
        whole = np.append(h[at[i] : at[i + 1]] * _MIX[1 : 1 + counts[i]], _MIX[40 + counts[i]])
        runs[at_run[i]] = mixed(np.sum(whole, keepdims=True))[0]
    for a, b in zip(at_run[:-1], at_run[1:], strict=True):
        runs[a:b].sort()
    fresh = np.ones(len(runs), bool)
    fresh[1:] = runs[1:] != runs[:-1]
    fresh[at_run[:-1][each > 0]] = True
    left = np.concatenate([[0], np.cumsum(fresh)])
    return runs[fresh], left[at_run]
