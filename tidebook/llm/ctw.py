"""Language-model scores by context-tree weighting over bytes.

A text is the byte stream of its words, A-Z lower-cased, each followed by a
space, and a newline at the end.  Every byte is eight binary decisions; each
decision has its own tree of contexts, the ``DEPTH`` bytes before it.  A node of
the tree holds the Krichevsky-Trofimov estimate of its bits; the probability of
a bit mixes the estimates of all depths by the weights that the counts of the
training texts give them.

1. A block of texts emits its distinct (context, byte) grams with their training
   counts, packed, by a hash of the three nearest context bytes.
2. A bucket so holds whole subtrees below contexts of three bytes.  It computes
   weighted probabilities bottom up; what it knows of contexts of two bytes is
   summed over buckets, in groups of the pairs that a bucket shares with few
   others.  The two topmost levels (257 contexts, whatever the corpus) are summed
   over groups and travel to all.
3. A bucket, beside the pairs of its group, scores each distinct gram once; scores
   return to the blocks, and texts add up the scores of their positions.

A context that training lacks predicts as its deepest known suffix does.  Word
counts for the unigram base travel in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_id, input_splits, pack, tidy, unpack, unvarint, varint
from .scratch import keep, materialize
from .text import SPACED, string_chunks, word_hashes, word_spans

DEPTH = 5
#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
_TEXTS, _GRAMS, _WORDS = 0, 1, 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def byte_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and terminators of each text, and where each text's begin."""
    starts, stops, at = word_spans(data, offsets)
    length = stops - starts
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(np.bincount(doc, length + 1, len(counts)).astype(np.int64) + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    kept = _LOW[data[SPACED[data]]]
    out[np.arange(len(kept)) + np.repeat(np.arange(len(length)) + doc, length)] = kept
    out[ends - 1] = 0x0A
    return out, np.concatenate([[0], ends])


def gram_keys(stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Nearest context byte first, then farther ones, then the byte itself.
    Before a text's start stand newlines."""
    key = stream.astype(np.uint64)
    within = np.arange(len(stream)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, DEPTH + 1):
        before = np.full(len(stream), 0x0A, np.uint64)
        before[j:] = stream[: len(stream) - j] if j < len(stream) else stream[:0]
        before[within < j] = 0x0A
        key |= before << np.uint64(8 * (DEPTH + 1 - j))
    return key


def _lgamma_table(n: int) -> np.ndarray:
    return np.array([math.lgamma(x / 2) if x else 0.0 for x in range(n)])


_SMALL = _lgamma_table(512)


def _lgamma(twice: np.ndarray) -> np.ndarray:
    """log gamma of ``twice / 2``: a table, then Stirling's series."""
    x = np.maximum(twice, 2) / 2.0
    big = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(twice < len(_SMALL), _SMALL[np.minimum(twice, len(_SMALL) - 1)], big)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(2 * n0 + 1) + _lgamma(2 * n1 + 1) - 2 * _SMALL[1] - _lgamma(2 * (n0 + n1) + 2)


_HALF = math.log(0.5)


def _summed(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, inverse = np.unique(codes, return_inverse=True)
    return found, *(np.bincount(inverse, v, len(found)) for v in values)


class Level:
    """Nodes of one depth, ``code = context * 256 + binary node``, in order."""

    def __init__(self, codes: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.codes, self.n0, self.n1 = codes, n0.astype(np.int64), n1.astype(np.int64)
        estimate = kt_block(self.n0, self.n1)
        self.weighted = estimate if below is None else np.logaddexp(_HALF + estimate, _HALF + below)
        self.weight = np.ones(len(codes)) if below is None else np.exp(_HALF + estimate - self.weighted)
        self.one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)

    def parent(self) -> Level:
        codes = ((self.codes >> np.uint64(16)) << np.uint64(8)) | (self.codes & np.uint64(255))
        codes, n0, n1, below = _summed(codes, self.n0, self.n1, self.weighted)
        return Level(codes, n0, n1, below)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes


def _node(byte: np.ndarray, bit: int) -> np.ndarray:
    return np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))


def subtree(keys: np.ndarray, counts: np.ndarray, down_to: int = 3) -> list[Level]:
    """Levels of depth DEPTH, DEPTH - 1, ... down_to of distinct grams."""
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)
    codes, zeros, ones = [], [], []
    for bit in range(8):
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        codes.append((context << np.uint64(8)) | _node(byte, bit))
        zeros.append(np.where(one, 0, counts))
        ones.append(np.where(one, counts, 0))
    levels = [Level(*_summed(np.concatenate(codes), np.concatenate(zeros), np.concatenate(ones)), None)]
    while len(levels) <= DEPTH - down_to:
        levels.append(levels[-1].parent())
    return levels


def score_grams(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram's byte in its context; ``levels`` from the
    deepest to depth 0."""
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)
    total = np.zeros(len(keys))
    for bit in range(8):
        node = _node(byte, bit)
        p, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for up, level in enumerate(levels):
            at, has = level.find(((context >> np.uint64(8 * up)) << np.uint64(8)) | node)
            if not len(level.codes):
                continue
            mixed = np.where(known, level.weight[at] * level.one[at] + (1 - level.weight[at]) * p, level.one[at])
            p = np.where(has, mixed, p)
            known |= has
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        total += np.log10(np.where(one, p, 1 - p))
    return total


def _spread(values: np.ndarray, seed: int) -> np.ndarray:
    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) >> np.uint64(33)


@dataclass(frozen=True)
class Buckets:
    """``groups`` of pairs of nearest context bytes, each in ``parts`` by the
    third: a frequent pair is several buckets'."""

    groups: int
    parts: int

    @classmethod
    def of(cls, wanted: int) -> Buckets:
        parts = int(min(256, max(8, math.isqrt(wanted))))
        return cls(min(1 << 16, -(-wanted // parts)), parts)

    @property
    def number(self) -> int:
        return self.groups * self.parts

    def group(self, pairs: np.ndarray) -> np.ndarray:
        return (_spread(pairs, 0) % np.uint64(self.groups)).astype(np.int64)

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        nearest = keys >> np.uint64(8 * (DEPTH - 1))
        part = (_spread(keys >> np.uint64(8 * (DEPTH - 2)), 1) % np.uint64(self.parts)).astype(np.int64)
        return self.group(nearest) * self.parts + part

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.number)).astype(np.int64)


class _Counts:
    """Distinct keys of a block and how often training texts have them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        found, inverse = (np.unique(keys[train], return_counts=True)) if train.any() else (keys[:0], np.zeros(0, np.int64))
        self.parts.append((found, inverse))
        other = np.unique(keys[~train])
        self.parts.append((other, np.zeros(len(other), np.int64)))
        if len(self.parts) > 16:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = _summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        return keys, counts.astype(np.int64)


def _by_bucket(keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of keys by bucket, and each bucket's piece of it."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(edges[1:], len(keys))
    return order, [(int(bucket[order[a]]), int(a), int(b)) for a, b in zip(edges, ends, strict=True)]


def _words_of(stream: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, at = word_spans(stream, offsets)
    return word_hashes(stream, starts, stops), at


_FIELDS = ["block", "kind", "bucket", "ids", "held", "lengths", "payload"]


def _scan(buckets: Buckets, id_type: pa.DataType):
    def entries(block: int, kind: int, counts: _Counts) -> pa.RecordBatch:
        keys, often = counts.merged()
        order, pieces = _by_bucket(keys, buckets.of_keys(keys) if kind == _GRAMS else buckets.of_words(keys))
        n = len(pieces)
        keys, often = keys[order], often[order]
        packed = [pack(np.frombuffer(varint(np.diff(keys[a:b], prepend=np.uint64(0))), np.uint8)) if kind == _GRAMS else keys[a:b].tobytes() for _, a, b in pieces]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * n, pa.int64()),
                pa.array([kind] * n, pa.int32()),
                pa.array([p for p, _, _ in pieces], pa.int32()),
                pa.nulls(n, pa.list_(id_type)),
                pa.nulls(n, pa.list_(pa.bool_())),
                pa.array([varint(often[a:b]) for _, a, b in pieces], pa.binary()),
                pa.array(packed, pa.binary()),
            ],
            _FIELDS,
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled, grams, words = 0, 0, _Counts(), _Counts()
        for batch in batches:
            for first, rows, data, offsets in string_chunks(batch.column(2)):
                held = batch.column(1).slice(first, rows)
                train = ~held.to_numpy(zero_copy_only=False).astype(bool)
                stream, at = byte_stream(data, offsets)
                grams.add(gram_keys(stream, at), np.repeat(train, np.diff(at)))
                hashes, word_at = _words_of(stream, at)
                words.add(hashes, np.repeat(train, np.diff(word_at)))
                one = pa.array([0, rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block_id(sequence)]),
                        pa.array([_TEXTS], pa.int32()),
                        pa.nulls(1, pa.int32()),
                        pa.ListArray.from_arrays(one, batch.column(0).slice(first, rows)),
                        pa.ListArray.from_arrays(one, held),
                        pa.array([varint(np.diff(at))], pa.binary()),
                        pa.array([pack(stream)], pa.binary()),
                    ],
                    _FIELDS,
                )
                filled += len(data)
                if filled >= BLOCK_BYTES:
                    yield entries(block_id(sequence), _GRAMS, grams)
                    yield entries(block_id(sequence), _WORDS, words)
                    sequence, filled, grams, words = sequence + 1, 0, _Counts(), _Counts()
        if filled or grams.parts:
            yield entries(block_id(sequence), _GRAMS, grams)
            yield entries(block_id(sequence), _WORDS, words)

    return tidy(scan)


def _bucket(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, their counts, each entry's place among them,
    and where each block's entries end."""
    read = (lambda x: np.cumsum(unvarint(unpack(x, np.uint8).tobytes())).astype(np.uint64)) if kind == _GRAMS else (lambda x: np.frombuffer(x, np.uint64))
    parts = [read(x.as_py()) for x in table.column("payload")]
    often = np.concatenate([unvarint(x.as_py()) for x in table.column("lengths")])
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(inverse, often, len(keys)).astype(np.int64), inverse, np.cumsum([0, *map(len, parts)])


_SUMS = "code long, n0 long, n1 long, below double"


def _sums(level: Level) -> pa.Table:
    """What a level gives to the one above."""
    codes = ((level.codes >> np.uint64(16)) << np.uint64(8)) | (level.codes & np.uint64(255))
    codes, n0, n1, below = _summed(codes, level.n0, level.n1, level.weighted)
    return pa.table({"code": pa.array(codes.astype(np.int64)), "n0": pa.array(n0.astype(np.int64)), "n1": pa.array(n1.astype(np.int64)), "below": pa.array(below)})


def _level(table: pa.Table) -> Level:
    """The level whose sums these are."""
    table = table.sort_by("code")
    n0, n1, below = (table.column(c).to_numpy() for c in ("n0", "n1", "below"))
    return Level(table.column("code").to_numpy().astype(np.uint64), n0, n1, below)


def _pair_sums(buckets: Buckets):
    def pair_sums(table: pa.Table) -> pa.Table:
        keys, counts, _, _ = _bucket(table, _GRAMS)
        seen = counts > 0
        sums = _sums(subtree(keys[seen], counts[seen], 3)[-1])
        group = buckets.group(sums.column("code").to_numpy().astype(np.uint64) >> np.uint64(8))
        return sums.append_column("group", pa.array(group.astype(np.int32)))

    return tidy(pair_sums)


def _top_sums(table: pa.Table) -> pa.Table:
    return _sums(_level(table))


def _score(top):
    def score(table: pa.Table, pairs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary()), "words": pa.array([], pa.int64()), "tokens": pa.array([], pa.int64())})
        keys, counts, inverse, ends = _bucket(table, _GRAMS)
        seen = counts > 0
        scores = score_grams(keys, [*subtree(keys[seen], counts[seen], 3), _level(pairs), *top.value])[inverse]
        packed = [pack(scores[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": table.column("block"), "kind": table.column("kind"), "bucket": table.column("bucket"), "payload": pa.array(packed, pa.binary()), "words": pa.nulls(len(packed), pa.int64()), "tokens": pa.nulls(len(packed), pa.int64())})

    return tidy(score)


def _count_words(table: pa.Table) -> pa.Table:
    _, counts, inverse, ends = _bucket(table, _WORDS)
    own = counts[inverse]
    packed = [varint(own[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = len(packed)
    once = lambda value: pa.array([int(value), *[0] * (n - 1)], pa.int64())
    return pa.table({"block": table.column("block"), "kind": table.column("kind"), "bucket": table.column("bucket"), "payload": pa.array(packed, pa.binary()), "words": once(np.count_nonzero(counts)), "tokens": once(counts.sum())})


def _assemble(buckets: Buckets, n: int, v: int, ends: int, id_type: pa.DataType):
    def answers(table: pa.Table, kind: int) -> list[bytes]:
        own = table.filter(pc.equal(table.column("kind"), kind)).sort_by("bucket")
        return [x.as_py() for x in own.column("payload")]

    def assemble(texts: pa.Table, given: pa.Table) -> pa.Table:
        pieces, grams, words = [], _Counts(), _Counts()
        for i in range(texts.num_rows):
            at = np.concatenate([[0], np.cumsum(unvarint(texts.column("lengths")[i].as_py()))])
            stream = unpack(texts.column("payload")[i].as_py(), np.uint8)
            pieces.append((stream, at))
            none = np.zeros(0, bool)
            for counts, keys in ((grams, gram_keys(stream, at)), (words, _words_of(stream, at)[0])):
                counts.add(keys, np.resize(none, len(keys)))
        keys, _ = grams.merged()
        order, _ = _by_bucket(keys, buckets.of_keys(keys))
        scores = np.zeros(len(keys))
        scores[order] = np.concatenate([np.zeros(0), *(unpack(x, np.float64) for x in answers(given, _GRAMS))])
        hashes, _ = words.merged()
        order, _ = _by_bucket(hashes, buckets.of_words(hashes))
        often = np.zeros(len(hashes), np.int64)
        often[order] = np.concatenate([np.zeros(0, np.int64), *(unvarint(x) for x in answers(given, _WORDS))])
        size = math.log10(n + v + 1)
        base_of = np.log10(often + 1.0) - size
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for i, (stream, at) in enumerate(pieces):
            found = gram_keys(stream, at)
            for a, b in zip(at[:-1], at[1:], strict=True):
                found[a:b].sort()
            value = np.concatenate([[0.0], scores[np.searchsorted(keys, found)]])
            out["score"].append(np.add.reduceat(value[1:], at[:-1]) if len(at) > 1 else value[:0])
            own, word_at = _words_of(stream, at)
            place = np.searchsorted(hashes, own)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(word_at))
            out["base_score"].append(np.bincount(doc, base_of[place], len(at) - 1) + math.log10(ends + 1) - size)
            out["n_known"].append(np.bincount(doc, often[place] > 0, len(at) - 1).astype(np.int64) + (ends > 0))
            out["n_tokens"].append(np.diff(word_at) + 1)
            out["doc_id"].append(texts.column("ids")[i].values)
            out["held_out"].append(texts.column("held")[i].values)
        columns = {k: pa.chunked_array(x, id_type if k == "doc_id" else pa.bool_()) if k in ("doc_id", "held_out") else pa.array(np.concatenate(x)) for k, x in out.items()}
        return pa.table({**columns, "train_tokens": pa.array(np.full(len(columns["score"]), n, np.int64))})

    return tidy(assemble)


def ctw_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: int = 7, holdout_value: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for each input row; scores are log10 probabilities of the whole text.

    Rows whose crc32(identifier as text) mod ``holdout`` is ``holdout_value`` are
    scored and not learned from.  Tokens are words and one end.  A null text is
    the empty text: it has the end token alone.  A null identifier is learned
    from.  If nothing is learned every bit has probability one half.  An empty
    table gives an empty result; columns not named are not read, and rows are
    never joined by identifier, so identifiers may repeat.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % holdout == holdout_value, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    buckets = Buckets.of(max(64, 2 * input_splits(docs)))
    schema = f"block long, kind int, bucket int, ids array<{kind.simpleString()}>, held array<boolean>, lengths binary, payload binary"
    scanned = keep(rows.mapInArrow(_scan(buckets, to_arrow_type(kind)), schema))

    grams = scanned.where(F.col("kind") == _GRAMS).select("block", "kind", "bucket", "lengths", "payload")
    total = [F.sum(c).alias(c) for c in ("n0", "n1", "below")]
    pairs = grams.groupBy("bucket").applyInArrow(_pair_sums(buckets), f"{_SUMS}, group int")
    pairs = materialize(pairs.groupBy("group", "code").agg(*total), "pair-sums")
    sums = pairs.groupBy("group").applyInArrow(tidy(_top_sums), _SUMS)
    first = _level(sums.groupBy("code").agg(*total).toArrow())
    top = spark.sparkContext.broadcast([first, first.parent()])

    reply = "block long, kind int, bucket int, payload binary, words long, tokens long"
    words = scanned.where(F.col("kind") == _WORDS).select("block", "kind", "bucket", "lengths", "payload")
    counted = keep(words.groupBy("bucket").applyInArrow(_count_words, reply))
    v, tokens = counted.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).head()
    texts = scanned.where(F.col("kind") == _TEXTS).select("block", "ids", "held", "lengths", "payload")
    learned = F.size(F.filter("held", lambda h: ~h))
    ends = int(texts.agg(F.coalesce(F.sum(learned), F.lit(0))).head()[0])

    part = F.explode(F.sequence(F.lit(0), F.lit(buckets.parts - 1)))
    pairs = pairs.withColumn("part", part).select((F.col("group") * buckets.parts + F.col("part")).cast("int").alias("bucket"), "code", "n0", "n1", "below")
    scored = grams.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(_score(top), reply)
    given = scored.unionByName(counted)
    together = texts.groupBy("block").cogroup(given.groupBy("block"))
    assembled = _assemble(buckets, int(tokens) + ends, int(v) + (ends > 0), ends, to_arrow_type(kind))
    return together.applyInArrow(assembled, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long")
