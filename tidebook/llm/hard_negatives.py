"""Hard-negative mining by a two-dimensional block matrix product.

Vectors are scaled to integers and dealt into blocks of rows; a block is cut into
chunks of dimensions.  The product of anchors and rows is tiled by (anchor block,
row block): a shuffle brings the chunks of a pair of blocks together, and their
products are added to an int64 tile.  This is done twice: for the best positives
of each anchor, then for the best negatives within each (anchor, positive) window.
Both are reduced by top-k, so only a few rows of a tile leave its task; the tiles
themselves, which grow with the square of the rows, never do.  A tile has a fixed
size, whatever the sizes of labels or the repetitions of a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_id, pack, tidy, unpack
from .scratch import materialize

#: Anchors and rows of a tile, about, and dimensions of a chunk.
ANCHORS = 256
ROWS = 4096
DIMENSIONS = 32
#: Rows of an input batch that share a number, by which repetitions spread.
STRETCH = 64
#: Components of a block at most.
CELLS = 1 << 22


def _scaled(scale: float):
    """Rows that take part: ``key, label, anchor, place, dims, vector`` (packed
    integers), ``place`` telling repetitions apart."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            vectors, out = batch.column("vector"), []
            for i in range(len(batch)):
                x = vectors[i].values
                x = None if x is None or x.null_count else np.asarray(x, np.float64)
                if x is not None and np.isfinite(x).all():
                    # Products of a vector's components stay below 2**56.
                    most = np.floor(np.sqrt(2.0**56 / max(1, len(x))))
                    out.append((i, np.clip(np.floor(scale * x), -most, most).astype("<i8")))
            at = [i for i, _ in out]
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": taken.column("key"),
                    "label": taken.column("label"),
                    "anchor": taken.column("anchor"),
                    "place": pa.array([block_id((place + i) // STRETCH) for i in at], pa.int64()),
                    "dims": pa.array([len(x) for _, x in out], pa.int64()),
                    "vector": pa.array([pack(x) for _, x in out], pa.binary()),
                }
            )
            place += len(batch)

    return run


def _narrow(a: np.ndarray) -> tuple[str, bytes]:
    """Integers in the fewest bytes that hold them all."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, pack(a.astype(kind))


BLOCK = "block int, chunk int, n int, keys binary, labels binary, kind string, data binary"


def _blocks(chunk: int):
    """The rows of a block, in order, as one matrix for each chunk of dimensions."""

    @tidy
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("label", "ascending"), ("place", "ascending"), ("vector", "ascending")])
        vectors = [unpack(v, "<i8") for v in table.column("vector").to_pylist()]
        chunks, out = max(1, -(-int(table.column("chunks")[0].as_py()) // chunk)), []
        keys, labels = (pack(table.column(c).to_numpy().astype("<i8")) for c in ("key", "label"))
        for c in range(chunks):
            data = np.zeros((len(vectors), chunk), np.int64)
            for i, v in enumerate(vectors):
                part = v[c * chunk : (c + 1) * chunk]
                data[i, : len(part)] = part
            kind, packed = _narrow(data)
            first = c == 0
            out.append((table.column("block")[0].as_py(), c, len(vectors), keys if first else None, labels if first else None, kind, packed))
        names = ["block", "chunk", "n", "keys", "labels", "kind", "data"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
        return pa.table({name: pa.array(column, t) for name, t, column in zip(names, types, zip(*out, strict=True), strict=True)})

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in 64-bit integers; by way of doubles where these are exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _opened(left: pa.Table, right: pa.Table, chunk: int) -> tuple[np.ndarray, ...] | None:
    """Scores of the anchors and rows of a pair of blocks, the products of their
    chunks added, and keys and labels of both; none where a block is empty."""
    if not len(left) or not len(right):
        return None
    sides, names = [], []
    for table in (left, right):
        rows = {r["chunk"]: r for r in table.select(["chunk", "keys", "labels", "kind", "data"]).to_pylist()}
        sides.append({c: unpack(r["data"], r["kind"]).reshape(-1, chunk) for c, r in rows.items()})
        names += [unpack(rows[0][n], "<i8") for n in ("keys", "labels")]
    total = None
    for c, x in sides[0].items():
        part = _product(x, sides[1][c])
        total = part if total is None else np.add(total, part, out=total)
    return (total, *names)


def _best(scores: np.ndarray, keys: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``able``, the ``k`` of highest score, smallest key first."""
    if len(able) > k:
        own = scores[able]
        able = able[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return able[np.lexsort((keys[able], -scores[able]))[:k]]


POSITIVES = "a int, place int, anchor_id long, positive_id long, positive_score long"
NEGATIVES = "a int, place int, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
_KINDS = {"int": pa.int32(), "long": pa.int64()}


def _table(columns: str, values: list) -> pa.Table:
    return pa.table({n: pa.array(v, _KINDS[kind]) for (n, kind), v in zip((c.split() for c in columns.split(", ")), values, strict=True)})


def _positives(k: int, chunk: int):
    """Of a pair of blocks, each anchor's best rows of its own label."""

    @tidy
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        opened = _opened(left, right, chunk)
        if opened is None:
            return _table(POSITIVES, [[]] * 5)
        tile, a_keys, a_labels, b_keys, b_labels = opened
        found = []
        for j in range(len(tile)):
            able = np.flatnonzero((b_labels == a_labels[j]) & (b_keys != a_keys[j]))
            best = _best(tile[j], b_keys, able, k)
            found.append((np.full(len(best), j), np.full(len(best), a_keys[j]), b_keys[best], tile[j][best]))
        place, anchor, key, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return _table(POSITIVES, [np.full(len(place), left.column("a")[0].as_py()), place, anchor, key, score])

    return run


def _negatives(k: int, low: int, high: int, chunk: int):
    """Of a pair of blocks, the best rows of other labels within each window; the
    windows come in a row beside the anchors' chunks."""

    @tidy
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = pc.is_valid(left.column("windows"))
        given = left.filter(own).column("windows").to_pylist()
        opened = _opened(left.filter(pc.invert(own)), right, chunk) if given else None
        if opened is None:
            return _table(NEGATIVES, [[]] * 8)
        tile, _, a_labels, b_keys, b_labels = opened
        (windows,), found = given, []
        for w, window in enumerate(windows):
            j, positive = window["place"], window["positive_score"]
            scores = tile[j]
            able = np.flatnonzero((low * positive <= 100 * scores) & (100 * scores <= high * positive) & (b_labels != a_labels[j]))
            best = _best(scores, b_keys, able, k)
            found.append((np.full(len(best), w), b_keys[best], scores[best]))
        of, key, score = (np.concatenate(x) for x in zip(*found, strict=True))
        named = [[windows[w][n] for w in of] for n in ("place", "nth", "anchor_id", "positive_id", "positive_score")]
        return _table(NEGATIVES, [np.full(len(of), left.column("a")[0].as_py()), *named, key, score])

    return run


def hard_negatives(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    block_anchors: int = ANCHORS,
    block_rows: int = ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.

    A component x counts as floor(scale * x); a row's score is its integer inner
    product with the anchor (of vectors of unequal lengths, the shorter counts as
    ended by zeros).  An anchor's positives are its best ``positives`` rows of its
    label with another identifier; for each of them, its negatives are the best
    ``negatives`` rows of another label whose score, times 100, is from
    ``window[0]`` to ``window[1]`` times the positive's.  Higher scores come first,
    then smaller identifiers; an anchor with few rows has fewer.  ``anchors``
    chooses anchors (by default, identifiers divisible by 100).

    Rows with a null identifier, label or vector, or null or non-finite components
    take no part.  Rows that repeat an identifier are rows of their own: each
    repeated anchor returns its rows.  An empty vector scores 0.  Components are
    clipped where products could pass 64 bits (at 2**28 / sqrt(dimensions) after
    scaling).  An empty table gives an empty result; other columns aren't read.
    """
    key, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long")
    chosen = anchors if anchors is not None else key % 100 == 0
    rows = embeddings.select(key.alias("key"), label.alias("label"), F.coalesce(chosen, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where("key is not null and label is not null and vector is not null")
    rows = materialize(rows.mapInArrow(_scaled(scale), "key long, label long, anchor boolean, place long, dims long, vector binary"), "scaled")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.coalesce(F.max("dims"), F.lit(0)).alias("dims")).head()
    # What a task holds of a block is bounded, however long vectors are.
    most = max(1, CELLS // max(1, size["dims"]))
    n_a, n_b = (max(1, -(-n // min(of, most))) for n, of in ((size["anchors"], block_anchors), (size["n"], block_rows)))

    def blocks(of: DataFrame, n: int, own: str, name: str) -> DataFrame:
        """Even blocks by a hash that also tells repetitions apart."""
        dealt = of.withColumn("block", F.pmod(F.xxhash64("key", "place"), F.lit(n)).cast("int")).withColumn("chunks", F.lit(size["dims"]))
        return materialize(dealt.groupBy("block").applyInArrow(_blocks(DIMENSIONS), BLOCK), name).withColumnRenamed("block", own)

    left, right = blocks(rows.where("anchor"), n_a, "a", "anchor-blocks"), blocks(rows, n_b, "b", "row-blocks")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def over_pairs(anchors: DataFrame, function, columns: str) -> DataFrame:
        """``function`` over the chunks of each pair of blocks.  Both sides are
        dealt by (a, b), so no key is hot, and neither is ever broadcast: with a
        row for each pair they are far larger than the tables that they are from."""
        sides = (df.withColumn(c, numbers(n)).groupBy("a", "b") for df, c, n in ((anchors, "b", n_b), (right, "a", n_a)))
        return next(sides).cogroup(next(sides)).applyInArrow(function, columns)

    best = Window.partitionBy("a", "place").orderBy(F.desc("positive_score"), "positive_id")
    found = over_pairs(left, _positives(positives, DIMENSIONS), POSITIVES)
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    # All windows of an anchor block: at most its anchors times ``positives``.
    windows = found.groupBy("a").agg(F.collect_list(F.struct("place", "nth", "anchor_id", "positive_id", "positive_score")).alias("windows"))
    windowed = left.unionByName(materialize(windows, "windows"), allowMissingColumns=True)
    mined = over_pairs(windowed, _negatives(negatives, *window, DIMENSIONS), NEGATIVES)
    order = Window.partitionBy("a", "place", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
