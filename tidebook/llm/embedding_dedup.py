"""Near-duplicate embeddings by product quantisation with exact bounds.

1. Equal vectors of a label collapse to one with a multiplicity.
2. Coarse centroids and residual codebooks are fitted on a bounded sample; then
   every vector gets its inverted list (label and nearest centroid), its residual
   codes, and the distance between it and its coded self.
3. A vector probes each list whose Voronoi cell is no farther than half the
   linking radius, by the bisector of both centroids.  Of a linked pair that a
   bisector parts, the distances to it sum to the radius at most, so one end
   probes the other's list and no link is lost; if both do, one of them counts.
4. In a list, table-lookup distances to the codes, with the coding error added,
   leave candidates, and lose none; exact cosines decide.
5. A list is dealt over tiles: chunks of its own vectors against chunks of the
   vectors that query it, both of bounded size.  Of links only counts and a
   spanning forest leave a tile, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import tops, unite
from .components import connected_components
from .scratch import keep, materialize

#: Distinct vectors on which centroids and codebooks are fitted, about, or so many
#: for each centroid if that is more.
SAMPLE_ROWS, SAMPLE_OF_LIST = 20_000, 16
#: Vectors of a list that one tile indexes, vectors that query them there, and
#: distances held at once.
CHUNK, QUERIES, PAIRS = 2048, 16_384, 1 << 21
#: Coarse centroids are the root of the number of vectors, and so many at most
#: (they are fitted on the driver and travel to all); subspaces, and codes of one.
MOST_LISTS, SUBSPACES, CODES = 1 << 14, 16, 64
SALTS = 256
#: Share of the linking radius by which lists are probed, from both sides of a
#: bisector: 0.5 is exact for any data, more probes in vain, less loses links.
MARGIN = 0.5


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, PAIRS // max(1, len(centres)))
    return np.concatenate([_squares(x[i : i + step], centres).argmin(axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray
    books: tuple[np.ndarray, ...]
    cuts: tuple[int, ...]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and distance between residual and its coded self."""
        codes = np.zeros((len(residual), len(self.books)), np.uint8)
        error = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = _nearest(part, book)
            error += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of a query's residual to all codes, by subspace."""
        return [_squares(residual[:, self.cuts[m] : self.cuts[m + 1]], book) for m, book in enumerate(self.books)]


def fit(x: np.ndarray, lists: int) -> Quantiser:
    centroids = _kmeans(x, lists)
    residual = x - centroids[_nearest(x, centroids)]
    parts = min(SUBSPACES, x.shape[1])
    cuts = tuple(int(c) for c in np.linspace(0, x.shape[1], parts + 1))
    return Quantiser(centroids, tuple(_kmeans(residual[:, cuts[m] : cuts[m + 1]], CODES) for m in range(parts)), cuts)


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as doubles; None for one that is null, zero or not finite."""
    out = []
    for v in column:
        v = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _prepare(kind: str):
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [None if not label.is_valid else v for v, label in zip(_rows(batch.column(2)), batch.column(1), strict=True)]
            vectors = [None if v is None else (v + 0.0).astype(kind).tobytes() for v in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "vector"])

    return prepare


def _units(column, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v.as_py(), kind) for v in column]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(quantiser, radius: float, margin: float, kind: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = quantiser.value
        step = max(1, PAIRS // (2 * len(q.centroids)))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            x = _units(batch.column("vector"), kind)
            squares = _squares(x, q.centroids)
            home = squares.argmin(axis=1)
            codes, error = q.encode(x - q.centroids[home])
            near, inverse = np.unique(home, return_inverse=True)
            between = np.sqrt(_squares(q.centroids[near], q.centroids))
            reach = squares - squares[np.arange(len(x)), home][:, None] <= 2 * radius * margin * between[inverse] + 1e-9
            reach[np.arange(len(x)), home] = False
            probes = [np.flatnonzero(r).astype(np.int32) for r in reach]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("rep", "label", "copies", "vector")),
                    pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                    pa.array(probes, pa.list_(pa.int32())),
                ],
                ["rep", "label", "copies", "vector", "home", "codes", "error", "probes"],
            )

    return assign


def _search(quantiser, least: float, radius: float, kind: str):
    def search(table: pa.Table) -> pa.Table:
        q: Quantiser = quantiser.value
        table = table.sort_by([("indexed", "descending"), ("rep", "ascending")])
        held = int(np.count_nonzero(table.column("indexed").to_numpy()))
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        # Pairs within the index are those of one of its tiles.
        first = 0 if table.column("part")[0].as_py() == 0 else held
        if held and len(ids) > max(1, first):
            x = _units(table.column("vector"), kind)
            centre = q.centroids[table.column("list")[0].as_py()]
            codes = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in table.column("codes").slice(0, held)])
            limit = radius + table.column("error").to_numpy()[:held] + 1e-6
            # Pairs that both ends find count from the smaller list's side.
            own, home = table.column("list")[0].as_py(), table.column("home").to_numpy()
            probed = np.zeros((held, len(q.centroids)), bool)
            probes = pc.list_parent_indices(table.column("probes").slice(0, held).combine_chunks()).to_numpy()
            probed[probes, pc.list_flatten(table.column("probes").slice(0, held)).to_numpy()] = True
            step = max(1, PAIRS // held)
            for a in range(first, len(ids), step):
                b = min(len(ids), a + step)
                squares = np.zeros((b - a, held))
                for m, lookup in enumerate(q.tables(x[a:b] - centre)):
                    squares += lookup[:, codes[:, m]]
                near = squares <= limit[None, :] ** 2
                # Within the index each pair once: the later against the earlier.
                near &= np.arange(held)[None, :] < np.arange(a, b)[:, None]
                later = np.flatnonzero(home[a:b] > own)
                near[later] &= ~probed[:, home[a + later]].T
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                linked = np.concatenate([np.einsum("ij,ij->i", x[a + i[s : s + PAIRS // 64]], x[j[s : s + PAIRS // 64]]) for s in range(0, len(i), PAIRS // 64)]) >= least
                i, j = a + i[linked], j[linked]
                counts += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
                for s, t in zip(edges[:-1], edges[1:], strict=True):
                    unite(root, np.append(j[s:t], i[s]))
        some, root = np.flatnonzero(counts), tops(root, root)
        return pa.table({"rep": pa.array(ids[some]), "links": pa.array(counts[some]), "root": pa.array(ids[root[some]])})

    return search


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, margin: float = MARGIN, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each input row.

    Vectors of one label link if their cosine, in double precision, is at least
    ``least``.  Rows with a null label, or whose vector is null, empty, zero or
    has null or non-finite components, link with nothing.  ``component_id`` is
    the smallest identifier reachable by links, the row's own included.  Vectors
    have one length (another length raises).  Identifiers are integers; a row
    with a null identifier links with nothing, has a null component and is kept.
    Rows repeating an identifier are vectors of their own that share a node.  An
    empty table gives an empty result; columns not named are not read.
    """
    spark = embeddings.sparkSession
    # Vectors travel in the width they came in; arithmetic is in double precision.
    given = embeddings.schema[vector_col].dataType
    kind = "<f4" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "<f8"
    radius = float(np.sqrt(2 - 2 * least)) + 1e-9
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(_prepare(kind), "vec_id long, label string, vector binary")
    rows = rows.withColumn("digest", F.unhex(F.sha2("vector", 256))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    rows = keep(rows)
    able = rows.where("vector is not null and vec_id is not null")
    salted = able.groupBy("label", "digest", "salt").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    distinct = salted.groupBy("label", "digest").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"), F.first("vector").alias("vector"))
    distinct = keep(distinct)

    n = distinct.count()
    found = None
    if n:
        lists = int(min(MOST_LISTS, max(8, np.sqrt(n))))
        share = float(1 << 30) * max(sample_rows, SAMPLE_OF_LIST * lists) / n
        chosen = distinct.where(F.pmod(F.xxhash64("label", "digest"), F.lit(1 << 30)) < share)
        sample = chosen.select("label", "digest", "vector").toArrow().sort_by([("label", "ascending"), ("digest", "ascending")])
        if not sample.num_rows:  # a few vectors can all miss the share
            sample = distinct.limit(1).select("vector").toArrow()
        quantiser = spark.sparkContext.broadcast(fit(_units(sample.column("vector"), kind), lists))
        schema = "rep long, label string, copies long, vector binary, home int, codes binary, error double, probes array<int>"
        coded = keep(distinct.select("rep", "label", "copies", "vector").mapInArrow(_assign(quantiser, radius, margin, kind), schema))
        # How many chunks of its own, and of queries from elsewhere, a list has.
        count = F.count(F.lit(1))
        sizes = coded.groupBy("label", F.col("home").alias("list")).agg(F.ceil(count / CHUNK).cast("int").alias("chunks"))
        asked = coded.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.ceil(count / QUERIES).cast("int").alias("parts"))
        sizes = materialize(sizes.join(asked, ["label", "list"], "left").fillna(1, ["parts"]), "list-sizes")
        spread = F.xxhash64("rep")
        own = coded.withColumn("list", F.col("home")).join(sizes, ["label", "list"]).withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
        # A tile: chunk against part; part 0 has pairs within the chunk and the
        # first queries, others further queries, and -j a later chunk j.
        chunks, parts = F.sequence(F.lit(0), F.col("chunks") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
        against = F.concat(parts, F.transform(F.filter(chunks, lambda c: c > F.col("chunk")), lambda c: -c))
        indexed = own.withColumn("part", F.explode(against))
        later = own.withColumn("part", -F.col("chunk")).withColumn("chunk", F.explode(F.filter(chunks, lambda c: c < F.col("chunk"))))
        away = coded.withColumn("list", F.explode("probes")).join(sizes, ["label", "list"])
        away = away.withColumn("part", F.pmod(spread, F.col("parts")).cast("int")).withColumn("chunk", F.explode(chunks))
        columns = ["label", "list", "chunk", "part", "rep", "copies", "vector", "home", "codes", "error", "probes"]
        tiles = indexed.select(*columns, F.lit(True).alias("indexed"))
        for queries in (later, away):
            bare = queries.withColumns({"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double"), "probes": F.lit(None).cast("array<int>")})
            tiles = tiles.unionByName(bare.select(*columns, F.lit(False).alias("indexed")))
        found = tiles.groupBy("label", "list", "chunk", "part").applyInArrow(_search(quantiser, least, radius, kind), "rep long, links long, root long")
        found = keep(found)
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
        classes = salted.select("label", "digest", "salt").join(distinct.drop("vector"), ["label", "digest"]).join(counts, "rep", "left").join(component, "rep", "left")
        rows = rows.join(classes, ["label", "digest", "salt"], "left").drop("vector")
    else:
        blank = {"rep": "long", "copies": "long", "links": "long", "component": "long"}
        rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    linked = F.col("vec_id").isNotNull() & F.col("rep").isNotNull()
    group = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    links = F.when(linked, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select("vec_id", links.alias("n_links"), group.alias("component_id"), F.col("vec_id").eqNullSafe(group).alias("kept"))
