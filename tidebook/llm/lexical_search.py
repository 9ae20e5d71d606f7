"""Ranked lexical search as a blocked sparse matrix product.

The left matrix has a row per item and the terms' multiplicities; the right one a
row per term and, for each document with it, an integer impact.  Documents are
packed into blocks (a term's postings beside each other), items into blocks of
sparse rows.  A task multiplies an item block with a document block row by row
(Gustavson): the postings of an item's terms, times weight and multiplicity, are
merged into one row of scores, of which the best few are kept.  Best rows are then
reduced over blocks.

The index holds only terms that items may have: a bitmap of hashes, of one fixed
size, goes to the tasks that read texts.  Where it lets other terms through, the
join of items' terms drops them.  Terms are 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_id, pack, tidy, unpack
from .scratch import materialize
from .text import ALNUM, string_chunks, word_hashes, word_spans

#: Bytes of text in a document block, about; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Items in an item block, about.
ITEMS = 512
#: Bits of the bitmap of items' terms (2 MB): its size doesn't depend on the data.
BITS = 24
#: Up to so many different (item, term) pairs (of 20 bytes) items travel to every
#: executor; more meet document blocks by a shuffle.
FEW_PAIRS = 200_000
#: Document blocks that share one copy of the items in that shuffle, about.
SHARE = 16
#: Partial results of an item are reduced over so many parts first.
PARTS = 64
#: Best rows are held for so many items at once in a task, then handed on.
HELD_ITEMS = 50_000


def _terms(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of a column: first row, hashes of all terms, where rows begin."""
    for first, _, data, offsets in string_chunks(column):
        starts, stops, at = word_spans(data, offsets, ALNUM)
        yield first, word_hashes(data, starts, stops), at


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@tidy
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, item_id, term, multiplicity``; ``row`` names a row of the items."""
    n = 0
    for batch in batches:
        for first, hashes, at in _terms(batch.column("text")):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            fresh = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))[: len(row)])
            times = np.diff(np.append(fresh, len(row)))
            row = row[fresh]
            named = pa.array((block_id(0) << 16) + n + first + row, pa.int64())
            yield pa.RecordBatch.from_pydict({"row": named, "item_id": batch.column("item_id").take(pa.array(first + row)), "term": pa.array(hashes[fresh].view(np.int64)), "times": pa.array(times, pa.int64())})
        n += len(batch)


INDEX = "block long, documents long, counted long, total long, ids binary, nameless binary, lengths binary, terms binary, ends binary, places binary, counts binary"
INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _index(wanted):
    """Document blocks: for each document its identifier and length, for each
    term that items may have its postings."""

    class Building:
        def __init__(self):
            self.ids, self.lengths, self.doc, self.term, self.bytes, self.n = [], [], [], [], 0, 0

        def add(self, ids: pa.Array, hashes: np.ndarray, at: np.ndarray, size: int) -> None:
            lengths = np.diff(at)
            bit = _bit(hashes)
            keep = (wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            self.doc.append((self.n + np.repeat(np.arange(len(lengths)), lengths)[keep]).astype(np.int64))
            self.term.append(hashes[keep])
            self.ids.append(ids)
            self.lengths.append(lengths)
            self.bytes += size
            self.n += len(lengths)

        def closed(self, sequence: int) -> pa.RecordBatch:
            doc, term = np.concatenate(self.doc), np.concatenate(self.term)
            order = np.lexsort((doc, term))
            doc, term = doc[order], term[order]
            change = np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))[: len(doc)]
            at = np.flatnonzero(change)
            counts, doc, term = np.diff(np.append(at, len(doc))), doc[at], term[at]
            ends = np.flatnonzero(np.append(term[1:] != term[:-1], True)[: len(term)]) + 1
            ids = pa.concat_arrays(self.ids)
            lengths = np.concatenate(self.lengths).astype("<i8")
            row = [block_id(sequence), self.n, int((lengths > 0).sum()), int(lengths.sum())]
            row += [pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")), pack(ids.is_null().to_numpy(zero_copy_only=False))]
            row += [pack(x.astype(k)) for x, k in ((lengths, "<i8"), (term[ends - 1], "<u8"), (ends, "<i8"), (doc, "<i4"), (counts, "<i4"))]
            types = [pa.int64()] * 4 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], INDEX_NAMES)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, block = 0, Building()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, hashes, at in _terms(batch.column("text")):
                block.add(ids.slice(first, len(at) - 1), hashes, at, 8 * len(hashes))
                if block.bytes >= BLOCK_BYTES:
                    yield block.closed(sequence)
                    sequence, block = sequence + 1, Building()
        if block.n:
            yield block.closed(sequence)

    return run


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, df`` of the blocks of a batch."""
    for batch in batches:
        found = {}
        for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            ends = unpack(ends, "<i8")
            found.setdefault("term", []).append(unpack(terms, "<u8"))
            found.setdefault("df", []).append(np.diff(ends, prepend=0))
        if found:
            term, at = np.unique(np.concatenate(found["term"]), return_inverse=True)
            df = np.zeros(len(term), np.int64)
            np.add.at(df, at, np.concatenate(found["df"]))
            yield pa.RecordBatch.from_pydict({"term": pa.array(term.view(np.int64)), "df": pa.array(df)})


def _item_rows(table: pa.Table) -> pa.Table:
    """An item block as sparse rows: ``row, item_id`` of each item, where its
    terms end, terms, and weight times multiplicity."""
    table = table.sort_by([("row", "ascending"), ("term", "ascending")])
    row = table.column("row").to_numpy()
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
    ids = table.column("item_id").combine_chunks().take(pa.array(ends - 1))
    out = [
        table.column("g")[0].as_py(),
        pack(row[ends - 1].astype("<i8")),
        pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")),
        pack(ids.is_null().to_numpy(zero_copy_only=False)),
        *(pack(x.astype("<i8")) for x in (ends, table.column("term").to_numpy(), table.column("factor").to_numpy())),
    ]
    names = ["g", "i_rows", "i_ids", "i_nameless", "i_ends", "i_terms", "i_factors"]
    return pa.table({n: pa.array([v], pa.int32() if n == "g" else pa.binary()) for n, v in zip(names, out, strict=True)})


ITEM_ROWS = "g int, i_rows binary, i_ids binary, i_nameless binary, i_ends binary, i_terms binary, i_factors binary"
BEST = "row long, item_id long, doc_id long, score long"


def measures(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document: 75 + (25 * length * N) div L, whatever the sizes."""
    if len(lengths) and int(lengths.max()) * 25 * n >= 1 << 63:
        return np.array([75 + 25 * int(x) * n // total for x in lengths], np.int64)
    return 75 + 25 * lengths * n // max(1, total)


def _product(n: int, total: int, top: int):
    """Of each pair of an item block and a document block, each item's best
    documents, merged over the blocks of a task."""

    class Best:
        def __init__(self):
            self.rows: dict[int, tuple] = {}

        def add(self, row: int, item: int | None, scores, ids, nameless) -> None:
            if row in self.rows:
                _, s, d, x = self.rows[row]
                scores, ids, nameless = np.append(s, scores), np.append(d, ids), np.append(x, nameless)
            if len(scores) > top:
                least = np.partition(scores, len(scores) - top)[len(scores) - top]
                near = np.flatnonzero(scores >= least)
                near = near[np.lexsort((ids[near], nameless[near], -scores[near]))[:top]]
                scores, ids, nameless = scores[near], ids[near], nameless[near]
            self.rows[row] = item, scores, ids, nameless

        def taken(self) -> pa.RecordBatch:
            held, self.rows = self.rows, {}
            sizes = [len(x[1]) for x in held.values()]
            items = [i for (i, *_), k in zip(held.values(), sizes, strict=True) for _ in range(k)]
            join = lambda at, kind: np.concatenate([np.zeros(0, kind), *(x[at] for x in held.values())]).astype(kind)
            ids = pa.array(join(2, np.int64), mask=join(3, bool))
            return pa.RecordBatch.from_pydict({"row": pa.array(np.repeat(np.array(list(held), np.int64), sizes)), "item_id": pa.array(items, pa.int64()), "doc_id": ids, "score": pa.array(join(1, np.int64))})

    def multiply(row: dict, best: Best) -> None:
        lengths, terms, ends = unpack(row["lengths"], "<i8"), unpack(row["terms"], "<u8").view(np.int64), unpack(row["ends"], "<i8")
        places, counts = unpack(row["places"], "<i4"), unpack(row["counts"], "<i4").astype(np.int64)
        ids, nameless = unpack(row["ids"], "<i8"), unpack(row["nameless"], bool)
        impacts = 1_000_000_000 * counts // (1000 * counts + 12 * measures(lengths, n, total)[places])
        starts, order = np.append(0, ends[:-1]), np.argsort(terms)
        i_rows, i_ids, i_nameless = unpack(row["i_rows"], "<i8"), unpack(row["i_ids"], "<i8"), unpack(row["i_nameless"], bool)
        i_ends, i_terms, i_factors = (unpack(row[f"i_{c}"], "<i8") for c in ("ends", "terms", "factors"))
        at = np.searchsorted(terms, i_terms, sorter=order) if len(terms) else np.zeros(len(i_terms), np.int64)
        at = order[np.minimum(at, len(terms) - 1)] if len(terms) else at
        has = terms[at] == i_terms if len(terms) else np.zeros(len(i_terms), bool)
        scores = np.zeros(len(lengths), np.int64)
        for k, (a, b) in enumerate(zip(np.append(0, i_ends[:-1]), i_ends, strict=True)):
            merged = []
            for j in range(a, b):
                if has[j]:
                    own = slice(starts[at[j]], ends[at[j]])
                    scores[places[own]] += i_factors[j] * impacts[own]
                    merged.append(places[own])
            if not merged:
                continue
            touched = np.concatenate(merged)
            found = np.flatnonzero(scores) if len(touched) > len(scores) else np.unique(touched)
            found = found[scores[found] > 0]
            best.add(int(i_rows[k]), None if i_nameless[k] else int(i_ids[k]), scores[found], ids[found], nameless[found])
            scores[touched] = 0

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best()
        for batch in batches:
            for i in range(len(batch)):
                multiply(batch.slice(i, 1).to_pylist()[0], best)
                if len(best.rows) > HELD_ITEMS:
                    yield best.taken()
        yield best.taken()

    return run


def _wanted(pairs: DataFrame) -> np.ndarray:
    """The bitmap of the items' terms, put together of at most 2**18 words."""
    bit = F.shiftrightunsigned("term", 64 - BITS)
    words = pairs.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return bitmap.view(np.uint8)


def search(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a
    score above 0, highest first, equal scores by ascending identifier.

    Terms are runs of ASCII letters, digits and non-ASCII characters, ASCII
    letters lower-cased; a null text has none.  With N documents that have terms,
    L terms in them, n in one of them, df documents with a term and tf of it in
    one: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), a document's
    m is 75 + (25 n N) div L, and its score sums, over an item's terms with their
    repeats, weight times (10**9 tf) div (1000 tf + 12 m), in 64-bit integers.

    Rows that repeat an item are items of their own; rows that repeat a document
    are documents of their own.  A document without an identifier comes after
    others of its score.  An empty table on either side gives an empty result.
    Columns not named are not read.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    pairs = materialize(asked.mapInArrow(_item_terms, "row long, item_id long, term long, times long"), "item-terms")
    bitmap = spark.sparkContext.broadcast(_wanted(pairs))
    texts = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text"))
    index = materialize(texts.mapInArrow(_index(bitmap), INDEX), "document-blocks")
    size = index.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("counted"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).head()

    df = index.select("terms", "ends").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * size["n"] + 2.0) / (2.0 * F.col("df") + 1.0)))
    count = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.approx_count_distinct("row").alias("items")).head()
    n_g = max(1, -(-count["items"] // ITEMS))
    weighed = pairs.join(df, "term").withColumn("factor", weight * F.col("times")).withColumn("g", F.pmod(F.xxhash64("row"), F.lit(n_g)).cast("int"))
    packed = materialize(weighed.select("g", "row", "item_id", "term", "factor").groupBy("g").applyInArrow(_item_rows, ITEM_ROWS), "item-blocks")
    columns = ["ids", "nameless", "lengths", "terms", "ends", "places", "counts"]
    if count["pairs"] <= FEW_PAIRS:
        met = index.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))).alias("g")).join(F.broadcast(packed), "g")
    else:
        shares = max(1, -(-size["blocks"] // SHARE))
        dealt = index.select(*columns, F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))).alias("g"))
        met = dealt.join(packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), ["g", "share"])
    best = met.mapInArrow(_product(size["n"], size["total"], top), BEST)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("row", "part").orderBy(*order)
    best = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
