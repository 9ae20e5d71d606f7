"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

1. One scan hashes the shingle sets of a block of documents.  The block's
   distinct shingles travel, packed and by hash range, to be counted over all
   documents, and return as one frequency class (log2) per shingle.
2. Sets meet only if their prefixes share a shingle.  A prefix is the first
   ``n - ceil(t n) + 1`` shingles in order of frequency class, then hash.  The
   order is total, so no pair at or above the threshold is missed; that it puts
   rare shingles first keeps documents that share a passage, and no more, apart.
   Sets that meet at a shingle hang on the head of their run of compatible
   sizes, one row per set and shingle: no pairs are written.  Equal sets meet
   once, and a shingle of very many sets is dealt over salts.
3. Components of these edges bound where links can be.  Small ones share a bin,
   a large one is dealt over tiles of block pairs.  In each the incidence
   product is accumulated exactly, in row blocks; pairs below the size-derived
   overlap are discarded, and links leave as a spanning forest.
4. Components of the forests are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_id, input_splits, pack, tidy, tops, unite, unpack, unvarint, varint
from .components import connected_components
from .scratch import all_columns, keep, materialize, unused
from .text import mixed, shingle_sets, string_chunks

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Shingles that one task multiplies at once, and entries of one row block.
TILE, BLOCK = 500_000, 500_000
#: Parts into which a group of equal sets is split.
SALTS = 256
#: A shingle of 2 ** HOT_CLASS sets or more is dealt over salts, of so many each.
HOT_CLASS = 16


def _digests(shingles: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; None for an empty one."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles ^ np.uint64(c)))]) for c in (0x51ED270B1, 0xA24BAED4963EE407)]
    pairs = np.stack([s[at[1:]] - s[at[:-1]] for s in sums], axis=1)
    return [pairs[i].tobytes() if at[i + 1] > at[i] else None for i in range(len(pairs))]


class _Block:
    """Shingle sets of a block's documents; equal sets count once, by a row that
    has an identifier: one without links with nothing."""

    def __init__(self, k: int):
        self.k, self.seen, self.sets, self.filled = k, set(), [], 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None], np.ndarray]:
        shingles, at = shingle_sets(data, offsets, self.k)
        digests, new = _digests(shingles, at), np.zeros(len(at) - 1, bool)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        for i, d in enumerate(digests):
            if named[i] and d is not None and d not in self.seen:
                self.seen.add(d)
                new[i] = True
        self.sets.append(shingles[np.repeat(new, np.diff(at))])
        self.filled += len(data)
        return shingles, at, digests, new

    def distinct(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The upper ``bits`` of all shingles, in order, and in how many sets."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]) >> np.uint64(64 - bits), return_counts=True)


_FIELDS = ["block", "bucket", "ids", "lengths", "payload"]


def _scan(k: int, bits: int, bucket_bits: int):
    def shingles(block: int, sets: _Block) -> pa.RecordBatch:
        values, counts = sets.distinct(bits)
        edges = np.searchsorted(values, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(bits - bucket_bits))
        edges = np.append(edges, len(values)).tolist()
        rows, lengths, payload = [], [], []
        for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if y > x:
                rows.append(b)
                base = np.uint64(b << (bits - bucket_bits))
                payload.append(varint(np.diff(values[x:y] - base, prepend=np.uint64(0))))
                lengths.append(pack(np.frombuffer(varint(counts[x:y]), np.uint8)))
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array(rows, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.array(lengths, pa.binary()), pa.array(payload, pa.binary())], _FIELDS
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, sets = 0, _Block(k)
        for batch in batches:
            ids = batch.column(0)
            for first, rows, data, offsets in string_chunks(batch.column(1)):
                own = ids.slice(first, rows)
                sets.add(own, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block_id(sequence)]),
                        pa.nulls(1, pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), own),
                        pa.array([varint(np.diff(offsets))], pa.binary()),
                        pa.array([pack(data)], pa.binary()),
                    ],
                    _FIELDS,
                )
                if sets.filled >= BLOCK_BYTES:
                    yield shingles(block_id(sequence), sets)
                    sequence, sets = sequence + 1, _Block(k)
        yield shingles(block_id(sequence), sets)

    return tidy(scan)


def _only_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Takes all columns, so that this branch and the one over texts read one
    # and the same exchange.
    for batch in batches:
        yield batch.filter(batch.column("bucket").is_valid()).select(["block", "bucket", "lengths", "payload"])


def _frequencies(table: pa.Table) -> pa.Table:
    """For a range of hashes: the frequency class of each block's shingles."""
    values = [np.cumsum(unvarint(x.as_py())) for x in table.column("payload")]
    counts = [unvarint(unpack(x.as_py(), np.uint8)) for x in table.column("lengths")]
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    often = np.bincount(inverse, np.concatenate(counts))
    classes = np.log2(often).astype(np.uint8)[inverse]
    ends = np.cumsum([0, *map(len, values)])
    payload = [pack(classes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(payload, pa.binary())})


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64())), ("often", pa.list_(pa.int8())), ("text", pa.string())])


def _prefixes(k: int, percent: int, bits: int):
    def prefixes(texts: pa.Table, classes: pa.Table) -> pa.Table:
        """Every document's size and digest; and of one document for each set of
        the block, unless it can meet no other, its prefix with the classes of
        its shingles, and its text."""
        sets, pieces = _Block(k), []
        texts = texts.filter(pc.is_null(texts.column("bucket")))
        for i in range(texts.num_rows):
            ids = texts.column("ids")[i].values  # not numpy's: with a null its numbers are doubles
            offsets = np.concatenate([[0], np.cumsum(unvarint(texts.column("lengths")[i].as_py()))])
            data = unpack(texts.column("payload")[i].as_py(), np.uint8)
            pieces.append((ids, data, offsets, *sets.add(ids, data, offsets)))
        values, _ = sets.distinct(bits)
        classes = classes.sort_by("bucket").column("payload")
        often = np.concatenate([np.zeros(0, np.uint8), *(unpack(x.as_py(), np.uint8) for x in classes)])
        out = []
        for ids, data, offsets, shingles, at, digests, new in pieces:
            sizes = np.diff(at)
            rows = len(sizes)
            out.append(pa.table([ids, pa.array(sizes), pa.array(digests, pa.binary()), *(pa.nulls(rows, t) for t in _OUT.types[3:])], schema=_OUT))
            own, counted = np.zeros(len(shingles), np.uint8), np.repeat(new, sizes)
            own[counted] = often[np.searchsorted(values, shingles[counted] >> np.uint64(64 - bits))]
            rank = (own.astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
            picked, owners = [], []
            for i in np.flatnonzero(new):
                a, n = int(at[i]), int(sizes[i])
                first = n - (percent * n + 99) // 100 + 1
                if np.count_nonzero(own[a : a + n] == 0) >= first:
                    continue
                order = np.argsort(rank[a : a + n], kind="stable")[:first]
                picked.append(a + order[own[a + order] > 0])  # a shingle of one set joins nothing
                owners.append(i)
            if picked:
                each, places = np.array(owners), np.concatenate(picked)
                ends = pa.array(np.cumsum([0, *map(len, picked)]).astype(np.int32))
                whole = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in owners]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (shingles[places].view(np.int64), own[places].view(np.int8))]
                out.append(pa.table([ids.take(pa.array(each)), pa.array(sizes[each]), pa.array([digests[i] for i in owners], pa.binary()), *lists, pa.array(whole, pa.string())], schema=_OUT))
        return pa.concat_tables(out) if out else _OUT.empty_table()

    return tidy(prefixes)


def sparse_links(shingles: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first set of its component under links of at least
    ``percent``, by row blocks of the incidence product."""
    m = len(at) - 1
    root = np.arange(m)
    sizes = np.diff(at)
    doc = np.repeat(np.arange(m), sizes)
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([head, [len(ordered)]]))
    column = np.empty(len(shingles), np.int64)
    column[order] = np.repeat(np.arange(len(head)), length)
    posting = doc[order]
    a = 0
    while a < m:
        # A block: rows whose counters and expanded postings both stay bounded.
        b, spread = a, 0
        while b < m and (b == a or (spread < BLOCK and (b - a + 1) * m <= 4 * BLOCK)):
            spread += int(length[column[at[b] : at[b + 1]]].sum())
            b += 1
        entries = column[at[a] : at[b]]
        many = length[entries] > 1
        entries, rows = entries[many], doc[at[a] : at[b]][many] - a
        counts = length[entries]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        other = posting[np.repeat(head[entries], counts) + within]
        overlap = np.bincount(np.repeat(rows, counts) * m + other, minlength=(b - a) * m).reshape(b - a, m)
        bound = percent * (sizes[a:b, None] + sizes[None, :])
        linked = (overlap > 0) & ((100 + percent) * overlap >= bound)
        for i in range(a, b):
            unite(root, np.append(np.flatnonzero(linked[i - a]), i))
        a = b
    return tops(root, root)


def _product(k: int, percent: int):
    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids = table.column("rep").to_numpy()
        sets, ends, n = [], [0], 0
        for _, _, data, offsets in string_chunks(table.column("text")):
            shingles, at = shingle_sets(data, offsets, k)
            sets.append(shingles)
            ends.extend((at[1:] + n).tolist())
            n += len(shingles)
        root = sparse_links(np.concatenate(sets), np.array(ends), percent)
        hung = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(ids[hung]), "b": pa.array(ids[root[hung]])})

    return tidy(product)


def _runs(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """``head``: the first row of the run of compatible sizes that a row of
    ``rep, least, most`` (sizes) is in, among those of its ``keys``."""
    along = Window.partitionBy(*keys).orderBy("least", "rep")
    before = F.max("most").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("least") * percent > before * 100, F.lit(True))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("opens", opens).withColumn("head", F.last(F.when(F.col("opens"), F.col("rep")), ignorenulls=True).over(upto)).drop("opens")


def _meetings(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: sets, of ``rep, n, prefix, often``, that hang together at a
    shingle of their prefixes.  A shingle of very many sets is dealt over salts;
    the runs of its salts then hang together as sets do."""
    each = sets.select("rep", F.col("n").alias("least"), F.col("n").alias("most"), F.explode(F.arrays_zip("prefix", "often")).alias("x"))
    salts = F.pow(F.lit(2.0), F.greatest(F.col("x.often").cast("int") - HOT_CLASS, F.lit(0))).cast("long")
    each = each.select("rep", "least", "most", F.col("x.prefix").alias("shingle"), salts.alias("salts"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    first = _runs(each, ["shingle", "salt"], percent)
    edges = first.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    hot = first.where("salts > 1").groupBy("shingle", "salt", "head").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    again = _runs(hot.withColumnRenamed("head", "rep"), ["shingle"], percent).where("rep <> head")
    return edges.unionByName(again.select(F.col("rep").alias("a"), F.col("head").alias("b"))).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each input row.

    A document's set is its distinct shingles of ``k`` words (A-Z lower-cased,
    cut at ASCII white space); with fewer words the whole sequence is the one
    shingle; without words, or with a null text, the set is empty and links with
    nothing.  Two sets link if 100 x intersection >= ``percent`` x union.  The
    component is the smallest identifier reachable by links, the document's own
    included.  Equal sets are one node, so copies cost nothing.  Identifiers are
    integers; rows repeating one are the same node, and a row with a null
    identifier links with nothing and has a null component.  Sets of any size are
    compared whole; a pair exactly at ``percent`` links.  An empty table
    gives an empty result; columns not named are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    partitions = input_splits(docs)
    bucket_bits = max(6, math.ceil(math.log2(2 * partitions + 1)))
    # Enough bits that few shingles of a block are counted with another; a
    # shared count can only move a shingle in the order, never lose a pair.
    bits = min(42, 34 + math.ceil(math.log2(partitions + 1)))
    scanned = texts.mapInArrow(_scan(k, bits, bucket_bits), "block long, bucket int, ids array<long>, lengths binary, payload binary")
    scanned = scanned.repartition(max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    counted = scanned.mapInArrow(_only_shingles, "block long, bucket int, lengths binary, payload binary")
    counted = counted.groupBy("bucket").applyInArrow(_frequencies, "block long, bucket int, payload binary")
    blocks = scanned.groupBy("block").cogroup(counted.groupBy("block"))
    blocks = keep(blocks.applyInArrow(_prefixes(k, percent, bits), "doc_id long, n long, digest binary, prefix array<long>, often array<tinyint>, text string"))

    sets = blocks.where("text is null").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    # Equal sets find their smallest identifier by way of salted groups, so that
    # a task holds no more of one digest than a salt does.
    sets = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = sets.where("digest is not null and doc_id is not null").groupBy("digest", "salt").agg(F.min("doc_id").alias("rep"))
    least = salted.groupBy("digest").agg(F.min("rep").alias("rep"))
    classes = salted.drop("rep").join(least, "digest")
    member = materialize(sets.join(classes, ["digest", "salt"], "left").select("doc_id", "n_shingles", "rep"), "jaccard-members")
    # Of blocks that know a set, one speaks for it: a copied text meets others once.
    known = blocks.where("text is not null")
    speaks = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(least, "digest")
    spoken = materialize(known.select("digest", "doc_id", "n", "prefix", "often").join(speaks, ["digest", "doc_id"]).dropDuplicates(["digest"]), "jaccard-prefixes")
    met = connected_components(_meetings(spoken, percent))

    size = spoken.groupBy("rep").agg(F.max("n").alias("n"))
    met = materialize(met.join(size, F.col("node") == F.col("rep")).select("node", "component", "n"), "jaccard-met")
    totals = met.groupBy("component").agg(F.ceil(F.sum("n") / TILE).cast("long").alias("blocks"))
    bins = int(met.agg(F.coalesce(F.ceil(F.sum("n") / TILE), F.lit(0))).head()[0]) + 1
    met = met.join(totals, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))
    met = met.withColumn("other", F.explode(others)).select(
        "node",
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("bin"),
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
    )
    chosen = spoken.join(met.select(F.col("node").alias("rep")).distinct(), "rep", "left_semi").select("digest", "doc_id", "rep")
    told = known.select("digest", "doc_id", "text").join(chosen, ["digest", "doc_id"]).select("rep", "text")
    tiles = met.join(told, F.col("node") == F.col("rep")).select("bin", "i", "j", "rep", "text")
    links = tiles.groupBy("bin", "i", "j").applyInArrow(_product(k, percent), "a long, b long")
    # A repeated identifier is one node, whatever its texts.
    twice = member.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    links = links.unionByName(member.join(twice, "doc_id").select("a", F.col("rep").alias("b")))
    found = connected_components(links).withColumnRenamed("node", "rep")
    return member.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, of each component the smallest
    identifier, with all their columns.

    Rows repeating an identifier are one document, which stays or goes as a
    whole, be their texts equal or not; rows with a null identifier stay, and so
    do texts without words.  An empty table gives an empty result; columns of any
    name stay.
    """
    gone = jaccard_components(docs, id_col, text_col, **options).where("doc_id <> component_id").select("doc_id").distinct()
    key = unused("near_key", docs)
    own = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    left = own.join(gone.withColumnRenamed("doc_id", key), key, "left_anti")
    return left.select(*all_columns(docs))
