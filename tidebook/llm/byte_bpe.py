"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding by
a join to the token-byte table.

1. Each text is split by the pre-token pattern.  A block of texts holds its
   pre-tokens as positions' codes into the block's own list of distinct words.
2. Distinct words travel by a hash of the word.  Every bucket encodes each of
   its distinct words once, whatever number of blocks holds it.
3. Ids return to the blocks, and each text is reassembled by position.
4. Decoding joins each distinct id of a block to its bytes in the token-byte
   table, and puts every text's bytes together by the positions of its ids.  The
   table has one row per token of a fixed file, so it is broadcast, and nothing
   is shuffled.

Steps 2 and 3 start from the same exchange of blocks, so that texts are split
once.  The vocabulary travels as its file (its size is fixed), read on the
driver; executors need no path.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_id, input_splits, pack, tidy, unpack, unvarint, varint
from .scratch import all_columns, materialize
from .text import string_chunks

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: A vocabulary file beyond this is refused rather than broadcast.
MOST_VOCABULARY_BYTES = 64 << 20

_cache: dict[bytes, object] = {}


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return data


def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, vocabulary.splitlines()))}


def _once(vocabulary: bytes, kind: str, build):
    key = hashlib.sha256(kind.encode() + vocabulary).digest()
    if key not in _cache:
        _cache[key] = build(_ranks(vocabulary))
    return _cache[key]


_NONE = 1 << 62


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Cuts of ``word``: of neighbouring parts those with the lowest rank become
    one, the first of equals first, until none has a rank."""
    cuts = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair and (best := min(pair)) < _NONE:
        i = pair.index(best)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[cuts[i] : cuts[i + 2]], _NONE)
        if i:
            pair[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], _NONE)
    return cuts


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs, for words that would make lists slow."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = after[i]
        if middle >= n or after[middle] != stop:  # one of its parts has grown or gone
            continue
        after[i], before[stop], after[middle] = stop, i, n
        for a, b in ((i, after[stop] if stop < n else None), (before[i], stop)):
            if a >= 0 and b is not None and (r := ranks.get(word[a:b])) is not None:
                heapq.heappush(heap, (r, a, b))
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(after[cuts[-1]])
    return cuts


def _merger(ranks: dict[bytes, int]):
    """Ids of one pre-token."""

    def merge(word: bytes) -> list[int]:
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        cuts = (_merge_short if len(word) <= 256 else _merge_long)(word, ranks)
        return [ranks[word[a:b]] for a, b in itertools.pairwise(cuts)]

    return merge


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces ``flat[start : start + length]`` end to end."""
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat[np.repeat(starts, lengths) + within]


def _split(pattern: str, buckets: int, id_type: pa.DataType):
    def words(block: int, index: dict[str, int]) -> pa.RecordBatch:
        encoded = [w.encode() for w in index]
        index.clear()
        at = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.int32, len(encoded))
        order = np.argsort(at, kind="stable")
        rows = [(int(at[own[0]]), own.tolist()) for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)]
        payload = []
        for _, own in rows:
            own_words = [encoded[i] for i in own]
            head = [varint(np.diff(np.array(own), prepend=0)), varint(np.array([len(w) for w in own_words]))]
            payload.append(pack(np.frombuffer(b"".join([*(len(h).to_bytes(8, "little") for h in head), *head, *own_words]), np.uint8)))
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.binary()), pa.array(payload, pa.binary())],
            ["block", "bucket", "ids", "lengths", "payload"],
        )

    def texts(block: int, ids: pa.Array, counts: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        payload = pack(np.frombuffer(varint(np.concatenate(codes)), np.uint8)) if codes else pack(np.zeros(0, np.uint8))
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.nulls(1, pa.int32()), lists, pa.array([varint(np.array(counts))], pa.binary()), pa.array([payload], pa.binary())],
            ["block", "bucket", "ids", "lengths", "payload"],
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        sequence, filled = 0, 0
        index: dict[str, int] = defaultdict(itertools.count().__next__)
        for batch in batches:
            ids, column = batch.column(0), pc.fill_null(batch.column(1), "")
            for first, rows, data, _ in string_chunks(column):
                counts, codes = [], []
                for text in column.slice(first, rows).to_pylist():
                    found = find(text)
                    counts.append(len(found))
                    codes.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
                yield texts(block_id(sequence), ids.slice(first, rows), counts, codes)
                filled += len(data)
                if filled >= BLOCK_BYTES:
                    yield words(block_id(sequence), index)
                    sequence, filled = sequence + 1, 0
                    index = defaultdict(itertools.count().__next__)
        if index:
            yield words(block_id(sequence), index)

    return tidy(split)


def _only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # All columns are taken, none is pruned and no filter moves below the
    # exchange: so this branch and the reassembly read one and the same exchange.
    for batch in batches:
        yield batch.filter(batch.column("bucket").is_valid()).select(["block", "bucket", "payload"])


def _unpacked_words(data: bytes) -> tuple[bytes, list[bytes]]:
    """Packed indices, and the words."""
    raw = unpack(data, np.uint8).tobytes()
    a, b = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    ends = np.cumsum(unvarint(raw[16 + a : 16 + a + b])).tolist()
    words, start, base = [], 0, 16 + a + b
    for end in ends:
        words.append(raw[base + start : base + end])
        start = end
    return raw[16 : 16 + a], words


def _encode(vocabulary):
    def encode(table: pa.Table) -> pa.Table:
        merge = _once(vocabulary.value, "merge", _merger)
        known: dict[bytes, bytes] = {}
        payload = []
        for data in table.column("payload"):
            indices, words = _unpacked_words(data.as_py())
            pieces = []
            for word in words:
                got = known.get(word)
                if got is None:
                    got = known[word] = array("I", merge(word)).tobytes()
                pieces.append(got)
            ids = np.frombuffer(b"".join(pieces), np.uint32)
            head = [indices, varint(np.array([len(p) // 4 for p in pieces]))]
            payload.append(pack(np.frombuffer(b"".join([*(len(h).to_bytes(8, "little") for h in head), *head, varint(ids)]), np.uint8)))
        return pa.table({"block": table.column("block"), "payload": pa.array(payload, pa.binary())})

    return tidy(encode)


def _with_dictionary(rows: pa.Table, packed: list[bytes | None]) -> pa.Table:
    """Rows, and after them one with the distinct ids of theirs."""
    used = np.unique(np.frombuffer(b"".join(p or b"" for p in packed), "<u4")).astype(np.int32)
    last = pa.table([pa.nulls(1, f.type) for f in rows.schema], names=rows.column_names)
    rows = rows.cast(last.schema).append_column("tokens", pa.nulls(len(rows), pa.list_(pa.int32())))
    return pa.concat_tables([rows, last.append_column("tokens", pa.array([used], pa.list_(pa.int32())))])


def _assemble(id_type: pa.DataType):
    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        where, lengths, flat = [], [], []
        for data in answers.column("payload"):
            raw = unpack(data.as_py(), np.uint8).tobytes()
            a, b = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
            where.append(np.cumsum(unvarint(raw[16 : 16 + a])))
            lengths.append(unvarint(raw[16 + a : 16 + a + b]))
            flat.append(unvarint(raw[16 + a + b :]).astype(np.uint32))
        none = np.zeros(0, np.int64)
        at, length = np.concatenate([none, *where]), np.concatenate([none, *lengths])
        flat = np.concatenate([none.astype(np.uint32), *flat])
        by_code, of_code = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        by_code[at], of_code[at] = np.cumsum(length) - length, length
        ids, tokens, packed = [], [], []
        for row in texts.filter(pc.is_null(texts.column("bucket"))).select(["ids", "lengths", "payload"]).to_batches():
            for i in range(row.num_rows):
                ids.append(row.column("ids").slice(i, 1).flatten())
                codes = unvarint(unpack(row.column("payload")[i].as_py(), np.uint8).tobytes())
                ends = np.concatenate([[0], np.cumsum(unvarint(row.column("lengths")[i].as_py()))])
                out = _gather(flat, by_code[codes], of_code[codes])
                upto = np.concatenate([[0], np.cumsum(of_code[codes])])[ends]
                raw = out.astype("<u4").tobytes()
                packed += [raw[4 * x : 4 * y] for x, y in itertools.pairwise(upto.tolist())]
                tokens += np.diff(upto).tolist()
        column = pa.chunked_array(ids, id_type) if ids else pa.array([], id_type)
        rows = pa.table({"doc_id": column, "n_tokens": pa.array(tokens, pa.int64()), "ids": pa.array(packed, pa.binary())})
        return _with_dictionary(rows, packed)

    return tidy(assemble)


def _encoded(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str, text_col: str, buckets: int | None) -> DataFrame:
    """``doc_id, n_tokens, ids``, and after the rows of each block one with their
    distinct ids in ``tokens``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    splits = input_splits(docs)
    if buckets is None:
        buckets = max(128, 4 * splits)
    table = spark.sparkContext.broadcast(vocabulary)
    split = rows.mapInArrow(_split(pattern, buckets, to_arrow_type(kind)), f"block long, bucket int, ids array<{kind.simpleString()}>, lengths binary, payload binary")
    split = split.repartition(max(splits, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    words = split.mapInArrow(_only_words, "block long, bucket int, payload binary")
    answers = words.groupBy("bucket").applyInArrow(_encode(table), "block long, payload binary")
    together = split.groupBy("block").cogroup(answers.groupBy("block"))
    return together.applyInArrow(_assemble(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_tokens long, ids binary, tokens array<int>")


def encode_texts(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, decode: bool = False, staged: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids are little-endian unsigned 32-bit integers
    in a binary column.  With ``decode`` the bytes that they stand for follow as
    ``decoded``, as by :func:`decode_ids`.

    Each match of ``pattern`` is merged separately by the ranks of
    ``vocabulary`` (the content of a rank file); there are no special tokens.
    A null or empty text has no tokens; a text of any length is encoded whole, in
    one task.  Rows are never joined by identifier, so
    identifiers may repeat or be null.  An empty table gives an empty result;
    columns not named are not read.  ``buckets`` of words follow the size of the
    input unless given, which bounds what one bucket holds.  ``staged`` writes the
    encoded rows before they are decoded, so that a task runs one Python function
    at a time: less memory, for the ids on disk.
    """
    encoded = _encoded(docs, vocabulary, pattern, id_col, text_col, buckets)
    if decode and staged:
        encoded = materialize(encoded, "encoded")
    return _decoded(encoded, vocabulary, "ids", "decoded") if decode else encoded.where("tokens is null").drop("tokens")


def token_bytes(spark: SparkSession, vocabulary: bytes) -> DataFrame:
    """``token, piece``: the token-byte table, a row per token."""
    ranks = _ranks(vocabulary)
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks.keys(), pa.binary())}))


def _bytes_of(packed: list[bytes | None], tokens: np.ndarray, pieces: pa.Array) -> list[bytes | None]:
    """``pieces`` of the ``tokens`` (in order), put together as the ids stand."""
    if pieces.null_count:
        raise ValueError("an id isn't in the token-byte table")
    lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8), np.cumsum(lengths) - lengths
    place_of = np.full(int(tokens[-1]) + 1 if len(tokens) else 0, -1, np.int64)
    place_of[tokens] = np.arange(len(tokens))
    out: list[bytes | None] = []
    for own in packed:
        ids = np.frombuffer(own or b"", "<u4")
        if len(ids) and int(ids.max()) >= len(place_of):
            raise ValueError("rows came without the tokens of their ids")
        place = place_of[ids]
        if len(ids) and place.min() < 0:
            raise ValueError("rows came without the tokens of their ids")
        out.append(None if own is None else _gather(flat, starts[place], lengths[place]).tobytes())
    return out


def _rejoin(names: list[str], ids_col: str, name: str):
    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, then their tokens with their bytes, then the next rows."""
        rows: list[pa.RecordBatch] = []
        tokens: list[pa.Array] = []
        pieces: list[pa.Array] = []

        def decoded() -> Iterator[pa.RecordBatch]:
            known = np.concatenate([t.to_numpy(zero_copy_only=False) for t in tokens]) if tokens else np.zeros(0, np.int32)
            found = pa.concat_arrays(pieces) if pieces else pa.array([], pa.binary())
            order = np.argsort(known, kind="stable")
            known, found = known[order], found.take(pa.array(order))
            for own in rows:
                out = _bytes_of(own.column(ids_col).to_pylist(), known, found)
                yield own.append_column(name, pa.array(out, pa.binary()))
            rows.clear(), tokens.clear(), pieces.clear()

        for batch in batches:
            at = np.flatnonzero(np.diff(batch.column("position").is_valid().to_numpy(zero_copy_only=False).astype(np.int8), prepend=-1, append=-1))
            for a, b in itertools.pairwise(at.tolist()):
                own = batch.slice(a, b - a)
                if own.column("position")[0].is_valid:
                    tokens.append(own.column("token"))
                    pieces.append(own.column("piece"))
                    continue
                if tokens:
                    yield from decoded()
                rows.append(pa.RecordBatch.from_arrays(own.column("own_row").flatten(), names))
        yield from decoded()

    return rejoin


def _decoded(encoded: DataFrame, vocabulary: bytes, ids_col: str, decoded_col: str) -> DataFrame:
    """Rows followed by their distinct ids, each of which is joined to its bytes;
    the join streams both through in that order."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    table = F.broadcast(token_bytes(encoded.sparkSession, vocabulary))
    own = encoded.drop("tokens")
    # A block without ids has no row of its tokens.
    row = F.when(F.col("tokens").isNull(), F.struct(*all_columns(own))).alias("own_row")
    each = encoded.where("tokens is null or size(tokens) > 0").select(row, F.posexplode_outer("tokens").alias("position", "token"))
    joined = each.join(table, "token", "left").select("own_row", "position", "token", "piece")
    return joined.mapInArrow(tidy(_rejoin(own.columns, ids_col, decoded_col)), StructType([*own.schema.fields, StructField(decoded_col, BinaryType())]))


def decode_ids(encoded: DataFrame, vocabulary: bytes, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids (little-endian unsigned 32-bit
    integers in a binary column) joined from the token-byte table.

    A null value decodes to null, an empty one to no bytes.  An id that the
    table lacks raises.  Columns of any name but ``tokens`` stay.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    if "tokens" in (c.lower() for c in encoded.columns):
        raise ValueError("a column is named tokens")

    def with_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _with_dictionary(pa.Table.from_batches([batch]), batch.column(ids_col).to_pylist()).to_batches()

    own = [StructField(f.name, f.dataType) for f in encoded.schema]  # null where tokens stand
    schema = StructType([*own, StructField("tokens", ArrayType(IntegerType()))])
    return _decoded(encoded.mapInArrow(tidy(with_dictionary), schema), vocabulary, ids_col, decoded_col)
