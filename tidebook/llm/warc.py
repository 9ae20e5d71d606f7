"""WARC archives: a deterministic sharded writer, and a reader.

Writing range-sorts the records by identifier into shards, rolls files by
compressed size, and regenerates every header and digest from the data, so that
a rerun gives the same bytes.  Shards are cut where the exact running sum of
bytes, over identifiers in order, passes a multiple of the shard size: whatever
the identifiers are, and however the input is partitioned.  Each shard is one
task's.  A file is written under a temporary name and renamed when complete; it
counts only once the manifest, renamed into place last, leads to its name.  A
task that runs again rewrites the same names with the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Payload bytes of a shard, compressed bytes at which a file is closed.
SHARD_BYTES, FILE_BYTES = 32 << 20, 16 << 20
#: Bytes of a record besides its payload, about.
RECORD_BYTES = 512
#: Shards at most: their cuts (two numbers each) travel to all tasks.  Beyond,
#: shards grow; files don't.
MOST_SHARDS = 1 << 20
#: Parts into which a group of equal payloads is split.
SALTS = 256
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_KEY = ["page_id", "url", "digest"]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: tuple[int, str | None] | None, date: str = DATE) -> bytes:
    """The bytes of one record.  ``revisit``: identifier and address of the
    response that it refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(*revisit, digest))]
        if revisit[1] is not None:
            headers.append(("WARC-Refers-To-Target-URI", _clean(revisit[1])))
        headers.append(("X-Refers-To-Page-ID", str(revisit[0])))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


def _info_record(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\nsoftware: tidebook\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


class _ShardWriter:
    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.system, self.path = _open(folder)
        self.shard, self.file_bytes, self.date = shard, file_bytes, date
        self.sequence, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.sequence:04d}.warc.gz"
            self.held = f"{self.path}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.hash = self.system.open_output_stream(self.held), 0, 0, hashlib.sha256()
            self._put(_info_record(self.name, self.date))
        self._put(record)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def _put(self, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.held, f"{self.path}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.hash.hexdigest()))
            self.out, self.sequence = None, self.sequence + 1


def _writer(folder: str, file_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, key, done = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None or writer.shard != r["shard"]:
                    if writer is not None:
                        writer.close()
                        done += writer.done
                    writer = _ShardWriter(folder, r["shard"], file_bytes, date)
                own = (r["shard"], r["page_id"], r["url"], r["digest"])
                if own != key:
                    key, every, first, target = own, True, False, None
                if r["kind"] == 0:
                    every, first, target = not r["revisit"], r["wins"], (r["refers_to"], r["refers_url"])
                    continue
                # Rows that agree in all of these are alike: if one of them is
                # the response, any is.
                revisit, first = (None if every or first else target), False
                digest = base64.b32encode(r["digest"]).decode()
                writer.add(page_record(r["page_id"], r["url"], r["payload"] or b"", digest, revisit, date))
        if writer is not None:
            writer.close()
            done += writer.done
        if done:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "file", "records", "bytes", "sha256"])

    return write


def _decisions(facts: DataFrame, least_bytes: int) -> DataFrame:
    """For rows that are alike: whether they revisit, what, and whether the first
    of them is the response that the others revisit.  Large groups of equal
    payloads meet by way of salted groups."""
    able = F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes)
    keys = facts.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    salted = keys.where(able).groupBy("digest", "salt").agg(F.min(F.struct("page_id", "url")).alias("winner"))
    winners = salted.drop("winner").join(salted.groupBy("digest").agg(F.min("winner").alias("winner")), "digest")
    keys = keys.join(winners, ["digest", "salt"], "left")
    revisit = F.coalesce(able & F.col("winner").isNotNull(), F.lit(False))
    wins = revisit & F.col("winner").eqNullSafe(F.struct("page_id", "url"))
    return keys.select(*_KEY, "h", revisit.alias("revisit"), wins.alias("wins"), F.when(revisit, F.col("winner.page_id")).alias("refers_to"), F.when(revisit, F.col("winner.url")).alias("refers_url"))


def _cuts(facts: DataFrame, shard_bytes: int) -> pa.Table:
    """``page_id, h`` at which each shard begins, in order (null identifiers
    come first): by running sums within ranges of (page_id, h), and of ranges.
    Rows that are alike and together larger than a shard have a cut for each
    shard that they fill."""
    spots = facts.groupBy("page_id", "h").agg(F.sum(F.col("copies") * (F.col("payload_bytes") + RECORD_BYTES)).alias("held"))
    spots = materialize(spots.repartitionByRange("page_id", "h").withColumn("range", F.spark_partition_id()), "warc-spots")
    total = spots.agg(F.coalesce(F.sum("held"), F.lit(0))).head()[0]
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = spots.groupBy("range").agg(F.sum("held").alias("whole")).select("range", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy("page_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("offset") + F.coalesce(F.sum("held").over(inside), F.lit(0))
    placed = spots.join(ranges, "range").withColumn("shard", F.floor(at / shard_bytes).cast("long"))
    parts = F.ceil(F.col("held") / shard_bytes).cast("int")
    spot = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "h")
    firsts = placed.groupBy("shard").agg(F.min(spot).alias("first"), F.min(F.struct(spot.alias("spot"), parts.alias("parts"))).alias("own"))
    cuts = firsts.select("first.*", F.when(F.col("own.parts") > 1, F.col("own.parts")).otherwise(1).alias("parts"))
    large = placed.where(parts > 1).select(spot.alias("first"), parts.alias("parts")).select("first.*", "parts")
    cuts = cuts.unionByName(large).groupBy("named", "page_id", "h").agg(F.max("parts").alias("parts"))
    return cuts.select("named", "page_id", "h", F.explode(F.sequence(F.lit(1), F.col("parts")))).orderBy("named", "page_id", "h").select("page_id", "h").toArrow()


def _shards_of(cuts: pa.Table):
    """Of (page_id, h): the first and the last shard that may have it.  There is
    more than one only for a pair with several cuts."""
    named = cuts.column("page_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    ids, hashes = cuts.column("page_id").combine_chunks().fill_null(0).to_numpy(), cuts.column("h").to_numpy()
    nameless = int(np.count_nonzero(~named))

    def shards_of(page_id: pa.Array, h: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own, spread = page_id.fill_null(0).to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        has = page_id.is_valid().to_numpy(zero_copy_only=False)
        low = np.where(has, nameless + np.searchsorted(ids[nameless:], own, "left"), 0)
        high = np.where(has, nameless + np.searchsorted(ids[nameless:], own, "right"), nameless)
        first = high - 1  # the last cut not after the row
        last = first.copy()
        # Among cuts of one identifier the hash decides.
        pairs, inverse = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        for i in np.flatnonzero(pairs[1] > pairs[0]):
            rows = np.flatnonzero(inverse == i)
            among = hashes[pairs[0, i] : pairs[1, i]]
            last[rows] = pairs[0, i] + np.searchsorted(among, spread[rows], "right") - 1
            first[rows] = np.minimum(pairs[0, i] + np.searchsorted(among, spread[rows], "left"), last[rows])
        return np.maximum(first, 0).astype(np.int32), np.maximum(last, 0).astype(np.int32)

    return shards_of


def _all_shards(shards_of):
    @F.arrow_udf("array<int>")
    def every(page_id: pa.Array, h: pa.Array) -> pa.Array:
        first, last = shards_of(page_id, h)
        return pa.array([np.arange(a, b + 1, dtype=np.int32) for a, b in zip(first, last, strict=True)], pa.list_(pa.int32()))

    return every


def _own_shard(shards_of):
    """A task deals rows that are alike over their shards in turn.  It begins with
    the first shard, so that this one, which has the response, gets a row."""
    turn: dict[int, int] = {}

    def own_shard(page_id: pa.Array, h: pa.Array) -> pa.Array:
        first, last = shards_of(page_id, h)
        out = first.copy()
        several = np.flatnonzero(last > first)
        for a in np.unique(first[several]).tolist():
            rows = several[first[several] == a]
            begun = turn.get(a, 0)
            out[rows] = a + (begun + np.arange(len(rows))) % (int(last[rows[0]]) - a + 1)
            turn[a] = begun + len(rows)
        return pa.array(out)

    return F.arrow_udf(own_shard, "int").asNondeterministic()


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write ``pages`` to ``folder`` (a URI) and return the manifest: ``shard,
    file, records, bytes, sha256``.

    A null payload is the empty one.  Of equal payloads of at least
    ``least_revisit_bytes`` the smallest (identifier, address) is the response,
    the others revisit it, rows repeating both included.  A row with a null
    identifier is a response and is never referred to; a null address leaves its
    header out.  An empty table gives an empty manifest.  Columns not named,
    whatever their names, are not read.  Rows of one identifier may fill any
    number of shards; how many of those that are alike in address and payload too
    each of their shards has depends on the input's partitions, the records don't.

    ``manifest.json`` names the table of files (JSON lines, written by Spark) and
    counts them; it is put in place last.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", F.unhex(F.sha1("payload")).alias("digest"), "payload")
    spread = F.xxhash64("url", "digest").alias("h")
    # Rows that are alike are one from here on, with their number.
    alike = rows.groupBy(*_KEY).agg(F.first(F.octet_length("payload")).cast("long").alias("payload_bytes"), F.count(F.lit(1)).alias("copies"))
    facts = materialize(alike.withColumn("h", spread), "warc-facts")
    cuts = _cuts(facts, shard_bytes)
    shards_of = _shards_of(cuts)

    blank = {"payload": "binary", "revisit": "boolean", "wins": "boolean", "refers_to": "long", "refers_url": "string"}
    decided = _decisions(facts, least_revisit_bytes).withColumn("kind", F.lit(0)).withColumn("shards", _all_shards(shards_of)("page_id", "h"))
    decided = decided.select("*", F.posexplode("shards").alias("nth", "shard"))
    decided = decided.withColumn("wins", F.col("wins") & (F.col("nth") == 0)).drop("h", "shards", "nth")
    owned = rows.withColumn("kind", F.lit(1)).withColumn("shard", _own_shard(shards_of)("page_id", spread))
    both = owned.unionByName(decided, allowMissingColumns=True).select("shard", *_KEY, "kind", *blank)
    both = both.repartitionById(max(1, cuts.num_rows), "shard").sortWithinPartitions("shard", *_KEY, "kind")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    written = both.mapInArrow(_writer(folder, file_bytes, date), "shard int, file string, records long, bytes long, sha256 string")
    manifest = materialize(written, "warc-manifest")
    table = f"manifest-{uuid.uuid4().hex}"
    manifest.orderBy("shard", "file").write.json(f"{folder}/{table}")
    files, records, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).head()
    held = f"{path}/.manifest.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(held) as out:
        out.write(json.dumps({"table": table, "files": files, "records": records, "bytes": size}, indent=1).encode())
    system.move(held, f"{path}/manifest.json")
    return manifest


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip stream."""
    unpacker, packed, parts = zlib.decompressobj(31), b"", []
    while True:
        packed = packed or stream.read(1 << 20)
        if not packed:
            break
        parts.append(unpacker.decompress(packed))
        packed = unpacker.unused_data if unpacker.eof else b""
        if not unpacker.eof:
            continue
        unpacker, plain, parts = zlib.decompressobj(31), b"".join(parts), []
        head, _, rest = plain.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(headers["content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError("a record's length doesn't hold")
        yield headers, rest[:length]
    if any(parts):
        raise ValueError("the archive ends within a record")


def read_warc(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """``page_id, url, record_type, payload_digest, payload_bytes, payload,
    refers_to`` of the records of the files that the manifest leads to; ``names``
    has their ``file`` and ``bytes``.

    Digests are computed again from what is read, and a record whose block or
    payload digest doesn't hold raises.  A revisit has no payload; its digest
    and length are those its headers give.
    """
    if names is None:
        system, path = _open(folder)
        with system.open_input_stream(f"{path}/manifest.json") as file:
            table = json.loads(file.read())["table"]
        names = spark.read.schema("file string, bytes long").json(f"{folder}/{table}")
    tasks = 1 + names.agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0] // FILE_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64())])
        system, path = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a block digest doesn't hold")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, revisit = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "revisit"
                        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        if not revisit and (base32_sha1(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: a payload digest doesn't hold")
                        number = lambda key, h=headers: int(h[key]) if key in h else None
                        rows.append((number("x-page-id"), headers.get("warc-target-uri"), headers["warc-type"], digest, length, None if revisit else payload, number("x-refers-to-page-id")))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, payload binary, refers_to long"
    # About a file's bytes for each task; small files are dealt evenly.
    files = names.select("file").repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.mapInArrow(read, schema)
