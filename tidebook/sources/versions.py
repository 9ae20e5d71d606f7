"""A table by day whose readers see whole versions.

A write puts the days it touches into fresh folders, ``dt=<day>/v=<name>``, and
then commits by renaming one small record, ``_versions/<number>.json``, into
place.  The record names the folder of every day, what the writer last committed,
and the last session and time of each symbol, so that resuming reads one small
file.  Readers go by the newest record: before the rename they see the old
version, after it the new one.  A record's name can be taken once: of two writers
that start from the same version one fails.  Folders stay until two later
versions don't name them, so that who reads meanwhile can finish.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.cleaning import keep_last

from .tables import hadoop, list_files

#: Versions whose folders stay.
KEPT = 2
_RECORD = re.compile(r"^(\d{12})\.json$")


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: Folder of each day, below the table's.
    days: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    #: By writer: the last batch it committed.
    batches: dict[str, int] = field(default_factory=dict)
    #: By symbol: the last session and time (microseconds).
    last: dict[str, list[int]] = field(default_factory=dict)

    def resume(self, symbol: str | None = None) -> tuple[int, dt.datetime | None]:
        """The last session and time, of one symbol or of all."""
        found = [v for k, v in self.last.items() if symbol is None or k == symbol.upper()]
        if not found:
            return 1, None
        session, us = max(found, key=lambda v: (v[1], v[0]))
        return session, dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=us)


def _records(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    found = [(p, _RECORD.match(p.rsplit("/", 1)[-1])) for p, _ in list_files(spark, f"{path}/_versions")]
    return sorted((int(m[1]), p) for p, m in found if m)


def _read(spark: SparkSession, record: str) -> Version:
    system, target = hadoop(spark, record)
    stream = system.open(target)
    try:
        return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> Version:
    """The newest version; version 0, without days, before any."""
    found = _records(spark, path)
    return _read(spark, found[-1][1]) if found else Version()


def read(spark: SparkSession, path: str, days: list[str] | None = None, version: Version | None = None) -> DataFrame | None:
    """The rows of a version (the newest), or of some of its days; None where
    there are none."""
    version = version or current(spark, path)
    folders = [f"{path}/{version.days[d]}" for d in (sorted(version.days) if days is None else days) if d in version.days]
    if not folders:
        return None
    schema = T.StructType.fromJson(json.loads(version.schema))
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    system, folder = hadoop(spark, f"{path}/_versions")
    system.mkdirs(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    held, target = at(f"{path}/_versions/.{uuid.uuid4().hex}"), at(f"{path}/_versions/{version.number:012d}.json")
    out = system.create(held, False)
    out.write(json.dumps(version.__dict__).encode())
    out.close()
    # A rename onto a name that is there fails or, in a local folder, would
    # replace it: the name is taken first where that can happen.
    if system.exists(target) or not system.rename(held, target):
        system.delete(held, False)
        raise FileExistsError(f"version {version.number} of {path} was committed by another writer")


def upsert(batch: DataFrame, path: str, keys: list[str] | None = None, order: list[str] | None = None, writer: str = "", batch_id: int | None = None) -> Version:
    """Commit ``batch`` as a new version: of rows with equal keys (by default
    symbol and time) the new one stays; only the UTC days it has are written.  A
    batch that ``writer`` has committed already changes nothing."""
    spark, keys, order, path = batch.sparkSession, keys or [c for c in ("symbol", "timestamp") if c in batch.columns], order or [], path.rstrip("/")
    version = current(spark, path)
    if batch_id is not None and batch_id <= version.batches.get(writer, -1):
        return version
    new = batch.withColumn("dt", F.to_date("timestamp")).where("dt is not null")
    symbol = F.upper("symbol") if "symbol" in batch.columns else F.lit("")
    session = F.col("session_id").cast("long") if "session_id" in batch.columns else F.lit(1).cast("long")
    seen = new.groupBy("dt", symbol.alias("own")).agg(F.max(F.struct(F.unix_micros("timestamp").alias("us"), F.coalesce(session, F.lit(1)).alias("session"))).alias("r"))
    facts = [(r["dt"].isoformat(), r["own"] or "", r["r"]["session"], r["r"]["us"]) for r in seen.collect()]  # days times symbols of a batch
    if not facts:
        return version
    days = sorted({d for d, *_ in facts})
    old = read(spark, path, days, version)
    both = new.withColumn("upsert_turn", F.lit(1))
    if old is not None:
        both = old.drop("v").withColumn("upsert_turn", F.lit(0)).unionByName(both, allowMissingColumns=True)
    merged = keep_last(both, [*keys, "dt"], ["upsert_turn", *order]).drop("upsert_turn")
    name = f"{version.number + 1}-{uuid.uuid4().hex[:8]}"
    merged.repartition("dt").sortWithinPartitions("dt", "timestamp").withColumn("v", F.lit(name)).write.mode("append").partitionBy("dt", "v").parquet(path)
    last = dict(version.last)
    for _, own, number, us in facts:
        last[own] = max(last.get(own, [0, us]), [number, us], key=lambda v: (v[1], v[0]))
    stored = merged.schema.add("v", "string")
    made = Version(version.number + 1, version.days | {d: f"dt={d}/v={name}" for d in days}, json.dumps(stored.jsonValue()), version.batches | ({writer: batch_id} if batch_id is not None else {}), last)
    _commit(spark, path, made)
    _tidy(spark, path)
    return made


def _tidy(spark: SparkSession, path: str) -> None:
    """Remove folders that only versions before the last :data:`KEPT` name, and
    the records of these."""
    found = _records(spark, path)
    old, kept = found[:-KEPT], found[-KEPT:]
    named = {f for _, p in kept for f in _read(spark, p).days.values()}
    for _, record in old:
        for folder in set(_read(spark, record).days.values()) - named:
            system, target = hadoop(spark, f"{path}/{folder}")
            system.delete(target, True)
        system, target = hadoop(spark, record)
        system.delete(target, False)
