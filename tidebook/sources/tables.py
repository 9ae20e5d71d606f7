"""Readers, writers and discovery of tables."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: names of daily files.
DAILY = re.compile(r"^([A-Z0-9]+)_(\d{4}-\d{2}-\d{2})\.parquet$")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_ordered(spark: SparkSession, path: str, name: str = "raw_order") -> DataFrame:
    """A table with each row's place: file, then row in the file (Spark keeps no
    order of its own)."""
    df = spark.read.parquet(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select("*", place.alias(name))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Readers see all of a write or nothing (job commit)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_importance(spark: SparkSession, path: str, top: int = 20) -> DataFrame:
    """The first rows of an importance report: largest gain, then most splits,
    then by name."""
    rows = read_csv(spark, path, "feature string, importance_split long, importance_gain double")
    return rows.orderBy(F.desc("importance_gain"), F.desc("importance_split"), "feature").limit(top)


def hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, under a temporary name until complete."""
    system, target = hadoop(spark, path)
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(held, True)
    out.write(text.encode())
    out.close()
    system.delete(target, False)
    if not system.rename(held, target):
        raise OSError(f"{path} could not be put in place")


def write_json(spark: SparkSession, record: dict | list, path: str) -> None:
    write_text(spark, json.dumps(record, indent=2, default=str), path)


def read_json(spark: SparkSession, path: str) -> dict | list:
    rows = spark.read.text(path, wholetext=True).head()
    return json.loads(rows[0])


def records(df: DataFrame) -> list[dict]:
    """Rows of a report (few) as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Paths and times of change of the entries of a folder."""
    system, target = hadoop(spark, folder)
    return [(str(f.getPath()), int(f.getModificationTime())) for f in system.listStatus(target)] if system.exists(target) else []


def newest(spark: SparkSession, folder: str, suffix: str = ".parquet", only: Callable[[str], bool] = lambda name: True) -> str:
    """The entry changed last, of those whose name ends so and satisfies ``only``."""
    found = [(t, p) for p, t in list_files(spark, folder) if p.endswith(suffix) and only(p.rsplit("/", 1)[-1])]
    if not found:
        raise FileNotFoundError(f"no {suffix} in {folder}")
    return max(found)[1]


def daily_files(spark: SparkSession, folder: str, symbol: str, last: int, by: str = "date") -> list[str]:
    """The last ``last`` daily files of a symbol by date or time of change, in
    order of date; fewer raise."""
    found = []
    for path, changed in list_files(spark, folder):
        match = DAILY.match(path.rsplit("/", 1)[-1])
        if match and match[1] == symbol.upper():
            found.append((dt.date.fromisoformat(match[2]), changed, path))
    if len(found) < last:
        raise FileNotFoundError(f"{last} daily files of {symbol} wanted, {len(found)} found")
    latest = sorted(found, key=(lambda f: f[0]) if by == "date" else (lambda f: (f[1], f[0])))[-last:]
    return [path for _, _, path in sorted(latest)]


def latest_dates(df: DataFrame, last: int, column: str = "dt") -> DataFrame:
    """Rows of the last dates of a table partitioned by date: the dates are
    found first, so that only their partitions are read."""
    dates = [r[0] for r in df.select(column).distinct().orderBy(F.desc(column)).limit(last).collect()]
    if len(dates) < last:
        raise ValueError(f"{last} dates wanted, {len(dates)} found")
    return df.where(F.col(column).isin(dates))
