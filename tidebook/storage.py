"""Tables written on the way, in the folder that driver and executors share, and
the package on the executors.

``spark.checkpoint.dir`` names that folder.  Only where the session leaves it
unset (tests, a notebook) a folder of this process is used instead; such a
session runs in one JVM, so the folder is shared by definition.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()
#: By application: folders written on the way.
_left: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[key] = "file://" + tempfile.mkdtemp(prefix="tidebook-")
    return _own[key]


def _leftovers(spark: SparkSession) -> list[str]:
    return _left.setdefault(spark.sparkContext.applicationId, [])


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{root(spark)}/tidebook/{name}-{uuid.uuid4().hex}"
    _leftovers(spark).append(path)
    return path


def left(spark: SparkSession, path: str | None) -> bool:
    """Whether ``path`` is one that this session has written and not cleared."""
    return path in _leftovers(spark)


def clear(spark: SparkSession) -> None:
    """Remove what this session wrote below the shared folder on the way, and let
    go of all that it keeps on executors: for when its results are saved."""
    spark.catalog.clearCache()
    for path in _leftovers(spark):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _left.pop(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once, and the table read back: a cut of its lineage that
    outlives any executor.  What is built on it starts from a file, so that plans
    which read a table more than once stay small."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """This package on the executors' path, for tasks that run its functions."""
    key = spark.sparkContext.applicationId
    if key not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tidebook-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(key)
    return spark
