"""Intermediate tables of the operators, and what their tasks need.

Tables are written in the folder that driver and executors share (see
:mod:`tidebook.storage`), or kept on executors' disks with their lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.storage import new_path, ship, written

__all__ = ["all_columns", "keep", "materialize", "new_path", "prepared", "unused"]

#: A written table: a cut of the lineage that outlives any executor.
materialize = written


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept on the executors' disks for its consumers.
    The lineage stays, so what an executor loses is computed again;
    ``tidebook.storage.clear`` lets it go."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def prepared(spark: SparkSession, rows: int = 4096, size: str = "4m") -> SparkSession:
    """``spark`` with what tasks over texts need: this package on the executors,
    and Arrow batches bounded by rows and bytes (by default one batch of long
    texts can take a large part of an executor)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return ship(spark)
