"""A session with the settings the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Generated code of a stage beyond this size isn't compiled by the JVM, which
#: then interprets it row by row; below the limit operators are compiled apart.
WIDE = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def for_wide_rows(spark: SparkSession) -> SparkSession:
    """``spark`` with what plans over some hundred columns need."""
    for key, value in WIDE.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "tidebook", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; more settings by keyword,
    with ``__`` for dots (``spark__sql__shuffle__partitions="8"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {**WIDE, "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**fixed, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
