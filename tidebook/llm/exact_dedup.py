"""Exact deduplication by a tree merge of sorted digest runs (DataFrame
operations only).

Every row gets a run by a hash of its identifier.  A run holds one entry for each
of its digests: the smallest identifier and the number of rows, in order of the
digest.  In each round, runs are merged ``fan_in`` at a time: of ``fan_in``
neighbours all but the first send their entries to the first, entries are dealt
out by ranges of (run, digest) and sorted, and neighbours that agree become one.
With 512 runs and a fan-in of 8, three rounds leave one run.  Winners travel down
the same tree.  No task ever sees more than ``fan_in`` entries of a digest, or
more of its rows than a run holds, however large a group of copies is.

An entry's key is SHA-256, byte length and an independent 64-bit hash: the last
two verify the first at every level, and rows that differ in any never merge.
Every level is a written table, so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import all_columns, materialize, unused

#: White space that counts as one space when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "n_bytes", "verify"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _sorted(entries: DataFrame) -> DataFrame:
    """Runs in order: ranges of (run, digest), each sorted."""
    return entries.repartitionByRange("run", *KEY).sortWithinPartitions("run", *KEY, "best")


def _merged(level: DataFrame, step: int) -> DataFrame:
    """The runs whose number is a multiple of ``step``, each merged with those
    up to the next.  The window walks the sorted runs: it needs no further
    exchange or sort, and sees one entry of each run for a digest."""
    sent = level.withColumn("run", F.col("run") - F.col("run") % step)
    same = Window.partitionBy("run", *KEY).orderBy("best")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = _sorted(sent).withColumn("place", F.row_number().over(same)).withColumn("rows", F.sum("rows").over(whole))
    return merged.where("place = 1").drop("place")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 512, fan_in: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after each run of ASCII white space becomes
    one space; a null text counts as the empty text, which is a text like any
    other.  The smallest identifier stays; of rows repeating one identifier and
    text, one stays.  A null identifier never beats another; a group of only
    null identifiers has a null ``keep_id`` and one kept row.  Texts of any length
    are compared whole; only their digests travel.  An empty table
    gives an empty result.  Other columns, whatever their names, are not read.
    """
    text = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("verify"),
        F.spark_partition_id().alias("part"),
    )
    # Rows without an identifier go to the runs of their partitions.
    run = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("part"))), F.lit(runs)).cast("int")
    rows = materialize(rows.withColumn("run", run).drop("part"), "digests")
    # Null identifiers come last; among them the first run wins.
    best = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("run").alias("of_run"))
    first = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("rows"))
    levels, steps = [materialize(_sorted(first), "digest-runs")], [1]
    while steps[-1] < runs:
        steps.append(steps[-1] * fan_in)
        levels.append(materialize(_merged(levels[-1], steps[-1]), "digest-runs"))
    won = levels.pop().withColumnRenamed("run", "parent")
    while levels:
        step, level = steps.pop(), levels.pop()
        up = level.select("run", *KEY, (F.col("run") - F.col("run") % step).alias("parent"))
        won = up.join(won, ["parent", *KEY]).select(F.col("run").alias("parent"), *KEY, "best", "rows")
    again = F.row_number().over(Window.partitionBy("run", *KEY, "doc_id").orderBy("doc_id"))
    return (
        rows.withColumn("again", again)
        .join(won.withColumnRenamed("parent", "run"), ["run", *KEY])
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("rows").alias("group_size"),
            (best.eqNullSafe(F.col("best")) & (F.col("again") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all
    their columns.

    Of rows that repeat identifier and text, the one whose text is shortest and
    then smallest as it is written stays.  Null texts, null identifiers and
    empty tables are as in :func:`exact_dedup`; columns of any name stay.
    """
    key, rank = unused("copy_key", docs), unused("copy_rank", docs)
    kept = exact_dedup(docs, id_col, text_col, **options).where("kept").select("doc_id", "text_sha256")
    name = lambda i, h: F.struct(i.alias("a"), h.alias("b"))
    text = F.col(f"`{text_col}`")
    kept = kept.select(name(F.col("doc_id"), F.col("text_sha256")).alias(key))
    own = docs.withColumn(key, name(F.col(f"`{id_col}`"), F.sha2(normalised(text).cast("binary"), 256)))
    # The window reads what the join deals out: texts are shuffled once.
    once = Window.partitionBy(key).orderBy(F.length(text), text)
    left = own.join(kept, key, "left_semi").withColumn(rank, F.row_number().over(once))
    return left.where(F.col(rank) == 1).select(*all_columns(docs))
