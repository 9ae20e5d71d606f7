"""From raw documents to token ids: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, extra ones included, whatever their names.  A stage reads what its
predecessor wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from tidebook.llm.scratch import materialize, prepared

#: Part of the hash that rounds a document's share of the mix.
SEED = 17


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as good.  A null text is judged
    as the empty one; a null identifier is judged and never learned from;
    repeated rows are judged one by one; an empty table stays empty."""
    prepared(spark)
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier; of rows that
    repeat identifier and text, one.  Null and empty texts are equal; a null
    identifier stays only where no other has its text; an empty table stays
    empty."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest identifier.  Null
    and empty texts and null identifiers are near nothing and stay; rows
    repeating an identifier are one document; an empty table stays empty."""
    prepared(spark)
    return jaccard_join.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, at most three times.  A
    document without words isn't in the mix; null identifiers and sources are
    values like any other; an empty table stays empty."""
    return mixing.mix_documents(docs, seed=SEED)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and a digest of what they decode to.  A null text
    is the empty one, without ids; rows repeating an identifier, or without one,
    are encoded one by one; an empty table gives an empty result."""
    prepared(spark)
    vocabulary = byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode_texts(docs, vocabulary, public_tokenizers.PATTERN, decode=True, staged=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: Hash draws and byte pairs have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
