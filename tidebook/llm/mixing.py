"""Mixing sources to target weights (DataFrame operations only).

1. Words of a source form one stream, cut into blocks of ``block_words``.  The
   order inside a stream is pseudorandom chunk, then identifier; chunk offsets
   come from sums per chunk, so that no task orders a whole source.
2. Targets: shares of all words by weight, each stopped at ``max_epochs`` times
   its source, the excess shared again: the water level is found by one pass
   over sources sorted by cap per weight.
3. Every slot of every output shard draws a source by a counter-based hash:
   multinomial counts per shard.  The few draws beyond a source's block quota
   are handed, in order, to sources that fell short, so totals are exact.
4. The k-th draw of a source reads block ``permutation(k mod n)`` of pass
   ``k div n``, a Feistel permutation of its block indices, and the draws are
   joined to the documents by block index.

Sizes, the plan by source and the counts by shard are written once each, so that
every step's plan starts from a table and stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import all_columns, materialize, unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: of a text trimmed of white space, the gaps and one."""
    squeezed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORD, "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` from rows of ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn.  The window has
    one row per source and none per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everywhere)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    # The level of the first source that isn't full holds for all after it.
    place = F.struct(F.row_number().over(filling).alias("place"), "level")
    ranked = ranked.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), place))
    held = F.min("open").over(everywhere)["level"]
    target = F.least(F.col("cap"), F.coalesce(held, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def permuted(k: Column, n: Column, *key: Column, rounds: int = 4, walks: int = 12) -> Column:
    """A keyed pseudorandom permutation of 0..n-1: a Feistel network over the
    smallest rectangle that holds n, walked until it lands inside.  The
    rectangle exceeds n by fewer than its side, so a walk is rarely repeated."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(i), *key), a), a)
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(i), *key), b), b)
        return left * b + right

    steps = F.sequence(F.lit(1), F.lit(walks))
    return F.aggregate(steps, F.lit(-1).cast("long"), lambda y, _: F.when(y < 0, once(k)).when(y >= n, once(y)).otherwise(y))


def _intervals(rows: DataFrame, total: int, length: str) -> tuple[DataFrame, int]:
    """``rows`` laid end to end over 0..total-1 by column ``length``, as pieces
    by bin: ``bin, lo, hi`` and the columns.  A lookup joins on the bin."""
    width = max(1, -(-total // 1024))
    order = Window.orderBy("skey")
    hi = F.sum(length).over(order)
    laid = rows.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(length)).where(F.col(length) > 0)
    bins = F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor((F.col("hi") - 1) / width).cast("long"))
    return laid.withColumn("bin", F.explode(bins)), width


def _lookup(points: DataFrame, at: Column, intervals: DataFrame, width: int) -> DataFrame:
    points = points.withColumn("at", at).withColumn("bin", F.floor(F.col("at") / width).cast("long"))
    return points.join(intervals, "bin").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))


def _sum_before(rows: DataFrame, key: str, at: str, value: str, name: str, width: int = 1024) -> DataFrame:
    """``name``: the sum of ``value`` over rows of the same ``key`` with a
    smaller ``at``.  Sums over ``width`` neighbours go first, so that no task
    orders all rows of a key."""
    group = F.floor(F.col(at) / width).cast("long")
    rows = rows.withColumn("group", group)
    sums = rows.groupBy(key, "group").agg(F.sum(value).alias("held"))
    earlier = Window.partitionBy(key).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "group", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("held"))
    inside = Window.partitionBy(key, "group").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, [key, "group"]).withColumn(name, F.col(name) + F.col("held")).drop("group", "held")


def _draws(plan: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, skey, k``: which draw of which source each slot makes."""
    spark = plan.sparkSession
    shares, width = _intervals(plan.select("skey", "quota"), slots, "quota")
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(slots))
    drawn = _lookup(spark.range(slots), at, shares.select("bin", "lo", "hi", "skey"), width)
    drawn = drawn.select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), F.col("id").alias("slot"), "skey")
    counts = materialize(drawn.groupBy("shard", "skey").count(), "mix-counts")
    base = _sum_before(counts, "skey", "shard", "count", "base").drop("count")
    sums = counts.groupBy("skey").agg(F.sum("count").alias("drawn"))
    quota = plan.select("skey", "quota").join(sums, "skey", "left").fillna(0, ["drawn"])
    over, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    before = F.sum("surplus").over(Window.orderBy("skey")) - F.col("surplus")  # a row per source
    quota = materialize(quota.withColumn("surplus", over).withColumn("short", short).withColumn("surplus_at", before), "mix-quota")
    spare = int(quota.agg(F.coalesce(F.sum("surplus"), F.lit(0))).head()[0])
    within = Window.partitionBy("shard", "skey").orderBy("slot")
    ranked = (
        drawn.withColumn("rank", F.row_number().over(within) - 1)
        .join(base, ["shard", "skey"])
        .withColumn("k", F.col("base") + F.col("rank"))
        .join(quota.select("skey", "quota", "surplus_at"), "skey")
    )
    kept = ranked.where(F.col("k") < F.col("quota")).select("shard", "skey", "k")
    if not spare:
        return kept
    needs, width = _intervals(quota.select("skey", "short", "drawn"), spare, "short")
    moved = ranked.where(F.col("k") >= F.col("quota")).select("shard", (F.col("surplus_at") + F.col("k") - F.col("quota")).alias("m"))
    moved = _lookup(moved, F.col("m"), needs, width)
    return kept.unionByName(moved.select("shard", "skey", (F.col("drawn") + F.col("at") - F.col("lo")).alias("k")))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    block_words: int = 64,
    shard_slots: int = 4096,
    chunk_docs: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each input row.

    ``taken`` is the number of words that the mix reads from the document, with
    repeats; no document gives more than ``max_epochs`` times its size.  A source
    gives a whole number of its blocks: the nearest to its target by its blocks'
    mean size.  A null or empty text has size 0 and gives nothing; a null source
    is a source of its own.  Rows repeating an identifier are documents of their
    own, null identifiers included.  A text of any length is cut into as many
    blocks as it fills.  An empty table gives an empty result, and
    columns not named are not read.  Reruns agree: every draw is a hash of
    ``seed`` and a counter.  Sources may number thousands (their plan is ordered
    in one task); documents may number any.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text.cast("string")).alias("spread"),
    )
    rows = materialize(rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))), "mix-sizes")
    sums = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    plan = source_targets(sums.select("source", "source_size"), weights, max_epochs)
    plan = plan.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    plan = plan.join(sums.select("skey", "n_docs"), "skey").withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    # The last block is short, so blocks are counted by their mean size.
    blocks = F.round(F.coalesce(F.try_divide(F.col("target") * F.col("n_blocks"), F.col("source_size")), F.lit(0.0))).cast("long")
    plan = materialize(plan.withColumn("quota", F.least(F.col("n_blocks") * max_epochs, blocks)), "mix-plan")
    slots = int(plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).head()[0])
    out = ["doc_id", "source", "size", "source_size", "target"]
    known = rows.join(plan.select("skey", "source_size", "target", "n_docs"), "skey")
    nothing = F.lit(0).cast("long").alias("taken")
    if not slots:
        return known.select(*out, nothing)

    n_chunks = F.ceil(F.col("n_docs") / chunk_docs).cast("long")
    placed = known.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "spread"), n_chunks)).drop("n_docs")
    chunks = placed.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    chunks = _sum_before(chunks, "skey", "chunk", "words", "offset").drop("words")
    inside = Window.partitionBy("skey", "chunk").orderBy("doc_id", "size", "spread").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(chunks, ["skey", "chunk"])
    placed = placed.withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    draws = _draws(plan, slots, shard_slots, seed).join(plan.select("skey", "n_blocks"), "skey")
    turn, k = F.floor(F.col("k") / F.col("n_blocks")).cast("long"), F.pmod(F.col("k"), F.col("n_blocks"))
    block = permuted(k, F.col("n_blocks"), F.lit(seed), F.col("skey"), turn)
    uses = draws.select("skey", block.alias("block")).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("uses"))
    first, last = F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    # Words of a source start at one document each: (source, start) names a row.
    taken = (
        pieces.select("skey", "start", "block", (hi - lo).alias("words"), F.struct(*out).alias("row"))
        .join(uses, ["skey", "block"], "left")
        .groupBy("skey", "start", "row")
        .agg(F.sum(F.coalesce("uses", F.lit(0)) * F.col("words")).cast("long").alias("taken"))
    )
    return taken.select("row.*", "taken").unionByName(known.where("size = 0").select(*out, nothing))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """Rows of ``docs``, whole and with all their columns, as often as the mix
    takes them: ``taken / size`` times, the fraction rounded by a hash, so that
    each source keeps to its target and no document comes more than
    ``max_epochs`` times.

    Rows that agree in identifier, source and size share what they are taken.  A
    document without words isn't in the mix.  A null identifier or source is a
    value like any other; columns of any name stay as they are; an empty table
    gives an empty result.
    """
    taken = mix_sources(docs, id_col, text_col, source_col, seed=seed, **options).where("taken > 0")
    taken = taken.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    share = F.col("taken") / (F.col("size") * F.col("rows"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("int")
    # One composite key, equal where its parts are equal or both null.
    key, turns, turn = (unused(n, docs) for n in ("mix_key", "mix_times", "mix_turn"))
    taken = taken.select(F.struct(F.col("doc_id").alias("a"), F.col("source").alias("b"), F.col("size").alias("c")).alias(key), times.alias(turns)).where(F.col(turns) > 0)
    own = F.struct(F.col(f"`{id_col}`").alias("a"), F.col(f"`{source_col}`").cast("string").alias("b"), word_count(F.col(f"`{text_col}`")).alias("c"))
    mixed = docs.withColumn(key, own).join(taken, key)
    return mixed.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turns)))).select(*all_columns(docs))
