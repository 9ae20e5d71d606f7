"""License scan by diagonal voting.

1. One scan cuts every whole text into words and hashes each run of ``k`` words.
2. Spark joins all of these hashes to the templates' positions.  A match of text
   position p and template position q votes for the diagonal p - q of that
   template.
3. Votes are counted by text, template and diagonal; neighbouring diagonals, as
   inserted or missing words make them, are merged into spans.
4. Spans with enough votes are verified word by word against the template.

Beside the hashes the scan hands on the words of passages around runs that a
template has, for step 4: a span's words are cut out of its passage by Spark, and
no other words of a text travel.  Phrases are sought in the same scan, by exact
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_id, tidy
from .license_templates import PHRASES, TEMPLATES
from .scratch import keep
from .text import ALNUM, combined, string_chunks, word_hashes, word_spans

#: Entries of all templates together beyond which the join isn't broadcast.
MOST_BROADCAST = 200_000
#: Hashes in one list at most.
LIST = 1 << 15
#: Words of a stretch of a text by which spans find their passages.
STRETCH = 1024


def words_of(text: str) -> list[str]:
    """Words of a text: A-Z lower-cased, runs of [0-9a-z] and non-ASCII."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, stops, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    lowered = bytes(data + 32 * ((data > 64) & (data < 91)).astype(np.uint8))
    return [lowered[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, stops, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, stops)


def _runs(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and position of every run of ``k`` words within a text."""
    runs = combined(h, k)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(doc[: len(runs)] == doc[k - 1 :]) if len(runs) else np.zeros(0, np.int64)
    return runs[first], doc[first], first - at[doc[first]]


_FACTS = [("doc_id", None), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string()))]
_PASSAGE = pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string()))])


def _passages(hits: np.ndarray, doc: np.ndarray, margin: int) -> Iterator[tuple[int, int, int]]:
    """``doc, first, last`` of hits (in order) that lie within twice ``margin``
    of each other in a text."""
    if len(hits):
        edges = np.flatnonzero((np.diff(doc) > 0) | (np.diff(hits) > 2 * margin)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(hits)], strict=True):
            yield int(doc[a]), int(hits[a]), int(hits[b - 1])


def _scan(k: int, grams: np.ndarray, margin: int, phrases: dict[str, str], id_type: pa.DataType):
    sought = [(label, p.split(" "), _hashes(p.split(" "))) for p, label in sorted(phrases.items())]
    grams = np.unique(grams)
    fact_type = pa.struct([(name, kind or id_type) for name, kind in _FACTS])

    def batch_of(rows, facts, passages, base, runs) -> pa.RecordBatch:
        n = len(rows)
        own = [x if x is not None else pa.nulls(n, t) for x, t in ((facts, fact_type), (passages, _PASSAGE), (base, pa.int64()), (runs, pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *own], ["row", "fact", "passage", "base", "grams"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block_id(0) << 8
        for batch in batches:
            for first, rows, data, offsets in string_chunks(batch.column(1)):
                starts, stops, at = word_spans(data, offsets, ALNUM)
                h = word_hashes(data, starts, stops)
                row = np.arange(number, number + rows)
                number += rows
                lowered = (data + 32 * ((data > 64) & (data < 91)).astype(np.uint8)).tobytes()
                spelled = lambda a, b, text=lowered, x=starts, y=stops: [text[i:j].decode() for i, j in zip(x[a:b].tolist(), y[a:b].tolist(), strict=True)]
                places: dict[int, list[tuple[int, str]]] = {}
                for label, words, hashes in sought:
                    n = len(words)
                    if len(h) < n:
                        continue
                    hit = np.ones(len(h) - n + 1, bool)
                    for j in range(n):
                        hit &= h[j : len(h) - n + 1 + j] == hashes[j]
                    for p in np.flatnonzero(hit).tolist():
                        doc = int(np.searchsorted(at, p, "right")) - 1
                        if spelled(p, p + n) == words and p + n <= at[doc + 1]:
                            places.setdefault(doc, []).append((p - int(at[doc]), label))
                found = [places.get(i, []) for i in range(rows)]
                columns = [
                    batch.column(0).slice(first, rows).cast(id_type),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([min(f)[0] if f else None for f in found], pa.int64()),
                    pa.array([max(f)[0] if f else None for f in found], pa.int64()),
                    pa.array([sorted({label for _, label in f}) for f in found], pa.list_(pa.string())),
                ]
                yield batch_of(row, pa.StructArray.from_arrays(columns, fields=list(fact_type)), None, None, None)

                runs, doc, position = _runs(h, at, k)
                if not len(runs):
                    continue
                # All runs of a text, in lists of bounded length.
                heads = np.flatnonzero((np.diff(doc, prepend=-1) > 0) | (position % LIST == 0))
                ends = pa.array(np.append(heads, len(runs)).astype(np.int32))
                yield batch_of(row[doc[heads]], None, None, pa.array(position[heads].astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(runs.view(np.int64))))
                seen = np.flatnonzero(np.isin(runs, grams))
                near = [(d, max(0, a - margin), min(int(at[d + 1] - at[d]), b + k + margin)) for d, a, b in _passages(position[seen], doc[seen], margin)]
                if near:
                    words = [spelled(int(at[d]) + a, int(at[d]) + b) for d, a, b in near]
                    passages = pa.StructArray.from_arrays([pa.array([a for _, a, _ in near], pa.int64()), pa.array(words, pa.list_(pa.string()))], fields=list(_PASSAGE))
                    yield batch_of(row[[d for d, _, _ in near]], None, passages, None, None)

    return tidy(scan)


def _verify(templates: list[tuple[str, list[str]]], least_share: float):
    def verify(table: pa.Table) -> pa.Table:
        """Spans of one passage, best first; one that mostly overlaps a better one
        (another version of the same wording) goes."""
        spans, found = table.to_pylist(), []
        for r in spans:
            label, wanted = templates[r["template"]]
            blocks = [m for m in SequenceMatcher(None, r["words"], wanted, autojunk=False).get_matching_blocks() if m.size]
            matched = sum(m.size for m in blocks)
            if blocks and matched / len(wanted) >= least_share:
                found.append((-matched, -matched / len(wanted), r["start"] + blocks[0].a, r["start"] + blocks[-1].a + blocks[-1].size, label))
        kept: list[tuple] = []
        near: dict[int, list[tuple]] = {}  # those kept, by the stretches they touch
        for span in sorted(found):
            stretches = range(span[2] // STRETCH, (span[3] - 1) // STRETCH + 1)
            if all(2 * (min(span[3], x[3]) - max(span[2], x[2])) <= span[3] - span[2] for i in stretches for x in near.get(i, ())):
                kept.append(span)
                for i in stretches:
                    near.setdefault(i, []).append(span)
        columns = zip(*[(spans[0]["row"], x[4], -x[1], x[2], x[3]) for x in kept], strict=True) if kept else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["row", "label", "share", "start", "end"])

    return verify


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, gap: int = 3, gap_share: float = 0.3, least_share: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Per text its phrases, and per verified span ``row, label, share, start,
    end`` (words, end exclusive).  ``row`` numbers the rows, so identifiers may
    repeat or be null.  Diagonals are neighbours within ``gap`` words or
    ``gap_share`` of the template, whichever is more."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    clauses = [(label, words_of(clause)) for label, own in sorted(templates.items()) for clause in own]
    clauses = [(label, words) for label, words in clauses if len(words) >= k]
    entries = []
    for i, (_, words) in enumerate(clauses):
        entries += [(int(g), i, q) for q, g in enumerate(combined(_hashes(words), k).view(np.int64))]
    grams = np.array([g for g, _, _ in entries], np.int64).view(np.uint64)
    margin = 2 * max([len(words) for _, words in clauses], default=0) + gap
    fact = f"doc_id {kind.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>".replace(", ", ",").replace(" ", ":")
    schema = f"row long, fact struct<{fact}>, passage struct<start:bigint,words:array<string>>, base long, grams array<long>"
    scanned = rows.mapInArrow(_scan(k, grams, margin, phrases, to_arrow_type(kind)), schema)

    table = spark.createDataFrame(entries, "gram long, template int, place int")
    lengths = spark.createDataFrame([(i, len(words)) for i, (_, words) in enumerate(clauses)], "template int, length int")
    if len(entries) <= MOST_BROADCAST:
        table, lengths = F.broadcast(table), F.broadcast(lengths)
    # Facts and passages ride along as rows without a hash.
    each = scanned.select("row", "fact", "passage", "base", F.posexplode_outer("grams").alias("offset", "gram"))
    each = each.join(table, "gram", "left").where("fact is not null or passage is not null or template is not null")
    each = keep(each.select("row", "fact", "passage", (F.col("base") + F.col("offset")).alias("position"), "template", "place"))

    hits = each.where("template is not null")
    votes = hits.groupBy("row", "template", (F.col("position") - F.col("place")).alias("diagonal")).agg(F.count_distinct("place").alias("votes"), F.min("position").alias("first"), F.max("position").alias("last"))
    votes = votes.join(lengths, "template")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.greatest(F.lit(float(gap)), F.col("length") * gap_share)
    votes = votes.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("opens").over(along))
    spans = votes.groupBy("row", "template", "length", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + k).alias("last"))
    # A word changed costs k votes: a span of the least share has at least these.
    floor = F.greatest(F.lit(1), F.col("length") - k + 1 - F.ceil(F.col("length") * (1 - least_share)) * k)
    spans = spans.where(F.col("votes") >= floor).select("row", "template", F.greatest(F.col("first") - gap, F.lit(0)).alias("start"), (F.col("last") + gap).alias("stop"))
    # A span starts in one passage; they meet by stretches of the text.
    size = F.size("passage.words")
    touched = F.sequence(F.floor(F.col("passage.start") / STRETCH), F.floor((F.col("passage.start") + size - 1) / STRETCH))
    passages = each.where("passage is not null").select("row", F.col("passage.start").alias("from"), F.col("passage.words").alias("passage"), F.explode(touched).alias("stretch"))
    spans = spans.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    inside = (F.col("start") >= F.col("from")) & (F.col("start") < F.col("from") + F.size("passage"))
    own = F.slice("passage", (F.col("start") - F.col("from") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    found = spans.join(passages, ["row", "stretch"]).where(inside).select("row", "from", "template", "start", own.alias("words"))
    found = found.groupBy("row", "from").applyInArrow(_verify(clauses, least_share), "row long, label string, share double, start long, end long")
    return each.where("fact is not null").select("row", "fact.*"), found


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` for each input row; options as of :func:`license_spans`.

    ``n_base`` counts every place of a phrase, ``first_word`` and ``last_word``
    are the smallest and largest word at which one starts.  ``labels`` adds the
    labels of verified spans.  ``score`` is 1 with a phrase, else the largest
    share of a template's words that a span has, else 0.  A null text counts as
    empty and has no words; texts of any length are scanned whole.  Repeated rows
    are scanned each on its own, and null identifiers stay null.  An empty table
    gives an empty result; columns not named are not read.
    """
    texts, spans = license_spans(docs, **options)
    best = spans.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    both = F.array_union("base_labels", F.coalesce("added", F.array().cast(T.ArrayType(T.StringType()))))
    return texts.join(best, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
