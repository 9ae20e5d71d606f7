"""Quality classifier: a sparse rule ensemble over text statistics.

1. One scan turns each whole text into numeric statistics.
2. On a bounded sample of labelled rows, small boosted trees are grown and every
   path from a root becomes a conjunctive rule.
3. A lasso logistic regression weighs the rules; most weights become zero.
4. The rules left are compiled to one Spark column expression, which scores the
   statistics of all documents in the scan that makes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import release, tidy
from .scratch import all_columns, unused
from .text import string_chunks, word_hashes, word_spans

#: Labelled rows, about, on which the model is fitted: those of the smallest
#: hashes of identifiers.
SAMPLE_ROWS = 12_000

#: Classes of bytes that statistics count.
_CLASSES = ["upper", "lower", "digit", "space", "newline", "mark", "bar", "symbol", "punctuation", "beyond"]
_CLASS_OF = np.full(256, _CLASSES.index("punctuation"), np.int64)
_CLASS_OF[65:91], _CLASS_OF[97:123], _CLASS_OF[48:58], _CLASS_OF[128:] = 0, 1, 2, _CLASSES.index("beyond")
_CLASS_OF[[9, 11, 12, 13, 32]], _CLASS_OF[10], _CLASS_OF[[33, 63]], _CLASS_OF[124] = 3, 4, 5, 6
_CLASS_OF[[ord(c) for c in "#$%&*@^~<>{}[]=+\\/_"]] = 7
_CLASS_OF[:9], _CLASS_OF[14:32], _CLASS_OF[127] = 7, 7, 7

_FLAGS = ["capital", "symbolic", "single", "repeated", "numeric", "marked"]
WINDOW = 16
STATISTICS = [
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "sentence_words",
    *(f"share_{c}" for c in _CLASSES),
    *(f"words_{f}" for f in _FLAGS),
    *(f"worst_{f}" for f in _FLAGS),
]


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text; all zero for an empty one."""
    rows = len(offsets) - 1
    out = {name: np.zeros(rows) for name in STATISTICS}
    size = np.diff(offsets)
    kind = _CLASS_OF[data]
    doc = np.repeat(np.arange(rows), size)
    shares = np.bincount(doc * len(_CLASSES) + kind, minlength=rows * len(_CLASSES)).reshape(rows, -1) / np.maximum(size, 1)[:, None]
    for i, name in enumerate(_CLASSES):
        out[f"share_{name}"] = shares[:, i]
    starts, stops, at = word_spans(data, offsets)
    n = np.diff(at)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(n)
    if len(starts):
        some = np.maximum(n, 1)
        length = stops - starts
        hashes = word_hashes(data, starts, stops)
        totals = lambda x: np.concatenate([[0], np.cumsum(x)])
        held = {i: totals(kind == i) for i in (0, 1, 2, 5, 7)}
        upper, lower, digit, mark, symbol = (held[i][stops] - held[i][starts] for i in (0, 1, 2, 5, 7))
        again = np.zeros(len(starts), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[at[:-1][n > 0]] = False
        flags = {"capital": (upper > 1) & (lower == 0), "symbolic": symbol > 0, "single": length == 1, "repeated": again, "numeric": digit > 0, "marked": mark > 1}
        word_doc = np.repeat(np.arange(rows), n)
        for name, flag in flags.items():
            run = totals(flag)
            out[f"words_{name}"] = (run[at[1:]] - run[at[:-1]]) / some
            first = np.maximum(np.arange(len(starts)) - WINDOW + 1, at[:-1][word_doc])
            window = run[1:] - run[first]
            full = np.flatnonzero(n > 0)
            out[f"worst_{name}"][full] = np.maximum.reduceat(window, at[:-1][full]) / WINDOW
        run = totals(length)
        out["mean_word"] = (run[at[1:]] - run[at[:-1]]) / some
        full = np.flatnonzero(n > 0)
        out["longest_word"][full] = np.log1p(np.maximum.reduceat(length, at[:-1][full]))
        out["sentence_words"] = np.log1p(n / (1.0 + shares[:, _CLASSES.index("punctuation")] * size))
        for i in full:
            own = np.sort(hashes[at[i] : at[i + 1]])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            out["distinct_words"][i] = (len(edge) - 1) / len(own)
            out["top_word"][i] = np.diff(edge).max() / len(own)
    return np.stack([out[name] for name in STATISTICS], axis=1)


def with_statistics(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` and an array column ``name`` of STATISTICS of the text; a null
    text counts as empty."""
    at = rows.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in string_chunks(batch.column(at)):
                values = text_statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values.ravel()))
                yield batch.slice(first, n).append_column(name, lists)

    return rows.mapInArrow(tidy(scan), T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``statistic > cut`` (or ``<=``) and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, cut in self.terms:
            out &= (x[:, i] > cut) == above
        return out


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]


def _grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> list[tuple[np.ndarray, tuple, float]]:
    """Leaves and inner nodes of one tree: rows, terms, value."""
    nodes, open_ = [], [(np.arange(len(binned)), ())]
    while open_:
        rows, terms = open_.pop()
        g, h = gradient[rows], hessian[rows]
        value = g.sum() / (h.sum() + 1.0)
        best = (1e-9, -1, -1)
        if len(terms) < depth and len(rows) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for i, cut in enumerate(cuts):
                if not len(cut):
                    continue
                own = binned[rows, i]
                gl, hl, nl = (np.cumsum(np.bincount(own, w, len(cut) + 1))[:-1] for w in (g, h, None))
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], i, j)
        _, i, j = best
        nodes.append((rows, terms, value, i < 0))
        if i >= 0:
            above = binned[rows, i] > j
            open_ += [(rows[~above], (*terms, (i, False, float(cuts[i][j])))), (rows[above], (*terms, (i, True, float(cuts[i][j]))))]
    return nodes


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 10) -> list[Rule]:
    """Every distinct path of boosted trees, inner nodes included."""
    cuts = _cuts(x, bins)
    binned = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    score, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        for rows, terms, value, leaf in _grow(binned, cuts, y - p, p * (1 - p), depth, least):
            if terms:
                found.setdefault(frozenset(terms), Rule(terms))
            if leaf:
                score[rows] += rate * value
    return list(found.values())


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the
    intercept is not penalised."""
    n, m = z.shape
    full = np.concatenate([z, np.ones((n, 1), np.float32)], axis=1, dtype=np.float32)
    size = float(np.linalg.norm(full.T @ full / n, 2)) / 4 + 1e-6
    w = np.zeros(m + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ v.astype(np.float32), -30, 30)))
        new = v - (full.T @ (p - y).astype(np.float32)).astype(float) / n / size
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - penalty / size, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:m], float(w[m])


#: A rule as Spark sees it.
RULE_TYPE = "array<struct<terms:array<struct<statistic:int,above:boolean,cut:double>>,weight:double>>"


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, statistics: Column) -> Column:
        """Between 0 and 1, from an array of STATISTICS.  The rules are one
        literal, and one expression sums the weights of those that hold: its
        size doesn't grow with their number."""
        rules = [{"terms": [dict(zip(("statistic", "above", "cut"), t, strict=True)) for t in r.terms], "weight": r.weight} for r in self.rules]
        literal = F.from_json(F.lit(json.dumps(rules)), RULE_TYPE)
        holds = lambda r: F.forall(r["terms"], lambda t: (F.get(statistics, t["statistic"]) > t["cut"]) == t["above"])
        total = F.aggregate(literal, F.lit(self.intercept), lambda sum_, r: sum_ + F.when(holds(r), r["weight"]).otherwise(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, relaxed: float = 1e-4) -> RuleEnsemble:
    """Without both labels the score is the smoothed share of label 1."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleEnsemble((), float(np.log(p / (1 - p))))
    # The lasso chooses rules; a second, weaker one weighs those without the
    # shrinkage of the first.
    rules = extract_rules(x, y)
    for strength in (penalty, relaxed):
        held = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(x), 0))
        weights, intercept = fit_lasso(held, y.astype(float), strength)
        rules = [replace(r, weight=float(w)) for r, w in zip(rules, weights, strict=True) if w]
    return RuleEnsemble(tuple(rules), intercept)


def _fitted(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, holdout: int, sample_rows: int) -> RuleEnsemble:
    """``rows``: doc_id and text.  The labelled sample is drawn from the labels,
    by a hash of the identifier, before any text is read; its identifiers are
    distinct and so bounded, and travel to all."""
    mark = F.col(f"`{label_col}`").try_cast("double").alias("label")
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), mark).where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull())
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % holdout != 0).distinct()
    share = F.lit(float(1 << 30) * sample_rows / max(1, marks.count()))
    chosen = F.broadcast(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share))
    train = with_statistics(rows.join(chosen, "doc_id").select("doc_id", "label", "text"), "text", "statistics")
    # Of rows repeating an identifier one teaches: what is collected is bounded.
    train = train.groupBy("doc_id", "label").agg(F.min("statistics").alias("statistics")).toArrow()
    train = train.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = train.column("statistics").combine_chunks().flatten().to_numpy().reshape(train.num_rows, len(STATISTICS))
    model = fit(x, train.column("label").to_numpy())
    del train, x
    release()  # the driver lives on, and has more stages to run
    return model


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout: int = 5, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each input row.

    Labels of rows whose crc32(identifier as text) mod ``holdout`` is 0 are
    never learned; of the others about ``sample_rows``, by hash of the
    identifier, are.  Only the text is an input of a score.  A null text is
    scored as the empty text; null labels teach nothing; a null identifier is
    scored, held_out false.  Without labels the score is 0.5.  Repeated rows are
    scored one by one; of labelled rows repeating an identifier one teaches.  Texts
    of any length are read whole.  An empty table gives an empty result; columns
    not named are not read.
    """
    rows = _texts(docs, id_col, text_col)
    model = _fitted(rows, labels, id_col, label_col, holdout, sample_rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holdout == 0, F.lit(False))
    scored = with_statistics(rows, "text", "statistics").select("doc_id", held.alias("held_out"), model.score(F.col("statistics")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout: int = 5, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_scores` predicts as 1, with all
    their columns.  Rows repeating an identifier are judged one by one, and no
    text is shuffled."""
    model = _fitted(_texts(docs, id_col, text_col), labels, id_col, label_col, holdout, sample_rows)
    name = unused("statistics", docs)
    judged = with_statistics(docs, text_col, name)
    return judged.where(model.score(F.col(name)) >= threshold).select(*all_columns(docs))
