"""Language identification by nearest centroid of TF-IDF n-gram vectors.

A text's vector has byte bigrams and trigrams of its letters in lower case, hashed to
``DIMENSIONS`` slots, damped, weighted by inverse document frequency and scaled
to length one.  Each language has several centroids, from spherical k-means.
The language of the centroid with the largest cosine is predicted; beyond that
centroid's radius the prediction is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import tidy
from .text import string_chunks

#: Slots of a vector, and texts turned into vectors at once.
DIMENSIONS, ROWS = 4096, 512
#: Labelled texts on which the model is fitted, about, of all languages.
SAMPLE_ROWS = 6000
#: Languages at most; more raise.
MOST_LANGUAGES = 10_000

#: Letters lower-cased; other ASCII bytes count as a space.
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[:128] = 32
_LOWER[65:91] = _LOWER[97:123] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed bigram and trigram counts, a row per text."""
    rows = len(offsets) - 1
    low = _LOWER[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    low[1:] += np.uint32(32) * capital  # of Latin-1
    doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    out = np.zeros(rows * DIMENSIONS, np.float32)
    for n in (2, 3):
        m = len(low) - n + 1
        if m <= 0:
            continue
        code = low[:m].copy()
        for j in range(1, n):
            code = code * np.uint32(257) + low[j : j + m]
        slot = (code * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - 12)
        same = doc[:m] == doc[n - 1 :]
        for j in range(1, n):
            same &= (low[j - 1 : j - 1 + m] != 32) | (low[j : j + m] != 32)
        out += np.bincount((doc[:m] * DIMENSIONS + slot)[same], minlength=len(out))
    return out.reshape(rows, DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i in range(0, len(offsets) - 1, ROWS):
        at = offsets[i : i + ROWS + 1]
        yield i, data[at[0] : at[-1]], at - at[0]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray, sharpness: float = 30.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and whether the text is too far."""
        cosine = self.vectors(counts) @ self.centroids.T
        nearest = cosine.argmax(axis=1)
        best = np.full((len(counts), len(self.languages)), -1.0)
        for i in range(len(self.languages)):
            best[:, i] = cosine[:, self.owner == i].max(axis=1)
        p = np.exp(sharpness * (best - best.max(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(counts))
        return self.owner[nearest], p[rows, self.owner[nearest]], 1 - cosine[rows, nearest] > self.radius[nearest]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starting points."""
    picked = [0]
    far = 1 - x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[picked[-1]])
    centres = x[picked]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def fit(counts: np.ndarray, languages: list[str], k: int = 3, slack: float = 1.25) -> LanguageModel | None:
    """From n-gram counts, a row per text."""
    if not languages:
        return None
    names = sorted(set(languages))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    label = np.array([names.index(v) for v in languages])
    centroids, owner, radius = [], [], []
    for i in range(len(names)):
        own = x[label == i]
        centres = _cluster(own, k)
        cosine = own @ centres.T
        nearest = cosine.argmax(axis=1)
        for j in range(len(centres)):
            far = 1 - cosine[nearest == j, j]
            centroids.append(centres[j])
            owner.append(i)
            radius.append(slack * far.max() if len(far) else 0.0)
    return LanguageModel(tuple(names), idf, np.stack(centroids).astype(np.float32), np.array(owner), np.array(radius))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as packed counts: at most DIMENSIONS slots, however long the text."""
    for batch in batches:
        for first, rows, data, offsets in string_chunks(batch.column(2)):
            packed = []
            for _, d, o in _pieces(data, offsets):
                for own in ngram_counts(d, o):
                    slots = np.flatnonzero(own)
                    packed.append(slots.astype("<u2").tobytes() + own[slots].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(packed, pa.binary())], ["lang", "h", "counts"])


def _sample(docs: DataFrame, fold, holdout_value: int, sample_rows: int) -> tuple[np.ndarray, list[str]]:
    """Counts and languages of about ``sample_rows`` labelled texts, evenly over
    languages, by a hash of identifier and text.  Shares travel as a literal, so
    that no text is shuffled for the sample; equal rows count once, and what
    reaches the driver is at most twice the sample."""
    learned = docs.where((fold != holdout_value) & F.col("lang").isNotNull())
    counts = learned.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return np.zeros((0, DIMENSIONS), np.float32), []
    each = float(1 << 30) * sample_rows / len(counts)
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], each / r["count"])))
    chosen = learned.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).where(F.col("text").rlike(r"\p{L}"))
    chosen = chosen.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(tidy(_counted), "lang string, h long, counts binary")
    # Drawn hashes are below the shares, so the order is by one mixed anew.
    rows = chosen.groupBy("lang", "h").agg(F.min("counts").alias("counts")).orderBy(F.xxhash64("h"), "h").limit(2 * sample_rows).toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    out = np.zeros((rows.num_rows, DIMENSIONS), np.float32)
    for i, packed in enumerate(rows.column("counts").to_pylist()):
        n = len(packed) // 6
        out[i, np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)
    return out, rows.column("lang").to_pylist()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout: int = 3, holdout_value: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for each input row.

    Learns from text and language of rows whose crc32(identifier as text) mod
    ``holdout`` is not ``holdout_value``; predicts from the text alone.
    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text
    is null or has no letter, or nothing could be learned.  A null language
    teaches nothing; a null identifier neither teaches nor is held out.  Repeated
    rows are predicted alike and teach once; of languages as near, the first by
    name is predicted.  Texts of any length are read whole.  An
    empty table gives an empty result; columns not named are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    fold = F.crc32(F.col("doc_id").cast("string")) % holdout
    model = rows.sparkSession.sparkContext.broadcast(fit(*_sample(rows, fold, holdout_value, sample_rows)))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        known = model.value
        for batch in batches:
            for first, n, data, offsets in string_chunks(batch.column(2)):
                has = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
                has = has[1:] > has[:-1]
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = letter.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()) is not None
                names, scores, far = ["und"] * n, np.zeros(n), np.zeros(n, bool)
                for i, d, o in _pieces(data, offsets) if known else ():
                    language, score, beyond = known.predict(ngram_counts(d, o))
                    for j in np.flatnonzero(has[i : i + ROWS]).tolist():
                        names[i + j] = known.languages[language[j]]
                        scores[i + j], far[i + j] = min(1.0, float(score[j])), beyond[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n).cast(id_type), batch.column(1).slice(first, n), pa.array(names), pa.array(scores), pa.array(far)], ["doc_id", "held_out", "lang_pred", "score", "rejected"]
                )

    given = rows.select("doc_id", F.coalesce(fold == holdout_value, F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(tidy(scan), f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
