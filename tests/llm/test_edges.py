"""Long texts, far and missing identifiers, clashing columns, and plain-Python
versions of what no SQL expresses."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, SPACE, lower, odd_rows, pages, shingles, vocabulary, words
from tidebook.llm import byte_bpe, ctw, embedding_dedup, exact_dedup, jaccard_join, language, license_scan, mixing, quality, warc
from tidebook.llm.scratch import new_path, prepared

LONG_WORD = "ab" * 600_000


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepared(spark)


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(220_000)]
    near = list(base)
    for i in range(0, len(near), 900):
        near[i] = "changed"
    licensed = [*base[:100_000], *"Permission is hereby granted released under the MIT License".split(), *base[100_000:]]
    texts = [" ".join(base), " ".join(near), "  ".join(base), LONG_WORD, " ".join(licensed), "short", None]
    assert len(texts[0]) > 1_000_000 and len(LONG_WORD) > 1_000_000
    return [(i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, SCHEMA).repartition(2).persist()


# ---- texts beyond a megabyte ----------------------------------------------------


def test_long_texts_encode_and_decode(long_docs, long_rows):
    data, pattern = vocabulary()
    got = {r["doc_id"]: r for r in byte_bpe.encode_texts(long_docs, data, pattern, decode=True).collect()}
    for i, t, *_ in long_rows:
        assert bytes(got[i]["decoded"]) == (t or "").encode()
        assert len(got[i]["ids"]) == 4 * got[i]["n_tokens"]


def test_long_texts_are_scored(long_docs, long_rows):
    got = {r["doc_id"]: r for r in ctw.ctw_scores(long_docs).collect()}
    for i, t, *_ in long_rows:
        assert got[i]["n_tokens"] == len(words(t)) + 1 and -math.inf < got[i]["score"] < 0


def test_long_texts_join(long_docs, long_rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(long_docs).collect()}
    sets = {i: shingles(t) for i, t, *_ in long_rows}
    assert {i: n for i, (n, _) in got.items()} == {i: len(s) for i, s in sets.items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert near(0, 1) and near(0, 4)
    assert {i: c for i, (_, c) in got.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 5, 6: 6}


def test_long_texts_deduplicate_and_mix(long_docs, long_rows):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(long_docs).collect()}
    for i, t, *_ in long_rows:
        assert got[i]["text_sha256"] == hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()
    assert [got[i]["keep_id"] for i in range(7)] == [0, 1, 0, 3, 4, 5, 6]
    mixed = {r["doc_id"]: r for r in mixing.mix_sources(long_docs).collect()}
    assert {i: r["size"] for i, r in mixed.items()} == {i: len(words(t)) for i, t, *_ in long_rows}
    assert all(r["taken"] <= 3 * r["size"] for r in mixed.values())


def test_long_texts_are_judged(spark, long_docs, long_rows):
    licenses = {r["doc_id"]: r for r in license_scan.license_scan(long_docs).collect()}
    assert (licenses[4]["n_base"], licenses[4]["base_labels"]) == (1, "mit")
    assert all(licenses[i]["n_base"] == 0 for i in (0, 1, 2, 3, 5, 6))
    known = language.identify(long_docs.unionByName(spark.createDataFrame([(100 + i, f"der die das und {i}", "de", "a", 0) for i in range(9)], SCHEMA)))
    assert {r["doc_id"] for r in known.collect()} == {*range(7), *range(100, 109)}
    scores = quality.quality_scores(long_docs, spark.createDataFrame([(0, 1), (5, 0)], "doc_id long, quality int")).collect()
    assert len(scores) == 7 and all(0 <= r["score"] <= 1 for r in scores)


def test_long_pages_are_archived(spark, long_rows):
    folder = new_path(spark, "warc-long")
    docs = spark.createDataFrame([(i, f"u{i}", t) for i, t, *_ in long_rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder, warc.write_warc(docs, folder, file_bytes=100_000)).collect()}
    for i, t, *_ in long_rows:
        assert bytes(got[i]["payload"]) == (t or "").encode()


# ---- shingle frequencies ----


def test_a_blocks_counts_are_exact():
    """A shingle of a thousand short texts of one block has its own class, by
    which it is dealt over salts."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array([f"one two three four five w{i}" for i in range(1000)])})
    out = pa.Table.from_batches(list(jaccard_join._scan(5, 40, 0)(iter([texts]))))
    shingles = out.filter(out.column("bucket").is_valid())
    classes = jaccard_join._frequencies(shingles).column("payload").to_pylist()
    found = np.concatenate([jaccard_join.unpack(c, np.uint8) for c in classes])
    assert sorted(found.tolist()) == [0] * 1000 + [9]


# ---- license spans ----


def test_whole_license_texts_are_found(spark):
    """Whole texts, as they are, with words changed, and cut short: each is named
    by its own label."""
    from tidebook.llm.license_templates import WHOLE

    rng, rows = random.Random(8), []
    for i, (label, text) in enumerate(sorted(WHOLE.items())):
        own = text.split()
        for at in rng.sample(range(len(own)), len(own) // 25):
            own[at] = "changed"
        filler = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
        rows += [(3 * i, f"{filler} {text}\n{filler}", label), (3 * i + 1, " ".join(own), label), (3 * i + 2, " ".join(text.split()[:6]), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    _, spans = license_scan.license_spans(docs)
    texts = {r["row"]: r["doc_id"] for r in license_scan.license_spans(docs)[0].collect()}
    got = collections.defaultdict(set)
    for r in spans.collect():
        got[texts[r["row"]]].add(r["label"])
    for i, _, label in rows:
        assert (label in got[i]) if label else not got[i]


def test_many_far_passages_stay_apart(spark):
    """Clauses far from each other in one text meet their own passages only."""
    clause = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    filler = " ".join(f"w{i}" for i in range(1500))
    docs = spark.createDataFrame([(1, f" {filler} ".join([clause] * 60))], "doc_id long, text string")
    _, spans = license_scan.license_spans(docs)
    found = sorted((r["start"], r["end"]) for r in spans.collect())
    n = len(license_scan.words_of(clause))
    assert found == [(i * (n + 1500), i * (n + 1500) + n) for i in range(60)]


# ---- language samples ----


def test_language_sample_is_of_texts_not_identifiers(spark, monkeypatch):
    """Many texts under one identifier are drawn one by one, and what reaches the
    driver is bounded."""
    rows = [(6, f"der text nummer {i} und so weiter {i * 7}", "de") for i in range(4000)] + [(i, f"the text number {i} and so on", "en") for i in range(300, 420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    held = docs.select(fold).distinct().collect()
    assert any(r[0] != 1 for r in held)
    counts, languages = language._sample(docs, fold, 5, 400)
    found = collections.Counter(languages)
    assert 120 < found["de"] < 280 and found["en"] > 80 and len(counts) == len(languages)
    same = spark.createDataFrame([(1, "der die das", "de")], docs.schema).crossJoin(spark.range(3000)).drop("id")
    assert len(language._sample(same, fold, 5, 100)[0]) <= 1


# ---- WARC shards -----------------------------------------------------------------


def shard_sizes(manifest):
    out = collections.Counter()
    for r in manifest.collect():
        out[r["shard"]] += r["records"]
    return out


@pytest.mark.parametrize("case", ["far", "hot", "null", "clustered"])
def test_warc_shards_stay_even(spark, case):
    n = 400
    number = {"far": lambda i: 10**15 if i == n - 1 else i, "hot": lambda i: 7 if i % 3 else i, "null": lambda i: None if i % 3 else i, "clustered": lambda i: i if i % 2 else 10**12 + i}[case]
    rows = [(number(i), f"http://h/{i}", f"page {i} " + "x" * 500) for i in range(n)]
    folder = new_path(spark, "warc-test")
    manifest = warc.write_warc(pages(spark, rows).repartition(4), folder, shard_bytes=20_000)
    sizes = shard_sizes(manifest)
    assert sum(sizes.values()) == n and len(sizes) > 15 and max(sizes.values()) <= 2 * n / len(sizes)
    got = warc.read_warc(spark, folder)
    assert sorted(r["payload_digest"] for r in got.collect()) == sorted(base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for *_, t in rows)
    named = [r["page_id"] for r in got.where("record_type = 'response'").collect()]
    assert collections.Counter(named) == collections.Counter(number(i) for i in range(n))


def test_warc_spreads_rows_that_are_alike(spark):
    """Two thousand rows alike in everything, among two hundred others: even
    shards, one response."""
    rows = [(50, "http://h/50", "x" * 500)] * 2000 + [(i, f"http://h/{i}", f"page {i} " + "y" * 500) for i in range(200)]
    folder = new_path(spark, "warc-test")
    manifest = warc.write_warc(pages(spark, rows).repartition(4), folder, shard_bytes=20_000)
    sizes = shard_sizes(manifest)
    assert sum(sizes.values()) == 2200 and len(sizes) > 50 and max(sizes.values()) <= 2 * 2200 / len(sizes)
    got = warc.read_warc(spark, folder).groupBy("page_id", "record_type", "refers_to").count().collect()
    found = {tuple(r)[:3]: r["count"] for r in got}
    assert found.pop((50, "response", None)) == 2 and found.pop((50, "revisit", 50)) == 1999
    assert set(found.values()) == {1} and len(found) == 199


def test_warc_of_alike_rows_without_an_identifier(spark):
    rows = [(None, None, "z" * 900)] * 100 + [(3, None, "z" * 900)] * 40
    folder = new_path(spark, "warc-test")
    warc.write_warc(pages(spark, rows).repartition(3), folder, shard_bytes=10_000)
    got = warc.read_warc(spark, folder).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert {tuple(r) for r in got} == {(None, "response", None, 100), (3, "response", None, 1), (3, "revisit", 3, 39)}


def test_warc_leaves_other_columns_alone(spark):
    names = ["shard", "digest", "payload", "kind", "salt", "h", "range", "held", "revisit"]
    rows = pages(spark, [(1, "u", "a"), (2, "v", "a"), (3, None, None)]).withColumns({n: F.lit("x") for n in names})
    folder = new_path(spark, "warc-test")
    warc.write_warc(rows, folder)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, folder).collect()}
    assert got == {1: ("response", None, 1), 2: ("revisit", 1, 1), 3: ("response", None, 0)}


# ---- embeddings --------------------------------------------------------------------


def test_embeddings_in_small_tiles(spark, monkeypatch):
    """Chunks of lists against chunks of their queries, with clashing columns."""
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 24)
    x = np.random.default_rng(5).normal(size=(500, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.93).sum(axis=1))}
    docs = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    docs = docs.withColumns({n: F.lit("x") for n in ("rep", "digest", "salt", "vector", "copies", "home", "list", "part", "chunk", "links")})
    got = embedding_dedup.near_duplicates(docs)
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == wanted


# ---- Jaccard: hot shingles, repeated identifiers ------------------------------------


def test_jaccard_deals_hot_shingles_over_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_CLASS", 1)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = base[: rng.choice([30, 34, 40, 60])]
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    parent = list(range(150))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [shingles(t) for _, t in rows]
    for a, b in itertools.combinations(range(150), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: find(i) for i in range(150)} and 1 < len(set(got.values())) < 150


def test_jaccard_takes_a_repeated_identifier_as_one_node(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a), (5, a + " tail"), (5, b), (9, b + " tail"), (7, "alone in this table of five")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (7, 7)}


# ---- language against plain Python -----------------------------------------------------


def plain_counts(text):
    data = (text or "").encode()
    low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
    for i in range(1, len(data)):  # capitals of Latin-1
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E and data[i] != 0x97:
            low[i] += 32
    out = collections.Counter()
    for n in (2, 3):
        for i in range(len(low) - n + 1):
            gram = low[i : i + n]
            if any(gram[j - 1] == 32 and gram[j] == 32 for j in range(1, n)):
                continue
            code = 0
            for b in gram:
                code = (code * 257 + b) % 2**32
            out[(code * (0x9E3779B1 + 2 * n) % 2**32) >> 20] += 1
    return out


def test_language_is_the_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame(odd_rows()[:11], SCHEMA))
    rows = docs.select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    counts, languages = language._sample(rows, fold, 1, language.SAMPLE_ROWS)
    model = language.fit(counts, languages)
    texts = collections.defaultdict(list)
    for r in rows.collect():
        texts[r["doc_id"]].append(r["text"])
    learned = collections.Counter(r["lang"] for r in rows.collect() if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and re.search(r"[^\W\d_]", r["text"]))
    assert collections.Counter(languages) == learned
    checked = 0
    for r in language.identify(docs).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if len(texts[r["doc_id"]]) > 1:
            continue
        text = texts[r["doc_id"]][0]
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        vector = np.zeros(language.DIMENSIONS)
        for slot, n in plain_counts(text).items():
            vector[slot] = math.log1p(n) * model.idf[slot]
        vector /= np.linalg.norm(vector)
        near = [sum(a * b for a, b in zip(vector[vector > 0], c[vector > 0], strict=True)) for c in model.centroids]
        best = {name: max(n for n, o in zip(near, model.owner, strict=True) if o == i) for i, name in enumerate(model.languages)}
        top = max(best.values())
        assert best[r["lang_pred"]] == pytest.approx(top, abs=1e-5)
        assert r["score"] == pytest.approx(1 / sum(math.exp(30 * (b - top)) for b in best.values()), abs=1e-3)
        checked += 1
    assert checked > 150


# ---- quality against plain Python ---------------------------------------------------------


def plain_statistics(text):
    data = (text or "").encode()
    kind = lambda b: quality._CLASSES[quality._CLASS_OF[b]]
    own = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(own)
    out = dict.fromkeys(quality.STATISTICS, 0.0)
    out["log_bytes"], out["log_words"] = math.log1p(len(data)), math.log1p(n)
    counts = collections.Counter(map(kind, data))
    for c in quality._CLASSES:
        out[f"share_{c}"] = counts[c] / max(1, len(data))
    if n:
        fold = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in own]
        of = lambda w, *cs: sum(kind(b) in cs for b in w)
        flags = {
            "capital": [of(w, "upper") > 1 and of(w, "lower") == 0 for w in own],
            "symbolic": [of(w, "symbol") > 0 for w in own],
            "single": [len(w) == 1 for w in own],
            "repeated": [i > 0 and fold[i] == fold[i - 1] for i in range(n)],
            "numeric": [of(w, "digit") > 0 for w in own],
            "marked": [of(w, "mark") > 1 for w in own],
        }
        for name, flag in flags.items():
            out[f"words_{name}"] = sum(flag) / n
            out[f"worst_{name}"] = max(sum(flag[max(0, i - quality.WINDOW + 1) : i + 1]) for i in range(n)) / quality.WINDOW
        out["mean_word"], out["longest_word"] = sum(map(len, own)) / n, math.log1p(max(map(len, own)))
        out["distinct_words"], out["top_word"] = len(set(fold)) / n, max(collections.Counter(fold).values()) / n
        out["sentence_words"] = math.log1p(n / (1 + counts["punctuation"]))
    return [out[s] for s in quality.STATISTICS]


def test_quality_is_the_rules_of_the_statistics(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(odd_rows()[:11], SCHEMA).withColumn("doc_id", F.col("doc_id") + 10**6))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality._fitted(quality._texts(docs, "doc_id", "text"), labels, "doc_id", "quality", 5, quality.SAMPLE_ROWS)
    assert model.rules
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = plain_statistics(r["text"])
        total = model.intercept + sum(rule.weight for rule in model.rules if all((x[i] > cut + (1e-12 if above else -1e-12)) == above for i, above, cut in rule.terms))
        own = got[r["doc_id"]]
        assert own["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=0.02), r["doc_id"]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert own["predicted"] == (own["score"] >= 0.3)


def test_quality_never_learns_held_out_or_repeated_rows_twice(spark):
    rows = [(i, f"good text number {i} with some more words", "en", "a", 0) for i in range(60)] + [(1000 + i, "BUY NOW !!! $$$ " * 5, "en", "a", 0) for i in range(60)]
    labels = [(i, int(i < 1000)) for i, *_ in rows]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    docs = spark.createDataFrame(rows + rows[:30] * 3, SCHEMA)
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped))
    assert a == b and min(a[i] for i in range(60)) > 0.5 > max(a[1000 + i] for i in range(60))


# ---- mixing: draws and small sources ----------------------------------------------------------


def test_small_sources_get_their_share(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * 200), None, "big", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(["w"] * rng.choice([3, 10, 40, 100])), None, f"tiny{i}", 0) for i in range(25)]
    rows += [(None, "one two three", None, "nameless", 0)] * 3 + [(None, None, None, None, 0)] * 2
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert len(got) == len(rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.5 * min(64, size[s]) * 1.5, 0.02 * target[s]), s
    assert taken["nameless"] == 27  # three times each


def test_draws_use_every_block_as_often_as_due(spark):
    plan = spark.createDataFrame([("a", 300, 100), ("b", 50, 80), ("c", 0, 5), ("d", 7, 3)], "skey string, quota long, n_blocks long")
    draws = mixing._draws(plan, 357, 32, 5).collect()
    by_source = collections.defaultdict(list)
    for r in draws:
        by_source[r["skey"]].append(r["k"])
    assert {s: sorted(ks) for s, ks in by_source.items()} == {"a": list(range(300)), "b": list(range(50)), "d": list(range(7))}
    assert {r["shard"] for r in draws} == set(range(12))
    assert max(collections.Counter(r["shard"] for r in draws).values()) <= 32


def test_mixed_documents_keep_nulls_and_columns(spark):
    rows = [(None, "a b c d", "en", "x", 0)] * 20 + [(i, "a b c d", "en", "x", 0) for i in range(20)] + [(99, None, "en", "x", 0)]
    names = ["mix_key", "mix_times", "own_id", "own_turn", "size", "taken", "Mix_Key_"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in names})
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert all(r[n] == n for r in found for n in names)
    assert sum(r["doc_id"] is None for r in found) >= 15 and not any(r["doc_id"] == 99 for r in found)


# ---- shingle frequencies ----


def test_a_blocks_counts_are_exact():
    """A shingle of a thousand short texts of one block has its own class, by
    which it is dealt over salts."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array([f"one two three four five w{i}" for i in range(1000)])})
    out = pa.Table.from_batches(list(jaccard_join._scan(5, 40, 0)(iter([texts]))))
    shingles = out.filter(out.column("bucket").is_valid())
    classes = jaccard_join._frequencies(shingles).column("payload").to_pylist()
    found = np.concatenate([jaccard_join.unpack(c, np.uint8) for c in classes])
    assert sorted(found.tolist()) == [0] * 1000 + [9]


# ---- license spans --------------------------------------------------------------------------------


def test_license_labels_are_those_of_a_full_comparison(spark):
    rng = random.Random(21)
    filler = [f"f{i}" for i in range(500)]
    clauses = [(label, c) for label, own in license_scan.TEMPLATES.items() for c in own]
    rows = []
    for i in range(120):
        label, clause = clauses[i % len(clauses)]
        w = clause.split()
        if i % 4 == 1 and len(w) > 12:  # words missing
            del w[5 : 5 + len(w) // 12]
        if i % 4 == 2 and len(w) > 12:  # words in between
            w[8:8] = ["including", "the", "next", "paragraph"][: max(1, len(w) // 5)]
        if i % 4 == 3 and len(w) > 20:  # half of it only
            w = w[: len(w) // 2]
        rows.append((i, " ".join([*rng.sample(filler, 60), *w, *rng.sample(filler, 60)])))
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own = license_scan.words_of(text)
        share = {}
        for label, clause in clauses:
            wanted = license_scan.words_of(clause)
            if len(wanted) >= 3:
                matched = sum(m.size for m in SequenceMatcher(None, own, wanted, autojunk=False).get_matching_blocks())
                share[label] = max(share.get(label, 0.0), matched / len(wanted))
        base, found = (set(got[i][c].split(",")) - {""} for c in ("base_labels", "labels"))
        assert base <= found and found - base <= {label for label, s in share.items() if s >= 0.8}
        if i % 4 != 3:
            assert clauses[i % len(clauses)][0] in found, text
        assert got[i]["n_words"] == len(own)


def test_all_hashes_reach_the_join(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, text), (2, lower("Released under the MIT License.")), (3, None)], "doc_id long, text string").coalesce(1)
    each, _ = license_scan.license_spans(docs)
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan or "InMemoryRelation" in plan
    got = {r["doc_id"]: (r["n_words"], r["labels"]) for r in license_scan.license_scan(docs).collect()}
    assert got == {1: (70_000, ""), 2: (5, "mit"), 3: (0, "")}
