"""The corpus pipeline against brute force, stage by stage, on a small table."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebook.llm.scratch import prepared

SF = "/root/testdata/sf0.01"
SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the result of the last, as written."""
    prepared(spark)
    docs, out, top = spark.read.parquet(f"{SF}/documents.parquet"), [], tmp_path_factory.mktemp("pipeline")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(str(top / str(i)))
        docs = spark.read.parquet(str(top / str(i)))
    return [*out, docs]


def test_columns_stay(stages):
    for docs in stages[:-1]:
        assert docs.columns == stages[0].columns


def test_quality_keeps_the_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [i for i, q in marks.items() if q == 1], [i for i, q in marks.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_exact_copies_leave_the_smallest(stages):
    before, after = (s.select("doc_id", "text").collect() for s in stages[1:3])
    first = {}
    for r in before:
        key = SPACE.sub(" ", r["text"] or "")
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_near_copies_leave_one(stages):
    sets = {}
    for r in stages[2].select("doc_id", "text").collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    where, parent = collections.defaultdict(list), {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sorted(sets):
        for j in {j for s in sets[i] for j in where[s]}:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    assert sorted(r["doc_id"] for r in stages[3].select("doc_id").collect()) == sorted(i for i in sets if find(i) == i)


def test_mix_repeats_whole_documents(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    rows = stages[4].collect()
    assert all(texts[r["doc_id"]] == r["text"] for r in rows)
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 3
    words = lambda docs: sum(len(WORD.findall(r["text"])) for r in docs)
    assert 0.9 < words(rows) / words(stages[3].collect()) < 1.1


def test_tokens_decode_to_the_texts(stages):
    wanted = collections.Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in stages[4].collect())
    got = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in stages[5].collect())
    assert got == wanted


def test_repeated_rows_and_nulls_do_not_crash(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g", "en", "x", 1)] * 3 + [(2, None, None, None, None), (3, "", "en", None, 0), (None, "some text of its own here", "en", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    assert corpus_pipeline.drop_copies(spark, docs, SF).count() == 3
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.mix(spark, docs, SF).where(F.col("text").isNull()).count() == 0
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == len(rows)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_keep_null_identifiers_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").select("text").distinct().limit(30).collect()]
    rows = [(None if i % 3 else i, t, "en", ["x", None][i % 2], len(t)) for i, t in enumerate(good)]
    names = ["own_sha256", "own_turn", "copy_key", "copy_rank", "near_key", "mix_key", "mix_times", "mix_turn", "statistics", "size", "kept", "digest", "run", "rep", "block", "tokens", "ids", "decoded", "position"]
    docs = spark.createDataFrame(rows, schema).withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(r[n] == n for r in found for n in names), name
        assert sum(r["doc_id"] is None for r in found) >= 10, name
    assert corpus_pipeline.tokenize(spark, docs, SF).where("doc_id is null").count() == sum(r[0] is None for r in rows)


def test_run_is_its_stages_one_after_another(spark):
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, SF.replace("0.01", "0.001")).collect()))
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF.replace("0.01", "0.001")).toArrow())
    assert got == collections.Counter(map(tuple, docs.collect()))
