"""Operators against brute force, on small hand-made and generated tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import blocks, byte_bpe, components, ctw, embedding_dedup, exact_dedup, jaccard_join, language, license_scan, mixing, quality, queries, warc
from tidebook.llm.scratch import new_path, prepared
from tidebook.llm.text import string_chunks
from tests.oracle import expect_equal

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepared(spark)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def odd_texts():
    """Nulls, blanks, one word, long words, long texts, non-ASCII, repeats."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) for _ in range(25)]
    out = [None, "", " \t\n", "x", "X", "one two three four", "One  two three\nfour", "é" * 5000, "a" * 20_000, "𝒳 ﬁ ǅ İ", "\x00 \x1f\x85 　 z"]
    out += base + base[:5] + [b + " tail" for b in base[:10]] + [b.replace(" ", "\n", 3) for b in base[:5]]
    for b in base[5:10]:  # a chain of copies, each a little further off
        w = b.split()
        for i in range(6):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out += ["MIT License", "GNU  General\nPublic-License, gnu general public license", "cc by-nc", "Licensed under CC BY-NC 4.0.", "the word apache license here", " ".join(base)]
    return out


def odd_rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "hot"][i % 4], 0) for i, t in enumerate(odd_texts())]
    return rows + [rows[20], rows[20], (None, "without an identifier at all, twice", "en", "a", 0), (None, "without an identifier at all, twice", "en", "a", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns whose names the operators use inside."""
    names = ["block", "bucket", "payload", "run", "digest", "salt", "statistics", "kept", "shingle", "rep", "held", "row", "skey", "size", "k"]
    return odd.withColumns({n: F.lit("x") for n in names})


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# ---- blocks and components ----------------------------------------------------


def test_varints_round_trip():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**35, 2**48 - 1, 2**55])
    assert (blocks.unvarint(blocks.varint(values)) == values).all()
    assert len(blocks.unvarint(blocks.varint(np.zeros(0)))) == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 520)] + [(7, 7), (None, 3), (8, 9), (9, 8)] + [(rng.randint(1000, 1050), rng.randint(1000, 1050)) for _ in range(30)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


# ---- 1 WARC --------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip_and_bytes_agree(spark):
    rows = [(i, f"http://h/{i} x\n", ["same", None, "", f"body {i} é", "x" * 3000][i % 5]) for i in range(60)] + [(3, "http://h/3 x\n", "body 3 é"), (None, None, "same"), (None, None, "alone")]
    hashes = []
    for cut in (1, 4):
        folder = new_path(spark, "warc-test")
        manifest = warc.write_warc(pages(spark, rows).repartition(cut), folder, shard_bytes=4000, file_bytes=1500)
        hashes.append(sorted((r["file"], r["sha256"], r["records"]) for r in manifest.collect()))
        got = warc.read_warc(spark, folder).collect()
    assert hashes[0] == hashes[1] and len(hashes[0]) > 3
    assert len(got) == len(rows)
    payload = lambda t: (t or "").encode()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[payload(t)] = min(first.get(payload(t), i), i)
    by_type = collections.Counter((r["page_id"], r["record_type"]) for r in got)
    for i, _, t in rows:
        if i is not None and first[payload(t)] != i:
            assert by_type[i, "revisit"] and not by_type[i, "response"]
    assert by_type[3, "response"] == 1 and by_type[3, "revisit"] == 1
    assert by_type[None, "response"] == 2
    for r in got:
        if r["page_id"] is not None:
            own = next(payload(t) for i, _, t in rows if i == r["page_id"])
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(own).digest()).decode()
            assert r["payload_bytes"] == len(own)
            assert (bytes(r["payload"]) == own) if r["record_type"] == "response" else r["refers_to"] == first[own]


def test_warc_small_payloads_and_empty_table(spark):
    folder = new_path(spark, "warc-test")
    warc.write_warc(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), folder, least_revisit_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in warc.read_warc(spark, folder).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder = new_path(spark, "warc-test")
    assert warc.write_warc(pages(spark, []), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0


def test_warc_damage_is_found(spark):
    import io

    record = warc.page_record(1, "u", b"body", warc.base32_sha1(b"body"), None)
    import gzip

    packed = gzip.compress(record)
    assert len(list(warc.read_records(io.BytesIO(packed + packed)))) == 2
    with pytest.raises(Exception):
        list(warc.read_records(io.BytesIO(packed[:-12])))


# ---- 2 byte-level BPE -------------------------------------------------------------


def vocabulary():
    import public_tokenizers

    return byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe_equals_the_library_and_decodes(spark, odd, clashing, empty):
    import tiktoken

    data, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe._ranks(data), special_tokens={})
    wanted = collections.Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in odd_rows())
    for docs in (odd, clashing):
        encoded = byte_bpe.encode_texts(docs, data, pattern)
        decoded = byte_bpe.decode_ids(encoded, data)
        assert decoded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
        got = collections.Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in decoded.collect())
        assert got == wanted
        assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in encoded.collect())
        fused = byte_bpe.encode_texts(docs, data, pattern, decode=True)
        assert collections.Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in fused.collect()) == wanted
    assert byte_bpe.encode_texts(empty, data, pattern, decode=True).count() == 0
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(empty, data, pattern), data).count() == 0


def test_bpe_decodes_nulls_and_batches_of_any_size(spark):
    data, _ = vocabulary()
    ranks = byte_bpe._ranks(data)
    own = {rank: token for token, rank in ranks.items()}
    rng = random.Random(6)
    lists = [None, [], [5], *([rng.randrange(len(ranks)) for _ in range(rng.randint(0, 40))] for _ in range(40))]
    packed = [None if t is None else np.array(t, "<u4").tobytes() for t in lists]
    rows = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(packed)], "position long, ids binary, piece string, own_row string").coalesce(1)
    for size in (1, 7, 4096):
        prepared(spark, size)
        got = {r["position"]: r["decoded"] for r in byte_bpe.decode_ids(rows, data).collect()}
        assert got == {i: None if t is None else b"".join(own[x] for x in t) for i, t in enumerate(lists)}
    with pytest.raises(Exception, match="isn't in the token-byte table"):
        byte_bpe.decode_ids(rows.withColumn("ids", F.unhex(F.lit("ffffff0f"))), data).collect()


def test_bpe_merges_of_short_and_long_words_agree():
    import tiktoken

    data, _ = vocabulary()
    ranks = byte_bpe._ranks(data)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for n in [1, 2, 3, 5, 9, 40, 255, 256, 257, 3000]:
        for letters in ("ab", "a", "the quick brown é "):
            word = "".join(rng.choice(letters) for _ in range(n))
            raw = word.encode()
            assert byte_bpe._merge_short(raw, ranks) == byte_bpe._merge_long(raw, ranks)
            assert byte_bpe._merger(ranks)(raw) == library.encode_ordinary(word)


# ---- 3 context-tree weighting ---------------------------------------------------------


def brute_ctw(train, text, depth):
    """Weighted probabilities straight from the definition, for one text."""
    stream = lambda t: b"".join(w.encode() + b" " for w in words(t)) + b"\n"
    counts = collections.defaultdict(lambda: [0, 0])

    def bits(s):
        for i, byte in enumerate(s):
            context = (b"\n" * depth + s)[i : i + depth]
            node = 1
            for shift in range(7, -1, -1):
                bit = byte >> shift & 1
                yield context, node, bit
                node = node * 2 + bit

    for t in train:
        for context, node, bit in bits(stream(t)):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
    children = collections.defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node])
            if len(context) < depth:
                below = sum(weighted(c, node)[0] for c in children[context, node])
                total = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
                memo[context, node] = (total, math.exp(math.log(0.5) + own - total))
            else:
                memo[context, node] = (own, 1.0)
        return memo[context, node]

    score = 0.0
    for context, node, bit in bits(stream(text)):
        p = None
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            if (c, node) in counts:
                a, b = counts[c, node]
                own, w = (b + 0.5) / (a + b + 1), weighted(c, node)[1]
                p = own if p is None else w * own + (1 - w) * p
        p = 0.5 if p is None else p
        score += math.log10(p if bit else 1 - p)
    return score


def test_ctw_scores_and_base(spark, clashing, empty):
    rows = [r for r in odd_rows() if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t, *_ in rows if not held(i)]
    count = collections.Counter(w for t in train for w in [*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    got = collections.defaultdict(list)
    for r in ctw.ctw_scores(docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        tokens = [*words(t), "\n"]
        r = got[i][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
    for i, t, *_ in rows[:9] + rows[30:33]:
        assert got[i][0]["score"] == pytest.approx(brute_ctw(train, t, ctw.DEPTH), rel=1e-4, abs=1e-4)
    assert ctw.ctw_scores(clashing).count() == len(odd_rows())
    assert ctw.ctw_scores(empty).count() == 0


def test_ctw_probabilities_sum_to_one():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**20, 500).astype(np.uint64))
    levels = ctw.subtree(keys, np.arange(1, len(keys) + 1), 2)
    levels.append(levels[-1].parent())
    levels.append(levels[-1].parent())
    asked = (np.uint64(12345) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert (10 ** ctw.score_grams(asked, levels)).sum() == pytest.approx(1.0)


# ---- 4 n-gram Jaccard join ---------------------------------------------------------------


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_jaccard(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return collections.Counter((i, len(shingles(t)), None if i is None else find(i)) for i, t, *_ in rows)


def test_jaccard_components(spark, odd, clashing, empty):
    wanted = brute_jaccard(odd_rows())
    for docs in (odd, clashing):
        assert bag(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == wanted
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_in_tiles_and_small_blocks(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(160):  # one group of near copies that no single pivot covers
        w = list(base)
        for _ in range(1 + i % 5):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    monkeypatch.setattr(jaccard_join, "TILE", 3000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert bag(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


def test_jaccard_at_the_threshold(spark):
    w = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join(w[:22])), (2, " ".join(w[:18])), (3, " ".join(w[:17])), (4, "A b"), (5, "a  B"), (6, "b a")]
    assert bag(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


def test_jaccard_null_identifiers_beside_equal_texts(spark):
    text = " ".join(f"n{i}" for i in range(60))
    large = 2**53 + 1
    rows = [(None, text), (5, text), (9, text + " more"), (None, "alone with no identifier in this table"), (large, "one text"), (large + 2, "One text"), (large + 4, "another")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert bag(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


# ---- 5 embeddings ------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:180] = x[:80] + rng.normal(size=(80, 16)).astype(np.float32) * 0.12
    x[180:200] = x[0]
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, [float(v) for v in x[0]], None), (305, [2 * float(v) for v in x[0]], 0), (306, [], 1), (None, [float(v) for v in x[0]], 0), (5, [float(v) for v in x[5]], 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), margin=1.0)
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = {i: i for i, *_ in rows}
    links = collections.Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (i, u, p) in enumerate(good):
        for j, v, q in good[:a]:
            if p == q and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[i] += 1
                links[j] += 1
                if i != j:
                    r, s = find(i), find(j)
                    parent[max(r, s)] = min(r, s)
    seen = {}
    for r in got.collect():
        seen[r["vec_id"]] = r
        assert r["component_id"] == find(r["vec_id"])
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        if r["vec_id"] != 5:  # twice there, with counts of its own
            assert r["n_links"] == links[r["vec_id"]]
    assert seen[0]["n_links"] > 7
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_recall_at_the_default_margin(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x[750:] = x[:750] + rng.normal(size=(750, 64)) * rng.uniform(0.02, 0.38, size=(750, 1))
    docs = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = int(((unit @ unit.T) >= 0.93).sum() - len(x))
    assert embedding_dedup.near_duplicates(docs).agg(F.sum("n_links")).head()[0] >= 0.99 * wanted > 300


def test_embedding_links_of_few_dimensions(spark):
    # Displacements go straight at the next list, and from both sides of a border.
    x = np.random.default_rng(3).normal(size=(600, 3))
    docs = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    # So close that components are many.
    near = unit @ unit.T >= 0.999
    reach = near.copy()
    while (wider := (reach.astype(int) @ near) > 0).sum() > reach.sum():
        reach = wider
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(docs, least=0.999).collect()}
    assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(len(x))}
    wanted = {i: int(n) for i, n in enumerate((unit @ unit.T >= 0.93).sum(axis=1) - 1)}
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(docs).collect()} == wanted


# ---- 6 language --------------------------------------------------------------------------------------


def test_language(spark, odd, clashing, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    for d in (odd, clashing):
        rows = language.identify(d).collect()
        assert len(rows) == len(odd_rows())
        by_id = {r["doc_id"]: r for r in rows}
        assert [by_id[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
        assert by_id[7]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 7 exact dedup ---------------------------------------------------------------------------------------


def test_exact_dedup(spark, odd, clashing, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[SPACE.sub(" ", t or "")].append(i)
    wanted = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            wanted[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    for docs in (odd, clashing):
        got = exact_dedup.exact_dedup(docs, runs=16, fan_in=4)
        assert bag(got, "doc_id", "keep_id", "group_size", "text_sha256") == wanted
        assert got.where("kept").count() == len(groups)
        assert got.where("kept and not (doc_id <=> keep_id)").count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0


# ---- 8 mixing ----------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1.0, 2.0, 3.0), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, odd, clashing, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), None, ["big", "big", "big", "é", "small", None][i % 6] if i > 12 else "tiny", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs, block_words=16, shard_slots=64, chunk_docs=32).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    target, taken = brute_targets(sizes), collections.Counter()
    assert any(target[s] == 3 * sizes[s] for s in sizes)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], abs=2 * 16 + 0.01 * target[s])
    again = mixing.mix_sources(docs.repartition(7), block_words=16, shard_slots=64, chunk_docs=32).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    for d in (odd, clashing):
        assert mixing.mix_sources(d).count() == len(odd_rows())
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(odd.withColumn("text", F.lit(" "))).agg(F.sum("taken")).head()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000])
def test_permutations_are_bijective(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))


# ---- 9 license scan --------------------------------------------------------------------------------------------


def test_license_scan(spark, odd, clashing, empty):
    extra = [(900, "intro. Permission to use, copy, modify, and/or distribute this software for any purpose with or without a fee is now granted, provided that the above copyright notice and this permission notice appear in all copies. end", None, None, 0), (901, "x " * 50 + "All rights reserved.", None, None, 0)]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for docs in (odd, clashing):
        docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
        got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
        for i, t, *_ in odd_rows() + extra:
            w = pattern.findall(lower(t))
            places, labels = [], set()
            for phrase, label in license_scan.PHRASES.items():
                p = phrase.split()
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        places.append(j)
                        labels.add(label)
            r = got[i]
            assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
            assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
            assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert got[900]["labels"] == "isc" and 0.9 < got[900]["score"] < 1
        assert got[901]["labels"] == "all-rights-reserved"
    assert license_scan.license_scan(empty).count() == 0


# ---- 10 quality --------------------------------------------------------------------------------------------------


def test_quality(spark, odd, clashing, empty):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    blank = spark.createDataFrame([], "doc_id long, quality int")
    for d in (odd, clashing):
        rows = quality.quality_scores(d, labels).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert {r["score"] for r in quality.quality_scores(d, blank).collect()} == {0.5}
        kept = quality.keep_quality(d, blank)
        assert kept.columns == d.columns and kept.count() == len(odd_rows())
    assert quality.quality_scores(empty, labels).count() == 0


def test_rules_in_spark_equal_rules_in_python(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.4)).astype(float)
    model = quality.fit(x, y)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, s array<double>")
    got = np.array([r[0] for r in df.select(model.score(F.col("s"))).collect()])
    total = np.full(len(x), model.intercept)
    for rule in model.rules:
        total += rule.weight * rule.holds(x)
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.97


# ---- queries and texts ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    expect_equal(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL)


def test_chunks_cover_all_rows():
    import pyarrow as pa

    column = pa.chunked_array([["ab", None, "c" * 3_000_000], ["", "d"]], pa.string())
    pieces = [(first, rows, bytes(data)) for first, rows, data, _ in string_chunks(column)]
    assert b"".join(p[2] for p in pieces) == b"ab" + b"c" * 3_000_000 + b"d"
    assert [p[0] for p in pieces] == list(np.cumsum([0, *(p[1] for p in pieces[:-1])]))
