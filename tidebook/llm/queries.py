"""Queries of the training-data operators, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, ctw, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, language, lexical_search, license_scan, mixing, quality, secret_scan, warc
from .scratch import new_path, prepared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.ctw_scores(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ctw": op3_ctw,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}

def _spans_sql(place: int, rule: secret_scan.Rule, pattern: str, least: int) -> str:
    """Spans of one rule: stretches up to a match, and running sums of lengths."""
    quoted = "'" + rf"(?s).*?({pattern})".replace("'", "''") + "'"
    return f"""
select doc_id, {place} as place, '{rule.kind}' as kind, stop - length(regexp_extract(piece, {quoted}, 1)) as start, stop
from (select doc_id, piece, sum(length(piece)) over (partition by doc_id order by nth)::bigint as stop
      from (select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as nth
            from (select doc_id, regexp_extract_all(coalesce(text, ''), {quoted}, 0) as pieces from documents)))
where length(regexp_extract(piece, {quoted}, {1 + rule.group})) >= {least}"""


#: The base rules as they are stated; letters of either case spelled out.
_STATED = {
    "assign": ("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
}
_SPANS = " union all ".join(_spans_sql(i, r, *_STATED.get(r.kind, (r.pattern, 1))) for i, r in enumerate(secret_scan.RULES))
_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, place)"

SQL: dict[str, str] = {
    "op11_lexical_search": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
s as (select count(*) as n, sum(len(t))::bigint as total from d where len(t) > 0),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(t) as term from i) group by 1, 2),
tf as (
  select doc_id, m, term, count(*) as tf
  from (select doc_id, 75 + (25 * len(t) * n) // total as m, unnest(t) as term from d, s where len(t) > 0)
  where term in (select term from asked) group by 1, 2, 3),
w as (select term, floor(1000 * ln((2.0::double * n + 2) / (2.0::double * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), s),
scores as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join w using (term) join tf using (term) group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
""",
    "op12_secret_scan": f"""
with found as ({_SPANS}),
b as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         {_LISTED} filter (kind in ('assign', 'access', 'hex')) as base, {_LISTED} as spans
  from found group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join b using (doc_id)
""",
    "op13_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: x::double) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null),
q as (select vec_id, label, list_transform(e, lambda x: floor(256 * x)) as x from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score
  from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
       other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
""",
    "op1_warc": r"""
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
d as (
  select page_id, strlen(payload) as payload_bytes, min(page_id) over (partition by h) as first,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest
  from p)
select page_id, payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d
""",
    "op4_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as overlap
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * overlap >= 80 * (x.n + y.n - overlap)),
reach(doc_id, low) as (
  select doc_id, doc_id from documents
  union select b, low from reach join links on a = doc_id where low < b)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(low) as component_id
from documents d join reach using (doc_id) left join sizes using (doc_id) group by d.doc_id
""",
    "op5_embedding_dedup": r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
degree as (select a, count(*) as n from links group by a),
reach(vec_id, low) as (
  select vec_id, vec_id from embeddings
  union select b, low from reach join links on a = vec_id where low < b),
c as (select vec_id, min(low) as component_id from reach group by vec_id)
select c.vec_id, coalesce(n, 0) as n_links, component_id, c.vec_id = component_id as kept
from c left join degree on a = vec_id
""",
    "op7_exact_dedup": r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
""",
}
