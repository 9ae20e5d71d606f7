"""Secret scans over an incremental ledger of blobs (DataFrame operations only).

Every row is a historical version of some path.  Its text is addressed by its
SHA-256: equal texts are one blob, however many paths and versions hold them.
The ledger says which rule versions have seen a blob and what they found.  A scan
reads only texts of blobs that some wanted rule version hasn't seen, runs only
these rules over each such blob once, appends to the ledger, and joins the
ledger's findings back to all paths.

Positions come from one regular expression a rule: ``\\G.*?(rule)`` cuts a text
into stretches that end with a match, so running sums of their lengths are the
places of the matches.  Stretches become lengths at once; they are summed in a
window over a blob and rule, which is partitioned as the texts already are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import all_columns, materialize, new_path, unused


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one match at a place; ``group`` of it (the whole, for 0)
    has at least ``least`` characters, else the match is dropped, after it has
    used up its characters.  ``literal`` is in every match.  A change of any of
    these needs a new ``version``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    literal: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    # A run of 20 or 24 characters begins where its maximal run does, so these
    # two ask for the length inside the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", literal="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What this scan finds beside them: forms that issuers of credentials publish.
ISSUED = (
    Rule("private-key", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----", literal="PRIVATE KEY-----"),
    Rule("repository-token", r"gh[pousr]_[A-Za-z0-9]{36,}", literal="gh"),
    Rule("chat-token", r"xox[abprs]-[A-Za-z0-9-]{10,}", literal="xox"),
    Rule("web-token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", literal="eyJ"),
    Rule("map-key", r"AIza[A-Za-z0-9_-]{35}", literal="AIza"),
)
RULES = BASE + ISSUED

LEDGER = "blob binary, rules array<string>, findings array<struct<start: long, rule: string, end: long>>"
#: Up to so many blobs (of 32 bytes and the names of their rules) travel to every
#: executor to choose texts before these are shuffled; more are joined by a shuffle.
FEW_BLOBS = 100_000


def _lengths(text: Column, rule: Rule) -> Column:
    """Of each stretch that ends with a match: its length, the match's, and
    whether the match counts."""
    anchored = rf"(?s)\G.*?({rule.pattern})"
    match = lambda s: F.regexp_extract(s, anchored, 1)
    counts = (lambda s: F.length(F.regexp_extract(s, anchored, 1 + rule.group)) >= rule.least) if rule.least else (lambda s: F.lit(True))
    found = F.transform(F.regexp_extract_all(text, F.lit(anchored), F.lit(0)), lambda s: F.struct(F.length(s).cast("long").alias("stretch"), F.length(match(s)).cast("long").alias("match"), counts(s).alias("counts")))
    return F.when(F.contains(text, F.lit(rule.literal)), found) if rule.literal else found


def _scanned(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``todo (blob, text, needed)``: each blob once."""
    entries = [F.when(F.array_contains("needed", r.key), F.struct(F.lit(r.key).alias("rule"), _lengths(F.col("text"), r).alias("found"))) for r in rules]
    # The text's digest deals the rows out; nothing below needs another exchange.
    per_rule = todo.select("blob", "needed", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("blob", "needed", "e.rule", "e.found")
    # A rule without a match keeps a row, so that its blob counts as seen.
    stretches = per_rule.select("blob", "needed", "rule", F.posexplode_outer("found").alias("place", "f"))
    before = Window.partitionBy("blob", "rule").orderBy("place")
    placed = stretches.withColumn("end", F.sum("f.stretch").over(before))
    finding = F.when(F.col("f.counts"), F.struct((F.col("end") - F.col("f.match")).alias("start"), "rule", "end"))
    return placed.groupBy("blob").agg(F.first("needed").alias("rules"), F.collect_list(finding).alias("findings"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of a ledger; none where it doesn't exist yet."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger}/scans")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", addressed: DataFrame | None = None) -> int:
    """Scan what the ledger lacks and append it; the number of blobs scanned.

    ``addressed`` may give the blobs of ``versions`` where they are written
    already.  An append is one job's output, which Spark commits at its end: a
    scan that breaks off leaves the ledger as it was, and running it again scans
    the same pairs.
    """
    spark = versions.sparkSession
    texts = versions.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).select(blob_of(F.col("text")).alias("blob"), "text")
    wanted = F.array(*(F.lit(r.key) for r in rules))
    blobs = (addressed if addressed is not None else texts).select("blob").distinct()
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    needed = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.join(seen, "blob", "left").select("blob", needed.alias("needed")).where(F.size("needed") > 0)
    unseen = materialize(unseen, "unseen-blobs")
    n = unseen.count()
    if not n:
        return 0
    one = F.first("text").alias("text")
    if n <= FEW_BLOBS:
        todo = texts.join(F.broadcast(unseen), "blob").groupBy("blob").agg(one, F.first("needed").alias("needed"))
    else:
        # Copies of a text become one row of a task before anything is shuffled.
        todo = texts.groupBy("blob").agg(one).join(unseen.hint("shuffle_hash"), "blob")
    _scanned(todo, rules).write.mode("append").option("compression", "zstd").parquet(f"{ledger}/scans")
    return n


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _listed(spans: Column, names: dict[str, str]) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kind = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_in(ledger_rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, spans``: what the given rule versions found, by start and then in
    the order of the rules; blobs without a finding have no row."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    own = F.filter("findings", lambda f: f["rule"].isin(*(r.key for r in rules)))
    rows = ledger_rows.select("blob", own.alias("own")).where(F.size("own") > 0)
    spans = F.transform(F.flatten(F.collect_list("own")), lambda f: F.struct(f["start"].alias("start"), F.element_at(order, f["rule"]).alias("place"), f["end"].alias("end"), f["rule"].alias("rule")))
    # A pair scanned twice (two scans at once) has its findings twice.
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(spans)).alias("spans"))


def secret_scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``versions``: its identifier, ``n_<kind>`` of each
    base rule, ``base_sha256`` (of the base spans' list) and ``spans``.

    Spans are ``kind:start:end`` in code points, by start and then by the order
    of the rules.  A null text is the empty text, and has no spans; texts of any
    length are scanned whole.  Repeated rows are versions of their own that share
    a blob; null identifiers stay null.  An empty table gives an empty result.
    Columns not named are not read, whatever their names.  Without ``ledger``,
    the scan starts from an empty one.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "blob-ledger")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    addressed = materialize(versions.select(F.col(f"`{id_col}`").alias("path"), blob_of(text).alias("blob")), "versions")
    update_ledger(versions, ledger, rules, text_col, addressed)
    found = found_in(read_ledger(spark, ledger), rules)
    names, base_keys = {r.key: r.kind for r in rules}, [r.key for r in base]
    of_base = F.filter("spans", lambda s: s["rule"].isin(*base_keys))
    of_rule = lambda r: F.filter("spans", lambda s: s["rule"] == r.key)
    counts = {f"n_{r.kind}": F.size(of_rule(r)).cast("long") for r in base}
    found = found.select("blob", *(c.alias(name) for name, c in counts.items()), F.sha2(_listed(of_base, names), 256).alias("base_sha256"), _listed(F.col("spans"), names).alias("listed"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return addressed.join(found, "blob", "left").select(
        F.col("path").alias(id_col),
        *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts),
        F.coalesce("base_sha256", none).alias("base_sha256"),
        F.coalesce("listed", F.lit("")).alias("spans"),
    )


def with_findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``versions`` with an array ``findings`` of ``kind, start, end, secret``
    for those that have any: what a review or a redaction works on."""
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "blob-ledger")
    update_ledger(versions, ledger, rules, text_col)
    key, spans, out = unused("blob_key", versions), unused("blob_spans", versions), unused("findings", versions)
    found = found_in(read_ledger(spark, ledger), rules).select(F.col("blob").alias(key), F.col("spans").alias(spans))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kind = reduce(lambda col, r: lambda s, col=col, r=r: F.when(s["rule"] == r.key, r.kind).otherwise(col(s)), rules, lambda s: F.lit(None).cast("string"))
    cut = lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    listed = F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), cut(s).alias("secret")))
    return versions.withColumn(key, blob_of(text)).join(found, key).select(*all_columns(versions), listed.alias(out))
