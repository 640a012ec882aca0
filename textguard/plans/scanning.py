"""Rule scans, validated data, secrets and what is counted on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import severity
from textguard.functions.masking import audit_text
from textguard.functions.text import truncated_prefix
from textguard.operators import distinct, guard, ruleset, scan
from textguard.plans import sql
from textguard.plans.registry import query
from textguard.rules import rules_of, validated
from textguard.sources.tables import corpus, table

KEYS = ["corpus", "id"]


def _texts(spark, sf):
    return corpus(spark, sf)


def _pack_sql(pack):
    pairs = rules_of(pack)
    return sql.with_corpus(
        "SELECT pack, rule, severity, count(DISTINCT corpus || id) AS texts, count(value) AS matches "
        f"FROM ({sql.rule_table(pairs)}) LEFT JOIN hits USING (n, pack, rule, severity) GROUP BY ALL",
        hits=sql.rule_hits(pairs),
    )


def _register_pack(name, pack):
    @query(name, _pack_sql(pack))
    def run(spark, sf):
        return scan.rule_counts(_texts(spark, sf), [pack])


# Texts and matches per rule, one query per pack.
_register_pack("b2_secret_rules", "secrets")
_register_pack("b3_us_core_rules", "pii-us-core")
_register_pack("b4_us_extended_rules", "pii-us-extended")
_register_pack("b5_financial_rules", "pii-financial")
_register_pack("b6_international_rules", "pii-international")
_register_pack("b7_injection_rules", "xss")
_register_pack("b8_compliance_rules", "compliance")


@query(
    "b1_match_offsets",
    sql.with_corpus('SELECT corpus, id, rule, pack, severity, 1.0::DOUBLE AS confidence, value, start, "end" FROM hits', hits=sql.rule_hits()),
)
def match_offsets(spark, sf):
    return scan.findings(_texts(spark, sf), KEYS)


@query(
    "g1_all_packs",
    sql.with_corpus("SELECT corpus, pack, count(*) AS findings, count(DISTINCT id) AS texts FROM hits GROUP BY ALL", hits=sql.rule_hits()),
)
def all_packs(spark, sf):
    seen = scan.scan(_texts(spark, sf))
    # Per text the packs are counted in place, so that what is grouped is one
    # row per text and pack, not one per finding.
    per = seen.select(
        *KEYS,
        F.explode_outer(F.array_distinct("matches.pack")).alias("pack"),
        "matches",
    ).where(F.col("pack").isNotNull())
    sized = per.select("corpus", "pack", F.size(F.filter("matches", lambda m: m["pack"] == F.col("pack"))).alias("n"))
    return sized.groupBy("corpus", "pack").agg(
        F.sum(F.col("n").cast("long")).alias("findings"), F.count(F.lit(1)).alias("texts")
    )


@query(
    "d9_pack_counts",
    sql.with_corpus(
        "SELECT pack, max(pattern_count) AS pattern_count, count(value) AS matches FROM (SELECT pack, count(*)::INT AS pattern_count "
        f"FROM ({sql.rule_table(sql.PAIRS)}) GROUP BY pack) LEFT JOIN hits USING (pack) GROUP BY pack",
        hits=sql.rule_hits(),
    ),
)
def pack_counts(spark, sf):
    return scan.pack_counts(_texts(spark, sf))


@query(
    "f1_ordered_findings",
    sql.with_corpus(
        "SELECT corpus, id, string_agg(rule || '@' || start, ' ' ORDER BY start, n) AS findings FROM hits GROUP BY corpus, id",
        hits=sql.rule_hits(),
    ),
)
def ordered_findings(spark, sf):
    listed = F.transform("matches", lambda m: F.concat(m["rule"], F.lit("@"), m["start"].cast("string")))
    rows = scan.scan(_texts(spark, sf)).select(*KEYS, F.array_join(listed, " ").alias("findings"))
    return rows.select(*KEYS, F.explode_outer(F.filter(F.array("findings"), lambda f: f != "")).alias("findings")).where(
        F.col("findings").isNotNull()
    )


# -------------------------------------------------------- validated categories
_PII_ROWS = 'corpus, id, category, start, "end", value, severity, redacted'


@query("b9_validated_pii", sql.with_corpus(f"SELECT {_PII_ROWS} FROM pii", pii=sql.pii()))
def validated_pii(spark, sf):
    return scan.exploded(guard.with_pii(_texts(spark, sf), into="pii"), KEYS, "pii")


@query("h10_context_findings", sql.with_corpus("SELECT corpus, id, category, start, redacted AS value FROM pii", pii=sql.pii()))
def context_findings(spark, sf):
    seen = guard.with_pii(_texts(spark, sf)).withColumn("pii", guard.context_view(F.col("pii")))
    return scan.exploded(seen, KEYS, "pii").select(*KEYS, "category", "start", "value")


def _counted(df, column):
    """Findings per value of a struct field: partial counts per task."""
    return df.select(F.explode_outer(column).alias("k")).where(F.col("k").isNotNull()).groupBy("k")


@query("d1_category_counts", sql.with_corpus("SELECT category, count(*) AS n FROM pii GROUP BY category", pii=sql.pii()))
def category_counts(spark, sf):
    seen = guard.with_pii(_texts(spark, sf))
    return _counted(seen, "pii.category").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("k", "category")


@query(
    "d2_severity_summary",
    sql.with_corpus(
        "SELECT corpus, count(*) FILTER (severity >= 5) AS critical, count(*) FILTER (severity = 4) AS high, "
        "count(*) FILTER (severity = 3) AS medium, count(*) FILTER (severity < 3) AS low "
        "FROM corpus LEFT JOIN pii USING (corpus, id) GROUP BY corpus",
        pii=sql.pii(),
    ),
)
def severity_summary(spark, sf):
    seen = guard.with_pii(_texts(spark, sf))
    names = F.transform("pii", lambda m: severity.name_of(m["severity"]))
    count = lambda name: F.sum(F.size(F.filter("names", lambda s: s == name)).cast("long")).alias(name)
    return seen.select("corpus", names.alias("names")).groupBy("corpus").agg(
        *[count(n) for n in ("critical", "high", "medium", "low")]
    )


_META_ROWS = ", ".join(
    f"({sql.lit(c)}, {s}, {sql.lit(f)}, {sql.lit(p)})" for c, (s, fs, p) in validated.METADATA.items() for f in fs
)


@query(
    "c2_category_metadata",
    sql.with_corpus(
        "SELECT corpus, id, category, start, m.severity AS category_severity, m.prefix, m.frameworks FROM pii JOIN "
        f"(SELECT category, severity, string_agg(framework, ',' ORDER BY framework) AS frameworks, prefix FROM (VALUES {_META_ROWS}) "
        "AS t(category, severity, framework, prefix) GROUP BY ALL) m USING (category)",
        pii=sql.pii(),
    ),
)
def category_metadata(spark, sf):
    meta = spark.createDataFrame(
        [(c, s, ",".join(sorted(f)), p) for c, (s, f, p) in validated.METADATA.items()],
        "category string, category_severity int, frameworks string, prefix string",
    )
    found = scan.exploded(guard.with_pii(_texts(spark, sf)), KEYS, "pii")
    # The metadata table has one row per category of the catalogue.
    return found.join(F.broadcast(meta), "category", "left").select(
        *KEYS, "category", "start", "category_severity", "prefix", "frameworks"
    )


@query(
    "c7_framework_exposure",
    sql.with_corpus(
        "SELECT framework, corpus, count(*) AS findings, count(DISTINCT id) AS texts FROM pii JOIN "
        f"(VALUES {_META_ROWS}) AS t(category, s, framework, prefix) USING (category) GROUP BY framework, corpus",
        pii=sql.pii(),
    ),
)
def framework_exposure(spark, sf):
    table_of = F.create_map(
        *[x for c, (_, fs, _) in validated.METADATA.items() for x in (F.lit(c), F.array(*[F.lit(f) for f in fs]))]
    )
    hit = F.flatten(F.transform("pii.category", lambda c: F.element_at(table_of, c)))
    per = guard.with_pii(_texts(spark, sf)).select(*KEYS, hit.alias("hit"))
    rows = per.select("corpus", "hit", F.explode_outer(F.array_distinct("hit")).alias("framework")).where(
        F.col("framework").isNotNull()
    )
    n = F.size(F.filter("hit", lambda f: f == F.col("framework"))).cast("long")
    return rows.select("framework", "corpus", n.alias("n")).groupBy("framework", "corpus").agg(
        F.sum("n").alias("findings"), F.count(F.lit(1)).alias("texts")
    )


# ---------------------------------------------------------------------- secrets
@query(
    "b2_secret_findings",
    sql.with_corpus('SELECT corpus, id, rule, category, provider, severity, mask AS value, start, "end" FROM secret', secret=sql.secret()),
)
def secret_findings(spark, sf):
    return scan.exploded(guard.with_secrets(_texts(spark, sf)), KEYS, "secrets")


@query(
    "d3_secrets_by_provider",
    sql.with_corpus(
        "SELECT provider, category, severity, count(*) AS n, count(DISTINCT corpus || id) AS texts FROM secret GROUP BY ALL",
        secret=sql.secret(),
    ),
)
def secrets_by_provider(spark, sf):
    return guard.secret_counts(guard.with_secrets(_texts(spark, sf)))


# ---------------------------------------------------------- thresholds and texts
_THRESHOLDS = ("low", "medium", "high", "critical", "bogus")


def _test(meets, threshold):
    return lambda s: meets(s, threshold)


@query(
    "b11_severity_threshold",
    sql.with_corpus(
        "SELECT threshold, count(*) FILTER (level >= least_level) AS kept, count(*) AS total FROM (SELECT "
        f"{sql.LEVEL} AS level FROM (SELECT severity FROM hits UNION ALL SELECT '' FROM corpus)), "
        "(VALUES ('low', 1), ('medium', 2), ('high', 3), ('critical', 4), ('bogus', 3)) AS t(threshold, least_level) GROUP BY threshold",
        hits=sql.rule_hits(),
    ),
)
def severity_threshold(spark, sf):
    # Each text also adds an unnamed severity, which no threshold lets through.
    seen = scan.scan(_texts(spark, sf)).select(F.array_append("matches.severity", F.lit("")).alias("s"))
    counts = seen.select(
        F.size("s").alias("total"),
        *[F.size(F.filter("s", _test(severity.meets, t))).alias(t) for t in _THRESHOLDS],
    )
    sums = counts.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("total", *_THRESHOLDS)])
    rows = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(t).alias("kept"), F.col("total")) for t in _THRESHOLDS]
    )
    return sums.select(F.inline(rows))


@query(
    "b12_editor_threshold",
    sql.with_corpus(
        "SELECT threshold, count(*) FILTER (level >= least_level) AS kept FROM (SELECT CASE severity WHEN 'critical' THEN 4 "
        "WHEN 'high' THEN 3 WHEN 'low' THEN 1 WHEN 'info' THEN 1 ELSE 2 END AS level FROM (SELECT severity FROM hits UNION ALL "
        "SELECT unnest(['info', '']) FROM corpus)), (VALUES ('low', 1), ('medium', 2), ('high', 3), ('critical', 4), ('bogus', 2)) "
        "AS t(threshold, least_level) GROUP BY threshold",
        hits=sql.rule_hits(),
    ),
)
def editor_threshold(spark, sf):
    seen = scan.scan(_texts(spark, sf)).select(
        F.concat("matches.severity", F.array(F.lit("info"), F.lit(""))).alias("s")
    )
    counts = seen.select(
        *[F.size(F.filter("s", _test(severity.meets_in_editor, t))).alias(t) for t in _THRESHOLDS]
    )
    sums = counts.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in _THRESHOLDS])
    return sums.select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(t).alias("kept")) for t in _THRESHOLDS]))
    )


@query(
    "b25_audit_text",
    sql.with_corpus(
        "SELECT corpus, id, rule, start, CASE WHEN rule LIKE 'secret\\_%' ESCAPE '\\' THEN '[REDACTED]' WHEN rule LIKE 'pii%' THEN "
        "CASE WHEN length(value) < 4 THEN '[REDACTED]' ELSE left(value, 2) || '***' || right(value, 2) END ELSE value END AS shown FROM hits",
        hits=sql.rule_hits(),
    ),
)
def audit_texts(spark, sf):
    found = scan.findings(_texts(spark, sf), KEYS)
    return found.select(*KEYS, "rule", "start", audit_text(F.col("rule"), F.col("value")).alias("shown"))


# The cap is small here so that the given texts reach it.
_CAP = 1000


@query(
    "b10_scan_cap",
    "SELECT doc_id, strlen(text) > 1000 AS truncated, length(head)::INT AS kept_chars, md5(head) AS head FROM (SELECT doc_id, text, "
    "CASE WHEN strlen(text) <= 1000 THEN text ELSE left(text, list_max(list_filter(range(0, 1001), "
    "lambda k: strlen(left(text, k)) <= 1000))) END AS head FROM documents)",
)
def scan_cap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    head = docs.withColumn("h", truncated_prefix(F.col("text"), _CAP))
    return head.select(
        "doc_id", (F.octet_length("text") > _CAP).alias("truncated"), F.length("h").alias("kept_chars"), F.md5("h").alias("head")
    )


@query(
    "c6_scan_each_text_once",
    sql.with_corpus(
        'SELECT doc_id, rule, start, "end" FROM hits',
        documents_keyed="SELECT doc_id, text FROM documents",
        hits=sql.rule_hits(source="documents_keyed", keys="doc_id"),
    ),
)
def scan_each_text_once(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = distinct.once_per_text(docs, "doc_id", lambda texts: scan.findings(texts, ["text_id"]))
    return found.select("doc_id", "rule", "start", "end")


_OWN_PATTERNS = (r"\b[0-9a-f]{40}\b", r"[a-z0-9]+\.example\.com")


@query(
    "j1_custom_patterns",
    sql.with_corpus(
        f"SELECT corpus, id, category, start, value, severity, redacted FROM ({sql.pii()}) "
        "UNION ALL SELECT corpus, id, 'email', start, value, 3, '****' FROM ("
        + sql.matches([sql.Rule(f"own_{i}", "", p) for i, p in enumerate(_OWN_PATTERNS)])
        + ")",
    ),
)
def custom_patterns(spark, sf):
    texts = _texts(spark, sf)
    shown = [*KEYS, "category", "start", "value", "severity", "redacted"]
    known = scan.exploded(guard.with_pii(texts), KEYS, "pii").select(*shown)
    rules = spark.createDataFrame(
        [(validated.CUSTOM_CATEGORY, validated.CUSTOM_SEVERITY, validated.CUSTOM_REDACTED, p) for p in _OWN_PATTERNS],
        "category string, severity int, redacted string, pattern string",
    )
    return known.unionByName(ruleset.findings(texts, rules, KEYS).select(*shown))


def _item_rules(items):
    """A rule for each benchmark item: its first four runs of letters, however they are written and parted."""
    runs = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 4)
    named = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    pattern = F.concat(F.lit(r"(?i)\b"), F.array_join(runs, "[^A-Za-z]+"), F.lit(r"\b"))
    return items.select(named.alias("rule"), pattern.alias("pattern")).where(F.size(runs) == 4)


@query(
    "a7_rules_table",
    r"""SELECT doc_id, rule, count(*) AS n, min(length(split_part(t, chr(1), 1))) AS first
    FROM (SELECT doc_id, rule, unnest(regexp_extract_all(text, pattern)) AS hit, regexp_replace(text, pattern, chr(1)) AS t
      FROM (SELECT doc_id, text, rule, pattern FROM documents, (
        SELECT 'item-' || item_id AS rule, '(?i)\b' || array_to_string(runs[1:4], '[^A-Za-z]+') || '\b' AS pattern
        FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS runs FROM benchmark) WHERE len(runs) >= 4)))
    GROUP BY doc_id, rule""",
)
def rules_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = ruleset.findings(docs, _item_rules(table(spark, sf, "benchmark")), ["doc_id"])
    return found.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("long").alias("first"))


