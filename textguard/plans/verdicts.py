"""Verdicts, summaries, policy decisions, audit rows and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import severity
from textguard.functions.text import token_estimate
from textguard.operators import audit, guard, hosts, policy, redact, scan, usage
from textguard.operators.claims import EXPLANATION
from textguard.operators.threat import heuristic_score
from textguard.plans import monitoring, scoring, sql
from textguard.plans.registry import query
from textguard.session import shared_dir
from textguard.sources import log
from textguard.sources.tables import corpus, table, traffic

KEYS = ["corpus", "id"]
TALK = ["conv_id", "turn"]


def _texts(spark, sf):
    return corpus(spark, sf)


def _joined(column):
    return F.array_join(column, ",")


_VERDICT = {"threats": sql.threats(), "verdict": sql.verdict()}
_RESULTS = {"threats": sql.threats(), "results": sql.results()}
_DOCS = "SELECT doc_id, text FROM documents"
_DOC_RESULTS = {
    "docs": _DOCS,
    "threats": sql.threats("docs", "doc_id"),
    "verdict": sql.verdict("docs", "doc_id"),
    "results": sql.results("docs", "doc_id"),
}


@query(
    "a1_document_summary",
    sql.with_corpus(
        "SELECT doc_id, coalesce(n, 0) AS total_detections, NOT allowed AS blocked, block_reason, tokens, "
        "array_to_string(pii, ',') AS pii_categories, array_to_string(secrets, ',') AS secret_types, "
        "coalesce(highest, 'low') AS highest_severity FROM verdict LEFT JOIN (SELECT doc_id, count(*) AS n, "
        f"arg_max(severity, {sql.LEVEL}) AS highest FROM results GROUP BY doc_id) USING (doc_id)",
        **_DOC_RESULTS,
    ),
)
def document_summary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    s = F.col("summary")
    return guard.with_summary(docs).select(
        "doc_id",
        s["total_detections"].alias("total_detections"),
        s["blocked"].alias("blocked"),
        s["block_reason"].alias("block_reason"),
        s["tokens"].alias("tokens"),
        _joined(s["pii_categories"]).alias("pii_categories"),
        _joined(s["secret_types"]).alias("secret_types"),
        policy.highest_severity(s["results"]).alias("highest_severity"),
    )


@query(
    "b24_verdict",
    sql.with_corpus(
        "SELECT corpus, id, allowed, block_reason, tokens, threat_count, array_to_string(types, ',') AS types, "
        "array_to_string(pii, ',') AS pii, array_to_string(secrets, ',') AS secrets, array_to_string(xss, ',') AS xss, "
        "array_to_string(compliance, ',') AS compliance FROM verdict",
        **_VERDICT,
    ),
)
def verdicts(spark, sf):
    v = F.col("verdict")
    return guard.with_verdict(_texts(spark, sf)).select(
        *KEYS,
        v["allowed"].alias("allowed"),
        v["block_reason"].alias("block_reason"),
        v["tokens"].alias("tokens"),
        F.size(v["threats"]).alias("threat_count"),
        _joined(v["threats"]["type"]).alias("types"),
        *[_joined(v[c]).alias(c) for c in ("pii", "secrets", "xss", "compliance")],
    )


@query(
    "b24_strict_verdict",
    sql.with_corpus(
        "SELECT corpus, id, threat_count = 0 AS allowed, CASE WHEN block_reason <> '' THEN block_reason WHEN threat_count > 0 "
        "THEN 'Strict mode: threats detected in response' ELSE '' END AS block_reason FROM verdict",
        **_VERDICT,
    ),
)
def strict_verdicts(spark, sf):
    config = guard.GuardConfig(strict=True)
    v = F.col("verdict")
    return guard.with_verdict(_texts(spark, sf), config=config).select(
        *KEYS, v["allowed"].alias("allowed"), v["block_reason"].alias("block_reason")
    )


_LIMITS = usage.Limits(max_tokens=3000, tokens_per_window=2000, requests_per_window=4, window_seconds=3600)
_ALL_CHECKS = {
    "docs": _DOCS,
    "events": f"SELECT doc_id AS event_id, doc_id // 5 AS user_id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS ts, {sql.TOKENS} AS value FROM docs",
    "refused": f"SELECT event_id AS doc_id, reason FROM ({monitoring._limiter_sql(_LIMITS)}) WHERE NOT allowed",
    "claimed": f"SELECT doc_id FROM ({scoring._BASE.replace('corpus, id, text', 'doc_id').replace('FROM corpus', 'FROM docs')}) WHERE phrases > 3 AND total_claims > 2",
    "threats": sql.threats("docs", "doc_id")
    + " UNION ALL SELECT doc_id, 5, 0, 0, 'token_limit', 4, reason, '', '', 0, 0 FROM refused"
    + f" UNION ALL SELECT doc_id, 7, 0, 0, 'hallucination', 3, {sql.lit(EXPLANATION)}, '', '', 0, 0 FROM claimed",
    "verdict": sql.verdict("docs", "doc_id"),
}


@query(
    "b24_full_precedence",
    sql.with_corpus(
        f"""SELECT doc_id, threat_count = 0 AS allowed, CASE WHEN c.doc_id IS NOT NULL THEN 'Hallucination detected: ' || {sql.lit(EXPLANATION)}
          WHEN block_reason <> '' THEN block_reason WHEN reason IS NOT NULL THEN reason
          WHEN threat_count > 0 THEN 'Strict mode: threats detected in response' ELSE '' END AS block_reason,
          threat_count, array_to_string(types, ',') AS types, len(secrets) = 0 AND len(pii) = 0 AND threat_count = 0 AS clean_report
        FROM verdict LEFT JOIN refused USING (doc_id) LEFT JOIN claimed c USING (doc_id)""",
        **_ALL_CHECKS,
    ),
)
def full_precedence(spark, sf):
    """Strict verdicts with every check on: limiter, toxicity and claims, whose reasons overwrite each other in order."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    sent = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60)
    requests = docs.select(
        "doc_id", F.expr("doc_id DIV 5").alias("client"), sent.alias("ts"), token_estimate(F.col("text")).alias("tokens")
    )
    decided = usage.limit(requests, "client", "ts", "doc_id", "tokens", _LIMITS)
    refused = decided.where(~F.col("allowed")).select("doc_id", F.col("reason").alias("refusal"))
    judged = guard.with_verdict(docs, config=guard.GuardConfig(strict=True, hallucination=True)).select("doc_id", "verdict")
    all_ = judged.join(refused, "doc_id", "left").withColumn("verdict", guard.limited(F.col("verdict"), F.col("refusal")))
    v = F.col("verdict")
    return all_.select(
        "doc_id", v["allowed"].alias("allowed"), v["block_reason"].alias("block_reason"), F.size(v["threats"]).alias("threat_count"),
        _joined(v["threats"]["type"]).alias("types"),
        F.coalesce(F.element_at(v["reports"], "SOC2")["compliant"], F.lit(False)).alias("clean_report"),
    )


@query(
    "b14_severity_mapping",
    sql.with_corpus(
        "SELECT type, severity AS score, CASE WHEN severity >= 5 THEN 'critical' WHEN severity >= 4 THEN 'high' "
        "WHEN severity >= 3 THEN 'medium' ELSE 'low' END AS name, count(*) AS n FROM threats GROUP BY ALL",
        threats=sql.threats(),
    ),
)
def severity_mapping(spark, sf):
    rows = scan.exploded(guard.with_verdict(_texts(spark, sf)).select("verdict.threats"), [], "threats")
    named = rows.select("type", F.col("severity").alias("score"), severity.name_of(F.col("severity")).alias("name"))
    return named.groupBy("type", "score", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_toxicity",
    sql.with_corpus(
        "SELECT corpus, id, 5 AS severity, 'Harmful content detected: ' || array_to_string(tox, ', ') AS explanation "
        f"FROM (SELECT corpus, id, {sql.TOXICITY} AS tox FROM corpus) WHERE len(tox) > 0"
    ),
)
def toxicity(spark, sf):
    t = F.col("toxicity")
    rows = guard.with_toxicity(_texts(spark, sf)).select(
        *KEYS, t["severity"].alias("severity"), t["explanation"].alias("explanation")
    )
    # Filtering on an exploded one-element array keeps the patterns from being
    # evaluated once more inside a pushed-down filter.
    kept = F.filter(F.array("explanation"), lambda e: e != "")
    return rows.select(*KEYS, "severity", F.explode_outer(kept).alias("explanation")).where(F.col("explanation").isNotNull())


_FRAMEWORKS = """
  SELECT corpus, id, 'GDPR' AS framework, false AS compliant FROM verdict WHERE list_has_any(pii, ['email', 'phone', 'address'])
  UNION ALL SELECT corpus, id, 'HIPAA', false FROM verdict WHERE list_has_any(pii, ['health_info', 'date_of_birth'])
  UNION ALL SELECT corpus, id, 'PCI-DSS', false FROM verdict WHERE list_has_any(pii, ['credit_card', 'bank_account'])
  UNION ALL SELECT corpus, id, 'SOC2', len(secrets) = 0 FROM verdict WHERE len(secrets) > 0 OR (len(pii) = 0 AND allowed)"""


@query("d4_compliance_reports", sql.with_corpus(f"SELECT * FROM ({_FRAMEWORKS})", **_VERDICT))
def compliance_reports(spark, sf):
    seen = guard.with_verdict(_texts(spark, sf))
    rows = seen.select(*KEYS, F.explode_outer("verdict.reports").alias("framework", "r")).where(
        F.col("framework").isNotNull()
    )
    return rows.select(*KEYS, "framework", F.col("r.compliant").alias("compliant"))


@query(
    "d4_framework_rollup",
    sql.with_corpus(
        f"SELECT corpus, framework, count(*) FILTER (compliant) AS compliant, count(*) FILTER (NOT compliant) AS violations FROM ({_FRAMEWORKS}) GROUP BY ALL",
        **_VERDICT,
    ),
)
def framework_rollup(spark, sf):
    return compliance_reports(spark, sf).groupBy("corpus", "framework").agg(
        F.count(F.when(F.col("compliant"), 1)).alias("compliant"),
        F.count(F.when(~F.col("compliant"), 1)).alias("violations"),
    )


@query(
    "d5_text_summary",
    sql.with_corpus(
        "SELECT corpus, id, count(r.rule) AS total_detections, count(*) FILTER (layer = 'guard') AS guard_n, "
        "count(*) FILTER (layer = 'rules') AS rules_n, coalesce(string_agg(category || '/' || severity, ' ' ORDER BY block, o1, o2), '') AS results "
        "FROM corpus LEFT JOIN results r USING (corpus, id) GROUP BY corpus, id",
        **_RESULTS,
    ),
)
def text_summary(spark, sf):
    r = F.col("summary.results")
    count = lambda layer: F.size(F.filter(r, lambda x: x["layer"] == layer)).cast("long")
    return guard.with_summary(_texts(spark, sf)).select(
        *KEYS,
        F.col("summary.total_detections").cast("long").alias("total_detections"),
        count("guard").alias("guard_n"),
        count("rules").alias("rules_n"),
        F.array_join(F.transform(r, lambda x: F.concat_ws("/", x["category"], x["severity"])), " ").alias("results"),
    )


@query(
    "g2_distinct_findings",
    sql.with_corpus(
        "SELECT corpus, count(*) FILTER (layer = 'guard') AS guard_n, count(*) FILTER (layer = 'rules' AND rule NOT LIKE 'xss%' "
        "AND rule NOT IN (SELECT rule FROM (" + sql.rule_table(sql.rules_of("compliance")) + "))) AS rules_n FROM results GROUP BY corpus",
        **_RESULTS,
    ),
)
def distinct_findings(spark, sf):
    r = F.col("summary.results")
    count = lambda layer: F.size(F.filter(r, lambda x: x["layer"] == layer)).cast("long")
    seen = guard.with_summary(_texts(spark, sf), distinct=True)
    per = seen.select("corpus", count("guard").alias("g"), count("rules").alias("r"))
    return per.groupBy("corpus").agg(F.sum("g").alias("guard_n"), F.sum("r").alias("rules_n")).where("guard_n + rules_n > 0")


@query(
    "d6_highest_severity",
    sql.with_corpus(
        f"SELECT corpus, id, coalesce(arg_max(severity, {sql.LEVEL}), 'low') AS highest FROM corpus LEFT JOIN results USING (corpus, id) GROUP BY corpus, id",
        **_RESULTS,
    ),
)
def highest(spark, sf):
    return guard.with_summary(_texts(spark, sf)).select(
        *KEYS, policy.highest_severity(F.col("summary.results")).alias("highest")
    )


_SUMMARY_SQL = "CASE WHEN threat_count > 0 THEN array_to_string(types[1:3], ',') || CASE WHEN len(types) >= 3 THEN ',...' ELSE '' END ELSE '' END"


@query(
    "d19_threat_summary",
    sql.with_corpus(f"SELECT corpus, id, {_SUMMARY_SQL} AS summary FROM verdict", **_VERDICT),
)
def threat_summaries(spark, sf):
    return guard.with_verdict(_texts(spark, sf)).select(
        *KEYS, policy.threat_summary(F.col("verdict.threats.type")).alias("summary")
    )


@query(
    "d20_scan_outcomes",
    sql.with_corpus(
        "SELECT corpus, id, CASE WHEN allowed THEN 'medium' ELSE 'high' END AS event_severity, threat_count AS threats, len(pii) AS pii, "
        f"len(secrets) AS secrets, len(xss) AS xss, len(compliance) AS compliance, allowed, {_SUMMARY_SQL} AS summary "
        "FROM verdict WHERE threat_count > 0",
        **_VERDICT,
    ),
)
def scan_outcomes(spark, sf):
    return policy.scan_outcomes(guard.with_verdict(_texts(spark, sf)), KEYS)


# ---------------------------------------------------------------------- policy
def _first_blocking(level: int, wanted: str = "true") -> str:
    return (
        "SELECT corpus, id, first(category || ': ' || text ORDER BY block, o1, o2) AS reason FROM results "
        f"WHERE {sql.LEVEL} >= {level} AND {wanted} GROUP BY corpus, id"
    )


@query(
    "b26_policy_decision",
    sql.with_corpus(
        f"SELECT corpus, id, reason IS NOT NULL AS blocked, coalesce(reason, '') AS reason FROM corpus LEFT JOIN ({_first_blocking(3)}) USING (corpus, id)",
        **_RESULTS,
    ),
)
def policy_decision(spark, sf):
    decided = policy.with_decision(guard.with_summary(_texts(spark, sf)))
    return decided.select(*KEYS, "decision.*")


@query(
    "b13_category_filter",
    sql.with_corpus(
        "SELECT corpus, id, reason IS NOT NULL AS blocked, coalesce(reason, '') AS reason FROM corpus LEFT JOIN "
        f"({_first_blocking(2, wanted=chr(99) + 'ategory IN (' + sql.lit('xss') + ', ' + sql.lit('secret') + ', ' + sql.lit('secrets') + ')')}) USING (corpus, id)",
        **_RESULTS,
    ),
)
def category_filter(spark, sf):
    rule = policy.Policy(threshold="medium", categories=("xss", "secrets"))
    return policy.with_decision(guard.with_summary(_texts(spark, sf)), rule).select(*KEYS, "decision.*")


@query(
    "f2_first_finding",
    sql.with_corpus(
        "SELECT corpus, id, first(rule ORDER BY block, o1, o2) AS rule, first(severity ORDER BY block, o1, o2) AS severity "
        f"FROM results WHERE {sql.LEVEL} >= 4 GROUP BY corpus, id",
        **_RESULTS,
    ),
)
def first_finding(spark, sf):
    first = policy.first_blocking(F.col("summary.results"), policy.Policy(threshold="critical"))
    rows = guard.with_summary(_texts(spark, sf)).select(*KEYS, F.array_compact(F.array(first)).alias("f"))
    return scan.exploded(rows, KEYS, "f").select(*KEYS, "rule", "severity")


@query(
    "b28_editor_view",
    sql.with_corpus(
        "SELECT corpus, id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'low' THEN 'hint' ELSE 'warning' END AS level, "
        "rule, trim(CASE category WHEN 'pii' THEN '🔐 ' WHEN 'xss' THEN '⚔️ ' WHEN 'secret' THEN '🔑 ' WHEN 'compliance' THEN '📋 ' ELSE '' END || text, ' ') "
        "|| CASE WHEN severity IN ('critical', 'high') THEN ' [BLOCKED]' ELSE '' END AS message "
        f"FROM results WHERE {sql.LEVEL} >= 2",
        **_RESULTS,
    ),
)
def editor_view(spark, sf):
    rows = policy.editor_findings(F.col("summary.results"), "medium", "block")
    return scan.exploded(guard.with_summary(_texts(spark, sf)).select(*KEYS, rows.alias("r")), KEYS, "r")


# ----------------------------------------------------------- traffic and audit
_TRAFFIC = {
    "threats": sql.threats("traffic", "conv_id, turn"),
    "verdict": sql.verdict("traffic", "conv_id, turn"),
    "results": sql.results("traffic", "conv_id, turn"),
}
_TRAFFIC_BLOCK = (
    "SELECT conv_id, turn, first(category || ': ' || text ORDER BY block, o1, o2) AS reason FROM results "
    f"WHERE {sql.LEVEL} >= 3 GROUP BY conv_id, turn"
)
_TRAFFIC_LISTS = (
    "SELECT conv_id, turn, count(*)::INT AS total, string_agg(category, ',' ORDER BY block, o1, o2) AS categories, "
    "string_agg(severity, ',' ORDER BY block, o1, o2) AS severities, string_agg(rule, ',' ORDER BY block, o1, o2) AS rules, "
    f"arg_max(severity, {sql.LEVEL}) AS peak FROM results GROUP BY conv_id, turn"
)


def _summarized(spark, sf):
    return guard.with_summary(traffic(spark, sf))


def _decided(spark, sf):
    return policy.with_decision(_summarized(spark, sf))


# Whether the audit row shows less of a finding than its text.
_MASKED = (
    "bool_or(text <> '' AND (lower(category) = 'secrets' OR starts_with(lower(category), 'secret_') OR starts_with(lower(category), 'pii')))"
)
_AUDIT = sql.with_traffic(
    "SELECT conv_id, turn, ts AS timestamp, direction, host, path, total AS total_detections, NOT allowed AS blocked, "
    "reason IS NOT NULL AS policy_blocked, array_to_string(pii, ',') AS pii_categories, array_to_string(secrets, ',') AS secret_types, "
    "categories, severities, rules, redacted, 0.0::DOUBLE AS ml_score FROM traffic JOIN verdict USING (conv_id, turn) "
    f"JOIN (SELECT conv_id, turn, {_MASKED} AS redacted FROM results GROUP BY conv_id, turn) USING (conv_id, turn) "
    f"JOIN ({_TRAFFIC_LISTS}) USING (conv_id, turn) LEFT JOIN ({_TRAFFIC_BLOCK}) USING (conv_id, turn)",
    **_TRAFFIC,
)
_LISTS = ("pii_categories", "secret_types", "categories", "severities", "rules")


@query("a4_audit_rows", _AUDIT)
def audit_rows(spark, sf):
    rows = audit.audit_rows(_decided(spark, sf), TALK)
    flat = rows.withColumns({c: _joined(F.col(c)) for c in _LISTS})
    return flat.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "b27_block_reports",
    sql.with_traffic(
        "SELECT conv_id, turn, direction, host, path, true AS blocked, reason, peak AS severity, 'Request blocked by policy' AS message, "
        "403 AS status, to_json({'direction': direction, 'host': host, 'path': path, 'blocked': true, 'reason': reason, 'severity': peak, "
        "'message': 'Request blocked by policy', 'results': listed})::VARCHAR AS body FROM traffic JOIN (SELECT conv_id, turn, "
        "list({'category': category, 'severity': severity, 'rule': rule, 'text': text, 'confidence': 1.0::DOUBLE} ORDER BY block, o1, o2) AS listed "
        f"FROM results GROUP BY conv_id, turn) USING (conv_id, turn) JOIN ({_TRAFFIC_BLOCK}) USING (conv_id, turn) JOIN ({_TRAFFIC_LISTS}) USING (conv_id, turn)",
        **_TRAFFIC,
    ),
)
def block_reports(spark, sf):
    return policy.block_reports(_decided(spark, sf), TALK)


@query(
    "d7_traffic_counts",
    sql.with_traffic(
        "SELECT direction, host, count(*) AS intercepted, count(total) AS detections, count(reason) AS blocked, "
        "0::BIGINT AS scored_nonzero, coalesce(sum(total), 0)::BIGINT AS findings FROM traffic "
        f"LEFT JOIN ({_TRAFFIC_LISTS}) USING (conv_id, turn) LEFT JOIN ({_TRAFFIC_BLOCK}) USING (conv_id, turn) GROUP BY direction, host",
        **_TRAFFIC,
    ),
)
def traffic_counts(spark, sf):
    return audit.traffic_counts(_decided(spark, sf), ["direction", "host"])


@query(
    "a5_export_events",
    "SELECT 'textguard' AS source, '1' AS version, conv_id, turn, timestamp, direction, host, path, total_detections, blocked, "
    "nullif(pii_categories, '') AS pii_categories, nullif(secret_types, '') AS secret_types, categories, severities, rules, "
    f"nullif(ml_score, 0) AS ml_score FROM ({_AUDIT})",
)
def export_events(spark, sf):
    path = shared_dir(spark)
    stamped = audit.export_events(audit.audit_rows(_decided(spark, sf), TALK))
    log.append(stamped, path, batch=0)
    events = log.read(spark, path, stamped.schema)
    shape = (
        "source string, version string, conv_id bigint, turn bigint, timestamp timestamp, direction string, host string, path string, "
        "total_detections int, blocked boolean, " + ", ".join(f"{c} array<string>" for c in _LISTS) + ", ml_score double"
    )
    parsed = events.select(F.from_json("event", shape).alias("e")).select("e.*")
    flat = parsed.withColumns({c: _joined(F.col(c)) for c in _LISTS})
    return flat.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("a3_audit_sink", f"SELECT *, timestamp::DATE AS date FROM ({_AUDIT})")
def audit_sink(spark, sf):
    back = audit.write_audit(audit.audit_rows(_decided(spark, sf), TALK), shared_dir(spark), batch=0)
    flat = back.withColumns({c: _joined(F.col(c)) for c in _LISTS})
    return flat.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "b27_scored_traffic",
    sql.with_traffic(
        "SELECT direction, count(*) AS intercepted, count(*) FILTER (total > 0 OR score >= 0.3) AS detections, "
        "count(*) FILTER (reason IS NOT NULL OR score >= 0.3) AS blocked, count(*) FILTER (score > 0 AND (total > 0 OR score >= 0.3)) AS scored_nonzero, "
        "(sum(coalesce(total, 0)) + count(*) FILTER (score >= 0.3))::BIGINT AS findings FROM traffic JOIN scored USING (conv_id, turn) "
        f"LEFT JOIN ({_TRAFFIC_LISTS}) USING (conv_id, turn) LEFT JOIN ({_TRAFFIC_BLOCK}) USING (conv_id, turn) GROUP BY direction",
        scored=scoring.HEURISTIC.format(keys="conv_id, turn", source="traffic"),
        **_TRAFFIC,
    ),
)
def scored_traffic(spark, sf):
    seen = guard.with_summary(traffic(spark, sf), scorer=heuristic_score, threshold=0.3, shadow=False)
    return audit.traffic_counts(policy.with_decision(seen))


_SUFFIXES = "list_transform(range(len(string_split(host, '.')) - 1), lambda i: array_to_string(string_split(host, '.')[i + 1:], '.')) || [host]"


@query(
    "c1_target_hosts",
    f"""SELECT page_id, host, list_has_any({_SUFFIXES}, ['example.com', 'example.net', 'therin.example.org']) AS watched
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)""",
)
def target_hosts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", hosts.host_of(F.col("url")).alias("host"))
    # Fixture hosts stand in for the built-in list, which no given page is on.
    return pages.withColumn(
        "watched", hosts.is_target(F.col("host"), ("example.com", "example.net", "therin.example.org"))
    )


@query(
    "c1_watched_pages",
    f"""SELECT page_id, url FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)
    WHERE list_has_any({_SUFFIXES}, (SELECT list(DISTINCT regexp_extract(url, '://([^/?#:]+)', 1)) FROM pages WHERE page_id % 3 = 0))""",
)
def watched_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    hosted = pages.withColumn("host", hosts.host_of(F.col("url")))
    targets = hosted.where(F.col("page_id") % 3 == 0).select(F.col("host").alias("domain")).distinct()
    return hosts.watched(hosted, "host", targets).select("page_id", "url")


# ------------------------------------------------------------------- redaction
def _spans_sql(source: str, keys: str, where: str = "true") -> str:
    """Spans that survive when the first of overlapping ones wins, step by step."""
    return f"""
  WITH RECURSIVE spans AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY start, "end" DESC, put) AS k,
      start, "end", put, category FROM ({source}) WHERE {where}),
  walk AS (SELECT {keys}, 1 AS k, "end" AS reach, true AS kept FROM spans WHERE k = 1
    UNION ALL SELECT s.{keys.split(', ')[-1] if ',' not in keys else keys.replace(', ', ', s.')}, s.k,
      CASE WHEN s.start >= w.reach THEN s."end" ELSE w.reach END, s.start >= w.reach
    FROM walk w JOIN spans s USING ({keys}) WHERE s.k = w.k + 1)
  SELECT {keys}, start, "end", put, category FROM spans JOIN walk USING ({keys}, k) WHERE kept"""


_ENABLED = "category IN ('ssn', 'credit_card', 'email', 'phone', 'health_info')"
_PII_SPANS = _spans_sql('SELECT corpus, id, start, "end", redacted AS put, category FROM pii', "corpus, id", _ENABLED)
_REBUILD = """SELECT corpus, id, md5(coalesce(out, text)) AS {0}, length(coalesce(out, text))::INT AS chars FROM corpus LEFT JOIN (
    SELECT corpus, id, string_agg(text[prev + 1:start] || put, '' ORDER BY start) || max(text[last + 1:]) AS out
    FROM (SELECT corpus, id, start, "end", put, text, coalesce(lag("end") OVER w, 0) AS prev, max("end") OVER (PARTITION BY corpus, id) AS last
      FROM kept JOIN corpus USING (corpus, id) WINDOW w AS (PARTITION BY corpus, id ORDER BY start)) GROUP BY corpus, id) USING (corpus, id)"""


@query("h6_redacted_texts", sql.with_corpus(_REBUILD.format("redacted"), pii=sql.pii(), kept=_PII_SPANS))
def redacted_texts(spark, sf):
    out = redact.redact_spans(_texts(spark, sf))
    return out.select(*KEYS, F.md5("redacted").alias("redacted"), F.length("redacted").alias("chars"))


_SECRET_SPANS = _spans_sql('SELECT corpus, id, start, "end", mask AS put, category FROM secret', "corpus, id")


@query("h9_masked_secrets", sql.with_corpus(_REBUILD.format("masked"), secret=sql.secret(), kept=_SECRET_SPANS))
def masked_secrets(spark, sf):
    out = redact.mask_secrets(_texts(spark, sf))
    return out.select(*KEYS, F.md5("masked").alias("masked"), F.length("masked").alias("chars"))


@query(
    "d18_redaction_stats",
    sql.with_corpus(
        'SELECT category, count(*) AS total_redacted, sum("end" - start)::BIGINT AS chars_redacted FROM kept GROUP BY category',
        pii=sql.pii(), kept=_PII_SPANS,
    ),
)
def redaction_stats(spark, sf):
    return redact.redaction_stats(redact.redaction_audit(_texts(spark, sf), KEYS))


@query(
    "h5_redaction_forms",
    sql.with_corpus("SELECT category, redacted, count(*) AS n FROM pii GROUP BY ALL", pii=sql.pii()),
)
def redaction_forms(spark, sf):
    rows = scan.exploded(guard.with_pii(_texts(spark, sf)), KEYS, "pii")
    return rows.groupBy("category", "redacted").agg(F.count(F.lit(1)).alias("n"))


def _value_sql(put: str, pii_on: bool) -> str:
    """Values replaced everywhere, then the secrets of the result in place."""
    body = _body_sql(put)
    spans = _spans_sql(
        f"""SELECT corpus, id, start, "end", {put.format('("end" - start)')} AS put, category FROM secret
        WHERE category IN ('api_key', 'aws_key', 'password', 'bearer_token', 'jwt')""",
        "corpus, id",
    )
    ctes = {"pii": sql.pii(), "bodies": body if pii_on else "SELECT * FROM corpus", "secret": sql.secret("bodies"), "kept": spans}
    return sql.with_corpus(_REBUILD.format("redacted").replace("corpus LEFT JOIN (", "bodies LEFT JOIN (", 1).replace("JOIN corpus USING", "JOIN bodies USING"), **ctes)


def _body_sql(put: str) -> str:
    """Texts with each found value replaced, in order of first occurrence."""
    values = (
        "SELECT corpus, id, list(value ORDER BY o) AS vs FROM (SELECT corpus, id, value, min(start * 100 + n) AS o FROM pii "
        "WHERE category IN ('ssn', 'email', 'phone', 'credit_card') GROUP BY corpus, id, value) GROUP BY corpus, id"
    )
    return (
        "SELECT corpus, id, CASE WHEN vs IS NULL THEN text ELSE list_reduce(vs, lambda acc, v: replace(acc, v, "
        f"{put.format('strlen(v)')}), text) END AS text FROM corpus LEFT JOIN ({values}) USING (corpus, id)"
    )


@query("h7_value_redaction", _value_sql("repeat('*', {0})", True))
def value_redaction(spark, sf):
    out = redact.redact_values(_texts(spark, sf), policy=redact.ValueRedaction(strategy="asterisks"))
    return out.select(*KEYS, F.md5("redacted").alias("redacted"), F.length("redacted").alias("chars"))


@query("h8_secrets_only", _value_sql("'[REDACTED]'", False))
def secrets_only(spark, sf):
    out = redact.redact_secrets_only(_texts(spark, sf))
    return out.select(*KEYS, F.md5("redacted").alias("redacted"), F.length("redacted").alias("chars"))


@query(
    "h8_pii_only",
    sql.with_corpus(
        "SELECT corpus, id, md5(text) AS redacted, length(text)::INT AS chars FROM bodies",
        pii=sql.pii(), bodies=_body_sql("'[REDACTED]'"),
    ),
)
def pii_only(spark, sf):
    out = redact.redact_pii_only(_texts(spark, sf))
    return out.select(*KEYS, F.md5("redacted").alias("redacted"), F.length("redacted").alias("chars"))


@query(
    "j7_replacement_rules",
    sql.with_corpus(
        "SELECT corpus, id, md5(regexp_replace(regexp_replace(text, '\\b[0-9a-f]{40}\\b', '[hex]', 'g'), '(?i)passport', '[doc]', 'g')) AS redacted "
        "FROM corpus"
    ),
)
def replacement_rules(spark, sf):
    rules = redact.Redaction(categories=(), replacements={r"\b[0-9a-f]{40}\b": "[hex]", r"(?i)passport": "[doc]"})
    return redact.redact_spans(_texts(spark, sf), policy=rules).select(*KEYS, F.md5("redacted").alias("redacted"))
