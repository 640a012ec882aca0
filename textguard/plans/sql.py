"""SQL building blocks of the oracles, written from the raw patterns.

Nothing here uses the JVM patterns, the gates or the Spark expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from textguard.rules import phrases, rules_of, secrets, validated
from textguard.rules.model import Rule


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(column: str, table: dict, default: str = "NULL") -> str:
    show = lambda v: lit(v) if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


CORPUS = """
  SELECT 'documents' AS corpus, doc_id::VARCHAR AS id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'pages', page_id::VARCHAR, html FROM pages
  UNION ALL SELECT 'benchmark', item_id::VARCHAR, text FROM benchmark"""
TRAFFIC = """
  SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn * 20) AS ts,
    CASE WHEN role = 'assistant' THEN 'response' ELSE 'request' END AS direction,
    'host' || (conv_id % 7) || '.example.com' AS host, '/chat/' || conv_id AS path, text
  FROM conversations"""

_MARK = "chr(3)"


def matches_of(rule: Rule, n: int, source: str = "corpus", keys: str = "corpus, id") -> str:
    """Rows (keys, n, start, end, value) of one rule over ``source``."""
    return f"""
  SELECT {keys}, {n} AS n, unnest(list_transform(range(len(p) // 2), lambda i: {{
      'start': length(array_to_string(p[1:2 * i + 1], ''))::INT, 'value': p[2 * i + 2]}})) AS m
  FROM (SELECT {keys}, string_split(regexp_replace(text, {lit(rule.regex)}, {_MARK} || '\\0' || {_MARK}, 'g'), {_MARK}) AS p
        FROM {source} WHERE regexp_matches(text, {lit(rule.regex)}))"""


def matches(rules: Sequence[Rule], source: str = "corpus", keys: str = "corpus, id", first: int = 0) -> str:
    """Rows (keys, n, start, end, value) of several rules."""
    each = " UNION ALL ".join(matches_of(r, first + i, source, keys) for i, r in enumerate(rules))
    return f"""SELECT {keys}, n, m.start AS start, m.start + length(m.value)::INT AS "end", m.value AS value FROM ({each})"""


def rule_table(pairs) -> str:
    """Rows (n, pack, rule, severity) of the catalogue slice."""
    rows = ", ".join(f"({i}, {lit(p)}, {lit(r.name)}, {lit(r.severity)})" for i, (p, r) in enumerate(pairs))
    return f"SELECT * FROM (VALUES {rows}) AS t(n, pack, rule, severity)"


PAIRS = rules_of()
RULES = [r for _, r in PAIRS]
CUT = "CASE WHEN length(value) > 200 THEN left(value, 200) || '...' ELSE value END"


def rule_hits(pairs=PAIRS, source: str = "corpus", keys: str = "corpus, id") -> str:
    """Named findings of the rule layer."""
    return f"""SELECT {keys}, r.n, rule, pack, severity, start, "end", {CUT} AS value
  FROM ({matches([r for _, r in pairs], source, keys)}) JOIN ({rule_table(pairs)}) r USING (n)"""


# -------------------------------------------------- validated personal data
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"""(length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1),
  lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT
    WHEN reverse({_DIGITS})[i]::INT * 2 > 9 THEN reverse({_DIGITS})[i]::INT * 2 - 9
    ELSE reverse({_DIGITS})[i]::INT * 2 END)) % 10 = 0)"""
_SSN = "regexp_replace(value, '[-. ]', '', 'g')"
VALID = f"""CASE category
  WHEN 'ssn' THEN length({_SSN}) = 9 AND left({_SSN}, 3) NOT IN ('000', '666') AND left({_SSN}, 1) <> '9'
    AND substr({_SSN}, 4, 2) <> '00' AND substr({_SSN}, 6, 4) <> '0000'
  WHEN 'credit_card' THEN {_LUHN}
  WHEN 'email' THEN instr(value, '@') > 1 AND instr(value, '@') <= length(value) - 2
    AND contains(split_part(value, '@', 2), '.') AND length(split_part(value, '@', 2)) >= 3
  WHEN 'phone' THEN length({_DIGITS}) >= 10
  WHEN 'ip_address' THEN len(string_split(value, '.')) = 4
  ELSE strlen(value) >= 3 END"""
_DIALLED = "regexp_replace(value, '[^0-9+]', '', 'g')"
REDACTED = f"""CASE category
  WHEN 'ssn' THEN 'XXX-XX-' || right(value, 4)
  WHEN 'credit_card' THEN '****-****-****-' || right({_DIGITS}, 4)
  WHEN 'email' THEN CASE WHEN length(split_part(value, '@', 1)) > 2 THEN left(value, 2) ELSE '' END
    || '***@' || split_part(value, '@', 2)
  WHEN 'phone' THEN '***-***-' || right({_DIALLED}, 4)
  ELSE {case('category', {c: p for c, (_, _, p) in validated.METADATA.items()})} END"""
CATEGORIES = {i: r.name for i, r in enumerate(validated.RULES)}
PII_SEVERITY = {c: s for c, (s, _, _) in validated.METADATA.items()}


def pii(source: str = "corpus", keys: str = "corpus, id") -> str:
    """Validated personal data with severity and redacted form."""
    return f"""SELECT *, {case('category', PII_SEVERITY)} AS severity, {REDACTED} AS redacted FROM (
    SELECT {keys}, n, {case('n', CATEGORIES)} AS category, start, "end", value
    FROM ({matches(validated.RULES, source, keys)})) WHERE {VALID}"""


# ------------------------------------------------------------------ secrets
SECRET_KIND = {i: r.category for i, r in enumerate(secrets.RULES)}
SECRET_NAME = {i: r.name for i, r in enumerate(secrets.RULES)}
SECRET_SEVERITY = {c: s for c, (s, _) in secrets.METADATA.items()}
PROVIDER = (
    "CASE " + " ".join(f"WHEN contains(upper(value), {lit(m)}) THEN {lit(p)}" for m, p in secrets.PROVIDERS)
    + " ELSE 'Unknown' END"
)


def secret(source: str = "corpus", keys: str = "corpus, id") -> str:
    """Secrets with provider and mask; the raw value is dropped."""
    return f"""SELECT {keys}, n, rule, category, provider, start, "end", {case('category', SECRET_SEVERITY)} AS severity,
    '[MASKED-' || upper(replace(replace(CASE WHEN provider IN ('Unknown', 'JWT', 'Private Key') THEN category
      ELSE provider END, '_', '-'), ' ', '-')) || ']' AS mask
  FROM (SELECT {keys}, n, {case('n', SECRET_NAME)} AS rule, {case('n', SECRET_KIND)} AS category,
      {PROVIDER} AS provider, start, "end", value FROM ({matches(secrets.RULES, source, keys)}))
  WHERE NOT (category = 'aws_key' AND starts_with(value, 'AKIAIA'))
    AND NOT (category = 'bearer_token' AND length(value) < 20) AND length(value) >= 8"""


# ----------------------------------------------------------------- toxicity
TOXICITY = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {lit(p)}) THEN {lit(words)} END" for _, words, p in phrases.TOXICITY
) + "], lambda x: x IS NOT NULL)"


# ------------------------------------------------------------------ verdict
def threats(source: str = "corpus", keys: str = "corpus, id") -> str:
    """Guard threats in their order: ``ord`` within ``block`` within a text."""
    found = rule_hits([x for x in PAIRS if x[0] in ("xss", "compliance")], source, keys)
    score = "CASE severity WHEN 'critical' THEN 5 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 4 END"
    return f"""
  SELECT {keys}, 1 AS block, start AS o1, n AS o2, 'pii' AS type, severity, category || ' detected in response' AS message,
    category AS pattern, category AS label, start, "end" FROM ({pii(source, keys)})
  UNION ALL SELECT {keys}, 2, start, n, 'secret', severity, provider || ' ' || category || ' detected in response',
    category, provider || ':' || category, start, "end" FROM ({secret(source, keys)})
  UNION ALL SELECT {keys}, CASE pack WHEN 'xss' THEN 3 ELSE 4 END, start, n, pack, {score},
    CASE pack WHEN 'xss' THEN 'XSS vector detected: ' ELSE 'Compliance violation: ' END || rule, rule, rule, start, "end"
    FROM ({found})
  UNION ALL SELECT {keys}, 6, 0, 0, 'toxicity', 5, 'Harmful content detected: ' || array_to_string(tox, ', '), '', '', 0, 0
    FROM (SELECT {keys}, {TOXICITY} AS tox FROM {source}) WHERE len(tox) > 0"""


TOKENS = "floor(len(regexp_extract_all(text, '[^ \\n\\t]+')) / 0.75)::INT"


def verdict(source: str = "corpus", keys: str = "corpus, id") -> str:
    """One row per text: threat lists, allowed, reason and tokens."""
    pick = lambda what, block: (
        f"coalesce(list({what} ORDER BY o1, o2) FILTER (block = {block}), [])"
    )
    return f"""SELECT {keys}, tokens, coalesce(threat_count, 0) AS threat_count,
    coalesce(types, []) AS types, coalesce(pii, []) AS pii, coalesce(secrets, []) AS secrets,
    coalesce(xss, []) AS xss, coalesce(compliance, []) AS compliance,
    coalesce(top, 0) AS top, tox IS NULL AS allowed,
    CASE WHEN tox IS NULL THEN '' ELSE 'Toxic content detected: ' || tox END AS block_reason
  FROM (SELECT {keys}, {TOKENS} AS tokens FROM {source})
  LEFT JOIN (SELECT {keys}, count(*) AS threat_count, list(type ORDER BY block, o1, o2) AS types, max(severity) AS top,
      {pick('label', 1)} AS pii, {pick('label', 2)} AS secrets, {pick('label', 3)} AS xss, {pick('label', 4)} AS compliance,
      max(message) FILTER (block = 6) AS tox
    FROM threats GROUP BY {keys}) USING ({keys})"""


def results(source: str = "corpus", keys: str = "corpus, id") -> str:
    """Summary results in order: guard findings, then rule findings."""
    name = "CASE WHEN severity >= 5 THEN 'critical' WHEN severity >= 4 THEN 'high' WHEN severity >= 3 THEN 'medium' ELSE 'low' END"
    return f"""
  SELECT {keys}, block, o1, o2, type AS category, {name} AS severity, message AS text, pattern AS rule, 'guard' AS layer
    FROM threats WHERE {keys.split(',')[-1]} IS NOT NULL
  UNION ALL SELECT {keys}, 9, start, n, rule, severity, value, rule, 'rules' FROM ({rule_hits(PAIRS, source, keys)})"""


def with_corpus(body: str, **ctes: str) -> str:
    """A statement over the corpus and named sub-queries."""
    listed = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in {"corpus": CORPUS, **ctes}.items())
    return f"WITH {listed} {body}"


def with_traffic(body: str, **ctes: str) -> str:
    listed = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in {"traffic": TRAFFIC, **ctes}.items())
    return f"WITH {listed} {body}"


LEVEL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
