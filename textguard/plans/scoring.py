"""Evasion, threat and claim scores, text features and quality of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as tx
from textguard.operators import claims, distinct, evaluate, evasion, findings, scan, threat, variants
from textguard.plans import sql
from textguard.plans.registry import query
from textguard.rules import phrases, validated
from textguard.session import shared_dir, written
from textguard.sources import log
from textguard.sources.tables import corpus, table

KEYS = ["corpus", "id"]


def _texts(spark, sf):
    return corpus(spark, sf)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# ---------------------------------------------------------------------- evasion
def _evasion_sql(extra=()):
    rows = (*phrases.EVASION, *extra)
    return "list_filter([" + ", ".join(
        f"{{'name': {sql.lit(n)}, 'category': {sql.lit(c)}, 'weight': {w}::DOUBLE, 'match': regexp_extract(text, {sql.lit(p)})}}"
        for n, c, w, p in rows
    ) + "], lambda t: t.match <> '')"


def _evasion_scores(extra=()):
    return sql.with_corpus(
        "SELECT corpus, id, len(m) > 0 AS detected, round(least(1.0, coalesce(list_sum(list_transform(m, lambda t: t.weight)), 0)), 6) AS score, "
        "array_to_string(list_transform(m, lambda t: t.name || '=' || t.match), '|') AS matched FROM evaded",
        evaded=f"SELECT corpus, id, {_evasion_sql(extra)} AS m FROM corpus",
    )


def _evasion_rows(df):
    e = F.col("evasion")
    shown = F.array_join(F.transform(e["matched"], lambda m: F.concat(m["name"], F.lit("="), m["match"])), "|")
    return df.select(*KEYS, e["detected"].alias("detected"), F.round(e["score"], 6).alias("score"), shown.alias("matched"))


@query("b16_evasion_scores", _evasion_scores())
def evasion_scores(spark, sf):
    return _evasion_rows(evasion.with_evasion(_texts(spark, sf)))


_OWN = (("tripled_mark", "obfuscation", 0.25, r"[!?*#]{3,}"), ("shouting", "semantic", 0.15, r"\b[A-Z]{4,}\s+[A-Z]{4,}\b"))


@query("j2_own_technique", _evasion_scores(_OWN))
def own_technique(spark, sf):
    rules = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(_OWN)], "place int, name string, category string, weight double, pattern string"
    )
    return _evasion_rows(evasion.with_rules(_texts(spark, sf), rules, KEYS))


@query(
    "d8_evasion_counts",
    sql.with_corpus(
        "SELECT t.category, coalesce(t.name, '*') AS name, count(*) AS texts FROM (SELECT unnest(m) AS t FROM evaded) "
        "GROUP BY GROUPING SETS ((t.category, t.name), (t.category))",
        evaded=f"SELECT corpus, id, {_evasion_sql()} AS m FROM corpus",
    ),
)
def evasion_counts(spark, sf):
    return evasion.evasion_counts(_texts(spark, sf))


# ----------------------------------------------------------------- threat scores
_BLANK = r"[\t\n\x0B\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORMAL = f"trim(regexp_replace(lower(replace(text, 'İ', 'i')), {sql.lit(_BLANK)}, ' ', 'g'), ' ')"
_CUT = f"left({_NORMAL}, 128)"
_BODY = f"regexp_replace({_NORMAL}, '[^ -~]', '�', 'g')"


def _any_sql(column, forms):
    return "(" + " OR ".join(f"contains({column}, {sql.lit(f)})" for f in forms) + ")"


def _swaps(word):
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]


def _bare(word):
    return word[0] + "".join(c for c in word[1:] if c not in "aeiou")


_TENTHS = " + ".join(
    [f"4 * {_any_sql('body', _swaps(w))}::INT" for w in phrases.ATTACK_WORDS]
    + [f"3 * contains(body, {sql.lit(_bare(w))})::INT" for w in phrases.ATTACK_WORDS if _bare(w) != w]
    + [f"3 * contains(body, {sql.lit(w[::-1])})::INT" for w in phrases.ATTACK_WORDS]
)
HEURISTIC = (
    f"SELECT {{keys}}, text, least({_TENTHS}, 9) / 10.0::DOUBLE AS score FROM "
    "(SELECT {keys}, text, " + _BODY.replace("{", "{{").replace("}", "}}") + " AS body FROM {source})"
)
_HEURISTIC = HEURISTIC.format(keys="corpus, id", source="corpus")


@query("b17_threat_scores", sql.with_corpus("SELECT corpus, id, score FROM scored", scored=_HEURISTIC))
def threat_scores(spark, sf):
    return _texts(spark, sf).select(*KEYS, threat.heuristic_score(F.col("text")).alias("score"))


@query(
    "b19_decisions",
    sql.with_corpus(
        "SELECT mode, count(*) FILTER (flag) AS threats, count(*) FILTER (kept > 0) AS scored, count(*) AS total FROM ("
        "SELECT 'active' AS mode, score AS kept, score >= 0.4 AS flag FROM scored UNION ALL SELECT 'shadow', score, false FROM scored "
        "UNION ALL SELECT 'disabled', 0, false FROM scored) GROUP BY mode",
        scored=_HEURISTIC,
    ),
)
def decisions(spark, sf):
    scored = _texts(spark, sf).select(threat.heuristic_score(F.col("text")).alias("s"))
    s = F.col("s")
    modes = {
        "active": threat.decision(s, 0.4),
        "shadow": threat.decision(s, 0.4, shadow=True, enabled=False),
        "disabled": threat.decision(s, 0.4, enabled=False),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), d["score"].alias("score"), d["is_threat"].alias("flag")) for m, d in modes.items()])
    return scored.select(F.inline(rows)).groupBy("mode").agg(
        F.count(F.when(F.col("flag"), 1)).alias("threats"),
        F.count(F.when(F.col("score") > 0, 1)).alias("scored"),
        F.count(F.lit(1)).alias("total"),
    )


_FORMS = {
    "direct_match": (4, sorted(set(phrases.ATTACK_WORDS))),
    "transposition": (4, sorted({v for w in phrases.ATTACK_WORDS for v in _swaps(w)})),
    "vowel_deleted": (3, sorted({_bare(w) for w in phrases.ATTACK_WORDS if _bare(w) != w})),
    "reversed": (3, sorted({w[::-1] for w in phrases.ATTACK_WORDS})),
}
_SET_COLUMNS = ", ".join(
    f"{weight} * len(list_filter([{', '.join(map(sql.lit, forms))}], lambda f: contains(low, f))) AS {kind}"
    for kind, (weight, forms) in _FORMS.items()
)
_SET_SCORES = f"""SELECT {{keys}}, CASE WHEN strlen(text) < 32 THEN 0 ELSE least(direct_match + transposition + vowel_deleted + reversed, 9) / 10.0 END::DOUBLE AS score,
  strlen(text) >= 32 AND direct_match + transposition + vowel_deleted + reversed >= 7 AS is_threat,
  CASE WHEN strlen(text) < 32 THEN 'fast_path' WHEN direct_match >= 7 THEN 'direct_match' WHEN direct_match + transposition >= 7 THEN 'transposition'
    WHEN direct_match + transposition + vowel_deleted >= 7 THEN 'vowel_deleted'
    WHEN direct_match + transposition + vowel_deleted + reversed >= 7 THEN 'reversed' ELSE 'heuristic' END AS variant
  FROM (SELECT *, {_SET_COLUMNS} FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM {{source}}))"""


@query("b18_set_scores", sql.with_corpus(_SET_SCORES.format(keys="corpus, id", source="corpus")))
def set_scores(spark, sf):
    return threat.with_set_score(_texts(spark, sf)).select(*KEYS, "set_score.*")


_VARIANTS = {"as_is": "text", "reversed": "reverse(text)", "no_blanks": "replace(text, ' ', '')"}


@query(
    "b20_best_variant",
    sql.with_corpus(
        "SELECT corpus, id, score, score >= 0.6 AS is_threat FROM (SELECT corpus, id, CASE WHEN a >= 0.6 THEN a WHEN b >= 0.6 THEN b "
        "ELSE greatest(a, b, c) END AS score FROM (SELECT corpus, id, max(score) FILTER (v = 'as_is') AS a, max(score) FILTER (v = 'reversed') AS b, "
        "max(score) FILTER (v = 'no_blanks') AS c FROM scored GROUP BY corpus, id))",
        scored=f"SELECT corpus, id, v, least({_TENTHS}, 9) / 10.0::DOUBLE AS score FROM (SELECT corpus, id, v, {_BODY} AS body FROM ("
        + " UNION ALL ".join(f"SELECT corpus, id, '{v}' AS v, {e} AS text FROM corpus" for v, e in _VARIANTS.items())
        + "))",
    ),
)
def best_variant(spark, sf):
    listed = F.array("text", F.reverse("text"), F.replace("text", F.lit(" "), F.lit("")))
    best = threat.with_best_variant(_texts(spark, sf).withColumn("v", listed), "v", threshold=0.6)
    return best.select(*KEYS, "best.score", "best.is_threat")


@query(
    "a6_shadow_log",
    sql.with_corpus(
        "SELECT corpus, id, left(sha256(text), 32) AS input_hash, score, 0.3::DOUBLE AS threshold, score >= 0.3 AS is_threat, "
        "'original' AS variant, 'heuristic' AS model_version, strlen(text)::INT AS input_length FROM scored",
        scored=_HEURISTIC,
    ),
)
def shadow_log(spark, sf):
    scored = _texts(spark, sf).withColumn("s", threat.heuristic_score(F.col("text")))
    rows, path = threat.shadow_log(scored, F.col("s"), keys=KEYS, threshold=0.3), shared_dir(spark)
    log.append(rows, path, batch=0)
    return log.read(spark, path, rows.schema)


# ----------------------------------------------------------------------- claims
_PHRASES = " + ".join(f"contains(lower(replace(text, 'İ', 'i')), {sql.lit(p)})::INT" for p in phrases.CONFIDENT_PHRASES)
_BASE = f"SELECT corpus, id, text, {_PHRASES} AS phrases, len(regexp_extract_all(text, {sql.lit(phrases.STAT_CLAIM)}))::INT AS total_claims FROM corpus"


@query(
    "b21_overconfidence",
    sql.with_corpus(
        "SELECT corpus, id, phrases, total_claims, phrases > 3 AND total_claims > 2 AS flagged, CASE WHEN phrases > 3 AND total_claims > 2 "
        "THEN 'Potential overconfident claims detected without attribution' ELSE '' END AS explanation FROM base",
        base=_BASE,
    ),
)
def overconfidence(spark, sf):
    return claims.with_overconfidence(_texts(spark, sf)).select(*KEYS, "claims.*")


_EDGE = _BLANK[:-1]
_RISK = f"""SELECT corpus, id, total_claims, phrases, len(over)::INT AS overconfident, len(unverified)::INT AS unverified, len(bare)::INT AS unquantified,
    (len(over) + 2 * len(unverified) + len(bare))::INT AS score
  FROM (SELECT *, list_filter(s, lambda x: regexp_matches(x, {sql.lit(phrases.OVERCONFIDENCE)})) AS over,
      list_filter(s, lambda x: regexp_matches(x, {sql.lit(phrases.FACTUAL_CLAIM)}) AND NOT regexp_matches(x, {sql.lit(phrases.ATTRIBUTION)})) AS unverified,
      list_filter(regexp_extract_all(text, {sql.lit(phrases.QUANTITY)}), lambda q: NOT regexp_matches(
        text[greatest(instr(text, q) - 200, 1):instr(text, q) + length(q) + 199], {sql.lit(phrases.ATTRIBUTION)})) AS bare
    FROM (SELECT *, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, {sql.lit('^' + _EDGE + '+|' + _EDGE + '+$')}, '', 'g')),
        lambda x: strlen(x) > 10) AS s FROM base))"""


@query(
    "b22_claim_risk",
    sql.with_corpus(
        "SELECT corpus, id, overconfident, unverified, unquantified, score, CASE WHEN score > 5 THEN 'high' WHEN score > 2 THEN 'medium' ELSE 'low' END AS level, "
        "score > 5 OR (phrases > 3 AND total_claims > 2) AS flagged FROM risk",
        base=_BASE, risk=_RISK,
    ),
)
def claim_risk(spark, sf):
    r = F.col("risk")
    return claims.with_claim_risk(_texts(spark, sf)).select(
        *KEYS, *[F.size(r[c]).alias(c) for c in ("overconfident", "unverified", "unquantified")],
        r["score"].alias("score"), r["level"].alias("level"), r["flagged"].alias("flagged"),
    )


@query(
    "b23_text_analysis",
    sql.with_corpus(
        "SELECT corpus, id, total_claims AS claim_count, CASE WHEN total_claims > 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, "
        "total_claims = 0 OR NOT (score > 5 OR (phrases > 3 AND total_claims > 2)) AS valid FROM risk",
        base=_BASE, risk=_RISK,
    ),
)
def text_analysis(spark, sf):
    r = F.col("risk")
    return claims.with_claim_risk(_texts(spark, sf)).select(
        *KEYS, r["claim_count"].alias("claim_count"), r["confidence"].alias("confidence"), r["valid"].alias("valid")
    )


# ---------------------------------------------------------------- text features
@query("h11_token_estimate", sql.with_corpus(f"SELECT corpus, id, {sql.TOKENS} AS tokens FROM corpus"))
def token_estimate(spark, sf):
    return _texts(spark, sf).select(*KEYS, tx.token_estimate(F.col("text")).alias("tokens"))


@query("h12_normalized", sql.with_corpus(f"SELECT corpus, id, {_CUT} AS normalized FROM corpus"))
def normalized(spark, sf):
    return _texts(spark, sf).select(*KEYS, tx.normalized(F.col("text"), 128).alias("normalized"))


@query(
    "h13_encoded",
    sql.with_corpus(
        "SELECT corpus, id, array_to_string(list_transform(CASE WHEN length(x) > 0 THEN string_split(x, '') ELSE [] END, "
        "lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN unicode(c) ELSE 1 END) || list_transform(range(128 - length(x)), lambda i: 0), ' ') AS ids, "
        "regexp_replace(x, '[^ -~]', '�', 'g') AS decoded "
        f"FROM (SELECT corpus, id, {_CUT} AS x FROM corpus)"
    ),
)
def encoded(spark, sf):
    ids = _texts(spark, sf).select(*KEYS, tx.encoded(tx.normalized(F.col("text"), 128), 128).alias("i"))
    return ids.select(*KEYS, F.array_join(F.col("i").cast("array<string>"), " ").alias("ids"), tx.decoded(F.col("i")).alias("decoded"))


@query("h14_fingerprints", sql.with_corpus("SELECT left(sha256(text), 32) AS input_hash, count(*) AS copies FROM corpus GROUP BY 1"))
def fingerprints(spark, sf):
    return _texts(spark, sf).groupBy(tx.fingerprint(F.col("text")).alias("input_hash")).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "h16_cut_texts",
    sql.with_corpus("SELECT corpus, id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS shown FROM corpus"),
)
def cut_texts(spark, sf):
    return _texts(spark, sf).select(*KEYS, tx.cut(F.col("text"), 80).alias("shown"))


# -------------------------------------------------------------------- evaluation
_DOC_SCORES = _SET_SCORES.format(keys="doc_id", source="(SELECT doc_id, text FROM documents)")
_PAIRED = f"SELECT doc_id, score, score >= 0.3 AS is_threat, toxic = 1 AS actual FROM ({_DOC_SCORES}) JOIN labels USING (doc_id)"


def _paired(spark, sf):
    docs = threat.with_set_score(_docs(spark, sf)).select("doc_id", F.col("set_score.score").alias("score"))
    scored = docs.withColumn("is_threat", F.col("score") >= 0.3)
    return evaluate.paired(scored, table(spark, sf, "labels"), "doc_id", "toxic")


@query("c3_label_pairs", f"WITH paired AS ({_PAIRED}) SELECT * FROM paired")
def label_pairs(spark, sf):
    return _paired(spark, sf)


_RATE = "coalesce({0} / nullif({1}, 0), 0)::DOUBLE"


@query(
    "d15_confusion",
    f"""WITH paired AS ({_PAIRED}), c AS (SELECT count(*) FILTER (is_threat AND actual) AS tp, count(*) FILTER (NOT is_threat AND NOT actual) AS tn,
      count(*) FILTER (is_threat AND NOT actual) AS fp, count(*) FILTER (NOT is_threat AND actual) AS fn, count(*) AS total FROM paired),
    r AS (SELECT *, {_RATE.format('tp', '(tp + fp)')} AS p, {_RATE.format('tp', '(tp + fn)')} AS q FROM c)
    SELECT tp, tn, fp, fn, total, round(p, 6) AS precision, round(q, 6) AS recall, round({_RATE.format('2 * p * q', '(p + q)')}, 6) AS f1 FROM r""",
)
def confusion(spark, sf):
    m = evaluate.metrics(_paired(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _auroc_sql(source):
    return f"""WITH s AS ({source}), g AS (SELECT score, count(*) FILTER (actual) AS pos, count(*) FILTER (NOT actual) AS neg FROM s GROUP BY score),
    c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g),
    t AS (SELECT sum(pos)::BIGINT AS p, sum(neg)::BIGINT AS n FROM g)
    SELECT p AS positives, n AS negatives, round(CASE WHEN p = 0 THEN 0 WHEN n = 0 THEN 1 ELSE
      (SELECT sum((fp / n - (fp - neg) / n) * (tp / p + (tp - pos) / p) / 2) FROM c) END, 6)::DOUBLE AS auroc FROM t"""


@query("d16_auroc_labels", _auroc_sql(_PAIRED))
def auroc_labels(spark, sf):
    return evaluate.auroc(_paired(spark, sf)).withColumn("auroc", F.round("auroc", 6))


@query("d16_auroc_events", _auroc_sql("SELECT value AS score, event_type = 'purchase' AS actual FROM events"))
def auroc_events(spark, sf):
    rows = table(spark, sf, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("actual"))
    return evaluate.auroc(rows).withColumn("auroc", F.round("auroc", 6))


@query(
    "e3_cumulative_counts",
    "SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS cum_pos, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS cum_neg "
    "FROM (SELECT value AS score, count(*) FILTER (event_type = 'purchase') AS pos, count(*) FILTER (event_type <> 'purchase') AS neg FROM events GROUP BY 1)",
)
def cumulative_counts(spark, sf):
    rows = table(spark, sf, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("actual"))
    return evaluate.roc_points(rows)


@query(
    "d14_calibration",
    f"""WITH paired AS ({_PAIRED}), m AS (SELECT greatest(coalesce(max(score), 0), 0) AS top, count(*) AS n, count(*) FILTER (score >= 0.7) AS fp FROM paired WHERE NOT actual)
    SELECT round(greatest(top + 0.05, 0.5), 6)::DOUBLE AS threshold, top AS max_benign_score, 0.05::DOUBLE AS margin, n AS benign_samples, fp AS false_positives,
      round(coalesce(fp / nullif(n, 0), 0), 6)::DOUBLE AS fpr FROM m""",
)
def calibration(spark, sf):
    result = evaluate.calibrate(_paired(spark, sf).where(~F.col("actual")))
    return result.withColumns({"threshold": F.round("threshold", 6), "fpr": F.round("fpr", 6)})


@query(
    "j4_model_scorer",
    """WITH s AS (SELECT len(regexp_extract_all(text, '[aeiou]')) / greatest(length(text), 1) AS score FROM documents),
    m AS (SELECT max(score) AS top, count(*) AS n, count(*) FILTER (score >= 0.35) AS fp FROM s)
    SELECT round(greatest(top + 0.05, 0.5), 6)::DOUBLE AS threshold, round(top, 6)::DOUBLE AS max_benign_score, 0.05::DOUBLE AS margin,
      n AS benign_samples, fp AS false_positives, round(fp / n, 6)::DOUBLE AS fpr FROM m""",
)
def model_scorer(spark, sf):
    """Calibration with a scorer handed in as a pandas function."""

    def vowel_share(texts):
        return texts.str.count("[aeiou]") / texts.str.len().clip(lower=1)

    scorer = threat.pandas_scorer(vowel_share)
    result = evaluate.calibrate(_docs(spark, sf).select(scorer(F.col("text")).alias("score")), threshold=0.35)
    return result.withColumns({c: F.round(c, 6) for c in ("threshold", "max_benign_score", "fpr")})


@query(
    "j4_batch_scorer",
    "SELECT doc_id, round(len(regexp_extract_all(text, '[aeiou]')) / greatest(length(text), 1), 6)::DOUBLE AS score FROM documents",
)
def batch_scorer(spark, sf):
    """Scores of a model that each worker loads once and hands bounded batches of texts."""

    def load():
        import re

        import numpy as np

        vowel = re.compile("[aeiou]")

        def predict(texts):
            return np.array([len(vowel.findall(t or "")) / max(len(t or ""), 1) for t in texts], "float64")

        return predict

    scorer = threat.batch_scorer(load, 256)
    return _docs(spark, sf).select("doc_id", F.round(scorer(F.col("text")), 6).alias("score"))


# ------------------------------------------------------------- one findings table
_FRAMEWORK_ROWS = ", ".join(f"({sql.lit(c)}, {sql.lit(f)})" for c, (_, fs, _) in validated.METADATA.items() for f in fs)


@query(
    "d0_findings_rollups",
    sql.with_corpus(
        f"""SELECT rollup, corpus, name, count(*) AS n, count(DISTINCT whole || '/' || id) AS texts FROM (
        SELECT 'category' AS rollup, NULL::VARCHAR AS corpus, category AS name, corpus AS whole, id FROM pii
        UNION ALL SELECT 'severity', corpus, CASE WHEN severity >= 5 THEN 'critical' WHEN severity >= 4 THEN 'high' WHEN severity >= 3 THEN 'medium' ELSE 'low' END, corpus, id FROM pii
        UNION ALL SELECT 'framework', corpus, framework, corpus, id FROM pii JOIN (VALUES {_FRAMEWORK_ROWS}) AS t(category, framework) USING (category)
        UNION ALL SELECT 'provider', NULL, provider || '/' || category || '/' || severity, corpus, id FROM secret
        UNION ALL SELECT 'technique', NULL, t.category || '/' || unnest([t.name, '*']), corpus, id FROM (SELECT corpus, id, unnest(m) AS t FROM evaded))
        GROUP BY ALL""",
        pii=sql.pii(),
        secret=sql.secret(),
        evaded=f"SELECT corpus, id, {_evasion_sql()} AS m FROM corpus",
    ),
)
def findings_rollups(spark, sf):
    return findings.rollups(written(findings.table_of(_texts(spark, sf), KEYS), "findings"))


# -------------------------------------------------------------------- robustness
def _roll_sql(seed: str, place: str, salt: int = 0) -> str:
    return f"(({seed} + {place} * 7919 + {salt * 104729})::BIGINT * 1223106847 % 2147483629 * 1664525957 % 2147483647)"


def _pick_sql(options, seed: str, place: str, salt: int) -> str:
    return f"([{', '.join(map(sql.lit, options))}])[{_roll_sql(seed, place, salt)} % {len(options)} + 1]"


def _seed_sql(text: str, method: str) -> str:
    return f"('0x' || left(md5({text} || '{method}'), 7))::BIGINT"


def _edit_sql(source: str, text: str, share: float, method: str, into: str) -> str:
    """``source`` with the edited form of ``text``."""
    action = f"{_roll_sql('seed', 'i', 1)} % 3"
    put = (
        f"CASE {action} WHEN 0 THEN {_pick_sql(variants.SUBSTITUTES, 'seed', 'i', 2)} "
        f"WHEN 1 THEN {_pick_sql(variants.INSERTS, 'seed', 'i', 3)} || cs[i + 1] "
        "ELSE CASE WHEN len(cs) > 1 THEN '' ELSE cs[i + 1] END END"
    )
    return f"""SELECT * EXCLUDE (cs, seed, rolls, top), CASE WHEN length({text}) > 0 THEN array_to_string(list_transform(range(len(cs)),
        lambda i: CASE WHEN rolls[i + 1] <= top THEN {put} ELSE cs[i + 1] END), '') ELSE {text} END AS {into}
      FROM (SELECT *, list_sort(rolls)[greatest(floor(len(cs) * {share}::DOUBLE)::INT, 1)] AS top
        FROM (SELECT *, list_transform(range(len(cs)), lambda i: {_roll_sql('seed', 'i')}) AS rolls
          FROM (SELECT *, string_split({text}, '') AS cs, {_seed_sql(text, method)} AS seed FROM ({source}))))"""


_ENTITY = " ".join(f"WHEN {sql.lit(k)} THEN {sql.lit(v)}" for k, v in variants.ENTITIES.items())
_BY_CHARACTER = {
    "unicode-homoglyph": f"CASE WHEN {_roll_sql('key', 'i', 10)} % 10 < 3 THEN translate(cs[i + 1], "
    f"{sql.lit(''.join(variants.HOMOGLYPHS))}, {sql.lit(''.join(variants.HOMOGLYPHS.values()))}) ELSE cs[i + 1] END",
    "whitespace-injection": f"CASE WHEN {_roll_sql('key', 'i', 20)} % 10 < 2 AND cs[i + 1] <> ' ' "
    f"THEN cs[i + 1] || {_pick_sql(variants.BLANKS, 'key', 'i', 21)} ELSE cs[i + 1] END",
    "encoding-mix": f"CASE WHEN {_roll_sql('key', 'i', 30)} % 10 < 3 THEN CASE cs[i + 1] {_ENTITY} ELSE cs[i + 1] END ELSE cs[i + 1] END",
}
_SPLIT_WORD = (
    f"CASE WHEN strlen(ws[i + 1]) <= 2 OR {_roll_sql('key', 'i', 40)} % 10 >= 3 THEN ws[i + 1] ELSE left(ws[i + 1], length(ws[i + 1]) // 2) "
    f"|| {_pick_sql(variants.SPLITTERS, 'key', 'i', 41)} || substring(ws[i + 1], length(ws[i + 1]) // 2 + 1) END"
)
_GAPS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _variants_sql(source: str, keys: str) -> str:
    """Rows (keys, method, method_group, step, text) of all methods over ``source``."""
    staged, last = _edit_sql(source, "text", 0.15, "single", "e0"), "text"
    for step in range(1, 6):
        staged, last = _edit_sql(staged, last, 0.1, f"multi{step}", f"e{step}"), f"e{step}"
    words = f"list_filter(regexp_split_to_array(text, {sql.lit(_GAPS)}), lambda w: w <> '')"
    seated = """array_to_string(list_transform(list_sort(list_concat(
        list_transform(range(taken), lambda k: {'i': seats[k + 1], 'w': rolled[k + 1].w}),
        list_transform(rolled[taken + 1:], lambda x: {'i': x.i, 'w': x.w}))), lambda x: x.w), ' ')"""
    rows = ["('fgsm', 'single', 0, e0)"] + [f"('pgd-step-{s}', 'multi', {s}, e{s})" for s in range(1, 6)]
    rows += [
        f"('evasion-{n}', 'evasion', 0, array_to_string(list_transform(range(len(cs)), lambda i: {e}), ''))"
        for n, e in _BY_CHARACTER.items()
    ]
    rows.append(f"('evasion-character-splitting', 'evasion', 0, array_to_string(list_transform(range(len(ws)), lambda i: {_SPLIT_WORD}), ' '))")
    rows.append(f"('evasion-word-reordering', 'evasion', 0, CASE WHEN len(ws) > 2 THEN {seated} ELSE text END)")
    each = " UNION ALL ".join(
        f"SELECT {keys}, {m} AS method, {g} AS method_group, {s} AS step, {v} AS text FROM staged"
        for m, g, s, v in (r[1:-1].split(", ", 3) for r in rows)
    )
    return f"""WITH staged AS MATERIALIZED (SELECT *, list_sort(list_transform(rolled[1:taken], lambda x: x.i)) AS seats
      FROM (SELECT *, least(len(ws), floor(len(ws) * 0.4::DOUBLE)::INT * 2) AS taken,
        list_sort(list_transform(range(len(ws)), lambda i: {{'r': {_roll_sql('key', 'i', 50)}, 'i': i, 'w': ws[i + 1]}})) AS rolled
      FROM (SELECT *, string_split(text, '') AS cs, {words} AS ws, {_seed_sql('text', 'evasion')} AS key FROM ({staged})))) {each}"""


@query("h15_text_variants", f"SELECT doc_id, method, step, md5(text) AS perturbed FROM ({_variants_sql('SELECT doc_id, text FROM documents', 'doc_id')})")
def text_variants(spark, sf):
    return variants.variants(_docs(spark, sf), ["doc_id"]).select("doc_id", "method", "step", F.md5("perturbed").alias("perturbed"))


_SHARES = ("single", 0.3), ("multi", 0.4), ("evasion", 0.3)
_ASKED = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"
_TESTED = ", ".join(
    f"count(*) FILTER (method_group = '{g}') AS {g}_tests, count(*) FILTER (method_group = '{g}' AND is_threat) AS {g}_passed" for g, _ in _SHARES
)
_RATE = "coalesce({g}_passed / nullif({g}_tests, 0), 0)::DOUBLE * 100"


@query(
    "d17_robustness",
    "SELECT *, "
    + ", ".join(f"round({_RATE.format(g=g)}, 6)::DOUBLE AS {g}_robustness" for g, _ in _SHARES)
    + ", round(" + " + ".join(f"{_RATE.format(g=g)} * {w}::DOUBLE" for g, w in _SHARES) + ", 6)::DOUBLE AS overall_robustness FROM "
    + f"(SELECT {_TESTED} FROM ("
    + _SET_SCORES.format(keys="method_group", source=f"({_variants_sql(_ASKED, 'conv_id, turn')})")
    + "))",
)
def robustness(spark, sf):
    """Per method, how many disguised forms of the users' requests are detected."""
    asked = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    made = variants.variants(asked, ["conv_id", "turn"])
    rates = variants.robustness(variants.judged(made, lambda df: threat.with_set_score(df, "perturbed")))
    return rates.withColumns({c: F.round(c, 6) for c in rates.columns if c.endswith("_robustness")})


@query(
    "j6_variant_generator",
    sql.with_corpus(
        "SELECT corpus, id, unnest([replace(text, 'e', '3'), replace(text, ' ', ''), replace(text, 'a', '4')]) AS p FROM corpus"
    ).replace("AS p FROM", "AS perturbed FROM"),
)
def variant_generator(spark, sf):
    make = lambda t: F.array(F.replace(t, F.lit("e"), F.lit("3")), F.replace(t, F.lit(" "), F.lit("")), F.replace(t, F.lit("a"), F.lit("4")))
    return variants.custom_variants(_texts(spark, sf), KEYS, make).drop("input")


@query(
    "c6_score_each_text_once",
    f"SELECT doc_id, score, is_threat, variant FROM ({_DOC_SCORES})",
)
def score_each_text_once(spark, sf):
    job = lambda texts: threat.with_set_score(texts).select("text_id", "set_score.*")
    return distinct.once_per_text(_docs(spark, sf), "doc_id", job)
