"""Per-text verdict: validated personal data, secrets, injection, compliance
phrases, toxicity and the reports and summary built on them.

Everything is a projection over one scan of the text: no explode, no group-by
and no shuffle, whatever the number of findings per text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import masking, severity
from textguard.functions.dialect import java_of
from textguard.functions.text import cut, quoted, token_estimate, truncated_prefix
from textguard.functions.validators import plausible
from textguard.operators.fence import fenced
from textguard.operators.ruleset import analysed
from textguard.operators.scan import _SAFE, VALUE_LIMIT, hits_of, lookup, where_present, with_matches, with_present
from textguard.rules import GATES, PACKS, phrases, rules_of, secrets, validated
from textguard.rules.model import Rule

ALL_GATES = {**GATES, **validated.GATES, **phrases.TOXICITY_GATES}
# Fixed value: bytes the reference-compatible cap lets the guard layer see.
CAP_BYTES = 64 * 1024
# How block reasons begin.
CLAIMS_REASON, TOXIC_REASON = "Hallucination detected: ", "Toxic content detected: "


@dataclass(frozen=True)
class GuardConfig:
    """Switches of the verdict. ``cap_bytes`` limits the guard layer to a
    leading part of each text; by default it reads the whole text."""

    pii: bool = True
    secrets: bool = True
    xss: bool = True
    compliance: bool = True
    toxicity: bool = True
    hallucination: bool = False
    strict: bool = False
    custom_pii: tuple[str, ...] = ()
    custom_secrets: tuple[str, ...] = ()
    cap_bytes: int | None = None


def check_patterns(df: DataFrame, patterns: Sequence[str]) -> None:
    """Rejects a bad user pattern before any text is read: it is tried on one empty string."""
    for pattern in patterns:
        java, _, error = analysed(pattern)
        try:
            if error is None:
                df.sparkSession.range(1).select(F.lit("").rlike(java)).collect()
        except PySparkException as err:
            error = str(err)
        if error is not None:
            raise ValueError(f"invalid pattern {pattern!r}: {error}")


# ----------------------------------------------------------------- categories


def _pii_rules(custom: Sequence[str]) -> list[Rule]:
    return [*validated.RULES, *[Rule(f"custom_{i}", "", p) for i, p in enumerate(custom)]]


def _pii_structs(matches: Column, first: int, custom: int) -> Column:
    """Validated personal data from matches whose rules start at ``first``."""
    known = len(validated.RULES)
    names = [r.name for r in validated.RULES] + [validated.CUSTOM_CATEGORY] * custom
    scores = [validated.METADATA[r.name][0] for r in validated.RULES] + [validated.CUSTOM_SEVERITY] * custom
    own = F.filter(matches, lambda m: m["n"].between(first, first + known + custom - 1))
    category = lambda m: lookup(names, m["n"] - first)
    valid = F.filter(own, lambda m: (m["n"] >= first + known) | plausible(category(m), m["value"]))
    return F.transform(
        valid,
        lambda m: F.struct(
            category(m).alias("category"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["value"].alias("value"),
            lookup(scores, m["n"] - first).alias("severity"),
            F.when(m["n"] >= first + known, validated.CUSTOM_REDACTED)
            .otherwise(masking.pii_redaction(category(m), m["value"]))
            .alias("redacted"),
        ),
    )


def _secret_structs(matches: Column, first: int, custom: int) -> Column:
    """Secrets from matches whose rules start at ``first``; the value is masked."""
    known = len(secrets.RULES)
    names = [r.name for r in secrets.RULES] + ["custom"] * custom
    kinds = [r.category for r in secrets.RULES] + [secrets.API] * custom
    scores = [secrets.METADATA[k][0] for k in kinds]
    own = F.filter(matches, lambda m: m["n"].between(first, first + known + custom - 1))
    kind = lambda m: lookup(kinds, m["n"] - first)
    real = F.filter(
        own,
        lambda m: (m["n"] >= first + known)
        | ~(
            (kind(m) == secrets.AWS) & m["value"].startswith("AKIAIA")
            | (kind(m) == secrets.BEARER) & (F.length(m["value"]) < 20)
            | (F.length(m["value"]) < 8)
        ),
    )
    return F.transform(
        real,
        lambda m: F.struct(
            lookup(names, m["n"] - first).alias("rule"),
            kind(m).alias("category"),
            masking.provider_of(m["value"]).alias("provider"),
            lookup(scores, m["n"] - first).alias("severity"),
            masking.secret_mask(kind(m), masking.provider_of(m["value"])).alias("value"),
            m["start"].alias("start"),
            m["end"].alias("end"),
        ),
    )


def with_pii(df: DataFrame, text: str = "text", into: str = "pii", custom: Sequence[str] = ()) -> DataFrame:
    """Adds the validated personal data of each text, sorted by position."""
    check_patterns(df, custom)
    found = with_matches(df, _pii_rules(custom), text, into, ALL_GATES)
    return found.withColumn(into, _pii_structs(F.col(into), 0, len(custom)))


def with_secrets(df: DataFrame, text: str = "text", into: str = "secrets", custom: Sequence[str] = ()) -> DataFrame:
    """Adds the secrets of each text with provider and masked value."""
    check_patterns(df, custom)
    rules = [*secrets.RULES, *[Rule(f"custom_secret_{i}", "", p) for i, p in enumerate(custom)]]
    found = with_matches(df, rules, text, into, ALL_GATES)
    return found.withColumn(into, _secret_structs(F.col(into), 0, len(custom)))


def with_personal_and_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii`` and ``secrets`` from one scan of each text."""
    known = _pii_rules(())
    found = with_matches(df, [*known, *secrets.RULES], text, "__both", ALL_GATES)
    both = F.col("__both")
    return found.withColumns({"pii": _pii_structs(both, 0, 0), "secrets": _secret_structs(both, len(known), 0)}).drop("__both")


def context_view(pii: Column) -> Column:
    """The same findings with each value replaced by its redacted form."""
    return F.transform(pii, lambda m: m.withField("value", m["redacted"]))


def toxicity_of(categories: Column) -> Column:
    """Filtered flag, severity and explanation from the hit categories."""
    words = F.create_map(*[F.lit(x) for c, w, _ in phrases.TOXICITY for x in (c, w)])
    listed = F.array_join(F.transform(categories, lambda c: F.element_at(words, c)), ", ")
    hit = F.size(categories) > 0
    return F.struct(
        categories.alias("categories"),
        F.when(hit, phrases.TOXICITY_SEVERITY).otherwise(0).alias("severity"),
        hit.alias("filtered"),
        F.when(hit, F.concat(F.lit(phrases.TOXICITY_PREFIX), listed)).otherwise(F.lit("")).alias("explanation"),
    )


def secret_counts(df: DataFrame, secrets: str = "secrets") -> DataFrame:
    """Per provider, category and severity, the findings ``n`` and the ``texts`` with one.

    A text's findings are in one array: they are counted there, so that only one
    partial row per group and task is shuffled.
    """
    group = ("provider", "category", "severity")
    names = F.transform(secrets, lambda s: F.struct(*[s[c].alias(c) for c in group]))
    seen = fenced(df.select(names.alias("names")), "names")
    counted = F.transform(
        F.array_distinct("names"),
        lambda n: F.struct(*[n[c].alias(c) for c in group], F.size(F.filter("names", lambda m: m == n)).alias("k")),
    )
    return seen.select(F.inline(counted)).groupBy(*group).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts"))


def with_toxicity(df: DataFrame, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds the toxicity verdict. Only presence counts, so rules are tested."""
    columns = [F.col(c) for c in df.columns]
    hit = []
    for i, r in enumerate(phrases.TOXICITY_RULES):
        test = f"rlike({_SAFE}, {quoted(java_of(r.name, r.regex))})"
        hit.append(f"CASE WHEN {where_present(i, test, 'false')} THEN {quoted(r.name)} END")
    seen = with_present(df, text, enumerate(phrases.TOXICITY_RULES))
    hits = seen.select(*columns, hits_of(hit, "h IS NOT NULL").alias(into))
    return fenced(hits.withColumn(into, toxicity_of(F.col(into))), into)


# -------------------------------------------------------------------- verdict


def _threat(kind, score, message, location, pattern, start, end) -> Column:
    return F.struct(
        kind.alias("type"),
        score.cast("int").alias("severity"),
        message.alias("message"),
        location.alias("location"),
        pattern.alias("pattern"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
    )


THREAT = "struct<type:string,severity:int,message:string,location:string,pattern:string,start:int,end:int>"


def _none(kind: str = f"array<{THREAT}>") -> Column:
    return F.array().cast(kind)


def reports_of(pii: Column, secret_types: Column, allowed: Column) -> Column:
    """Framework reports of one text: framework -> (compliant, violations)."""
    has = lambda *names: F.exists(pii, lambda c: c.isin(*names))

    def entry(name, violation):
        return F.struct(
            F.lit(name).alias("key"),
            F.struct(
                F.lit(not violation).alias("compliant"),
                (F.array(F.lit(violation)) if violation else F.array().cast("array<string>")).alias("violations"),
            ).alias("value"),
        )

    clean = (F.size(pii) == 0) & (F.size(secret_types) == 0) & allowed
    # Framework names, violation texts and categories.
    rows = F.array(
        F.when(has("email", "phone", "address"), entry("GDPR", "PII detected in AI response (GDPR Article 22)")),
        F.when(has("health_info", "date_of_birth"), entry("HIPAA", "Protected health information detected (HIPAA)")),
        F.when(has("credit_card", "bank_account"), entry("PCI-DSS", "Payment card data detected (PCI-DSS)")),
        F.when(F.size(secret_types) > 0, entry("SOC2", "Secret/API key detected in response (SOC2)")).when(
            clean, entry("SOC2", "")
        ),
    )
    return F.map_from_entries(F.array_compact(rows))


def with_verdict(
    df: DataFrame,
    text: str = "text",
    config: GuardConfig = GuardConfig(),
    limit_reason: Column | None = None,
    keep_rules: bool = False,
) -> DataFrame:
    """Adds ``verdict``, and ``rule_matches`` when ``keep_rules`` is set.

    ``limit_reason`` is the limiter's refusal for the row (null when allowed).
    """
    check_patterns(df, (*config.custom_pii, *config.custom_secrets))
    pairs = rules_of()
    first_pii = len(pairs)
    pii_rules = _pii_rules(config.custom_pii)
    first_tox = first_pii + len(pii_rules)
    custom_secrets = [Rule(f"custom_secret_{i}", "", p) for i, p in enumerate(config.custom_secrets)]
    first_custom = first_tox + len(phrases.TOXICITY_RULES)
    rules = [r for _, r in pairs] + pii_rules + list(phrases.TOXICITY_RULES) + custom_secrets

    columns = df.columns
    body, guard_from = text, "__matches"
    seen = df
    if config.cap_bytes:
        body = "__head"
        seen = seen.withColumn(body, truncated_prefix(F.col(text), config.cap_bytes))
        if keep_rules:
            seen = with_matches(seen, [r for _, r in pairs], text, "__rules", ALL_GATES)
    seen = with_matches(seen, rules, body, guard_from, ALL_GATES)
    rule_source = "__rules" if config.cap_bytes and keep_rules else guard_from

    m = F.col(guard_from)
    names = [r.name for _, r in pairs]
    levels = [r.severity for _, r in pairs]
    packs = [p for p, _ in pairs]

    def pack_threats(pack: str, kind: str, message: str) -> Column:
        low = packs.index(pack)
        high = low + len(PACKS[pack]) - 1
        return F.transform(
            F.filter(m, lambda x: x["n"].between(low, high)),
            lambda x: _threat(
                F.lit(kind),
                severity.score_of(lookup(levels, x["n"])),
                F.concat(F.lit(message), lookup(names, x["n"])),
                F.lit("response_body"),
                lookup(names, x["n"]),
                x["start"],
                x["end"],
            ),
        )

    off = F.slice(m, 1, 0)
    staged = seen.select(
        *columns,
        *([F.col(rule_source).alias("__all")] if keep_rules else []),
        _pii_structs(m if config.pii else off, first_pii, len(config.custom_pii)).alias("__pii"),
        F.array_sort(
            F.concat(
                _secret_structs(m if config.secrets else off, 0, 0),
                F.transform(
                    F.filter(m, lambda x: x["n"] >= first_custom),
                    lambda x: F.struct(
                        F.lit("custom").alias("rule"),
                        F.lit(secrets.API).alias("category"),
                        masking.provider_of(x["value"]).alias("provider"),
                        F.lit(secrets.METADATA[secrets.API][0]).alias("severity"),
                        masking.secret_mask(F.lit(secrets.API), masking.provider_of(x["value"])).alias("value"),
                        x["start"].alias("start"),
                        x["end"].alias("end"),
                    ),
                ),
            ),
            lambda a, b: a["start"] - b["start"],
        ).alias("__secrets"),
        (pack_threats("xss", "xss", "XSS vector detected: ") if config.xss else _none()).alias("__xss"),
        (
            pack_threats("compliance", "compliance", "Compliance violation: ") if config.compliance else _none()
        ).alias("__compliance"),
        toxicity_of(
            F.array_distinct(
                F.array_sort(
                    F.transform(
                        F.filter(m if config.toxicity else off, lambda x: x["n"].between(first_tox, first_custom - 1)),
                        lambda x: F.struct(
                            x["n"].alias("n"),
                            lookup([r.name for r in phrases.TOXICITY_RULES], x["n"] - first_tox).alias("name"),
                        ),
                    )
                )["name"]
            )
        ).alias("__toxicity"),
        token_estimate(F.col(body)).alias("__tokens"),
        (F.octet_length(F.col(text)) > (config.cap_bytes or CAP_BYTES)).alias("__truncated")
        if config.cap_bytes
        else F.lit(False).alias("__truncated"),
        *([F.col(body).alias("__body")] if config.hallucination else []),
        (limit_reason if limit_reason is not None else F.lit(None).cast("string")).alias("__limit"),
    )
    if config.hallucination:
        from textguard.operators.claims import with_overconfidence

        staged = with_overconfidence(staged, "__body", "__claims")
        flagged, claim_text = F.col("__claims.flagged"), F.col("__claims.explanation")
    else:
        flagged, claim_text = F.lit(False), F.lit("")

    pii, found = F.col("__pii"), F.col("__secrets")
    single = lambda on, t: F.when(on, F.array(t)).otherwise(_none())
    blank = F.lit("")
    zero = F.lit(0)
    threats = F.concat(
        F.transform(
            pii,
            lambda x: _threat(
                F.lit("pii"), x["severity"], F.concat(x["category"], F.lit(" detected in response")),
                F.lit("response_body"), x["category"], x["start"], x["end"],
            ),
        ),
        F.transform(
            found,
            lambda x: _threat(
                F.lit("secret"), x["severity"],
                F.concat(x["provider"], F.lit(" "), x["category"], F.lit(" detected in response")),
                F.lit("response_body"), x["category"], x["start"], x["end"],
            ),
        ),
        F.col("__xss"),
        F.col("__compliance"),
        single(
            F.col("__limit").isNotNull(),
            _threat(F.lit("token_limit"), F.lit(4), F.col("__limit"), F.lit("response_size"), blank, zero, zero),
        ),
        single(
            F.col("__toxicity.filtered"),
            _threat(
                F.lit("toxicity"), F.col("__toxicity.severity"), F.col("__toxicity.explanation"),
                F.lit("response_body"), blank, zero, zero,
            ),
        ),
        single(
            flagged,
            _threat(F.lit("hallucination"), F.lit(3), claim_text, F.lit("response_content"), blank, zero, zero),
        ),
    )
    judged = staged.withColumn("__threats", threats)
    any_threat = F.size("__threats") > 0
    strict = F.lit(config.strict)
    # The later check overwrites the reason; the strict message only fills a gap.
    reason = (
        F.when(flagged & strict, F.concat(F.lit(CLAIMS_REASON), claim_text))
        .when(F.col("__toxicity.filtered"), F.concat(F.lit(TOXIC_REASON), F.col("__toxicity.explanation")))
        .when(F.col("__limit").isNotNull(), F.col("__limit"))
        .when(strict & any_threat, F.lit("Strict mode: threats detected in response"))
        .otherwise(F.lit(""))
    )
    secret_types = F.transform("__secrets", lambda x: F.concat(x["provider"], F.lit(":"), x["category"]))
    categories = F.transform("__pii", lambda x: x["category"])
    verdict = F.struct(
        (reason == "").alias("allowed"),
        reason.alias("block_reason"),
        F.col("__threats").alias("threats"),
        categories.alias("pii"),
        secret_types.alias("secrets"),
        F.transform("__xss", lambda t: t["pattern"]).alias("xss"),
        F.transform("__compliance", lambda t: t["pattern"]).alias("compliance"),
        F.col("__truncated").alias("truncated"),
        F.col("__tokens").alias("tokens"),
        reports_of(categories, secret_types, reason == "").alias("reports"),
    )
    rule_matches = F.transform(
        F.filter("__all", lambda x: x["n"] < first_pii),
        lambda x: F.struct(
            lookup(names, x["n"]).alias("rule"),
            lookup(levels, x["n"]).alias("severity"),
            cut(x["value"], VALUE_LIMIT).alias("value"),
            x["start"].alias("start"),
            x["end"].alias("end"),
        ),
    ) if keep_rules else None
    kept = {"verdict": verdict, **({"rule_matches": rule_matches} if keep_rules else {})}
    return fenced(judged.select(*columns, *[v.alias(k) for k, v in kept.items()]), *kept)


def limited(verdict: Column, reason: Column) -> Column:
    """The verdict with the limiter's refusal of its row, as ``with_verdict`` gives it with ``limit_reason``.

    For refusals that are joined to verdicts afterwards, by key alone, so that texts are not shuffled.
    A null ``reason`` leaves the verdict as it is.
    """
    zero, blank = F.lit(0), F.lit("")
    refusal = _threat(F.lit("token_limit"), F.lit(4), reason, F.lit("response_size"), blank, zero, zero)
    later = lambda t: t["type"].isin("toxicity", "hallucination")
    threats = F.concat(
        F.filter(verdict["threats"], lambda t: ~later(t)), F.array(refusal), F.filter(verdict["threats"], later)
    )
    old = verdict["block_reason"]
    # Claims and toxicity are checked after the limit and overwrite its reason.
    kept = old.startswith(CLAIMS_REASON) | old.startswith(TOXIC_REASON)
    changed = {
        "allowed": F.lit(False),
        "block_reason": F.when(kept, old).otherwise(reason),
        "threats": threats,
        "reports": reports_of(verdict["pii"], verdict["secrets"], F.lit(False)),
    }
    with_reason = verdict
    for name, value in changed.items():
        with_reason = with_reason.withField(name, value)
    return F.when(reason.isNull(), verdict).otherwise(with_reason)


def with_summary(
    df: DataFrame,
    text: str = "text",
    config: GuardConfig = GuardConfig(),
    scorer=None,
    threshold: float = 0.7,
    shadow: bool = True,
    distinct: bool = False,
) -> DataFrame:
    """Adds ``summary``: guard findings, the scorer's finding and rule findings
    in that order, duplicates kept unless ``distinct``.

    ``scorer`` is a function Column -> Column; in shadow mode its score is kept
    but never raises a finding.
    """
    columns = df.columns
    judged = with_verdict(df, text, config, keep_rules=True)
    v = F.col("verdict")
    blank = F.coalesce(F.col(text), F.lit("")) == ""

    def result(category, sev, confidence, shown, rule, threat, layer, start, end):
        return F.struct(
            category.alias("category"), sev.alias("severity"), confidence.alias("confidence"),
            shown.alias("text"), rule.alias("rule"), F.lit(threat).alias("is_threat"),
            F.lit(layer).alias("layer"), start.alias("start"), end.alias("end"),
        )

    score = scorer(F.col(text)) if scorer else F.lit(0.0)
    scored = judged.withColumn("__score", F.when(blank, 0.0).otherwise(score))
    guard = F.transform(
        v["threats"],
        lambda t: result(
            t["type"], severity.name_of(t["severity"]), F.lit(1.0), t["message"], t["pattern"], True, "guard",
            t["start"], t["end"],
        ),
    )
    rules = F.transform(
        F.col("rule_matches"),
        lambda x: result(
            x["rule"], x["severity"], F.lit(1.0), x["value"], x["rule"], False, "rules", x["start"], x["end"]
        ),
    )
    parts = [guard]
    if scorer and not shadow:
        finding = result(
            F.lit("ml_threat"), F.lit("high"), F.col("__score"),
            F.lit("Adversarial prompt pattern detected"), F.lit("scorer"), True, "scorer", F.lit(0), F.lit(0),
        )
        parts.append(F.when(F.col("__score") >= threshold, F.array(finding)).otherwise(F.slice(F.array(finding), 1, 0)))
    if distinct:
        # Keep a rule finding only where the guard has none of the same span.
        rules = F.filter(
            rules,
            lambda r: ~F.exists(
                v["threats"], lambda t: (t["pattern"] == r["rule"]) & (t["start"] == r["start"]) & (t["end"] == r["end"])
            ),
        )
    parts.append(rules)
    joined = scored.withColumn("__results", F.concat(*parts))
    results = F.when(blank, F.slice("__results", 1, 0)).otherwise(F.col("__results"))
    summary = F.struct(
        F.size(results).alias("total_detections"),
        (~blank & ~v["allowed"]).alias("blocked"),
        v["block_reason"].alias("block_reason"),
        results.alias("results"),
        v["pii"].alias("pii_categories"),
        v["secrets"].alias("secret_types"),
        F.when(blank, F.map_from_entries(F.slice(F.map_entries(v["reports"]), 1, 0)))
        .otherwise(v["reports"])
        .alias("reports"),
        F.col("__score").alias("ml_score"),
        v["tokens"].alias("tokens"),
        v["truncated"].alias("truncated"),
    )
    return fenced(joined.select(*columns, summary.alias("summary")), "summary")
