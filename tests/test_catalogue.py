"""The catalogue, its JVM patterns and its gates, against RE2."""

import duckdb
import pytest
from pyspark.sql import functions as F

from probes import PROBES
from textguard.functions.dialect import to_java
from textguard.operators import scan
from textguard.operators.guard import ALL_GATES
from textguard.plans import sql
from textguard.rules import GATES, PACKS, phrases, rules_of, secrets, validated

RULES = [r for _, r in rules_of()] + [*validated.RULES, *phrases.TOXICITY_RULES, *phrases.EVASION_RULES]
EVERY_GATE = {**ALL_GATES, **phrases.EVASION_GATES}


def test_pack_sizes():
    assert {p: len(r) for p, r in PACKS.items()} == {
        "secrets": 45, "xss": 12, "pii-us-core": 15, "pii-us-extended": 13,
        "pii-financial": 9, "pii-international": 24, "compliance": 35,
    }
    names = [r.name for _, r in rules_of()]
    assert len(names) == len(set(names)) and set(names) == set(GATES)
    assert set(PACKS["secrets"]) == set(secrets.RULES) and len(validated.METADATA) == 12


@pytest.fixture(scope="module")
def found(spark):
    probes = spark.createDataFrame(list(enumerate(PROBES)), "id int, text string")
    rows = scan.exploded(scan.with_matches(probes, RULES, gates=EVERY_GATE), ["id"]).collect()
    return {(r.id, r.n, r.start, r.end, r.value) for r in rows}


def test_same_matches_as_re2(found):
    con = duckdb.connect()
    con.execute("CREATE TABLE probes (id INT, text VARCHAR)")
    con.executemany("INSERT INTO probes VALUES (?, ?)", list(enumerate(PROBES)))
    want = con.execute(sql.matches(RULES, "probes", "id")).fetchall()
    assert {(i, n, s, e, v) for i, n, s, e, v in want} == found


def test_every_rule_is_exercised(found):
    assert {n for _, n, *_ in found} == set(range(len(RULES)))


def test_gates_lose_nothing(spark, found):
    probes = spark.createDataFrame(list(enumerate(PROBES)), "id int, text string")
    rows = scan.exploded(scan.with_matches(probes, RULES, gates={}), ["id"]).collect()
    assert {(r.id, r.n, r.start, r.end, r.value) for r in rows} == found


@pytest.mark.parametrize(
    "re2, java",
    [
        (r"\d+", r"\d+"),
        (r"a\sb", "a[\\t\\n\\f\\r ]b"),
        (r"(?i)ask", "(?i)a[sſ][k\u212a]"),
        (r"(?i)[a-z]", "(?i)[a-z\u212aſ]"),
        (r"[A-C0-2_]+", "[ABC012_]+"),
        (r"[\p{L}0-2]", r"[\p{L}012]"),
        (r"[\s\S]", "[\\t\\n\\f\\r \\S\\x0B]"),
        (r"x.y$", r"x[^\n]y\z"),
        (r"\x{200b}", r"\x{200b}"),
    ],
)
def test_dialect(re2, java):
    assert to_java(re2) == java


def test_long_inputs_stay_linear_and_shallow(spark):
    words = "12 " + "word " * 200_000
    cases = [
        words,
        words + "Street",
        "Strada " + "Mare " * 100_000 + "Nr. 5",
        "Art. 1" + ", II" * 100_000,
        "x" * 300_000 + " a@b.co",
        "legal " * 100_000,
        "<script>" * 300,
        "1 " * 100_000,
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {(r.id, r.rule) for r in scan.findings(df, ["id"]).select("id", "rule").distinct().collect()}
    assert (1, "pii_address") in got and (0, "pii_address") not in got
    assert (2, "pii_street_intl") in got and (3, "lgpd_reference") in got and (4, "pii_email") in got


def test_many_matches_keep_exact_offsets(spark):
    body = "a@b.co é " * 5_000
    rows = scan.findings(spark.createDataFrame([(0, body)], "id int, text string"), ["id"], ["pii-us-core"])
    starts = sorted(r.start for r in rows.where(F.col("rule") == "pii_email").collect())
    assert starts == [i * 9 for i in range(5_000)]


def test_value_is_cut_and_counts_agree(spark, texts):
    df = texts("<script>" + "x" * 500 + "</script>", "a@b.co c@d.org", "", None)
    rows = scan.findings(df, ["id"]).collect()
    script = next(r for r in rows if r.rule == "xss_script_tag")
    assert len(script.value) == 203 and script.value.endswith("...") and script.end - script.start == 517
    counts = {r.rule: (r.texts, r.matches) for r in scan.rule_counts(df).collect()}
    assert counts["pii_email"] == (1, 2) and counts["pii_ssn"] == (0, 0) and len(counts) == 153
    assert sum(m for _, m in counts.values()) == len(rows)
    packs = {r.pack: (r.pattern_count, r.matches) for r in scan.pack_counts(df).collect()}
    assert packs["compliance"] == (35, 0) and len(packs) == 7
