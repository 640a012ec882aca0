"""Rules as a table: literals of patterns, both ways of the join, many rules, bad patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textguard.operators import ruleset


@pytest.mark.parametrize(
    "pattern, literals",
    [
        (r"\bemployee\s+id\b", ["employee"]),
        (r"(?i)\b(?:Foo1|barbaz)\b", ["barbaz", "foo1"]),
        (r"(?:ab|xyz)\d+", []),
        (r"[0-9a-f]{40}", []),
        (r"(?:secret){2}x?", ["secret"]),
        (r"(?:secret)?token", ["token"]),
        (r"\p{L}+corp|acme\x{2d}", ["acme", "corp"]),
        ("straße", ["stra"]),
    ],
)
def test_literals_that_must_occur(pattern, literals):
    assert ruleset.analysed(pattern)[1] == literals and ruleset.analysed(pattern)[2] is None


def _rules(spark, rows):
    return spark.createDataFrame(rows, "name string, severity int, pattern string")


def _rows(df):
    return sorted((r["id"], r["name"], r["start"], r["end"], r["value"]) for r in df.collect())


def _expected(texts, rules):
    return sorted(
        (i, name, m.start(), m.end(), m.group())
        for i, t in texts if t for name, _, p in rules for m in re.finditer(p, t) if m.group()
    )


def test_both_ways_equal_brute_force(spark):
    draw = random.Random(1)
    words = ["alpha", "beta", "Gamma", "AKIA", "x1", "#42", "émile", "foo.bar", "\u0001", "secretsecret", "12-34", "\n"]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(40)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "alpha " * 20_000)]
    rules = [("a", 1, r"\balpha\b"), ("either", 2, r"(?i)gamma|beta"), ("digits", 3, r"[0-9]+-[0-9]+"), ("twice", 1, r"(?:secret){2}"),
             ("dot", 1, r"foo\.bar"), ("a", 9, r"beta [A-Z]+"), ("never", 1, "zzzz"), ("short", 1, "x1")]
    df = spark.createDataFrame(texts, "id int, text string").withColumns({"rule": F.lit("mine"), "stretch": F.lit(1)})
    want = _expected(texts, rules)
    assert _rows(ruleset.findings(df.repartition(3), _rules(spark, rules), ["id"])) == want
    assert _rows(ruleset.findings(df, _rules(spark, rules), ["id"], most=1)) == want
    assert ruleset.findings(df, _rules(spark, rules).where("severity > 100"), ["id"]).count() == 0


def test_five_thousand_rules(spark):
    rules = [(f"r{i}", i % 5, rf"\bbadge[-_]{i:05d}\b" if i % 2 else rf"(?i)\bcase{i:05d}x\b") for i in range(5000)]
    texts = [(i, f"Some text {i} badge-{i:05d} and CASE{i + 1:05d}X, badge_{(i * 7) % 5000:05d}.") for i in range(0, 400)]
    df = spark.createDataFrame(texts, "id int, text string")
    want = []
    for i, t in texts:
        for m in re.finditer(r"\bbadge[-_](\d{5})\b|(?i:\bcase(\d{5})x\b)", t):
            n = int(m.group(1) or m.group(2))
            if bool(m.group(1)) == bool(n % 2):
                want.append((i, f"r{n}", m.start(), m.end(), m.group()))
    assert _rows(ruleset.findings(df, _rules(spark, rules), ["id"])) == sorted(want)
    assert _rows(ruleset.findings(df, _rules(spark, rules), ["id"], most=1000)) == sorted(want)


def test_bad_patterns_are_reported(spark):
    rules = _rules(spark, [("ok", 1, "abc"), ("open", 1, "a(b"), ("none", 1, None), ("class", 1, "[a"), ("many", 1, "a**")])
    assert {r["name"] for r in ruleset.rejected(rules).collect()} == {"open", "none", "class", "many"}
    df = spark.createDataFrame([(1, "xabcx")], "id int, text string")
    assert _rows(ruleset.findings(df, rules, ["id"])) == [(1, "ok", 1, 4, "abc")]


def test_few_rules_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(ruleset, "_stretches", None)
    texts = [(1, "see a.example.com, beta"), (2, "alpha 42"), (3, None), (4, "")]
    rules = [("host", 1, r"[a-z]+\.example\.com"), ("digits", 2, r"[0-9]{2}"), ("word", 3, "(?i)BETA|alpha")]
    df = spark.createDataFrame(texts, "id int, text string")
    assert _rows(ruleset.findings(df, _rules(spark, rules), ["id"])) == _expected(texts, rules)


def test_more_rules_than_few_use_the_index(spark, monkeypatch):
    monkeypatch.setattr(ruleset, "FEW", 1)
    texts = [(1, "see a.example.com, beta"), (2, "alpha 42")]
    rules = [("host", 1, r"[a-z]+\.example\.com"), ("digits", 2, r"[0-9]{2}"), ("word", 3, "(?i)BETA|alpha")]
    df = spark.createDataFrame(texts, "id int, text string")
    assert _rows(ruleset.findings(df, _rules(spark, rules), ["id"])) == _expected(texts, rules)
