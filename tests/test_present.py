"""Which rules are told to match, against RE2 run rule by rule, and what that spares."""

import duckdb
import pyarrow as pa
import pytest

from probes import PROBES
from textguard.operators import present, scan
from textguard.plans import sql
from textguard.rules import phrases, rules_of, validated

RULES = [r for _, r in rules_of()] + [*validated.RULES, *phrases.TOXICITY_RULES, *phrases.EVASION_RULES]
PATTERNS = [(i, present.SAME_TEXTS.get(r.name, r.regex)) for i, r in enumerate(RULES)]
# Has a word or digits that each of many rules asks for, and no match of those.
IDLE = "The system may now check this code, number or id for the model: a new tool, 12 34; no right, time or data. "


def test_listed_is_what_re2_finds():
    con = duckdb.connect()
    con.execute("CREATE TABLE probes (id INT, text VARCHAR)")
    con.executemany("INSERT INTO probes VALUES (?, ?)", list(enumerate(PROBES)))
    want = set(con.execute(f"SELECT DISTINCT id, n FROM ({sql.matches(RULES, 'probes', 'id')})").fetchall())
    got = present.listed(pa.array(PROBES, pa.string()), PATTERNS).to_pylist()
    assert {(i, n) for i, row in enumerate(got) for n in row} == want
    assert all(row == sorted(row) for row in got)


@pytest.mark.parametrize("slice_", [1, 40, 10_000])
def test_slices_and_nulls(monkeypatch, slice_):
    monkeypatch.setattr(present, "SLICE", slice_)
    texts = [None, "", "a@b.co", "x" * 100, "é@ü.org", None]
    got = present.listed(pa.array(["left out", *texts], pa.string()).slice(1), [(3, "@"), (1, "x{3}"), (2, r"\.org")])
    assert got.to_pylist() == [[], [], [3], [1], [2, 3], []]
    assert present.listed(pa.array([], pa.string()), PATTERNS).to_pylist() == []


def test_bytes_that_are_not_text(spark):
    df = spark.sql("SELECT 1 AS id, cast(concat(X'41FF', encode(' password=ab', 'utf-8'), X'FE', encode('cdefghij', 'utf-8')) AS string) AS text")
    rules = {r.rule for r in scan.findings(df, ["id"]).collect()}
    assert "secret_password_assignment" in rules


def test_patterns_run_only_where_they_match(spark):
    df = spark.createDataFrame([(0, IDLE), (1, ""), (2, None), (3, "a@b.co")], "id int, text string")
    rows = scan.with_present(df, "text", enumerate(RULES)).collect()
    told = {r.id: {RULES[n].name for n in r["__found"]} for r in rows}
    found = {"word_splitting", "camelcase_attack_word"}
    assert told == {0: found, 1: set(), 2: set(), 3: {"pii_email", "pii_email_intl", "email"}}
