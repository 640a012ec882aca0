"""Registered queries: their plans, their SQL on the smallest data, streams."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from probes import PROBES
from textguard import plans
from textguard.operators import guard, policy, scan, usage
from textguard.sources.tables import table
from tools.check import TABLES, rows_of

QUICK = [
    "b1_match_offsets", "b9_validated_pii", "d9_pack_counts", "c6_scan_each_text_once", "b24_verdict", "b26_policy_decision",
    "h6_redacted_texts", "d11_drift", "d16_auroc_events", "e1_trailing_usage", "e2_limiter_audit", "e2_saturated_limiter",
    "i1_live_findings", "i2_stream_limiter", "i3_minute_counts", "i5_daily_drift", "i6_blocked_traffic", "i7_first_deliveries",
    "d0_findings_rollups", "e3_cumulative_counts", "i4_late_labels", "j4_batch_scorer", "b24_full_precedence",
]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    result = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


# Rules that the given tables never hit: the same comparison with the probes as documents.
PROBED = [
    "b2_secret_rules", "b2_secret_findings", "b9_validated_pii", "c7_framework_exposure", "d2_severity_summary",
    "d3_secrets_by_provider", "g1_all_packs", "b15_toxicity", "b16_evasion_scores", "b18_set_scores", "b24_verdict",
    "d4_compliance_reports", "h6_redacted_texts", "h7_value_redaction", "h8_pii_only", "h8_secrets_only",
    "h9_masked_secrets", "j1_custom_patterns", "j7_replacement_rules", "d0_findings_rollups", "b24_full_precedence",
]


@pytest.fixture(scope="module")
def probed(sf, tmp_path_factory):
    """The given tables, but for documents, which hold the probe texts."""
    folder = tmp_path_factory.mktemp("probed")
    con = duckdb.connect()
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", folder / f"{t}.parquet")
    con.execute("CREATE TABLE probes (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO probes VALUES (?, ?)", list(enumerate(PROBES)))
    con.execute(
        "COPY (SELECT doc_id, text, 'en' AS lang, 'web' AS source, length(text) AS n_chars FROM probes) "
        f"TO '{folder}/documents.parquet' (FORMAT parquet)"
    )
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", PROBED)
def test_query_equals_sql_on_probes(spark, probed, name):
    folder, con = probed
    df = plans.QUERIES[name](spark, folder)
    result = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in result.description]
    rows = rows_of(df.columns, df.collect())
    assert rows and rows == rows_of(columns, result.fetchall())


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_plan_is_one_scan_without_shuffle_or_python(spark, sf):
    df = policy.with_decision(guard.with_summary(table(spark, sf, "documents")))
    plan = _plan(df.where("decision.blocked").select("doc_id", "decision.reason"))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    # The filter on the decision does not bring a second copy of the scan.
    assert plan.count("filter(array(named_struct(n") + plan.count("filter(array(struct(n") == 1


def test_reading_one_field_does_not_repeat_the_scan(spark, sf):
    judged = guard.with_verdict(table(spark, sf, "documents"))
    for df in (judged.select("verdict.threats"), judged.where("NOT verdict.allowed").select("verdict.pii")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1 and len(plan) < 200_000


def test_counts_shuffle_partial_sums_only(spark, sf):
    plan = _plan(scan.rule_counts(table(spark, sf, "documents")))
    assert "partial_sum" in plan and "ReadSchema: struct<text:string>" in plan


def test_usage_windows_are_linear_for_one_hot_client(spark):
    """All rows of one client in one window: sums run, they are not taken anew per row."""
    rows = spark.range(200_000).select(
        F.lit(1).alias("c"), F.timestamp_micros(F.col("id") * 100).alias("ts"), (F.col("id") % 7).alias("n")
    )
    got = usage.trailing_usage(rows, "c", "ts", "n", 60).agg(F.max("used_requests").alias("r"), F.max("used_tokens").alias("t")).first()
    assert got["r"] == 200_000 and got["t"] == sum(i % 7 for i in range(200_000))
    plan = _plan(usage.trailing_usage(rows, "c", "ts", "n", 60))
    assert "unboundedpreceding" in plan.lower()
