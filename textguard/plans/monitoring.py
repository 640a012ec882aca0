"""Histograms, drift and usage over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators import drift, usage
from textguard.plans.registry import query
from textguard.sources.tables import table

_SPLIT = "2024-01-16 00:00:00"


def _halves(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value", "ts")
    cut = F.lit(_SPLIT).cast("timestamp_ntz")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


_STATS = f"""SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd,
    CASE WHEN max(value) = min(value) THEN 0 ELSE min(value) END AS low,
    CASE WHEN max(value) = min(value) THEN 0.1 ELSE (max(value) - min(value)) / 10.0::DOUBLE END AS width
  FROM old GROUP BY feature"""
_BINS = """SELECT feature, bin, low + bin * width AS lower, low + (bin + 1) * width AS upper, n AS total, coalesce(k, 0) AS k
  FROM (SELECT *, unnest(range(10))::INT AS bin FROM stats) LEFT JOIN (
    SELECT feature, greatest(least(trunc((value - low) / width)::INT, 9), 0) AS bin, count(*) AS k
    FROM old JOIN stats USING (feature) GROUP BY ALL) USING (feature, bin)"""
_CTES = f"""WITH old AS (SELECT event_type AS feature, value FROM events WHERE ts < TIMESTAMP '{_SPLIT}'),
  new AS (SELECT event_type AS feature, value FROM events WHERE ts >= TIMESTAMP '{_SPLIT}'),
  stats AS ({_STATS}), bins AS ({_BINS}),
  placed AS (SELECT feature, value, CASE WHEN inside >= 0 THEN inside WHEN trunc(value * 10) BETWEEN 0 AND 9 THEN trunc(value * 10)::INT END AS bin
    FROM (SELECT feature, value, len(list_filter(lowers, lambda x: value >= x))::INT - 1 AS inside
      FROM new JOIN (SELECT feature, list(lower) AS lowers FROM bins GROUP BY feature) USING (feature))),
  now AS (SELECT feature, bin, count(*) AS c FROM placed WHERE bin IS NOT NULL GROUP BY ALL),
  sums AS (SELECT feature, sum(c) AS m FROM now GROUP BY feature),
  w AS (SELECT feature, bin, total, m, greatest(k / total, 0.0001) AS b, greatest(coalesce(c, 0) / m, 0.0001) AS c
    FROM bins JOIN sums USING (feature) LEFT JOIN now USING (feature, bin))"""


# The histograms of a whole table: every event counts as baseline.
_WHOLE = f"WITH old AS (SELECT event_type AS feature, value FROM events), stats AS ({_STATS}), bins AS ({_BINS})"


def _all_events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value")


@query(
    "d10_histogram",
    _WHOLE + " SELECT feature, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, k AS n, round(k / total, 6) AS weight FROM bins",
)
def histogram(spark, sf):
    rows = drift.histogram(drift.baseline(_all_events(spark, sf)))
    return rows.withColumns({c: F.round(c, 6) for c in ("lower", "upper", "weight")})


@query("d10_feature_stats", _WHOLE + " SELECT feature, n AS count, round(mean, 6) AS mean, round(sd, 6) AS std_dev FROM stats")
def feature_stats(spark, sf):
    return drift.baseline(_all_events(spark, sf)).select("feature", "count", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"))


@query(
    "d11_drift",
    _CTES
    + """ SELECT feature, round(sum((c - b) * ln(c / b)), 6) AS psi, round(sum(c * ln(c / b)), 6) AS kl,
    CASE WHEN sum((c - b) * ln(c / b)) >= 0.5 THEN 'major' WHEN sum((c - b) * ln(c / b)) >= 0.25 THEN 'significant'
      WHEN sum((c - b) * ln(c / b)) >= 0.1 THEN 'minor' ELSE 'none' END AS level,
    max(total) AS baseline_n, max(m)::BIGINT AS current_n FROM w GROUP BY feature""",
)
def drift_check(spark, sf):
    old, new = _halves(spark, sf)
    rows = drift.drift(drift.baseline(old), new).drop("dropped_n")
    return rows.withColumns({"psi": F.round("psi", 6), "kl": F.round("kl", 6)})


@query(
    "d13_shifted_drift",
    _CTES.replace("SELECT event_type AS feature, value FROM events WHERE ts >=", "SELECT event_type AS feature, value * 2.5 - 20 AS value FROM events WHERE ts >=")
    + """ SELECT feature, round(sum((c - b) * ln(c / b)), 6) AS psi, CASE WHEN sum((c - b) * ln(c / b)) >= 0.5 THEN 'major'
      WHEN sum((c - b) * ln(c / b)) >= 0.25 THEN 'significant' WHEN sum((c - b) * ln(c / b)) >= 0.1 THEN 'minor' ELSE 'none' END AS level,
    max(m)::BIGINT AS current_n, any_value(d) AS dropped_n FROM w JOIN (SELECT feature, count(*) FILTER (bin IS NULL) AS d FROM placed GROUP BY feature) USING (feature)
    GROUP BY feature""",
)
def shifted_drift(spark, sf):
    old, new = _halves(spark, sf)
    rows = drift.drift(drift.baseline(old), new.withColumn("value", F.col("value") * 2.5 - 20))
    return rows.select("feature", F.round("psi", 6).alias("psi"), "level", "current_n", "dropped_n")


@query("c4_bin_counts", _CTES + " SELECT feature, coalesce(bin, -1) AS bin, count(*) AS n FROM placed GROUP BY ALL")
def bin_counts(spark, sf):
    old, new = _halves(spark, sf)
    return drift.bin_counts(drift.binned(new, drift.baseline(old)))


@query("c5_value_bins", _CTES + " SELECT feature, value, bin, count(*) AS n FROM placed GROUP BY ALL")
def value_bins(spark, sf):
    old, new = _halves(spark, sf)
    placed = drift.binned(new, drift.baseline(old))
    return placed.groupBy("feature", "value", "bin").agg(F.count(F.lit(1)).alias("n"))


def _daily(spark, sf):
    """Drift of each later day against the first half."""
    old, new = _halves(spark, sf)
    base = drift.baseline(old)
    dated = drift.binned(new, base).withColumn("ts", F.to_date("ts"))
    return drift.check(base, drift.bin_counts(dated, ("ts",)), ("ts",))


_DAILY = (
    _CTES.split("placed AS")[0].replace("SELECT event_type AS feature, value FROM events WHERE ts >=", "SELECT event_type AS feature, value, ts::DATE AS ts FROM events WHERE ts >=")
    + """placed AS (SELECT feature, ts, value, CASE WHEN inside >= 0 THEN inside WHEN trunc(value * 10) BETWEEN 0 AND 9 THEN trunc(value * 10)::INT END AS bin
    FROM (SELECT feature, ts, value, len(list_filter(lowers, lambda x: value >= x))::INT - 1 AS inside
      FROM new JOIN (SELECT feature, list(lower) AS lowers FROM bins GROUP BY feature) USING (feature))),
  now AS (SELECT feature, ts, bin, count(*) AS c FROM placed WHERE bin IS NOT NULL GROUP BY ALL),
  sums AS (SELECT feature, ts, sum(c) AS m FROM now GROUP BY ALL),
  w AS (SELECT feature, ts, bin, total, m, greatest(k / total, 0.0001) AS b, greatest(coalesce(c, 0) / m, 0.0001) AS c
    FROM bins JOIN sums USING (feature) LEFT JOIN now USING (feature, ts, bin)),
  days AS (SELECT feature, ts, round(sum((c - b) * ln(c / b)), 6) AS psi, round(sum(c * ln(c / b)), 6) AS kl, max(m)::BIGINT AS current_n FROM w GROUP BY feature, ts)"""
)


@query("f3_last_checks", _DAILY + " SELECT * FROM days ORDER BY ts DESC, feature LIMIT 12")
def last_checks(spark, sf):
    rows = drift.last_checks(_daily(spark, sf), 12)
    return rows.select("feature", "ts", F.round("psi", 6).alias("psi"), F.round("kl", 6).alias("kl"), "current_n")


@query("e4_check_history", _DAILY + " SELECT * FROM days ORDER BY ts DESC, feature LIMIT 1000")
def check_history(spark, sf):
    rows = drift.last_checks(_daily(spark, sf))
    return rows.select("feature", "ts", F.round("psi", 6).alias("psi"), F.round("kl", 6).alias("kl"), "current_n")


# ------------------------------------------------------------------------ usage
_WINDOW = 6 * 3600


def _requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))


@query(
    "e1_trailing_usage",
    f"""SELECT event_id, user_id, floor(value)::BIGINT AS tokens, sum(floor(value)::BIGINT) OVER w AS used_tokens, count(*) OVER w AS used_requests
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {_WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW)""",
)
def trailing_usage(spark, sf):
    return usage.trailing_usage(_requests(spark, sf), "user_id", "ts", "tokens", _WINDOW).drop("ts")


def _limiter_sql(limits: usage.Limits) -> str:
    span = limits.window_seconds * 1_000_000
    return f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS us, floor(value)::BIGINT AS tokens,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS reason, []::STRUCT(us BIGINT, tokens BIGINT)[] AS win FROM ev
      UNION ALL SELECT user_id, k, event_id, reason, CASE WHEN reason = '' THEN win || [{{'us': us, 'tokens': tokens}}] ELSE win END FROM (
        SELECT *, CASE WHEN coalesce(list_sum(list_transform(win, lambda x: x.tokens)), 0) + tokens > {limits.tokens_per_window} THEN 'Token rate limit exceeded'
          WHEN len(win) + 1 > {limits.requests_per_window} THEN 'Request rate limit exceeded'
          WHEN tokens > {limits.max_tokens} THEN 'Response too large' ELSE '' END AS reason
        FROM (SELECT e.user_id, e.k, e.event_id, e.us, e.tokens, list_filter(w.win, lambda x: x.us > e.us - {span}) AS win
          FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.k = w.k + 1)))
    SELECT event_id, user_id, reason = '' AS allowed, reason FROM walk WHERE k > 0"""


_TIGHT = usage.Limits(max_tokens=120, tokens_per_window=150, requests_per_window=2, window_seconds=_WINDOW)
_LONG = usage.Limits(max_tokens=150, tokens_per_window=400, requests_per_window=5, window_seconds=4 * 24 * 3600)


@query("e2_limiter_audit", _limiter_sql(_TIGHT))
def limiter_audit(spark, sf):
    decided = usage.limit(_requests(spark, sf), "user_id", "ts", "event_id", "tokens", _TIGHT)
    return decided.select("event_id", "user_id", "allowed", "reason")


@query("e2_saturated_limiter", _limiter_sql(_LONG))
def saturated_limiter(spark, sf):
    decided = usage.limit(_requests(spark, sf), "user_id", "ts", "event_id", "tokens", _LONG)
    return decided.select("event_id", "user_id", "allowed", "reason")


@query("e2_default_limits", _limiter_sql(usage.Limits()))
def default_limits(spark, sf):
    decided = usage.limit(_requests(spark, sf), "user_id", "ts", "event_id", "tokens")
    return decided.select("event_id", "user_id", "allowed", "reason")
