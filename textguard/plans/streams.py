"""Streams replayed over the given tables; each equals its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators import drift, evaluate, policy, scan, threat
from textguard.plans import monitoring, scoring, sql, verdicts
from textguard.plans.registry import ORACLES, query
from textguard.sources.tables import stream, table, traffic_stream
from textguard.streaming import drift as stream_drift
from textguard.streaming import limiter, live, sinks

TALK = ["conv_id", "turn"]


@query(
    "i1_live_findings",
    sql.with_traffic(
        'SELECT conv_id, turn, direction, rule, pack, severity, 1.0::DOUBLE AS confidence, value, start, "end" FROM hits',
        hits=sql.rule_hits(source="traffic", keys="conv_id, turn, direction"),
    ),
)
def live_findings(spark, sf):
    return sinks.appended(spark, live.live_findings(traffic_stream(spark, sf), [*TALK, "direction"]))


@query(
    "a2_live_bodies",
    sql.with_traffic(
        "SELECT conv_id, turn, direction, host, path, total AS total_detections, NOT allowed AS blocked "
        f"FROM traffic JOIN verdict USING (conv_id, turn) JOIN ({verdicts._TRAFFIC_LISTS}) USING (conv_id, turn)",
        **verdicts._TRAFFIC,
    ),
)
def live_bodies(spark, sf):
    from textguard.operators import audit

    rows = audit.audit_rows(live.live_decisions(traffic_stream(spark, sf)), TALK)
    return sinks.appended(spark, rows).select(*TALK, "direction", "host", "path", "total_detections", "blocked")


_STREAM_LIMITS = monitoring._TIGHT


@query(
    "i2_stream_limiter",
    f"SELECT user_id::VARCHAR AS client, event_id AS seq, allowed, reason FROM ({monitoring._limiter_sql(_STREAM_LIMITS)})",
)
def stream_limiter(spark, sf):
    events = stream(spark, sf, "events").withColumn("tokens", F.floor("value"))
    last = table(spark, sf, "events").agg(F.max("ts").alias("ts"))
    return limiter.decisions(events, last, "user_id", "ts", "event_id", "tokens", _STREAM_LIMITS)


@query(
    "i3_minute_counts",
    sql.with_traffic(
        "SELECT date_trunc('minute', ts) AS start, direction, host, count(*) AS intercepted, count(total) AS detections, count(reason) AS blocked, "
        "0::BIGINT AS scored_nonzero, coalesce(sum(total), 0)::BIGINT AS findings FROM traffic "
        f"LEFT JOIN ({verdicts._TRAFFIC_LISTS}) USING (conv_id, turn) LEFT JOIN ({verdicts._TRAFFIC_BLOCK}) USING (conv_id, turn) GROUP BY ALL",
        **verdicts._TRAFFIC,
    ),
)
def minute_counts(spark, sf):
    counts = live.minute_counts(live.live_decisions(traffic_stream(spark, sf)), delay="30 days")
    rows = sinks.latest(spark, counts, ["start", "direction", "host"])
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "i4_running_confusion",
    ORACLES["d15_confusion"].replace("SELECT tp, tn", "SELECT 'heuristic' AS model_version, tp, tn"),
)
def running_confusion(spark, sf):
    docs = threat.with_set_score(stream(spark, sf, "documents").select("doc_id", "text"))
    scored = docs.select("doc_id", F.col("set_score.score").alias("score"), F.lit("heuristic").alias("model_version"))
    judged = scored.withColumn("is_threat", F.col("score") >= 0.3)
    paired = evaluate.paired(judged, table(spark, sf, "labels"), "doc_id", "toxic")
    counts = sinks.latest(spark, live.running_confusion(paired), ["model_version"])
    return evaluate.with_rates(counts).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# A label comes this many hours after its prediction; those past the limit count as none.
_LAG = "(doc_id * 37) % 100"


@query(
    "i4_late_labels",
    f"""SELECT 'heuristic' AS model_version, count(*) FILTER (is_threat AND actual) AS tp, count(*) FILTER (NOT is_threat AND NOT actual) AS tn,
      count(*) FILTER (is_threat AND NOT actual) AS fp, count(*) FILTER (NOT is_threat AND actual) AS fn, count(*) FILTER (actual IS NULL) AS unlabelled
    FROM (SELECT score >= 0.3 AS is_threat, CASE WHEN {_LAG} <= 72 THEN toxic = 1 END AS actual FROM ({scoring._DOC_SCORES}) LEFT JOIN labels USING (doc_id))""",
)
def late_labels(spark, sf):
    sent = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    docs = threat.with_set_score(stream(spark, sf, "documents").select("doc_id", "text"))
    predictions = docs.select(
        "doc_id", sent.alias("ts"), (F.col("set_score.score") >= 0.3).alias("is_threat"), F.lit("heuristic").alias("model_version")
    )
    lag = F.make_interval(hours=F.expr(f"CAST({_LAG} AS INT)"))
    labels = stream(spark, sf, "labels").select("doc_id", (sent + lag).alias("ts"), "toxic")
    return late_label_counts(spark, predictions, labels)


def late_label_counts(spark, predictions, labels, delay="3650 days"):
    """Counts of a replay that is run to its end, in whatever order its rows come within ``delay``."""
    # Rows that move both watermarks far on; they find no partner and wait for ever. They hold no
    # null: an empty micro-batch takes a column for non-null where the stream's own rows say so.
    close = lambda rows, day: spark.range(1).select(
        *[{"doc_id": F.lit(-1), "ts": F.lit(day).cast("timestamp")}.get(c, F.lit("0")).cast(t).alias(c) for c, t in rows.dtypes]
    )
    path = sinks.drain_closed(
        spark, lambda p, t: live.with_late_labels(p, t, "doc_id", delay=delay),
        (predictions, close(predictions, "2100-01-01")), (labels, close(labels, "2100-02-01")),
        handle=lambda folder: live.batch_counts(folder, ["model_version"]),
    )
    return live.total_counts(spark.read.parquet(path), ["model_version"])


@query("i5_daily_drift", monitoring._DAILY.replace("days AS (SELECT feature, ts,", "days AS (SELECT feature, ts::TIMESTAMP AS start,") + " SELECT * FROM days")
def daily_drift(spark, sf):
    old, _ = monitoring._halves(spark, sf)
    # A written table, which every micro-batch reads.
    base = drift.baseline(old)
    rows = stream(spark, sf, "events").select(F.col("event_type").alias("feature"), "value", "ts")
    new = rows.where(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    counts = sinks.latest(spark, stream_drift.windowed_bins(new, base, "1 day", "60 days"), stream_drift.KEYS)
    checked = stream_drift.checks(base, counts)
    return checked.select(
        "feature", F.col("start").cast("timestamp_ntz").alias("start"), F.round("psi", 6).alias("psi"),
        F.round("kl", 6).alias("kl"), "current_n",
    )


def _routed(spark, sf, name):
    decided = live.live_decisions(traffic_stream(spark, sf), policy.Policy(direction="response"))
    return spark.read.parquet(f"{sinks.drain(spark, decided, handle=live.route)}/{name}")


@query(
    "i6_blocked_traffic",
    sql.with_traffic(
        f"SELECT conv_id, turn, direction, host, path, reason FROM traffic JOIN ({verdicts._TRAFFIC_BLOCK}) USING (conv_id, turn) WHERE direction = 'response'",
        **verdicts._TRAFFIC,
    ),
)
def blocked_traffic(spark, sf):
    return _routed(spark, sf, "blocked").select(*TALK, "direction", "host", "path", "reason")


@query(
    "i6_allowed_traffic",
    sql.with_traffic(
        f"SELECT conv_id, turn, direction, md5(text) AS body FROM traffic LEFT JOIN ({verdicts._TRAFFIC_BLOCK}) USING (conv_id, turn) "
        "WHERE reason IS NULL OR direction <> 'response'",
        **verdicts._TRAFFIC,
    ),
)
def allowed_traffic(spark, sf):
    return _routed(spark, sf, "allowed").select(*TALK, "direction", F.md5("text").alias("body"))


@query("i7_first_deliveries", "SELECT DISTINCT left(sha256(text), 32) AS input_hash FROM conversations")
def first_deliveries(spark, sf):
    return sinks.appended(spark, live.first_deliveries(traffic_stream(spark, sf), "365 days")).select("input_hash")


@query(
    "i7_earlier_results",
    sql.with_traffic(
        "SELECT conv_id, turn, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) > 1 AS repeated, coalesce(n, 0) AS n_findings "
        "FROM traffic LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM hits GROUP BY ALL) USING (conv_id, turn)",
        hits=sql.rule_hits(source="traffic", keys="conv_id, turn, direction"),
    ),
)
def earlier_results(spark, sf):
    # One micro-batch, so that SQL knows which delivery is the first.
    talk = stream(spark, sf, "conversations", files=1_000_000).withColumn("delivery", F.struct("conv_id", "turn"))
    handle = lambda path: live.with_earlier_results(path, "delivery", lambda texts: scan.findings(texts, ["text_id"]), "1")
    rows = spark.read.parquet(f"{sinks.drain(spark, talk, handle=handle)}/results")
    return rows.select("delivery.*", "repeated", F.size("results").cast("long").alias("n_findings"))
