"""Streams over several micro-batches against the same job on the whole table."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textguard.operators import usage
from textguard.plans import streams
from textguard.sources.tables import as_traffic, stream, table
from textguard.streaming import limiter, live, sinks

PARTS = 4
LIMITS = usage.Limits(max_tokens=120, tokens_per_window=150, requests_per_window=2, window_seconds=86_400)


@pytest.fixture(scope="module")
def parts(sf, tmp_path_factory):
    """Events by time and conversations by number, as folders of several files."""
    folder = tmp_path_factory.mktemp("parts")
    for name, order in (("events", "ts, event_id"), ("conversations", "conv_id, turn")):
        os.mkdir(folder / f"{name}.parquet")
        for i in range(PARTS):
            path = folder / f"{name}.parquet" / f"part-{i}.parquet"
            duckdb.sql(
                f"COPY (SELECT * EXCLUDE part FROM (SELECT *, ntile({PARTS}) OVER (ORDER BY {order}) AS part "
                f"FROM '{sf}/{name}.parquet') WHERE part = {i + 1} ORDER BY hash({order.split(', ')[1]})) TO '{path}' (FORMAT parquet)"
            )
            # The source takes files by age.
            os.utime(path, (1_700_000_000 + i * 10,) * 2)
    return str(folder)


def _batches(folder):
    return len([d for d in os.listdir(folder.removeprefix("file:")) if d.startswith("batch=")])


def _files(spark, rows, folder, parts):
    """Event files that a stream takes one after the other, ``parts`` being the rows of each."""
    os.makedirs(folder / "events.parquet")
    for i, part in enumerate(parts):
        path = folder / "events.parquet" / f"part-{i}.parquet"
        rows.where(F.col("event_id").isin(part)).toPandas().to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i * 10,) * 2)
    return str(folder)


def _limited(spark, folder, delay):
    rows = stream(spark, folder, "events", files=1).withColumn("tokens", F.floor("value"))
    last = table(spark, folder, "events").agg(F.max("ts").alias("ts"))
    got = limiter.decisions(rows, last, "user_id", "ts", "event_id", "tokens", LIMITS, delay)
    return {(r.seq, r.allowed, r.reason) for r in got.collect()}


def test_limiter_decides_in_event_order_over_batches(spark, sf, tmp_path):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    ids = [r.event_id for r in events.orderBy(F.hash("event_id")).collect()]
    # Three batches in no order: with a delay as long as the table nothing is late.
    folder = _files(spark, events, tmp_path, [ids[k::3] for k in range(3)])
    whole = events.withColumns({"tokens": F.floor("value"), "ts": F.col("ts").cast("timestamp")})
    want = {(r.event_id, r.allowed, r.reason) for r in usage.limit(whole, "user_id", "ts", "event_id", "tokens", LIMITS).collect()}
    assert _limited(spark, folder, "3650 days") == want
    assert len(want) == len(ids) and any(not w[1] for w in want)


def test_late_requests_are_put_out_as_such(spark, sf, tmp_path):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    by_time = [r.event_id for r in events.orderBy("ts", "event_id").collect()]
    n = len(by_time)
    late = by_time[: n // 10]
    folder = _files(spark, events, tmp_path, [by_time[n // 10 : n // 2], by_time[n // 2 :], late])
    whole = events.where(~F.col("event_id").isin(late)).withColumns({"tokens": F.floor("value"), "ts": F.col("ts").cast("timestamp")})
    want = {(r.event_id, r.allowed, r.reason) for r in usage.limit(whole, "user_id", "ts", "event_id", "tokens", LIMITS).collect()}
    assert _limited(spark, folder, "1 minute") == want | {(i, False, limiter.LATE) for i in late}


def test_counters_add_up_over_batches(spark, parts):
    # Windows of many conversations, so that batches meet in one.
    counted = lambda df: live.minute_counts(live.live_decisions(as_traffic(df)), "10 days", "30 days")
    keys = ["start", "direction", "host"]
    got = sinks.latest(spark, counted(stream(spark, parts, "conversations", files=1)), keys)
    want = counted(table(spark, parts, "conversations"))
    columns = [*keys, "intercepted", "detections", "blocked", "findings"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_repeats_are_found_across_batches(spark, parts):
    talk = stream(spark, parts, "conversations", files=1)
    twice = live.first_deliveries(as_traffic(talk.withColumn("text", F.concat(F.lit("turn "), F.col("turn")))), "365 days")
    turns = table(spark, parts, "conversations").select("turn").distinct().count()
    folder = sinks.drain(spark, twice)
    assert _batches(folder) >= PARTS
    assert spark.read.option("recursiveFileLookup", "true").schema(twice.schema).parquet(folder).count() == turns


def test_repeats_carry_the_first_result_across_batches(spark, parts):
    from textguard.operators import scan

    talk = stream(spark, parts, "conversations", files=1).withColumn("delivery", F.struct("conv_id", "turn"))
    talk = talk.withColumn("text", F.concat(F.lit("mail joe@example.com turn "), F.col("turn")))
    handle = lambda path: live.with_earlier_results(path, "delivery", lambda t: scan.findings(t, ["text_id"]), "1")
    folder = sinks.drain(spark, talk, handle=handle)
    rows = spark.read.parquet(f"{folder}/results").select("delivery.*", "repeated", F.size("results").alias("n")).collect()
    turns = {r.turn for r in rows}
    assert len(rows) == table(spark, parts, "conversations").count()
    assert sum(not r.repeated for r in rows) == len(turns)
    assert len({(r.turn, r.n) for r in rows}) == len(turns) and min(r.n for r in rows) > 0


def test_labels_that_come_later(spark, tmp_path):
    """Three micro-batches in no order, labels before or after their predictions in the stream."""
    hours = lambda h: F.timestamp_seconds(F.lit(1_704_067_200) + F.lit(3600) * h)
    ids = spark.range(90).withColumnRenamed("id", "doc_id")
    sent = ids.select("doc_id", hours(F.col("doc_id")).alias("ts"), (F.col("doc_id") % 3 == 0).alias("is_threat"), F.lit("m").alias("model_version"))
    # Every fifth has no label, one comes too early, and those with a lag past 72 hours are too late.
    lag = F.when(F.col("doc_id") == 7, -1).otherwise(F.col("doc_id") % 80)
    truth = ids.where("doc_id % 5 <> 0").select("doc_id", hours(F.col("doc_id") + lag).alias("ts"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for name, rows, turn in (("sent", sent, 0), ("truth", truth, 1)):
        for i in range(3):
            path = tmp_path / f"{name}.parquet" / f"part-{i}.parquet"
            os.makedirs(path.parent, exist_ok=True)
            rows.where(F.abs(F.hash("doc_id")) % 3 == (i + turn) % 3).toPandas().to_parquet(path, coerce_timestamps="us")
            os.utime(path, (1_700_000_000 + i * 10,) * 2)
    read = lambda name, like: stream(spark, str(tmp_path), name, files=1).select(
        *[F.col(c).cast(t).alias(c) for c, t in like.dtypes]
    )
    counts = streams.late_label_counts(spark, read("sent", sent), read("truth", truth)).first()
    want = {"tp": 0, "tn": 0, "fp": 0, "fn": 0, "unlabelled": 0}
    for i in range(90):
        threat, toxic = i % 3 == 0, i % 2 == 1
        known = i % 5 != 0 and i != 7 and i % 80 <= 72
        want["unlabelled" if not known else ("t" if threat == toxic else "f") + ("p" if threat else "n")] += 1
    assert {k: counts[k] for k in want} == want and want["unlabelled"] > 18


def test_repeated_batch_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("m", True, True), ("m", False, None)], "model_version string, is_threat boolean, actual boolean")
    write = live.batch_counts(str(tmp_path), ["model_version"])
    for batch in (0, 1, 0):
        write(rows, batch)
    total = live.total_counts(spark.read.parquet(str(tmp_path)), ["model_version"]).first()
    assert (total.tp, total.unlabelled) == (2, 2)
