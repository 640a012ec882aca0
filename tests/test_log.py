"""The log of committed batches: replays, failures, rotation, streams."""

import os

import pytest
from pyspark.sql import functions as F

from textguard.operators import cache
from textguard.sources import log


def _rows(spark, path, schema):
    return sorted(tuple(r) for r in log.read(spark, path, schema).collect())


def test_a_batch_written_again_is_there_once(spark, tmp_path):
    path, df = str(tmp_path), spark.range(1000).repartition(3).withColumn("names", F.array(F.lit("a"), F.lit(None)))
    log.append(df, path, batch="first")
    log.append(df.limit(0), path, batch="none")
    log.append(df, path, batch="first")
    log.append(df.selectExpr("id + 1000 AS id", "names"), path, batch="second")
    assert [r[0] for r in _rows(spark, path, df.schema)] == list(range(2000))


def test_a_failed_task_leaves_no_row(spark, tmp_path):
    path = str(tmp_path)
    log.append(spark.range(10), path)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 500, F.raise_error("no").cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        log.append(bad, path, batch="b")
    assert len(_rows(spark, path, bad.schema)) == 10
    log.append(spark.range(10, 1000), path, batch="b")
    assert _rows(spark, path, bad.schema) == [(i,) for i in range(1000)]


def test_files_are_closed_at_their_size(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        log.append(spark.range(1000).coalesce(1), str(tmp_path), file_bytes=2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 4 <= len(os.listdir(tmp_path / "data")) <= 5
    assert len(_rows(spark, str(tmp_path), spark.range(1).schema)) == 1000


def test_a_replayed_micro_batch_is_there_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = spark.range(1).schema
    for i in range(3):
        spark.range(i * 100, i * 100 + 100).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    log.append_stream(rows, path, checkpoint).awaitTermination()
    assert _rows(spark, path, schema) == [(i,) for i in range(300)]
    # As if the driver had died after the last batch was written, before it was noted.
    commits = tmp_path / "check" / "commits"
    for name in ("2", ".2.crc"):
        os.replace(commits / name, tmp_path / f"lost{name}")
    log.append_stream(rows, path, checkpoint).awaitTermination()
    assert _rows(spark, path, schema) == [(i,) for i in range(300)]
    assert len(os.listdir(tmp_path / "out" / "data")) == 4


def _lengths(texts):
    """A job with a row for each word."""
    return texts.select("text_id", F.explode(F.split("text", " ")).alias("word")).where("word != ''")


def test_results_are_kept_over_runs(spark, tmp_path):
    path = str(tmp_path / "known")
    rows = [(i, t) for i, t in enumerate(["a b", "c", "a b", "", None, "a b"])]
    df = spark.createDataFrame(rows, "id int, text string")
    run = lambda df, version, batch: {
        r.id: (r.repeated, [x.word for x in r.results]) for r in cache.with_results(df, "id", _lengths, path, version, batch).collect()
    }
    scanned = lambda: {r.batch: r.n for r in log.batches(spark, path).groupBy("batch").agg(F.sum("rows").alias("n")).collect()}
    want = {0: (False, ["a", "b"]), 1: (False, ["c"]), 2: (True, ["a", "b"]), 3: (False, []), 4: (True, []), 5: (True, ["a", "b"])}
    assert run(df, "1", 0) == want and scanned() == {"0": 3}
    # The same batch again knows nothing of itself.
    assert run(df, "1", 0) == want and scanned() == {"0": 3}
    # A second run scans nothing, a new text is scanned alone, another version starts anew.
    assert all(r[0] for r in run(df, "1", 1).values()) and scanned() == {"0": 3}
    more = df.union(spark.createDataFrame([(9, "new")], df.schema))
    assert run(more, "1", 2)[9] == (False, ["new"]) and scanned() == {"0": 3, "2": 1}
    assert run(df, "2", 3) == want and scanned() == {"0": 3, "2": 1, "3": 3}
