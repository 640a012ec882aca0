"""Python workers outlive a stage: a task asks for one of them, and they hold what its function needs."""

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from textguard.llm import pieces, queries, store

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_token_ids_take_one_worker_a_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert _steps(corpus_pipeline.token_ids(spark, docs, sf)) == 1
    assert _steps(queries.op1_sentencepiece(spark, sf)) == 1


def test_round_trip_is_encode_and_decode(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", "two words", "a\nb  c ", "▁é벨𝒳\x00", "long " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.withColumns({"ids": F.lit("old"), "decoded": F.lit("old"), "other": F.col("doc_id") + 1})
    got = pieces.round_trip(docs, MODEL)
    two = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    rows = {r["doc_id"]: r.asDict() for r in got.collect()}
    assert rows == {r["doc_id"]: r.asDict() for r in two.collect()} and got.dtypes[-2:] == two.dtypes[-2:]
    for i, text in enumerate(texts):
        assert rows[i]["ids"] == library.encode(text or "") and rows[i]["decoded"] == library.decode(rows[i]["ids"])
        assert rows[i]["other"] == i + 1 and rows[i]["text"] == text


@pytest.mark.parametrize("module, left", [("textguard.llm.pieces", 1), ("textguard.llm.neardup", 0)])
def test_tables_go_when_a_worker_runs_another_module(monkeypatch, module, left):
    monkeypatch.setattr(store, "_TABLES", [])
    monkeypatch.setattr(store, "_LAST", ["textguard.llm.pieces"])
    table = pieces.Kept(len)
    assert table["abc"] == 3
    run = lambda batches: batches
    run.__module__ = module
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(store._lean(run, iter([batch]))) == [batch]
    assert len(table) == left and table["abc"] == 3
