"""What the plans must and must not contain, whatever the data."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from checks.tables import history
from lectern.functions.text import recursive_chunk
from lectern.operators import bm25, conversation, ranking
from lectern.operators.vector_search import vector_top_k

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 5)


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_no_query_forms_all_pairs(spark, name):
    shown = plan(registered.queries()[name](spark, SF))
    assert "CartesianProduct" not in shown and "NestedLoopJoin" not in shown


def test_searches_read_the_corpus_in_place(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    shown = plan(vector_top_k(items.withColumnRenamed("chunk_id", "query_id"), items, 3))
    scan = shown[shown.index("MapInArrow"):]
    assert "Exchange" not in scan and "Join" not in shown
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in shown

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.createDataFrame([(1, "the of")], "query_id long, text string")
    shown = plan(bm25.bm25_top_k(asked, bm25.bm25_index(docs, "doc_id", "text").stored(), 3))
    scan = shown[shown.index("MapInArrow"):]
    assert "Exchange" not in scan and "Join" not in shown
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown


def test_top_k_is_cut_before_the_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "n_chars")
    shown = plan(ranking.top_k(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3))
    assert shown.index("Final") < shown.index("Exchange") < shown.index("Partial")


def test_time_and_role_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "history")
    history(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    shown = plan(conversation.question_reply_pairs(stored, AS_OF, 7, ["x"]), "formatted")
    assert shown.count("GreaterThan(created_at,2023-12-29") == 2
    assert "EqualTo(role,user)" in shown and "EqualTo(role,assistant)" in shown
    assert "_bucket" in shown


def test_native_operators_use_no_python(spark):
    names = ("recursive_chunk_300", "explode_chunks", "build_silver", "confusion_heatmap", "parse_quiz",
             "split_sentences", "detect_language", "token_segments", "bm25_terms")
    for name in names:
        shown = plan(registered.queries()[name](spark, SF))
        assert "Python" not in shown and "InArrow" not in shown and "InPandas" not in shown, name


def test_one_wide_text_takes_one_pass(spark):
    """A text is split once per separator that it needs, not once per chunk."""
    body = "sentence number one. " * 20000
    df = spark.createDataFrame([(body,)], "t string")
    assert df.select(F.size(recursive_chunk(F.col("t"), 300))).first()[0] > 1000
