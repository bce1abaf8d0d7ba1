"""From raw documents to encoded training texts in five stages, each over all that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. `run` writes the result of each as
Parquet into the shared folder and reads it again, so that a lost executor costs a part of one
stage only. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language_id, line_dedup
from lectern.llm.jaccard_join import distinct_rows
from lectern.llm.queries import PIECES, encoded_digests
from lectern.llm.textblocks import unused
from lectern.session import shared_folder

#: No SQL: languages, edit distances and encodings are beyond it; the tests hold brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go."""
    names = (unused(docs.columns, "lang_pred"), unused(docs.columns, "score"))
    found = language_id.identify(docs, PIECES, docs, names=names)
    return found.filter(F.col(names[0]) != language_id.UNSURE).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of runs of lines of 50 words or more; a document of which nothing is left goes."""
    names = (unused(docs.columns, "n_lines"), unused(docs.columns, "n_deleted"))
    done = line_dedup.dedup_lines(docs, 50, names).filter((F.col(names[1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(names[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed)
    return done.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows that share an id are told apart by text.

    Documents without words are near copies of nothing and stay, as do rows with a null id.
    """
    return distinct_rows(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark; items that are null or have no word are in none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document with an id."""
    return encoded_digests(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("bpe_encode_decode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
