"""The given tables in the shapes the operators take, once in Spark and once in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.logs import retrieval_rows

AS_OF = dt.datetime(2024, 1, 5)
AS_OF_SQL = "TIMESTAMP '2024-01-05 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_ts(column: str) -> F.Column:
    """A time as text, so that it compares equal in any engine and zone setting."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# ---- conversations -----------------------------------------------------------------------

# Every fifth answer or so is a refusal, since the invented texts hold no such phrase.
HISTORY_SQL = """
SELECT conv_id * 100 + turn AS id,
       CAST(conv_id AS VARCHAR) AS session_id,
       role,
       CASE WHEN role = 'assistant' AND (conv_id * 7 + turn) % 5 = 0 THEN 'Sorry, this is NOT COVERED yet.'
            WHEN role = 'assistant' AND (conv_id * 7 + turn) % 5 = 1 THEN 'Ce point n''est pas abordé ici.'
            ELSE text END AS content,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (conv_id * 3600 + turn * 30) AS created_at
FROM conversations WHERE role IN ('user', 'assistant')
"""


def as_history(conversations: DataFrame) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    pick = (conv * 7 + turn) % 5
    reply = F.col("role") == "assistant"
    return conversations.filter(F.col("role").isin("user", "assistant")).select(
        (conv * 100 + turn).alias("id"),
        conv.cast("string").alias("session_id"),
        "role",
        F.when(reply & (pick == 0), "Sorry, this is NOT COVERED yet.")
        .when(reply & (pick == 1), "Ce point n'est pas abordé ici.")
        .otherwise(F.col("text"))
        .alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 30).alias("created_at"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_history(table(spark, sf_dir, "conversations"))


# A question is answered from five documents spread over the whole table.
LOG_SQL = """
SELECT h.session_id,
       substring(h.content, 1, 500) AS query,
       CAST(d.doc_id AS VARCHAR) AS chunk_id,
       substring(d.text, 1, 300) AS chunk_text,
       concat('doc_', CAST(d.doc_id AS VARCHAR), '.pdf') AS filename,
       d.source AS subject,
       d.lang AS chapter,
       CAST(100 - k.k * 15 AS DOUBLE) / 100 AS score,
       h.created_at AS retrieved_at
FROM history h
CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) k
JOIN documents d ON d.doc_id = (h.id * 31 + k.k * 13) % (SELECT count(*) FROM documents)
WHERE h.role = 'user'
"""


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question and source: id, session_id, query, retrieved_at, source."""
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.count()
    asked = history(spark, sf_dir).filter(F.col("role") == "user")
    steps = F.array(*[F.lit(13 * k) for k in range(5)])
    hits = asked.select("*", F.posexplode(steps).alias("k", "step")).withColumn(
        "doc_id", F.pmod(F.col("id") * 31 + F.col("step"), F.lit(n_docs))
    )
    source = F.struct(
        "k",
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("text").alias("chunk_text"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("source").alias("subject"),
        F.col("lang").alias("chapter"),
        ((100 - F.col("k") * 15).cast("double") / 100).alias("score"),
    )
    return hits.join(docs, "doc_id").select(
        "id", "session_id", F.col("content").alias("query"), F.col("created_at").alias("retrieved_at"),
        source.alias("source"),
    )


def retrieval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all requests, each noted source by source."""
    return retrieval_rows(retrieved(spark, sf_dir).withColumn("sources", F.array("source")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question with the array of its five sources."""
    return (
        retrieved(spark, sf_dir)
        .groupBy("id", "session_id", "query", "retrieved_at")
        .agg(F.array_sort(F.collect_list("source")).alias("sources"))
    )


FALLBACK_SQL = """(a.content ILIKE '%not covered%' OR a.content ILIKE '%haven%t covered%'
 OR a.content ILIKE '%not in the context%' OR a.content ILIKE '%pas abordé%'
 OR a.content ILIKE '%pas couvert%' OR a.content ILIKE '%je ne sais pas%')"""
HEADER_FALLBACK_SQL = """(a.content ILIKE '%not covered%' OR a.content ILIKE '%haven%t covered%'
 OR a.content ILIKE '%pas abordé%' OR a.content ILIKE '%pas couvert%')"""

PAIRS_FROM_SQL = """FROM history u JOIN history a
  ON a.session_id = u.session_id AND a.role = 'assistant'
 AND a.created_at > u.created_at AND a.created_at < u.created_at + INTERVAL 2 MINUTE"""


# Read more than once by later parts, so they are computed once.
MATERIALIZED = ("tf", "df", "raw_idf", "mean_idf", "sizes")


def with_ctes(body: str, **ctes: str) -> str:
    named = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({text})" for name, text in ctes.items())
    body = body.lstrip()
    return f"WITH {named}{body}" if body.startswith(",") else f"WITH {named}\n{body}"


def conversation_sql(body: str) -> str:
    return with_ctes(body, history=HISTORY_SQL, log=LOG_SQL)


# ---- documents as files ------------------------------------------------------------------

# Every eleventh document has a name that says nothing about its subject.
FILES_SQL = """
SELECT doc_id, text AS raw_text, lang, source,
       CASE WHEN doc_id % 11 = 0 THEN 'notes.pdf'
            ELSE concat(source, '_', lang, '_Ch', doc_id % 10,
                        CASE WHEN doc_id % 3 = 0 THEN '.PPTX' ELSE '.pdf' END) END AS filename
FROM documents
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    name = F.concat(
        "source", F.lit("_"), "lang", F.lit("_Ch"), (doc % 10).cast("string"),
        F.when(doc % 3 == 0, ".PPTX").otherwise(".pdf"),
    )
    return documents(spark, sf_dir).select(
        "doc_id",
        F.when(doc % 11 == 0, "notes.pdf").otherwise(name).alias("filename"),
        F.concat(F.lit("landing/"), doc.cast("string")).alias("path"),
        F.col("text").alias("raw_text"),
        F.lit(None).cast("string").alias("error"),
    )
