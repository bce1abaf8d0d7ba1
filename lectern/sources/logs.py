"""The two conversation tables: appending turns and retrievals, and clearing sessions."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lectern.config import DEFAULTS, Settings
from lectern.operators.conversation import clear_history, cleared_rows
from lectern.schemas import CHAT_HISTORY, RETRIEVAL_LOG, conform
from lectern.sources.deletions import compact_deletions, delete_rows, live_rows, vacuum

# The roles a stored turn may have.
ROLES = ("user", "assistant")


def _store(df: DataFrame, ts: str, path: str, batch: int | None) -> None:
    """One directory per day, so that time windows read few of them, and sorted by session.

    Every write has a directory of its own, so batch jobs and streams share a table. A micro-batch
    goes by its number and replaces it when it has to run again; other writes go by their time.
    """
    _store_in(df, ts, f"{path}/batch={time.time_ns() if batch is None else batch}")


def _store_in(df: DataFrame, ts: str, target: str) -> None:
    # rebalancing gathers a day's rows into few files and still splits a day that is too large
    rows = df.withColumn("day", F.to_date(ts)).hint("rebalance", F.col("day"))
    ordered = rows.sortWithinPartitions("day", "session_id", ts)
    ordered.write.mode("overwrite").partitionBy("day").parquet(target)


def turns(df: DataFrame) -> DataFrame:
    """Rows in the shape of the history; a role outside the closed set fails the write."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(
        F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("null"))))
    )
    shaped = df.withColumn("role", role)
    if "created_at" not in df.columns:
        shaped = shaped.withColumn("created_at", F.current_timestamp())
    return conform(shaped, CHAT_HISTORY)


def append_turns(df: DataFrame, path: str, batch: int | None = None) -> None:
    _store(turns(df), "created_at", path, batch)


def retrieval_rows(
    requests: DataFrame, settings: Settings = DEFAULTS, keep_empty: bool = False
) -> DataFrame:
    """One log row per source of a request (session_id, query, sources, retrieved_at).

    A request without sources gives no row, or an empty one with `keep_empty`. The question and
    the text are cut to the stored length; what a source lacks is '' or 0.
    """
    fields = {f.name for f in requests.schema["sources"].dataType.elementType.fields}

    def source(name: str):
        return F.col(f"s.{name}") if name in fields else F.lit(None).cast("string")

    each = F.explode_outer if keep_empty else F.explode
    exploded = requests.select("session_id", "query", "retrieved_at", each("sources").alias("s"))
    text = F.coalesce(source("chunk_text"), source("page_content"))
    rows = exploded.select(
        "session_id",
        F.substring("query", 1, settings.query_chars).alias("query"),
        source("chunk_id").cast("string").alias("chunk_id"),
        F.substring(text, 1, settings.logged_chunk_chars).alias("chunk_text"),
        *[source(n).cast("string").alias(n) for n in ("filename", "subject", "chapter")],
        source("score").cast("double").alias("score"),
        "retrieved_at",
    )
    blank = {n: "" for n in ("chunk_id", "chunk_text", "filename", "subject", "chapter")}
    return conform(rows, RETRIEVAL_LOG, {**blank, "score": 0.0})


def append_retrievals(requests: DataFrame, path: str, batch: int | None = None) -> None:
    """A refused question, which has no sources, is logged as one row without a chunk."""
    _store(retrieval_rows(requests, keep_empty=True), "retrieved_at", path, batch)


def append_clears(cleared: DataFrame, path: str) -> None:
    """Note sessions (session_id, cleared_at) as cleared; no stored turn is rewritten."""
    cleared.select("session_id", "cleared_at").write.mode("append").parquet(path)


def delete_cleared(spark: SparkSession, path: str, cleared: DataFrame) -> None:
    """Mark the stored turns of cleared sessions (session_id, cleared_at) as deleted in the files that hold them."""
    delete_rows(spark, path, lambda rows: cleared_rows(rows, cleared))


def compact_history(spark: SparkSession, path: str, least: int = 1, remove: bool = True) -> list[str]:
    """Write what is left of files with deleted turns anew, and remove the files unless readers may still need them."""
    replaced = compact_deletions(spark, path, lambda rows, folder: _store_in(rows, "created_at", folder), least)
    if remove:
        vacuum(spark, path)
    return replaced


def read_history(
    spark: SparkSession, path: str, clears: str | None = None, since: dt.date | None = None
) -> DataFrame:
    """The stored history without deleted turns and what has been cleared since; `since` skips older days."""
    stored = live_rows(spark, path)
    if since is not None:
        stored = stored.filter(F.col("day") >= F.lit(since))
    history = conform(stored, CHAT_HISTORY)
    if clears is None:
        return history
    try:
        cleared = spark.read.schema("session_id string, cleared_at timestamp").parquet(clears)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return history
    return clear_history(history, cleared)


def read_retrievals(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    if since is not None:
        stored = stored.filter(F.col("day") >= F.lit(since))
    return conform(stored, RETRIEVAL_LOG)
