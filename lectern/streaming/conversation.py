"""Live forms of the conversation analytics.

Turns are the columns of M6 with an event time `created_at` (TIMESTAMP). `delay` is how late a
turn may come; what is later is dropped, and what is older is forgotten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import DEFAULTS
from lectern.functions.text import is_fallback
from lectern.operators.conversation import NO_SUBJECT, reply_join, subject_or_unknown
from lectern.sources.logs import append_retrievals, append_turns


def streaming_reply_join(
    turns: DataFrame,
    delay: str = "10 minutes",
    phrases: Sequence[str] | None = None,
    seconds: int = DEFAULTS.reply_window_seconds,
) -> DataFrame:
    """Question and reply pairs as they happen.

    The window bounds how long either side is kept, and the time bucket in the join key spreads
    the state of a busy session over the partitions.
    """
    turns = turns.withWatermark("created_at", delay)
    asked = turns.filter(F.col("role") == "user")
    replies = turns.filter(F.col("role") == "assistant")
    if phrases is not None:
        replies = replies.filter(is_fallback(F.col("content"), phrases))
    return reply_join(asked, replies, seconds)


def streaming_heatmap(
    turns: DataFrame,
    log: DataFrame,
    delay: str = "10 minutes",
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    query_chars: int = DEFAULTS.query_chars,
) -> DataFrame:
    """Unanswered questions per day and subject, a day at a time once it is closed.

    `log` is the stored retrieval log, counted per question before it meets the stream. It is
    read again for every micro-batch, so give the days the stream covers (`read_retrievals` with
    `since`), not the whole past.
    """
    pairs = streaming_reply_join(turns, delay, phrases)
    logged = log.groupBy(
        "session_id", F.col("query").alias("_query"),
        subject_or_unknown(F.col("subject")).alias("_subject"),
    ).agg(F.count("*").alias("_chunks"))
    keyed = pairs.withColumn("_query", F.substring("question", 1, query_chars))
    return (
        keyed.join(logged, ["session_id", "_query"], "left")
        .groupBy(
            F.window("asked_at", "1 day"),
            F.coalesce("_subject", F.lit(NO_SUBJECT)).alias("subject"),
        )
        .agg(F.sum(F.coalesce("_chunks", F.lit(1))).alias("confusion_count"))
        .select(F.to_date("window.start").alias("day"), "subject", "confusion_count")
    )


def streaming_questions(turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Turns and questions per day."""
    return (
        turns.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.count_if(F.col("role") == "user").alias("questions"), F.count("*").alias("turns"))
        .select(F.to_date("window.start").alias("day"), "questions", "turns")
    )


def streaming_sessions(turns: DataFrame) -> DataFrame:
    """Distinct sessions per day.

    The delay is fixed to a day: a session's first turn is then remembered as long as another
    turn of the same day can still count.
    """
    return (
        turns.withWatermark("created_at", "1 day")
        .withColumn("_day", F.to_date("created_at"))
        .dropDuplicatesWithinWatermark(["session_id", "_day"])
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.count("*").alias("sessions"))
        .select(F.to_date("window.start").alias("day"), "sessions")
    )


def log_conversations(
    messages: DataFrame, history: str, retrievals: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Store each exchange as a user turn, its retrieval rows and an assistant turn.

    `messages` streams id, session_id, question, asked_at, sources, answer, answered_at.
    """

    def store(batch: DataFrame, number: int) -> None:
        said = batch.select(
            F.col("id") * 2, "session_id", F.lit("user"), "question", "asked_at"
        ).toDF("id", "session_id", "role", "content", "created_at")
        replied = batch.filter(F.col("answer").isNotNull()).select(
            F.col("id") * 2 + 1, "session_id", F.lit("assistant"), "answer", "answered_at"
        ).toDF("id", "session_id", "role", "content", "created_at")
        append_retrievals(
            batch.select(
                "session_id", F.col("question").alias("query"), "sources",
                F.col("asked_at").alias("retrieved_at"),
            ),
            retrievals, number,
        )
        append_turns(said.unionByName(replied), history, number)

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
