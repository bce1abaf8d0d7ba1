"""Quizzes grounded in the course material."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.jsonops import checked_type, parse_quiz
from lectern.functions.text import clamp_count, strip

NO_TOPIC = "no topic given"
NOT_COVERED = "the course material does not cover this topic"
NO_QUIZ = "no usable question was generated"


def quiz_requests(requests: DataFrame) -> DataFrame:
    """Requests (request_id, topic, num_questions, language) with trimmed topic and sane count."""
    return requests.withColumn("topic", strip(F.coalesce("topic", F.lit("")))).withColumn(
        "num_questions", clamp_count(F.col("num_questions"))
    )


def quiz_envelopes(requests: DataFrame, retrieved: DataFrame, replies: DataFrame) -> DataFrame:
    """One envelope per request: grounded only when the topic is covered and a quiz was read.

    `retrieved` is (request_id, grade, context, sources) and `replies` (request_id, raw): what a
    model wrote for the grounded requests.
    """
    none = F.array().cast(checked_type())
    # parsing is the costly part: it is done on the replies as they are read, before any shuffle
    parsed = replies.select("request_id", parse_quiz(F.col("raw")).alias("_parsed"))
    found = retrieved.select("request_id", "grade", "context", "sources")
    joined = (
        requests.join(found, "request_id", "left")
        .join(parsed, "request_id", "left")
        .withColumn("_questions", F.coalesce("_parsed", none))
    )
    covered = (F.coalesce("grade", F.lit("incorrect")) != "incorrect") & (
        F.length(strip(F.coalesce("context", F.lit("")))) > 0
    )
    error = (
        F.when(F.col("topic") == "", NO_TOPIC)
        .when(~covered, NOT_COVERED)
        .when(F.size("_questions") == 0, NO_QUIZ)
    )
    return joined.withColumn("error", error).select(
        "request_id",
        "topic",
        "language",
        F.col("error").isNull().alias("grounded"),
        F.when(F.col("error").isNull(), F.col("_questions")).otherwise(none).alias("questions"),
        "sources",
        "error",
    )
