"""From incoming messages to what a chat model needs to answer them, for a whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.language import detect_reply_language
from lectern.functions.text import build_prompt, chat_messages, session_id_or_new
from lectern.operators.conversation import history_before
from lectern.operators.retrieval import PairScorer, SearchCorpus, single_variant
from lectern.plans.search import retrieve_multistage


def with_sessions(messages: DataFrame) -> DataFrame:
    """Give messages without a session one of their own; store the result before going on."""
    return messages.withColumn("session_id", session_id_or_new(F.col("session_id")))


def prepare_replies(
    messages: DataFrame,
    history: DataFrame,
    corpus: SearchCorpus,
    scorer: PairScorer | None = None,
    variants: DataFrame | None = None,
) -> DataFrame:
    """One row per message (message_id, session_id, text, asked_at) with text.

    Adds the reply language, grade, context, sources, the prompt the grade asks for, and the
    chat messages with the session's past turns. `sources` fits `sources.logs.retrieval_rows`.
    Without `variants` the text itself is the only query.
    """
    messages = messages.filter(F.length("text") > 0)
    spoken = detect_reply_language(messages, "text")
    questions = messages.select(
        F.col("message_id").alias("question_id"), F.col("text").alias("question")
    )
    if variants is None:
        variants = single_variant(questions)
    found = retrieve_multistage(questions, corpus, scorer, variants).select(
        F.col("question_id").alias("message_id"), "grade", "top_score", "context", "sources"
    )
    past = history_before(messages, history)
    prompt = build_prompt(F.col("text"), F.col("context"), F.col("lang_name"), F.col("grade"))
    return (
        spoken.join(found, "message_id")
        .join(past, "message_id")
        .withColumn("prompt", prompt)
        .withColumn("chat", chat_messages(F.col("history"), F.col("prompt"), F.col("lang_name")))
    )
