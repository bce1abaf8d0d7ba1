"""Analytics over conversations and the log of what was retrieved for them.

`history` is M6 (id, session_id, role, content, created_at) and `log` M7. Every operator takes
the time it is asked at, `as_of`, so a run can be repeated.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions.text import instant, is_fallback, recent
from lectern.operators.ranking import latest, top_k

# Fixed value: shown where no subject is known.
NO_SUBJECT = "Unknown"


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def reply_join(
    asked: DataFrame, replies: DataFrame, seconds: int = DEFAULTS.reply_window_seconds
) -> DataFrame:
    """Pairs of a question and each reply of its session within `seconds` after it, both ends open.

    Besides the session, the join key holds a time bucket as wide as the window: a reply lies in
    the question's bucket or the next one. A session of any length is thus spread over many keys.
    """
    u = asked.select(
        F.col("session_id"),
        F.col("id").alias("question_id"),
        F.col("content").alias("question"),
        F.col("created_at").alias("asked_at"),
        F.explode(
            F.array(_bucket(F.col("created_at"), seconds), _bucket(F.col("created_at"), seconds) + 1)
        ).alias("_bucket"),
    )
    a = replies.select(
        F.col("session_id"),
        F.col("id").alias("reply_id"),
        F.col("content").alias("reply"),
        F.col("created_at").alias("replied_at"),
        _bucket(F.col("created_at"), seconds).alias("_bucket"),
    )
    gap = F.make_dt_interval(secs=F.lit(seconds))
    return u.join(a, ["session_id", "_bucket"]).filter(
        (F.col("replied_at") > F.col("asked_at"))
        & (F.col("replied_at") < F.col("asked_at") + gap)
    ).drop("_bucket")


def _query_key(c: Column, query_chars: int | None) -> Column:
    return c if query_chars is None else F.substring(c, 1, query_chars)


def question_reply_pairs(
    history: DataFrame,
    as_of: dt.datetime,
    days: int,
    phrases: Sequence[str] | None = None,
    seconds: int = DEFAULTS.reply_window_seconds,
    question_chars: int | None = None,
) -> DataFrame:
    """Recent questions with their replies; with `phrases`, only replies that contain one.

    `question_chars` cuts the question before the join, where a caller needs no more of it.
    """
    since = recent(F.col("created_at"), as_of, days)
    asked = history.filter((F.col("role") == "user") & since).withColumn(
        "content", _query_key(F.col("content"), question_chars)
    )
    # a reply is younger than its question, so the same bound prunes this side too
    replies = history.filter((F.col("role") == "assistant") & since)
    if phrases is not None:
        replies = replies.filter(is_fallback(F.col("content"), phrases))
    return reply_join(asked, replies, seconds)


def subject_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_SUBJECT))


def with_retrieval(
    rows: DataFrame,
    log: DataFrame,
    question: str = "question",
    query_chars: int | None = DEFAULTS.query_chars,
) -> DataFrame:
    """Left join to the log on session and logged question text; repeats rows per logged chunk.

    The log holds a cut question, so the full text is cut the same way before it is compared;
    `query_chars=None` compares the whole text.
    """
    logged = log.select(
        F.col("session_id"), F.col("query").alias("_query"), F.col("subject").alias("_subject")
    )
    keyed = rows.withColumn("_query", _query_key(F.col(question), query_chars))
    return (
        keyed.join(logged, ["session_id", "_query"], "left")
        .withColumn("subject", subject_or_unknown(F.col("_subject")))
        .drop("_query", "_subject")
    )


def confusion_heatmap(
    history: DataFrame,
    log: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    distinct_questions: bool = False,
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    query_chars: int | None = DEFAULTS.query_chars,
) -> DataFrame:
    """Unanswered questions by day and subject.

    The plain count has one unit per (question, reply, logged chunk); `distinct_questions`
    counts each question once per subject. Both sides are counted per session and question text
    first, so the product is a sum of products and its rows are never written out.
    """
    pairs = question_reply_pairs(history, as_of, days, phrases, question_chars=query_chars)
    if distinct_questions:
        pairs = pairs.select("session_id", "question_id", "question", "asked_at").distinct()
    asked = pairs.groupBy(
        "session_id", F.col("question").alias("query"), F.to_date("asked_at").alias("day")
    ).agg(F.count("*").alias("asked"))
    # of the log only what was asked in these days, whenever it was logged
    wanted = asked.select("session_id", "query").distinct()
    logged = log.join(wanted, ["session_id", "query"], "left_semi").groupBy(
        "session_id", "query", subject_or_unknown(F.col("subject")).alias("subject")
    ).agg(F.count("*").alias("chunks"))
    times = F.lit(1) if distinct_questions else F.coalesce(F.col("chunks"), F.lit(1))
    return (
        asked.join(logged, ["session_id", "query"], "left")
        .groupBy("day", F.coalesce("subject", F.lit(NO_SUBJECT)).alias("subject"))
        .agg(F.sum(F.col("asked") * times).alias("confusion_count"))
        .orderBy(F.col("day").desc(), F.col("confusion_count").desc(), "subject")
    )


def confusion_by_subject(heatmap: DataFrame) -> DataFrame:
    """Totals per subject over the days, with their share of the largest in percent."""
    totals = heatmap.groupBy(
        F.coalesce(F.nullif("subject", F.lit("")), F.lit(NO_SUBJECT)).alias("subject")
    ).agg(F.sum("confusion_count").alias("confusion_count"))
    largest = totals.agg(F.greatest(F.max("confusion_count"), F.lit(1))).scalar()
    return totals.withColumn(
        "share_of_max", F.round(F.col("confusion_count") / largest * 100, 1)
    ).orderBy(F.col("confusion_count").desc(), "subject")


def unanswered_questions(
    history: DataFrame,
    log: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    limit: int = 50,
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    query_chars: int | None = DEFAULTS.query_chars,
) -> DataFrame:
    """The newest unanswered questions with subject and reply.

    The join with the log only repeats pairs, and the order is by pair first, so the newest
    `limit` pairs hold every row of the answer: the log is searched for those alone.
    """
    newest = [F.col("asked_at").desc(), F.col("question_id").asc(), F.col("reply_id").asc()]
    pairs = latest(question_reply_pairs(history, as_of, days, phrases), newest, limit)
    wanted = pairs.select(
        "session_id", _query_key(F.col("question"), query_chars).alias("query")
    ).distinct()
    # no more than `limit` rows
    found = log.select("session_id", "query", "subject").join(
        F.broadcast(wanted), ["session_id", "query"], "left_semi"
    )
    rows = with_retrieval(pairs, found, query_chars=query_chars)
    return latest(rows, [*newest, F.col("subject").asc()], limit).select(
        "question", "asked_at", "session_id", "subject", F.col("reply").alias("professor_response")
    )


def top_chunks(
    log: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 20, by_chunk: bool = False
) -> DataFrame:
    """The most retrieved chunks. `by_chunk` counts a chunk once however its text was cut."""
    rows = log.filter(recent(F.col("retrieved_at"), as_of, days))
    described = ("chunk_text", "filename", "subject", "chapter")
    counts = (
        F.count("*").alias("retrieval_count"),
        F.max("retrieved_at").alias("last_retrieved"),
    )
    if by_chunk:
        newest = F.max(F.struct("retrieved_at", *described))
        counted = rows.groupBy("chunk_id").agg(newest.alias("_last"), *counts)
        counted = counted.select(
            "chunk_id", *[F.col(f"_last.{c}") for c in described], "retrieval_count",
            "last_retrieved",
        )
    else:
        counted = rows.groupBy("chunk_id", *described).agg(*counts)
    return latest(
        counted,
        [F.col("retrieval_count").desc(), F.col("chunk_id").asc(), F.col("chunk_text").asc()],
        limit,
    )


def activity_counts(history: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """One row: questions, sessions and the questions of the last 24 hours."""
    asked = F.col("role") == "user"
    today = F.col("created_at") > instant(as_of - dt.timedelta(hours=24))
    return history.filter(recent(F.col("created_at"), as_of, days)).agg(
        F.count_if(asked).alias("total_questions"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_if(asked & today).alias("questions_today"),
    )


def unanswered_count(
    history: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    distinct_questions: bool = False,
) -> DataFrame:
    """One row: pairs of a question and a fallback reply, or the questions that have any."""
    pairs = question_reply_pairs(history, as_of, days, phrases)
    counted = F.count_distinct("question_id") if distinct_questions else F.count("*")
    return pairs.agg(counted.alias("unanswered_questions"))


def activity_summary(
    history: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    distinct_questions: bool = False,
) -> DataFrame:
    """One row: the activity counts, unanswered questions and their share in percent."""
    names = ("total_questions", "total_sessions", "questions_today", "unanswered_questions")
    parts = activity_counts(history, as_of, days).unionByName(
        unanswered_count(history, as_of, days, phrases, distinct_questions),
        allowMissingColumns=True,
    )
    rate = F.col("unanswered_questions") / F.greatest(F.col("total_questions"), F.lit(1)) * 100
    return parts.agg(*[F.sum(n).alias(n) for n in names]).withColumn(
        "confusion_rate", F.round(rate, 1)
    )


def confusion_rate(
    history: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    distinct_questions: bool = False,
) -> DataFrame:
    return activity_summary(history, as_of, days, phrases, distinct_questions).select(
        "unanswered_questions", "total_questions", "confusion_rate"
    )


def last_n_turns(history: DataFrame, turns: int = DEFAULTS.history_turns) -> DataFrame:
    """The newest 2 x `turns` messages of every session; `position` counts from the oldest."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    kept = top_k(history, ["session_id"], newest, 2 * turns, "_age")
    # the k newest rows per session are few, so turning the order round is cheap
    oldest = [F.col("created_at").asc(), F.col("id").asc()]
    return top_k(kept, ["session_id"], oldest, 2 * turns, "position").drop("_age")


def load_history(
    history: DataFrame, session_id: str, turns: int = DEFAULTS.history_turns
) -> DataFrame:
    """Role and text of one session's newest 2 x `turns` messages, oldest first."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    kept = latest(history.filter(F.col("session_id") == session_id), newest, 2 * turns)
    return kept.orderBy("created_at", "id").select("role", "content")


def history_before(
    messages: DataFrame, history: DataFrame, turns: int = DEFAULTS.history_turns
) -> DataFrame:
    """(message_id, history): the session's newest 2 x `turns` turns before each message.

    `messages` is (message_id, session_id, asked_at); `history` comes oldest first, as an array of
    (role, content). Messages and turns are numbered together, day by day with the counts of the
    days before added, and a message then meets the one or two blocks of positions that hold its
    turns. So the work of a session of any length is spread, and no message meets all its turns.
    """
    span = 2 * turns
    columns = ("session_id", "at", "is_turn", "id", "role", "content", "message_id")
    said = history.select(
        "session_id", F.col("created_at").alias("at"), F.lit(1).alias("is_turn"), "id", "role",
        "content", F.lit(None).cast(messages.schema["message_id"].dataType).alias("message_id"),
    )
    asked = messages.select(
        "session_id", F.col("asked_at").alias("at"), F.lit(0).alias("is_turn"),
        F.lit(None).cast(history.schema["id"].dataType).alias("id"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"),
        "message_id",
    )
    rows = said.unionByName(asked).select(*columns, F.to_date("at").alias("day"))
    # a turn of the same instant is not before the message
    in_day = W.partitionBy("session_id", "day").orderBy("at", "is_turn", "id")
    local = rows.withColumn(
        "_seen", F.sum("is_turn").over(in_day.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    by_day = W.partitionBy("session_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        rows.groupBy("session_id", "day")
        .agg(F.sum("is_turn").alias("_n"))
        .select("session_id", "day", F.coalesce(F.sum("_n").over(by_day), F.lit(0)).alias("_earlier"))
    )
    # turns before the row: a turn does not count itself
    numbered = local.join(earlier, ["session_id", "day"]).withColumn(
        "pos", F.col("_earlier") + F.col("_seen") - F.col("is_turn")
    )

    def block(position: Column) -> Column:
        return F.floor(position / F.lit(span))

    first = F.greatest(F.col("pos") - span, F.lit(0))
    wanted = (
        numbered.filter((F.col("is_turn") == 0) & (F.col("pos") > 0))
        .select(
            "message_id", "session_id", first.alias("_from"), F.col("pos").alias("_to"),
            F.explode(F.array_distinct(F.array(block(first), block(F.col("pos") - 1)))).alias("_block"),
        )
    )
    placed = numbered.filter(F.col("is_turn") == 1).select(
        "session_id", block(F.col("pos")).alias("_block"), "pos", "role", "content"
    )
    found = wanted.join(placed, ["session_id", "_block"]).filter(
        (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))
    )
    # no more than 2 x turns rows per message
    listed = found.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("_rows")
    )
    past = F.transform(
        F.coalesce("_rows", F.array().cast("array<struct<pos:bigint,role:string,content:string>>")),
        lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
    )
    return messages.select("message_id").join(listed, "message_id", "left").select(
        "message_id", past.alias("history")
    )


def _by_clearing(history: DataFrame, cleared: DataFrame, how: str) -> DataFrame:
    gone = cleared.groupBy("session_id").agg(
        F.max(F.coalesce("cleared_at", instant(dt.datetime(9999, 1, 1)))).alias("cleared_at")
    )
    gone = gone.withColumnsRenamed({"session_id": "_session", "cleared_at": "_cleared"})
    on = (F.col("session_id") == F.col("_session")) & (F.col("created_at") <= F.col("_cleared"))
    return history.join(gone, on, how)


def clear_history(history: DataFrame, cleared: DataFrame) -> DataFrame:
    """The history without the sessions in `cleared` (session_id, cleared_at).

    A message sent after its session was cleared stays; a null `cleared_at` clears everything.
    """
    return _by_clearing(history, cleared, "left_anti")


def cleared_rows(history: DataFrame, cleared: DataFrame) -> DataFrame:
    """The rows that `clear_history` leaves out."""
    return _by_clearing(history, cleared, "left_semi")
