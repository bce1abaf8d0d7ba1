"""Conversation analytics: N1, N2, N5, A1 to A6, W1, S7, S8, P21, P22."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import query
from checks.tables import (
    AS_OF,
    AS_OF_SQL,
    FALLBACK_SQL,
    HEADER_FALLBACK_SQL,
    PAIRS_FROM_SQL,
    conversation_sql,
    history,
    requests,
    retrieval_log,
    text_ts,
)
from lectern.config import HEADER_FALLBACK_PHRASES
from lectern.functions.text import is_fallback, recent, severity_band, time_ago
from lectern.operators import conversation as ops
from lectern.operators import summaries
from lectern.session import shared_folder, stored_table
from lectern.sources.logs import append_turns, compact_history, delete_cleared, read_history, retrieval_rows

SINCE = f"u.role = 'user' AND u.created_at > {AS_OF_SQL} - INTERVAL 7 DAY"
SUBJECT = "coalesce(nullif(r.subject, ''), 'Unknown')"
LOG_JOIN = "LEFT JOIN log r ON r.session_id = u.session_id AND r.query = substring(u.content, 1, 500)"


@query(
    "reply_pairs",
    conversation_sql(
        f"SELECT u.session_id, u.id AS question_id, a.id AS reply_id {PAIRS_FROM_SQL} WHERE {SINCE}"
    ),
)
def reply_pairs(spark, sf_dir):
    pairs = ops.question_reply_pairs(history(spark, sf_dir), AS_OF, 7)
    return pairs.select("session_id", "question_id", "reply_id")


@query(
    "reply_pairs_with_subject",
    conversation_sql(
        f"SELECT u.id AS question_id, a.id AS reply_id, {SUBJECT} AS subject "
        f"{PAIRS_FROM_SQL} {LOG_JOIN} WHERE {SINCE}"
    ),
)
def reply_pairs_with_subject(spark, sf_dir):
    pairs = ops.question_reply_pairs(history(spark, sf_dir), AS_OF, 7)
    rows = ops.with_retrieval(pairs, retrieval_log(spark, sf_dir))
    return rows.select("question_id", "reply_id", "subject")


def heatmap_sql(counted: str) -> str:
    return (
        f"SELECT strftime(u.created_at, '%Y-%m-%d') AS day, {SUBJECT} AS subject, "
        f"{counted} AS confusion_count {PAIRS_FROM_SQL} {LOG_JOIN} "
        f"WHERE {SINCE} AND {FALLBACK_SQL} GROUP BY 1, 2"
    )


@query("confusion_heatmap", conversation_sql(heatmap_sql("count(*)")))
def confusion_heatmap(spark, sf_dir):
    heat = ops.confusion_heatmap(history(spark, sf_dir), retrieval_log(spark, sf_dir), AS_OF)
    return heat.withColumn("day", F.col("day").cast("string"))


@query("confusion_heatmap_distinct", conversation_sql(heatmap_sql("count(DISTINCT u.id)")))
def confusion_heatmap_distinct(spark, sf_dir):
    heat = ops.confusion_heatmap(
        history(spark, sf_dir), retrieval_log(spark, sf_dir), AS_OF, distinct_questions=True
    )
    return heat.withColumn("day", F.col("day").cast("string"))


@query(
    "confusion_by_subject",
    conversation_sql(
        "SELECT subject, CAST(sum(confusion_count) AS BIGINT) AS confusion_count, "
        "round(sum(confusion_count) / greatest(max(sum(confusion_count)) OVER (), 1) * 100, 1) "
        f"AS share_of_max FROM ({heatmap_sql('count(*)')}) GROUP BY subject"
    ),
)
def confusion_by_subject(spark, sf_dir):
    heat = ops.confusion_heatmap(history(spark, sf_dir), retrieval_log(spark, sf_dir), AS_OF)
    return ops.confusion_by_subject(heat)


@query(
    "unanswered_questions",
    conversation_sql(
        "SELECT question, asked_at, session_id, subject, professor_response FROM ("
        "SELECT u.content AS question, strftime(u.created_at, '%Y-%m-%d %H:%M:%S') AS asked_at, "
        f"u.session_id, {SUBJECT} AS subject, a.content AS professor_response "
        f"{PAIRS_FROM_SQL} {LOG_JOIN} WHERE {SINCE} AND {FALLBACK_SQL} "
        f"ORDER BY u.created_at DESC, u.id, a.id, {SUBJECT} LIMIT 50)"
    ),
)
def unanswered_questions(spark, sf_dir):
    rows = ops.unanswered_questions(history(spark, sf_dir), retrieval_log(spark, sf_dir), AS_OF)
    return rows.withColumn("asked_at", text_ts("asked_at"))


TOP_SQL = """
SELECT chunk_id, {cols}, count(*) AS retrieval_count,
       strftime(max(retrieved_at), '%Y-%m-%d %H:%M:%S') AS last_retrieved
FROM log WHERE retrieved_at > {as_of} - INTERVAL 7 DAY
GROUP BY {group} ORDER BY retrieval_count DESC, chunk_id, chunk_text LIMIT 20"""
BY_ROW = "chunk_text, filename, subject, chapter"
BY_CHUNK = (
    "max(chunk_text) AS chunk_text, max(filename) AS filename, "
    "max(subject) AS subject, max(chapter) AS chapter"
)


@query("top_chunks", conversation_sql(TOP_SQL.format(cols=BY_ROW, group="chunk_id, " + BY_ROW, as_of=AS_OF_SQL)))
def top_chunks(spark, sf_dir):
    rows = ops.top_chunks(retrieval_log(spark, sf_dir), AS_OF)
    return rows.withColumn("last_retrieved", text_ts("last_retrieved"))


@query("top_chunks_by_id", conversation_sql(TOP_SQL.format(cols=BY_CHUNK, group="chunk_id", as_of=AS_OF_SQL)))
def top_chunks_by_id(spark, sf_dir):
    rows = ops.top_chunks(retrieval_log(spark, sf_dir), AS_OF, by_chunk=True)
    return rows.withColumn("last_retrieved", text_ts("last_retrieved"))


@query("top_chunks_from_summaries", conversation_sql(TOP_SQL.format(cols=BY_ROW, group="chunk_id, " + BY_ROW, as_of=AS_OF_SQL)))
def top_chunks_from_summaries(spark, sf_dir):
    """Days are summed up by their 50 most retrieved chunks; those that can be among the best are counted again."""
    log = retrieval_log(spark, sf_dir)
    daily = stored_table(summaries.daily_chunks(log, 50))
    return summaries.top_chunks_from_summaries(daily, log, AS_OF).withColumn("last_retrieved", text_ts("last_retrieved"))


ACTIVITY_SQL = f"""
SELECT count(*) FILTER (WHERE role = 'user') AS total_questions,
       count(DISTINCT session_id) AS total_sessions,
       count(*) FILTER (WHERE role = 'user' AND created_at > {AS_OF_SQL} - INTERVAL 24 HOUR) AS questions_today
FROM history WHERE created_at > {AS_OF_SQL} - INTERVAL 7 DAY"""


def unanswered_sql(counted: str, phrases: str) -> str:
    return f"SELECT {counted} AS unanswered_questions {PAIRS_FROM_SQL} WHERE {SINCE} AND {phrases}"


RATE = "round(unanswered_questions / greatest(total_questions, 1) * 100, 1) AS confusion_rate"


@query(
    "activity_summary",
    conversation_sql(
        f"SELECT *, {RATE} FROM ({ACTIVITY_SQL}), ({unanswered_sql('count(*)', FALLBACK_SQL)})"
    ),
)
def activity_summary(spark, sf_dir):
    return ops.activity_summary(history(spark, sf_dir), AS_OF)


@query("activity_from_sketches", conversation_sql(f"SELECT *, true AS near FROM ({ACTIVITY_SQL})"))
def activity_from_sketches(spark, sf_dir):
    """Exact counts, and whether the sessions estimated from sketches are within three standard errors of them."""
    turns = history(spark, sf_dir)
    found = summaries.activity_from_sketches(stored_table(summaries.hourly_activity(turns)), turns, AS_OF)
    exact = ops.activity_counts(turns, AS_OF).select("total_sessions")
    near = summaries.within_error(F.col("sessions_estimate"), F.col("total_sessions")).alias("near")
    return found.crossJoin(exact).select("total_questions", "total_sessions", "questions_today", near)


@query(
    "activity_summary_header",
    conversation_sql(
        f"SELECT *, {RATE} FROM ({ACTIVITY_SQL}), ({unanswered_sql('count(*)', HEADER_FALLBACK_SQL)})"
    ),
)
def activity_summary_header(spark, sf_dir):
    """With the shorter list of phrases."""
    return ops.activity_summary(history(spark, sf_dir), AS_OF, phrases=HEADER_FALLBACK_PHRASES)


@query(
    "confusion_rate",
    conversation_sql(
        f"SELECT unanswered_questions, total_questions, {RATE} FROM ({ACTIVITY_SQL}), "
        f"({unanswered_sql('count(*)', FALLBACK_SQL)})"
    ),
)
def confusion_rate(spark, sf_dir):
    return ops.confusion_rate(history(spark, sf_dir), AS_OF)


@query(
    "confusion_rate_distinct",
    conversation_sql(
        "SELECT unanswered_questions, total_questions, confusion_rate, "
        "CASE WHEN confusion_rate > 30 THEN 'bad' WHEN confusion_rate > 15 THEN 'warn' ELSE 'good' END AS band "
        f"FROM (SELECT *, {RATE} FROM ({ACTIVITY_SQL}), "
        f"({unanswered_sql('count(DISTINCT u.id)', FALLBACK_SQL)}))"
    ),
)
def confusion_rate_distinct(spark, sf_dir):
    rate = ops.confusion_rate(history(spark, sf_dir), AS_OF, distinct_questions=True)
    return rate.withColumn("band", severity_band(F.col("confusion_rate")))


@query(
    "last_turns",
    conversation_sql(
        "SELECT session_id, id, role, CAST(row_number() OVER (PARTITION BY session_id "
        "ORDER BY created_at, id) AS BIGINT) AS position FROM (SELECT *, row_number() OVER "
        "(PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS age FROM history) WHERE age <= 6"
    ),
)
def last_turns(spark, sf_dir):
    kept = ops.last_n_turns(history(spark, sf_dir), turns=3)
    return kept.select("session_id", "id", "role", F.col("position").cast("bigint").alias("position"))


# A session is cleared when one of its questions says less than 30 characters.
CLEARED_SQL = conversation_sql(
    "SELECT h.id, h.session_id, h.role FROM history h WHERE NOT EXISTS (SELECT 1 FROM history c "
    "WHERE c.role = 'user' AND length(c.content) < 30 AND c.session_id = h.session_id "
    "AND h.created_at <= c.created_at)"
)


def clears_of(turns):
    return turns.filter((F.col("role") == "user") & (F.length("content") < 30)).select(
        "session_id", F.col("created_at").alias("cleared_at")
    )


@query("cleared_history", CLEARED_SQL)
def cleared_history(spark, sf_dir):
    turns = history(spark, sf_dir)
    return ops.clear_history(turns, clears_of(turns)).select("id", "session_id", "role")


@query("cleared_history_stored", CLEARED_SQL)
def cleared_history_stored(spark, sf_dir):
    """Turns come in two loads; after each, the sessions cleared by then are deleted; then the files are compacted."""
    turns, path = history(spark, sf_dir), f"{shared_folder(spark)}/history"
    for part in (turns.filter("id % 2 = 0"), turns.filter("id % 2 = 1")):
        append_turns(part, path)
        delete_cleared(spark, path, clears_of(turns))
    compact_history(spark, path)
    return read_history(spark, path).select("id", "session_id", "role")


@query(
    "retrieval_log",
    conversation_sql(
        "SELECT session_id, query, chunk_id, chunk_text, filename, subject, chapter, score, "
        "strftime(retrieved_at, '%Y-%m-%d %H:%M:%S') AS retrieved_at FROM log"
    ),
)
def log_rows(spark, sf_dir):
    return retrieval_rows(requests(spark, sf_dir)).withColumn("retrieved_at", text_ts("retrieved_at"))


@query(
    "recent_turns",
    conversation_sql(
        f"SELECT id, role FROM history WHERE created_at > {AS_OF_SQL} - INTERVAL 1 DAY"
    ),
)
def recent_turns(spark, sf_dir):
    return history(spark, sf_dir).filter(recent(F.col("created_at"), AS_OF, 1)).select("id", "role")


@query("fallback_answers", conversation_sql(f"SELECT a.id, {FALLBACK_SQL} AS is_fallback FROM history a"))
def fallback_answers(spark, sf_dir):
    return history(spark, sf_dir).select("id", is_fallback(F.col("content")).alias("is_fallback"))


@query(
    "time_ago",
    """
WITH e AS (SELECT event_id, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 1000000) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN concat(s, 's ago')
  WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago')
  ELSE concat(s // 86400, 'd ago') END AS age FROM e""",
)
def ages(spark, sf_dir):
    from checks.tables import table

    as_of = dt.datetime(2024, 2, 1)
    return table(spark, sf_dir, "events").select("event_id", time_ago(F.col("ts"), as_of).alias("age"))
