"""Streaming forms, run to the end over the given tables: L2 to L7 (L1 needs files, see tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks import query
from checks.tables import (
    FALLBACK_SQL,
    HISTORY_SQL,
    PAIRS_FROM_SQL,
    as_history,
    conversation_sql,
    requests,
    retrieval_log,
    table,
    with_ctes,
)
from lectern.session import shared_folder
from lectern.sources.logs import read_history, read_retrievals
from lectern.streaming import conversation as live
from lectern.streaming import heatmap, token_state, tokens


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # as a pattern, the path may stand for one file or for a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run(spark: SparkSession, rows: DataFrame, wait=StreamingQuery.awaitTermination) -> DataFrame:
    """Process all that is there, and return what the stream has written."""
    folder = shared_folder(spark)
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out")
    done = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    wait(done)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def live_turns(spark, sf_dir):
    return as_history(stream(spark, sf_dir, "conversations"))


# A day comes out once the watermark, ten minutes behind the newest turn, has passed its end.
CLOSED = "day + INTERVAL 1 DAY <= (SELECT max(created_at) FROM history{}) - INTERVAL {}"


@query(
    "stream_replies",
    conversation_sql(f"SELECT u.session_id, u.id AS question_id, a.id AS reply_id {PAIRS_FROM_SQL} WHERE u.role = 'user'"),
)
def stream_replies(spark, sf_dir):
    pairs = live.streaming_reply_join(live_turns(spark, sf_dir))
    return run(spark, pairs.select("session_id", "question_id", "reply_id"))


@query(
    "stream_questions",
    with_ctes(
        "SELECT strftime(day, '%Y-%m-%d') AS day, questions, turns FROM (SELECT CAST(created_at AS DATE) AS day, "
        "count(*) FILTER (WHERE role = 'user') AS questions, count(*) AS turns FROM history GROUP BY 1) WHERE "
        + CLOSED.format("", "10 MINUTE"),
        history=HISTORY_SQL,
    ),
)
def stream_questions(spark, sf_dir):
    days = live.streaming_questions(live_turns(spark, sf_dir))
    return run(spark, days.withColumn("day", F.col("day").cast("string")))


@query(
    "stream_sessions",
    with_ctes(
        "SELECT strftime(day, '%Y-%m-%d') AS day, sessions FROM (SELECT CAST(created_at AS DATE) AS day, "
        "count(DISTINCT session_id) AS sessions FROM history GROUP BY 1) WHERE " + CLOSED.format("", "1 DAY"),
        history=HISTORY_SQL,
    ),
)
def stream_sessions(spark, sf_dir):
    days = live.streaming_sessions(live_turns(spark, sf_dir))
    return run(spark, days.withColumn("day", F.col("day").cast("string")))


@query(
    "stream_heatmap",
    conversation_sql(
        "SELECT strftime(day, '%Y-%m-%d') AS day, subject, confusion_count FROM (SELECT CAST(u.created_at AS DATE) AS day, "
        f"coalesce(nullif(r.subject, ''), 'Unknown') AS subject, count(*) AS confusion_count {PAIRS_FROM_SQL} "
        "LEFT JOIN log r ON r.session_id = u.session_id AND r.query = substring(u.content, 1, 500) "
        f"WHERE u.role = 'user' AND {FALLBACK_SQL} GROUP BY 1, 2) WHERE "
        "day + INTERVAL 1 DAY <= least((SELECT max(created_at) FROM history WHERE role = 'user'), "
        f"(SELECT max(a.created_at) FROM history a WHERE a.role = 'assistant' AND {FALLBACK_SQL})) - INTERVAL 10 MINUTE"
    ),
)
def stream_heatmap(spark, sf_dir):
    days = live.streaming_heatmap(live_turns(spark, sf_dir), retrieval_log(spark, sf_dir))
    return run(spark, days.withColumn("day", F.col("day").cast("string")))


@query(
    "stream_heatmap_open",
    conversation_sql(
        "SELECT strftime(CAST(u.created_at AS DATE), '%Y-%m-%d') AS day, coalesce(nullif(r.subject, ''), 'Unknown') AS subject, "
        f"count(*) AS confusion_count {PAIRS_FROM_SQL} "
        "LEFT JOIN log r ON r.session_id = u.session_id AND r.query = substring(u.content, 1, 500) "
        f"WHERE u.role = 'user' AND {FALLBACK_SQL} GROUP BY 1, 2"
    ),
)
def stream_heatmap_open(spark, sf_dir):
    """The log comes in two parts after the turns, the first with wrong rows, which the second takes back; open days count."""
    folder = shared_folder(spark)
    log = retrieval_log(spark, sf_dir).select("session_id", "query", "subject").withColumn("change", F.lit(1))
    late = F.pmod(F.xxhash64("session_id", "query"), F.lit(2)) == 1
    wrong = log.filter(~late).withColumn("subject", F.lit("Wrong"))
    log.filter(~late).unionByName(wrong).coalesce(1).write.parquet(f"{folder}/log/0")
    log.filter(late).unionByName(wrong.withColumn("change", F.lit(-1))).coalesce(1).write.parquet(f"{folder}/log/1")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    changes = heatmap.heatmap_changes(live_turns(spark, sf_dir), source.parquet(f"{folder}/log"))
    heatmap.maintain_heatmap(changes, f"{folder}/heatmap", f"{folder}/state").awaitTermination()
    return heatmap.read_heatmap(spark, f"{folder}/heatmap").withColumn("day", F.col("day").cast("string"))


# ---- tokens ------------------------------------------------------------------------------


def token_rows(turns: DataFrame) -> DataFrame:
    """Assistant texts as tokens: the words with the blank before them, then an end mark."""
    pieces = F.transform(F.split("text", " "), lambda w, i: F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w))
    return turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("reply_id"),
        F.posexplode(F.concat(pieces, F.array(F.lit(None).cast("string")))).alias("seq", "token"),
    )


def token_lines(turns: DataFrame) -> DataFrame:
    """The same as a model server sends it, with blank and broken lines in between."""
    rows = token_rows(turns)
    message = F.to_json(
        F.struct(
            F.struct(F.coalesce("token", F.lit("ignored")).alias("content")).alias("message"),
            F.col("token").isNull().alias("done"),
        )
    )
    noise = F.when(F.col("seq") % 3 == 0, "").otherwise('{"message": {"content"')
    lines = F.array(message, noise, F.lit("   "))
    return rows.select(
        "session_id", "reply_id", (F.col("seq") * 3).alias("first"), F.posexplode(lines).alias("p", "line")
    ).select("session_id", "reply_id", (F.col("first") + F.col("p")).alias("seq"), "line")


STEP = (
    "CASE WHEN regexp_matches(x.o, '[.!?;:,*•\\-]') AND length(trim(a.o || x.o, chr(10) || ' ')) >= 20 "
    "THEN {'d': list_append(a.d, trim(a.o || x.o, chr(10) || ' ')), 'o': ''} ELSE {'d': a.d, 'o': a.o || x.o} END"
)
SEGMENTS_SQL = f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS reply_id,
  list_transform(string_split(text, ' '), lambda w, i: {{'d': CAST([] AS VARCHAR[]), 'o': CASE WHEN i > 1 THEN ' ' || w ELSE w END}}) AS p
  FROM conversations WHERE role = 'assistant'),
f AS (SELECT session_id, reply_id, list_reduce(list_prepend({{'d': CAST([] AS VARCHAR[]), 'o': ''}}, p), lambda a, x: {STEP}) AS r FROM t),
s AS (SELECT session_id, reply_id, CASE WHEN trim(r.o, chr(10) || ' ') <> '' THEN list_append(r.d, trim(r.o, chr(10) || ' ')) ELSE r.d END AS s FROM f)
SELECT session_id, reply_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS segment_no, unnest(s) AS segment FROM s"""


@query("token_segments", SEGMENTS_SQL)
def token_segments(spark, sf_dir):
    lines = tokens.parse_token_lines(token_lines(table(spark, sf_dir, "conversations")))
    return tokens.segment_tokens(tokens.until_done(lines))


@query("stream_token_segments", SEGMENTS_SQL)
def stream_token_segments(spark, sf_dir):
    lines = tokens.parse_token_lines(token_lines(stream(spark, sf_dir, "conversations")), keep_gaps=True)
    return run(spark, tokens.segment_stream(lines))


@query("stream_token_segments_shuffled", SEGMENTS_SQL)
def stream_token_segments_shuffled(spark, sf_dir):
    """The lines come in three batches, in any order, each line twice."""
    return run(spark, tokens.segment_stream(shuffled_lines(spark, sf_dir)))


@query("stream_token_segments_timers", SEGMENTS_SQL)
def stream_token_segments_timers(spark, sf_dir):
    """The same on named state and timers, in three micro-batches."""
    return run(spark, token_state.segment_stream_timers(shuffled_lines(spark, sf_dir)), token_state.drain)


def shuffled_lines(spark, sf_dir, batches=3):
    """The lines in so many batches, whatever the number of files: each batch meets the state of nearly all replies."""
    folder, made = shared_folder(spark), shared_folder(spark)
    rows = token_lines(table(spark, sf_dir, "conversations"))
    # the lines are made once, and not for each part and its sort
    rows.withColumn("part", F.pmod(F.xxhash64("reply_id", "seq"), F.lit(3)).cast("int")).write.partitionBy("part").parquet(made)
    parted = spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, part int").parquet(made)
    for part in range(3):
        some = parted.filter(F.col("part") == part).select(*rows.columns)
        twice = some.withColumn("_time", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_time")
        twice.orderBy(F.xxhash64("seq")).write.parquet(f"{folder}/{part}")
    files = len(spark.read.option("recursiveFileLookup", "true").parquet(folder).inputFiles())
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
    source = source.option("maxFilesPerTrigger", -(-files // batches))
    return tokens.parse_token_lines(source.parquet(folder), keep_gaps=True)


# ---- storing conversations as they happen ------------------------------------------------


@query(
    "stream_conversation_log",
    conversation_sql(
        "SELECT kind, session_id, said_at, md5(content) AS digest FROM ("
        "SELECT 'user' AS kind, session_id, content, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS said_at FROM history WHERE role = 'user' "
        "UNION ALL SELECT 'assistant', session_id, 'Re: ' || content, strftime(created_at + INTERVAL 20 SECOND, '%Y-%m-%d %H:%M:%S') AS said_at "
        "FROM history WHERE role = 'user' "
        "UNION ALL SELECT 'retrieval', session_id, chunk_id || ':' || chunk_text, strftime(retrieved_at, '%Y-%m-%d %H:%M:%S') AS said_at FROM log)"
    ),
)
def stream_conversation_log(spark, sf_dir):
    folder = shared_folder(spark)
    asked = requests(spark, sf_dir).select(
        "id", "session_id", F.col("query").alias("question"), F.col("retrieved_at").alias("asked_at"),
        "sources", F.concat(F.lit("Re: "), "query").alias("answer"),
        (F.col("retrieved_at") + F.expr("INTERVAL 20 SECONDS")).alias("answered_at"),
    )
    asked.write.parquet(f"{folder}/messages")
    messages = spark.readStream.schema(asked.schema).parquet(f"{folder}/messages")
    live.log_conversations(
        messages, f"{folder}/history", f"{folder}/retrievals", f"{folder}/state"
    ).awaitTermination()
    said = read_history(spark, f"{folder}/history").withColumnRenamed("role", "kind")
    found = read_retrievals(spark, f"{folder}/retrievals").select(
        F.lit("retrieval").alias("kind"), "session_id", F.concat_ws(":", "chunk_id", "chunk_text").alias("content"),
        F.col("retrieved_at").alias("created_at"),
    )
    rows = said.select("kind", "session_id", "content", "created_at").unionByName(found)
    return rows.select("kind", "session_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("said_at"), F.md5("content").alias("digest"))
