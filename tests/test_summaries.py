"""Dashboard figures from summaries against those from the logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import conversation, summaries

AS_OF = dt.datetime(2024, 1, 10)
LOG = "session_id string, query string, chunk_id string, chunk_text string, filename string, subject string, chapter string, score double, retrieved_at timestamp"


def log(spark, n=3000, flat=False):
    rng = random.Random(1)
    rows = []
    for _ in range(n):
        chunk = rng.randrange(400) if flat else min(int(rng.paretovariate(0.7)), 400)
        at = AS_OF - dt.timedelta(seconds=rng.randrange(10 * 86_400))
        if rng.random() < 0.05:
            at = dt.datetime(2024, 1, rng.randrange(1, 10))  # on an edge
        rows.append(("s", "q", str(chunk), f"t{chunk % 3}", "f", None if chunk % 5 == 0 else "law", "c", 0.5, at))
    return spark.createDataFrame(rows, LOG).cache()


@pytest.mark.parametrize("as_of", [AS_OF, AS_OF - dt.timedelta(hours=7, seconds=3)])
@pytest.mark.parametrize("by_chunk", [False, True])
def test_top_chunks_are_those_of_the_log(spark, as_of, by_chunk):
    keys = summaries.DESCRIBED[:1] if by_chunk else summaries.DESCRIBED
    for flat in (False, True):
        rows = log(spark, flat=flat)
        for size in (5, 60, 1000):
            daily = summaries.daily_chunks(rows, size, keys)
            for days, limit in ((1, 5), (7, 20), (3650, 20)):
                got = summaries.top_chunks_from_summaries(daily, rows, as_of, days, limit, by_chunk).collect()
                want = conversation.top_chunks(rows, as_of, days, limit, by_chunk).collect()
                assert [(r.chunk_id, r.retrieval_count) for r in got] == [(r.chunk_id, r.retrieval_count) for r in want]


def test_only_candidates_are_counted(spark):
    rows = log(spark)
    daily = summaries.daily_chunks(rows, 60)
    listed, others = summaries._bounds(daily, AS_OF, 7, summaries.DESCRIBED)
    exact = {tuple(r[:5]): r.n for r in rows.filter(F.col("retrieved_at") > AS_OF - dt.timedelta(days=7)).groupBy(*summaries.DESCRIBED).agg(F.count("*").alias("n")).collect()}
    found = {tuple(r[:5]): (r.low, r.high) for r in listed.collect()}
    assert all(low <= exact.get(k, 0) <= high for k, (low, high) in found.items())
    assert all(n <= others for k, n in exact.items() if k not in found)
    bar = sorted((low for low, _ in found.values()), reverse=True)[19]
    assert others < bar and sum(high >= bar for _, high in found.values()) < len(exact) / 3


@pytest.mark.parametrize("as_of", [AS_OF, AS_OF - dt.timedelta(minutes=17, microseconds=5)])
def test_activity_from_sketches(spark, as_of):
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        at = AS_OF - dt.timedelta(seconds=rng.randrange(9 * 86_400)) if i % 20 else dt.datetime(2024, 1, 3 + i % 7, i % 24)
        rows.append((i, f"s{rng.randrange(1500)}", rng.choice(["user", "assistant"]), "x", at))
    history = spark.createDataFrame(rows, "id long, session_id string, role string, content string, created_at timestamp").cache()
    hourly = summaries.hourly_activity(history).cache()
    for days in (1, 3, 7, 3650):
        got = summaries.activity_from_sketches(hourly, history, as_of, days).first()
        want = conversation.activity_counts(history, as_of, days).first()
        assert (got.total_questions, got.questions_today) == (want.total_questions, want.questions_today)
        assert abs(got.sessions_estimate - want.total_sessions) <= max(1, summaries.SESSION_ERROR * want.total_sessions)
    assert hourly.count() < 24 * 10


def test_empty_logs(spark):
    none = spark.createDataFrame([], LOG)
    assert summaries.top_chunks_from_summaries(summaries.daily_chunks(none), none, AS_OF).collect() == []
    turns = spark.createDataFrame([], "id long, session_id string, role string, content string, created_at timestamp")
    assert tuple(summaries.activity_from_sketches(summaries.hourly_activity(turns), turns, AS_OF).first()) == (0, 0, 0)
