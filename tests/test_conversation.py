import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.config import HEADER_FALLBACK_PHRASES
from lectern.operators import conversation as ops
from lectern.sources import logs

T0 = dt.datetime(2024, 1, 1, 12)
AS_OF = dt.datetime(2024, 1, 2)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def history(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id long, session_id string, role string, content string, created_at timestamp")


def log(spark, rows):
    return spark.createDataFrame(
        rows, "session_id string, query string, chunk_id string, chunk_text string, filename string, "
        "subject string, chapter string, score double, retrieved_at timestamp",
    )


NO = "this is not covered"


def test_reply_window_is_open_at_both_ends(spark):
    rows = [("s", "user", "q", at(0))] + [
        ("s", "assistant", str(s), at(s)) for s in (-1, 0, 1, 119, 120, 121)
    ] + [("other", "assistant", "x", at(1))]
    pairs = ops.question_reply_pairs(history(spark, rows), AS_OF, 7)
    assert sorted(r["reply"] for r in pairs.collect()) == ["1", "119"]


@pytest.mark.parametrize("offset", [0, 1, 59, 60, 119, 120, 7321])
def test_reply_join_equals_plain_join(spark, offset):
    rows = [("s", "user" if i % 3 else "assistant", str(i), at(offset + i * 17)) for i in range(60)]
    h = history(spark, rows)
    got = ops.question_reply_pairs(h, AS_OF, 7)
    times = {i: (r[1], offset + i * 17) for i, r in enumerate(rows)}
    want = {
        (u, a) for u, (ru, tu) in times.items() for a, (ra, ta) in times.items()
        if ru == "user" and ra == "assistant" and tu < ta < tu + 120
    }
    assert {(r["question_id"], r["reply_id"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_heatmap_counts(spark):
    long_question = "w" * 501
    h = history(spark, [
        ("s", "user", "q", at(0)), ("s", "assistant", NO, at(10)), ("s", "assistant", NO, at(20)),
        ("s", "user", long_question, at(1000)), ("s", "assistant", NO, at(1010)),
        ("t", "user", "no log", at(0)), ("t", "assistant", NO, at(10)),
        ("t", "user", "fine", at(500)), ("t", "assistant", "an answer", at(510)),
    ])
    def row(session, query, subject):
        return (session, query, "c", "t", "f", subject, "", 0.5, at(0))
    logged = log(spark, [
        row("s", "q", "Maths"), row("s", "q", "Maths"), row("s", "q", ""), row("s", "q", None),
        row("s", long_question[:500], "Physics"),
    ])
    counts = {r["subject"]: r["confusion_count"] for r in ops.confusion_heatmap(h, logged, AS_OF).collect()}
    assert counts == {"Maths": 4, "Unknown": 5, "Physics": 1}
    distinct = ops.confusion_heatmap(h, logged, AS_OF, distinct_questions=True)
    assert {r["subject"]: r["confusion_count"] for r in distinct.collect()} == {"Maths": 1, "Unknown": 2, "Physics": 1}
    exact = ops.confusion_heatmap(h, logged, AS_OF, query_chars=None)
    assert {r["subject"]: r["confusion_count"] for r in exact.collect()} == {"Maths": 4, "Unknown": 6}
    shares = ops.confusion_by_subject(ops.confusion_heatmap(h, logged, AS_OF)).collect()
    assert [(r["subject"], r["share_of_max"]) for r in shares] == [("Unknown", 100.0), ("Maths", 80.0), ("Physics", 20.0)]


def test_unanswered_limit_keeps_the_newest(spark):
    rows = []
    for i in range(8):
        rows += [("s", "user", f"q{i}", at(i * 1000)), ("s", "assistant", NO, at(i * 1000 + 5))]
    logged = log(spark, [("s", "q7", str(k), "t", "f", "Maths", "", 0.5, at(0)) for k in range(3)])
    got = ops.unanswered_questions(history(spark, rows), logged, AS_OF, limit=4).collect()
    assert [(r["question"], r["subject"]) for r in got] == [
        ("q7", "Maths"), ("q7", "Maths"), ("q7", "Maths"), ("q6", "Unknown"),
    ]


def test_summary(spark):
    h = history(spark, [
        ("a", "user", "q", at(0)), ("a", "assistant", NO, at(10)), ("a", "assistant", "pas couvert", at(20)),
        ("b", "user", "q", at(100)), ("b", "assistant", "je ne sais pas", at(110)),
        ("c", "user", "old", at(-40 * 86400)),
    ])
    row = ops.activity_summary(h, AS_OF, phrases=HEADER_FALLBACK_PHRASES).first()
    assert tuple(row) == (2, 2, 2, 2, 100.0)
    six = ops.confusion_rate(h, AS_OF).first()
    assert six["confusion_rate"] == 150.0
    once = ops.confusion_rate(h, AS_OF, distinct_questions=True).first()
    assert once["confusion_rate"] == 100.0
    empty = ops.activity_summary(h.limit(0), AS_OF).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0)


def test_last_turns(spark):
    h = history(spark, [("s", "user", str(i), at(i)) for i in range(30)] + [("t", "user", "x", at(0))])
    rows = ops.last_n_turns(h).filter("session_id = 's'").orderBy("position").collect()
    assert [r["content"] for r in rows] == [str(i) for i in range(10, 30)]
    assert [r["position"] for r in rows] == list(range(1, 21))
    assert [r["content"] for r in ops.load_history(h, "s", 2).collect()] == ["26", "27", "28", "29"]


def test_top_chunks_by_text_and_by_id(spark):
    logged = log(spark, [("s", "q", "1", f"cut {i % 2}", "f", "m", "c", 0.5, at(i)) for i in range(5)])
    assert ops.top_chunks(logged, AS_OF).first()["retrieval_count"] == 3
    row = ops.top_chunks(logged, AS_OF, by_chunk=True).first()
    assert (row["retrieval_count"], row["chunk_text"], row["last_retrieved"]) == (5, "cut 0", at(4))


def test_stored_logs(spark, tmp_path):
    turns, clears = str(tmp_path / "turns"), str(tmp_path / "clears")
    h = history(spark, [("a", "user", "q", at(0)), ("b", "user", "q", at(0)), ("a", "user", "later", at(100))])
    logs.append_turns(h, turns)
    assert logs.read_history(spark, turns, clears).count() == 3
    logs.append_clears(spark.createDataFrame([("a", at(50))], "session_id string, cleared_at timestamp"), clears)
    assert sorted(r["content"] for r in logs.read_history(spark, turns, clears).collect()) == ["later", "q"]
    with pytest.raises(Exception, match="unknown role: system"):
        logs.append_turns(h.withColumn("role", F.lit("system")), turns)
    everything = spark.createDataFrame([("a", None)], "session_id string, cleared_at timestamp")
    assert ops.clear_history(h, everything).count() == 1
    assert logs.read_history(spark, turns, since=dt.date(2024, 1, 2)).count() == 0


def test_repeated_batch_leaves_no_row_twice(spark, tmp_path):
    path = str(tmp_path / "turns")
    h = history(spark, [("a", "user", "q", at(0))])
    for batch in (0, 0, 1):
        logs.append_turns(h, path, batch)
    assert logs.read_history(spark, path).count() == 2


def test_retrieval_rows(spark):
    source = "chunk_id: string, chunk_text: string, page_content: string, subject: string, score: double"
    rows = [
        ("s", "q" * 600, at(0), [("1", "t" * 400, "p", "m", 0.5), (None, None, "page", None, None)]),
        ("t", "q", at(0), []),
    ]
    df = spark.createDataFrame(rows, f"session_id string, query string, retrieved_at timestamp, sources array<struct<{source}>>")
    got = sorted(logs.retrieval_rows(df).collect(), key=lambda r: r["chunk_id"])
    assert len(got) == 2
    assert (got[0]["chunk_id"], got[0]["chunk_text"], got[0]["subject"], got[0]["score"]) == ("", "page", "", 0.0)
    assert logs.retrieval_rows(df, keep_empty=True).filter("session_id = 't'").first()["subject"] == ""
    assert (len(got[1]["query"]), len(got[1]["chunk_text"]), got[1]["filename"]) == (500, 300, "")


@pytest.mark.parametrize("turns", [1, 2, 10])
def test_history_before_equals_brute_force(spark, turns):
    said = [(i, "s" if i % 4 else "t", "user", f"c{i}", T0 + dt.timedelta(hours=(i * 7) % 97)) for i in range(60)]
    asked = [(i, "s" if i % 3 else "t", T0 + dt.timedelta(hours=i * 5 - 10)) for i in range(25)] + [(99, "new", T0)]
    h = spark.createDataFrame(said, "id long, session_id string, role string, content string, created_at timestamp")
    m = spark.createDataFrame(asked, "message_id long, session_id string, asked_at timestamp")
    got = {r["message_id"]: [t["content"] for t in r["history"]] for r in ops.history_before(m, h, turns).collect()}
    for message, session, when in asked:
        before = sorted((t[4], t[0], t[3]) for t in said if t[1] == session and t[4] < when)
        assert got[message] == [c for _, _, c in before][-2 * turns:]
    assert len(got) == 26


def test_batch_and_stream_share_a_log(spark, tmp_path):
    when = dt.datetime(2024, 1, 2, 10)
    schema = "id long, session_id string, role string, content string, created_at timestamp"
    path = f"{tmp_path}/history"
    logs.append_turns(spark.createDataFrame([(1, "s", "user", "by a job", when)], schema), path)
    for _ in range(2):  # a micro-batch that runs again replaces itself
        logs.append_turns(spark.createDataFrame([(2, "s", "assistant", "by a stream", when)], schema), path, batch=0)
    logs.append_turns(spark.createDataFrame([(3, "s", "user", "by a job", when)], schema), path)
    assert sorted(r["id"] for r in logs.read_history(spark, path).collect()) == [1, 2, 3]


def test_a_refused_question_is_logged_without_a_chunk(spark, tmp_path):
    asked = spark.createDataFrame(
        [("s", "q", dt.datetime(2024, 1, 2), [])],
        "session_id string, query string, retrieved_at timestamp, sources array<struct<chunk_id: string, chunk_text: string>>",
    )
    logs.append_retrievals(asked, f"{tmp_path}/log")
    row = logs.read_retrievals(spark, f"{tmp_path}/log").first()
    assert (row["query"], row["chunk_id"], row["subject"], row["score"]) == ("q", "", "", 0.0)
