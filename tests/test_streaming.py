import datetime as dt
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks import streams
from lectern.operators import conversation as batch_ops
from lectern.session import STATE_STORE, shared_folder
from lectern.streaming import conversation as live
from lectern.streaming import heatmap, token_state, tokens

T0 = dt.datetime(2024, 1, 1, 12)
TURNS = "id long, session_id string, role string, content string, created_at timestamp"


def stream_of(spark, folder, schema, *batches):
    """A file stream that sees each batch of rows as one file, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{i:03d}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.json(folder)


def collect(spark, rows, folder, wait=StreamingQuery.awaitTermination):
    query = (
        rows.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    wait(query)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").collect()


def new(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def turn(i, session, role, minutes, content="x"):
    return (i, session, role, content, T0 + dt.timedelta(minutes=minutes))


def test_reply_join_equals_batch_and_drops_late_turns(spark, tmp_path):
    first = [turn(1, "a", "user", 0), turn(2, "a", "assistant", 1), turn(3, "b", "user", 2)]
    second = [turn(4, "b", "assistant", 3), turn(5, "a", "assistant", 2), turn(6, "b", "user", 90), turn(7, "b", "assistant", 90.5)]
    late = [turn(8, "a", "assistant", 1.5), turn(9, "a", "user", 0.5)]
    third = [turn(10, "c", "user", 95), turn(11, "c", "assistant", 99)]
    rows = stream_of(spark, new(tmp_path), TURNS, first, second, third, late)
    got = collect(spark, live.streaming_reply_join(rows), new(tmp_path))
    table = spark.createDataFrame(first + second + third, TURNS)
    want = batch_ops.question_reply_pairs(table, T0 + dt.timedelta(days=1), 7).collect()
    pairs = lambda rs: sorted((r["question_id"], r["reply_id"]) for r in rs)
    assert pairs(got) == pairs(want) == [(1, 2), (3, 4), (6, 7)]


def test_daily_counts_equal_batch_on_closed_days(spark, tmp_path):
    days = [[turn(100 * d + i, f"s{i % 3}", "user" if i % 2 else "assistant", 1440 * d + i) for i in range(7)] for d in range(4)]
    folder = new(tmp_path)
    rows = stream_of(spark, folder, TURNS, *days)
    counts = collect(spark, live.streaming_questions(rows), new(tmp_path))
    got = {str(r["day"]): (r["questions"], r["turns"]) for r in counts}
    assert got == {f"2024-01-0{d}": (3, 7) for d in (1, 2, 3)}
    sessions = collect(spark, live.streaming_sessions(rows), new(tmp_path))
    assert {str(r["day"]): r["sessions"] for r in sessions} == {"2024-01-01": 3, "2024-01-02": 3}


def test_heatmap_equals_batch_on_closed_days(spark, tmp_path):
    def day(d):
        base = 1440 * d
        return [
            turn(10 * d, "a", "user", base, "q"), turn(10 * d + 1, "a", "assistant", base + 1, "pas couvert"),
            turn(10 * d + 2, "b", "user", base + 5, "p"), turn(10 * d + 3, "b", "assistant", base + 6, "not covered"),
        ]
    batches = [day(d) for d in range(4)]
    log = spark.createDataFrame([("a", "q", "Maths"), ("a", "q", "Maths")], "session_id string, query string, subject string")
    rows = stream_of(spark, new(tmp_path), TURNS, *batches)
    got = collect(spark, live.streaming_heatmap(rows, log), new(tmp_path))
    table = spark.createDataFrame([r for b in batches for r in b], TURNS)
    want = batch_ops.confusion_heatmap(table, log, T0 + dt.timedelta(days=9), days=30).collect()
    shaped = lambda rs: sorted((str(r["day"]), r["subject"], r["confusion_count"]) for r in rs)
    assert shaped(got) == [w for w in shaped(want) if w[0] < "2024-01-04"]
    assert len(got) == 6


TOKENS = "session_id string, reply_id long, seq int, token string, done boolean"


def as_tokens(session, reply, words):
    rows = [(session, reply, i, w, False) for i, w in enumerate(words)]
    return [*rows, (session, reply, len(words), None, True)]


REPLIES = {
    ("a", 1): ["Short", ".", " but", " this one", " runs", " on", ",", " then ends", "."],
    ("b", 1): ["no end mark at all in this reply"],
    ("c", 1): [],
    ("d", 7): [" A loop repeats its body;", " tail"],
}
SEGMENTS = {
    ("a", 1): ["Short. but this one runs on,", "then ends."],
    ("b", 1): ["no end mark at all in this reply"],
    ("d", 7): ["A loop repeats its body;", "tail"],
}


def test_segments_in_batch(spark):
    rows = [r for (s, i), w in REPLIES.items() for r in as_tokens(s, i, w)]
    table = tokens.until_done(spark.createDataFrame(rows, TOKENS).withColumn("token", F.coalesce("token", F.lit(""))))
    got = {}
    for r in tokens.segment_tokens(table).orderBy("segment_no").collect():
        got.setdefault((r["session_id"], r["reply_id"]), []).append(r["segment"])
    assert got == SEGMENTS


@pytest.mark.parametrize(
    "segments, wait", [(tokens.segment_stream, StreamingQuery.awaitTermination), (token_state.segment_stream_timers, token_state.drain)]
)
def test_segments_in_a_stream_that_interleaves_sessions(spark, tmp_path, segments, wait):
    rows = [r for (s, i), w in REPLIES.items() for r in as_tokens(s, i, w)]
    after_done = [("a", 1, 99, "ignored after the end.", False)]
    # later stretches come first, and one comes twice
    late = [[r for r in rows if r[2] >= 5], [r for r in rows if 2 <= r[2] < 5], [r for r in rows if r[2] < 5], after_done]
    stream = stream_of(spark, new(tmp_path), TOKENS, *late)
    out = collect(spark, segments(stream), new(tmp_path), wait)
    got = {}
    for r in sorted(out, key=lambda r: r["segment_no"]):
        got.setdefault((r["session_id"], r["reply_id"]), []).append(r["segment"])
    assert got == SEGMENTS


def test_idle_replies_are_flushed_and_forgotten(spark, tmp_path):
    folder, place = new(tmp_path), new(tmp_path)
    first = [("a", 1, 0, "open and", False), ("a", 1, 1, " unfinished", False), ("b", 1, 0, "done", False), ("b", 1, 1, None, True), ("c", 1, 1, "the first is lost", False)]

    def run():
        rows = tokens.segment_stream(stream_of(spark, folder, TOKENS), idle_seconds=1)
        query = (
            rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        got = {(r["session_id"], r["segment"]) for r in spark.read.schema(rows.schema).parquet(f"{place}/out").collect()}
        return got, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    stream_of(spark, folder, TOKENS, first)
    assert run() == ({("b", "done")}, 3)
    time.sleep(4)
    spark.createDataFrame([("z", 1, 0, "next", False)], TOKENS).coalesce(1).write.json(f"{folder}/900")
    got, held = run()
    assert got == {("b", "done"), ("a", "open and unfinished"), ("c", "the first is lost")} and held == 1


def test_idle_replies_leave_no_state_behind(spark, tmp_path):
    """Read with Spark's state reader: what is held of each reply, before and after it was idle."""
    folder, place = new(tmp_path), new(tmp_path)
    first = [("a", 1, 0, "open and", False), ("a", 1, 1, " unfinished", False), ("b", 1, 0, "done", False), ("b", 1, 1, None, True), ("c", 1, 1, "the first is lost", False)]

    def run():
        rows = token_state.segment_stream_timers(stream_of(spark, folder, TOKENS), idle_seconds=25, remember_seconds=600)
        query = (
            rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
            .trigger(availableNow=True).start()
        )
        token_state.drain(query)
        return {(r["session_id"], r["segment"]) for r in spark.read.schema(rows.schema).parquet(f"{place}/out").collect()}

    def held(name):
        return {r["key"]["session_id"] for r in spark.read.format("statestore").option("stateVarName", name).load(f"{place}/state").collect()}

    stream_of(spark, folder, TOKENS, first)
    began = time.time()
    assert run() == {("b", "done")}
    assert (held("front"), held("early"), held("closed")) == ({"a", "c"}, {"c"}, {"b"})
    time.sleep(max(0, began + 45 - time.time()))
    again = [("z", 1, 0, "next", False), ("b", 1, 0, "done", False)]  # a line of an ended reply comes once more
    spark.createDataFrame(again, TOKENS).coalesce(1).write.json(f"{folder}/900")
    assert run() == {("b", "done"), ("a", "open and unfinished"), ("c", "the first is lost")}
    assert (held("front"), held("early"), held("closed")) == ({"z"}, set(), {"b"})


def test_token_lines(spark):
    def message(text, done=False):
        return json.dumps({"message": {"content": text}, "done": done})
    lines = ["", "{broken", message("one"), message(""), message("two"), message("x", True), message("late"), "[1]", "  "]
    df = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(lines)], "session_id string, reply_id long, seq int, line string")
    kept = tokens.until_done(tokens.parse_token_lines(df)).orderBy("seq").collect()
    assert [r["token"] for r in kept] == ["one", "two"]


@pytest.mark.parametrize("kind", ["timers", "heatmap"])
def test_named_state_in_a_session_with_the_default_store(spark, tmp_path, kind):
    mine = spark.newSession()
    mine.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    at = dt.datetime(2024, 1, 1)
    if kind == "timers":
        words = ["One whole sentence", " of some length.", " Rest"]
        lines = stream_of(mine, str(tmp_path / "in"), TOKENS, as_tokens("s", 1, words))
        out = collect(mine, token_state.segment_stream_timers(lines), new(tmp_path), token_state.drain)
        assert sorted(r.segment for r in out) == ["One whole sentence of some length.", "Rest"]
    else:
        turns = [(1, "s", "user", "q", at), (2, "s", "assistant", "Sorry, not covered.", at + dt.timedelta(seconds=5))]
        kinds = "id long, session_id string, role string, content string, created_at timestamp"
        log = stream_of(mine, str(tmp_path / "log"), "session_id string, query string, subject string", [("s", "q", "law")])
        changes = heatmap.heatmap_changes(stream_of(mine, str(tmp_path / "turns"), kinds, turns), log)
        heatmap.maintain_heatmap(changes, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert [tuple(r)[1:] for r in heatmap.read_heatmap(mine, str(tmp_path / "out")).collect()] == [("law", 1)]


def test_shuffled_lines_come_in_three_batches_however_many_files_hold_them(spark, monkeypatch):
    rows = [("s", i, seq, "{}") for i in range(40) for seq in range(9)]
    lines = spark.createDataFrame(rows, "session_id string, reply_id long, seq int, line string")
    monkeypatch.setattr(streams, "token_lines", lambda turns: lines)
    monkeypatch.setattr(streams, "table", lambda *args: lines)
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = streams.shuffled_lines(spark, "")
        folder = shared_folder(spark)
        query = found.writeStream.format("parquet").option("path", f"{folder}/out")
        query = query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert spark.read.parquet(f"{folder}/out").count() == 2 * len(rows)


def test_a_reply_comes_to_the_stateful_function_as_one_row_of_a_batch(spark):
    rows = [("a", 1, seq, "é" * (seq % 3), False) for seq in range(50)] + [("a", 1, 50, None, True), ("b", None, 0, "x", False), ("b", None, None, "y", None)]
    twice = spark.createDataFrame(rows + rows[::-1], TOKENS).repartition(7)
    got = {(r["session_id"], r["reply_id"], *x) for r in tokens.pack_replies(twice).collect() for x in tokens.unpacked(r["tokens"])}
    assert tokens.pack_replies(twice).count() == 2
    assert got == {(s, i, -1 if seq is None else seq, token or "", bool(done)) for s, i, seq, token, done in rows}


def test_tokens_ahead_of_their_turn_are_one_row_of_the_state(spark, tmp_path):
    place = new(tmp_path)
    rows = [("a", 1, seq, f" word{seq}", False) for seq in range(1, 40)]
    stream = token_state.segment_stream_timers(stream_of(spark, new(tmp_path), TOKENS, rows))
    collect(spark, stream, place, token_state.drain)
    reader = spark.read.format("statestore").option("stateVarName", "early")
    assert reader.load(f"{place}/state").count() == 1


def test_tokens_ahead_of_their_turn_are_read_from_older_checkpoints():
    class Held:
        def __init__(self, value):
            self.value = value

        def get(self):
            return self.value

    segments = token_state._Segments(1, 1)
    segments.front, segments.early = Held(("open", 1, 2, 3)), Held(iter([(4, "x", False), (-1, '[[6, "y", false], [7, "", true]]', False)]))
    assert segments._load() == (["open", 1, 2, 3], {4: ("x", False), 6: ("y", False), 7: ("", True)})


def test_broken_lines_are_not_parsed(spark):
    plan = tokens.parse_token_lines(spark.createDataFrame([("{",)], "line string"), keep_gaps=True)._jdf.queryExecution().toString()
    assert "Contains(" in plan


def test_replies_without_an_id_leave_the_ids_of_others_alone(spark, tmp_path):
    lines = [(s, i, seq, token, token is None) for s, i in (("a", None), ("a", 1), ("b", 2)) for seq, token in enumerate([f" words of {s} {i}.", None])]
    out = collect(spark, token_state.segment_stream_timers(stream_of(spark, new(tmp_path), TOKENS, lines)), new(tmp_path), token_state.drain)
    assert {tuple(r) for r in out} == {("a", None, 0, "words of a None."), ("a", 1, 0, "words of a 1."), ("b", 2, 0, "words of b 2.")}
