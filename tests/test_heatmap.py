"""The live heatmap against the batch one after every load: late rows, corrections, deletions, open days, restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lectern.operators.conversation import confusion_heatmap
from lectern.streaming import heatmap

TURN = "id long, session_id string, role string, content string, created_at timestamp, change int"
LOG = "session_id string, query string, subject string, change int"
START = dt.datetime(2024, 1, 1, 23, 30)
NO = "Sorry, this is not covered."


def batch(spark, turns, log):
    """The batch heatmap of what is left of signed rows."""

    def net(rows, schema):
        counts = {}
        for r in rows:
            counts[r[:-1]] = counts.get(r[:-1], 0) + r[-1]
        return spark.createDataFrame([(*r, 1) for r, n in counts.items() for _ in range(n)], schema)

    found = confusion_heatmap(net(turns, TURN), net(log, LOG), dt.datetime(2024, 2, 1), 365)
    return sorted(tuple(r) for r in found.collect())


def test_every_kind_of_change(spark, tmp_path):
    rng = random.Random(2)
    turns, log = [], []
    for i in range(60):
        at = START + dt.timedelta(seconds=37 * i)
        session = f"s{i % 3}"
        turns.append((2 * i, session, "user", f"q{i % 7}", at, 1))
        turns.append((2 * i + 1, session, "assistant", NO if i % 2 else "an answer", at + dt.timedelta(seconds=rng.choice([0, 5, 60, 119, 120, 121])), 1))
        if i % 4:
            log += [(session, f"q{i % 7}", s, 1) for s in rng.sample(["maths", "law", "", None, "art"], 3)]
    turns.append((500, "s0", "assistant", NO, START + dt.timedelta(seconds=10), 1))
    first = (turns[:80], log[:30])
    second = (turns[80:], log[30:])  # the rest, some of it older than what came before
    gone = [(*t[:-1], -1) for t in turns if t[1] == "s1" or t[0] % 10 == 4]  # a cleared session, and single turns
    wrong = [(*r[:-1], -1) for r in log[::3]] + [(*log[0][:2], "music", 1)]
    steps = [first, second, (gone, wrong), ([(900, "s2", "user", "q0", START, 1)], [("s9", "never asked", "law", 1)])]

    folder, out = str(tmp_path / "in"), str(tmp_path / "heatmap")
    seen_turns, seen_log = [], []
    for n, (some, rows) in enumerate(steps):
        spark.createDataFrame(some, TURN).coalesce(1).write.parquet(f"{folder}/turns/{n}")
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder}/log/{n}")
        streams = [spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(f"{folder}/{k}") for s, k in ((TURN, "turns"), (LOG, "log"))]
        # each step is a query of its own, which goes on from the state of the one before
        heatmap.maintain_heatmap(heatmap.heatmap_changes(*streams), out, str(tmp_path / "state")).awaitTermination()
        seen_turns, seen_log = seen_turns + some, seen_log + rows
        got = sorted(tuple(r) for r in heatmap.read_heatmap(spark, out).collect())
        assert got == batch(spark, seen_turns, seen_log), n
    assert {r[0] for r in got} == {dt.date(2024, 1, 1), dt.date(2024, 1, 2)}


def test_part_of_a_question():
    assert heatmap.part({"d": 2}, {}) == {("d", "Unknown"): 2}
    assert heatmap.part({"d": 2, "e": 1}, {"law": 3, "art": 0}) == {("d", "law"): 6, ("e", "law"): 3}
    assert heatmap.part({}, {"law": 3}) == {} == heatmap.part({"d": 0}, {})


def test_running_a_batch_again_counts_it_once(spark, tmp_path):
    out = str(tmp_path / "heatmap")
    cells = spark.createDataFrame([(dt.date(2024, 1, 1), "law", 2), (dt.date(2024, 1, 1), "law", -1)], heatmap.CELLS)
    for _ in range(2):
        cells.groupBy("day", "subject").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/batch=0")
    assert heatmap.read_heatmap(spark, out).first()["confusion_count"] == 1
