import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.operators import bm25, evaluation as ops, retrieval
from lectern.operators.chunks import with_embedding
from lectern.plans.evaluate import evaluate
from lectern.plans.quiz import quiz_envelopes, quiz_requests
from lectern.sources import results as store

# Expected verdict and best score of the 24 questions of a recorded run, in order.
RECORDED = [
    ("correct", 0.951), ("correct", 0.992), ("correct", 0.947), ("correct", 0.001),
    ("correct", 0.822), ("correct", 0.998), ("correct", 0.781), ("correct", 0.026),
    ("ambiguous", 0.233), ("ambiguous", 0.065), ("ambiguous", 0.028), ("ambiguous", 0.175),
    ("ambiguous", 0.022), ("ambiguous", 0.082), ("ambiguous", 0.602), ("ambiguous", 0.09),
    ("incorrect", 0.0), ("incorrect", 0.002), ("incorrect", 0.0), ("incorrect", 0.001),
    ("incorrect", 0.0), ("incorrect", 0.001), ("incorrect", 0.0), ("incorrect", 0.002),
]


@pytest.fixture(scope="module")
def recorded(spark):
    rows = [(i, *r) for i, r in enumerate(RECORDED)]
    return spark.createDataFrame(rows, "seq long, expected_verdict string, top_score double")


def test_recorded_run(spark, recorded):
    row = ops.concordance(ops.regrade(recorded)).first()
    assert (row["matches"], row["total"], row["rate"]) == (21, 24, 0.875)


def test_recalibration(spark, recorded):
    for hi, lo, want in ((0.25, 0.01, 21), (0.7, 0.3, 15), (2.0, -2.0, 8)):
        assert ops.concordance(ops.regrade(recorded, Settings(correct_above=hi, incorrect_below=lo))).first()["matches"] == want
    tried = ops.recalibrate(recorded, [0.25, 0.7, 2.0], [-2.0, 0.01, 0.3])
    got = {(r["correct_above"], r["incorrect_below"]): r["matches"] for r in tried.collect()}
    assert got[(0.25, 0.01)] == 21 and got[(0.7, 0.3)] == 15 and got[(2.0, -2.0)] == 8
    assert (0.25, 0.3) not in got
    best = ops.best_thresholds(tried).first()
    assert (best["correct_above"], best["incorrect_below"], best["matches"]) == (0.7, 0.01, 22)


def test_grade_is_monotone(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("s")).orderBy("s")
    order = {"incorrect": 0, "ambiguous": 1, "correct": 2}
    got = [order[r["g"]] for r in df.select(retrieval.grade(F.col("s")).alias("g")).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("stretch", [1, 5, 1000])
def test_running_concordance(spark, recorded, stretch):
    runs = ops.regrade(recorded).withColumn("run", F.lit("r"))
    rows = ops.running_concordance(runs, stretch=stretch).orderBy("seq").collect()
    assert [r["total_so_far"] for r in rows] == list(range(1, 25))
    assert rows[3]["matches_so_far"] == 3 and rows[-1]["matches_so_far"] == 21
    assert rows[3]["rate_so_far"] == 0.75


def test_empty_concordance(spark, recorded):
    row = ops.concordance(ops.regrade(recorded).limit(0)).first()
    assert tuple(row) == (0, 0, 0.0)


def test_top_score(spark):
    df = spark.createDataFrame(
        [(1, [("0.5",), ("x",), ("0.75",)]), (2, []), (3, None)], "i int, s array<struct<score: string>>"
    )
    got = [r[0] for r in df.orderBy("i").select(ops.top_score(F.col("s"))).collect()]
    assert got == [0.75, None, None]


def test_metric_means_ignore_failures(spark):
    df = spark.createDataFrame([(1, 0.5, float("nan")), (2, 1.0, None)], "i int, a double, b double")
    got = {r["metric"]: tuple(r)[1:] for r in ops.metric_means(df, ["i"], ["a", "b"]).collect()}
    assert got == {"a": (0.75, 2, 0), "b": (None, 0, 2)}


def test_grade_quiz(spark):
    key = spark.createDataFrame([("q", i, 0) for i in range(10)], "quiz_id string, q_idx int, correct_index int")
    answers = [(f"a{n}", "q", i, 0 if i < n else 1) for n in (10, 7, 4, 3) for i in range(10)]
    answers += [("short", "q", 0, 0)]
    df = spark.createDataFrame(answers, "attempt_id string, quiz_id string, q_idx int, chosen int")
    got = {r["attempt_id"]: (r["correct"], r["percent"], r["message"]) for r in ops.grade_quiz(df, key).collect()}
    assert got["a10"] == (10, 100, "All correct.") and got["a7"][1:] == (70, "Well understood.")
    assert got["a4"][1] == 40 and got["a3"][2] == "Go back to this topic." and got["short"][:2] == (1, 10)


def test_questions_file(spark, tmp_path):
    good = [{"question": "q", "category": "in_scope", "expected_verdict": "correct"}]
    bad = [*good, {"question": "p", "category": "x", "expected_verdict": "maybe"}]
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    assert store.read_eval_questions(spark, str(tmp_path / "good.json")).first()["category"] == "in_scope"
    with pytest.raises(Exception, match="invalid expected_verdict for p: maybe"):
        store.read_eval_questions(spark, str(tmp_path / "bad.json")).collect()


def corpus(spark):
    texts = ["a loop repeats its body while a test holds", "a tuple never changes after it is made"]
    df = spark.createDataFrame([(i, t, "f.pdf") for i, t in enumerate(texts)], "chunk_id long, chunk_text string, filename string")
    chunks = with_embedding(df)
    return retrieval.SearchCorpus(chunks, bm25.bm25_index(chunks), ("filename",))


def questions(spark):
    rows = [(1, "a loop repeats", "in_scope", "correct"), (2, "zebra stripes", "out_of_scope", "incorrect"), (3, "a tuple", "in_scope", "incorrect")]
    return spark.createDataFrame(rows, "question_id long, question string, category string, expected_verdict string")


def test_evaluate_and_store(spark, tmp_path):
    asked = questions(spark)
    answers = spark.createDataFrame([(1, "it repeats"), (3, "")], "question_id long, answer string")
    rows = evaluate(asked, corpus(spark), answers, variants=retrieval.single_variant(asked))
    path = str(tmp_path / "eval")
    store.append_eval_rows(rows, f"{path}/running")
    progress = store.eval_progress(spark, f"{path}/running").first()
    assert (progress["matches"], progress["total"]) == (2, 3)
    store.write_eval_results(rows, path)
    saved = {r["question"]: r for r in store.read_eval_results(spark, path).collect()}
    assert saved["a loop repeats"]["match"] and saved["a loop repeats"]["num_sources"] == 2
    assert saved["a loop repeats"]["context_texts"] and saved["a loop repeats"]["error"] is None
    assert saved["zebra stripes"]["obtained_verdict"] == "incorrect" and saved["zebra stripes"]["top_score"] == 0.0
    assert saved["zebra stripes"]["answer"] is None and saved["zebra stripes"]["num_sources"] == 0
    assert saved["a tuple"]["error"] and not saved["a tuple"]["match"]
    summary = spark.read.json(f"{path}/summary").first()
    assert (summary["total_questions"], summary["concordance_matches"], summary["eligible_count"]) == (3, 2, 1)
    assert ops.mismatch_report(store.read_eval_results(spark, path)).count() == 0


def test_nested_results_document(spark, tmp_path):
    row = {"question": "q", "expected_verdict": "correct", "obtained_verdict": "correct", "match": True,
           "top_score": 0.5, "answer": "a", "context_texts": ["c"], "num_sources": 1, "error": None}
    doc = {"status": "complete", "total_questions": 2, "per_question": [row, {**row, "answer": None}]}
    (tmp_path / "results.json").write_text(json.dumps(doc, indent=2))
    rows = store.read_eval_document(spark, str(tmp_path / "results.json"))
    assert rows.count() == 2
    assert tuple(ops.eligibility_counts(rows).first()) == (1, 1)


def test_quiz_envelopes(spark):
    asked = spark.createDataFrame(
        [(1, " Loops ", "3"), (2, " ", "3"), (3, "Cooking", None), (4, "Lists", "99")],
        "request_id int, topic string, num_questions string",
    ).withColumn("language", F.lit("French"))
    requests = quiz_requests(asked)
    assert [r["num_questions"] for r in requests.orderBy("request_id").collect()] == [3, 3, 5, 10]
    found = spark.createDataFrame(
        [(1, "correct", "ctx", ["s"]), (2, "correct", "ctx", ["s"]), (3, "incorrect", "", None), (4, "ambiguous", "ctx", ["s"])],
        "request_id int, grade string, context string, sources array<string>",
    )
    quiz = json.dumps({"questions": [{"question": "Q", "options": ["a", "b"], "correct_index": 0}]})
    replies = spark.createDataFrame([(1, quiz), (2, quiz), (3, quiz), (4, "nothing")], "request_id int, raw string")
    got = {r["request_id"]: r for r in quiz_envelopes(requests, found, replies).collect()}
    assert got[1]["grounded"] and got[1]["topic"] == "Loops" and len(got[1]["questions"]) == 1
    assert [got[i]["grounded"] for i in (2, 3, 4)] == [False] * 3
    assert len({got[i]["error"] for i in (2, 3, 4)}) == 3 and not got[4]["questions"]


def test_best_of_all_thresholds(spark):
    rng = random.Random(5)
    for n in (1, 7, 60):
        rows = [(rng.choice([None, *(k / 8 for k in range(-3, 9))]), rng.choice(["correct", "ambiguous", "incorrect"])) for _ in range(n)]
        rows.append((0.5, "correct"))
        scores = [s for s, _ in rows if s is not None]
        values = sorted({*scores, min(scores) - 1, max(scores) + 1})

        def matches(hi, lo):
            graded = ["incorrect" if s is None else "correct" if s > hi else "incorrect" if s < lo else "ambiguous" for s, _ in rows]
            return sum(g == e for g, (_, e) in zip(graded, rows))

        want = min(((-matches(hi, lo), hi, lo) for hi in values for lo in values if lo <= hi))
        df = spark.createDataFrame(rows, "top_score double, expected_verdict string")
        got = ops.best_thresholds_exact(df.repartition(5)).first()
        assert (-got["matches"], got["correct_above"], got["incorrect_below"]) == want and got["total"] == len(rows)
    none = spark.createDataFrame([(None, "correct")], "top_score double, expected_verdict string")
    assert ops.best_thresholds_exact(none).collect() == []
