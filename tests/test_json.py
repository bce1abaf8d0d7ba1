import json

from pyspark.sql import functions as F

import pytest

from lectern.functions import jsonops, variants as by_variant


def parse(spark, raw, how=jsonops.parse_quiz):
    df = spark.createDataFrame([(raw,)], "raw string")
    return [q.asDict() for q in df.select(how(F.col("raw")).alias("q")).first()["q"]]


BOTH = pytest.mark.parametrize("how", [jsonops.parse_quiz, by_variant.parse_quiz_variant])


def quiz(**changes):
    item = {"question": " Q? ", "options": ["a", "b", "c"], "correct_index": 1, "explanation": " e "}
    return {**item, **changes}


GOOD = {"question": "Q?", "options": ["a", "b", "c"], "correct_index": 1, "explanation": "e"}


@BOTH
def test_quiz_wrappings(spark, how):
    body = json.dumps({"questions": [quiz()]})
    for raw in (body, f"```json\n{body}\n```", f"Sure!\n{body}\nGood luck"):
        assert parse(spark, raw, how) == [GOOD]
    for raw in (None, "", "no json", "[1, 2]", '{"questions": 3}', '{"other": []}'):
        assert parse(spark, raw, how) == []


@BOTH
def test_quiz_rules(spark, how):
    kept = [quiz(), quiz(correct_index="2"), quiz(options=["a", " ", "b"])]
    dropped = [
        quiz(question=" "), quiz(options=["a"]), quiz(options=["a", ""]), quiz(correct_index=-1),
        quiz(correct_index=3), quiz(correct_index=1.5), quiz(correct_index=None),
        quiz(options=["", "a", "b"], correct_index=2),
    ]
    got = parse(spark, json.dumps({"questions": [*kept, *dropped]}), how)
    assert [g["correct_index"] for g in got] == [1, 2, 1]
    assert got[2]["options"] == ["a", "b"]
    missing = quiz()
    del missing["explanation"]
    assert parse(spark, json.dumps({"questions": [missing]}), how)[0]["explanation"] == ""


def read_variants(spark, question, raw, answer, how):
    df = spark.createDataFrame([(question, raw, answer)], "q string, r string, a string")
    got = df.select(how(F.col("q"), F.col("r"), F.col("a")).alias("v")).first()["v"]
    return [(v["kind"], v["text"]) for v in got]


def test_an_item_of_another_shape_costs_itself(spark):
    raw = json.dumps({"questions": [3, "text", quiz(), {"question": {"a": 1}}, None, quiz(question=7, correct_index="0")]})
    got = parse(spark, raw, by_variant.parse_quiz_variant)
    assert got[0] == GOOD and got[1] == {**GOOD, "question": "7", "correct_index": 0} and len(got) == 2


@pytest.mark.parametrize("how", [jsonops.parse_rewrites, by_variant.parse_rewrites_variant])
def test_rewrites(spark, how):
    def variants(spark, *args):
        return read_variants(spark, *args, how)

    got = variants(spark, "q", 'Here: ```json\n["a", "", "b"]\n``` done', " doc ")
    assert got == [("question", "q"), ("rewrite", "a"), ("rewrite", "b"), ("pseudo_answer", "doc")]
    assert variants(spark, "q", '["a", "b', None) == [("question", "q")]
    assert variants(spark, "q", '["a" "b"]', "") == [("question", "q")]
    assert variants(spark, "q", None, "doc") == [("question", "q"), ("pseudo_answer", "doc")]


def test_unpack(spark):
    df = spark.createDataFrame([('{"a": "1", "b": {"c": 2}}',), ("broken",)], "j string")
    rows = df.select(*jsonops.unpack_metadata(F.col("j"), ["a", "b"])).collect()
    assert (rows[0]["a"], rows[0]["b"]) == ("1", '{"c":2}')
    assert (rows[1]["a"], rows[1]["b"]) == (None, None)
