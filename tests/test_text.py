import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import language, text


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


def many(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_clean_text(spark):
    given_ = [None, "", "   ", "a\x0cb", "a\x00b", "a\n\n\n\n\nb", "a \t  b", "  a  "]
    want = [None, "", "", "a\nb", "ab", "a\n\nb", "a b", "a"]
    assert many(spark, given_, text.clean_text) == want


def test_word_count(spark):
    assert many(spark, [None, "", " x y ", "x  y\nz"], text.word_count) == [None, 1, 4, 3]


def test_assemble_sections_keeps_original_numbers(spark):
    got = one(spark, ["a", "", None, "b"], lambda c: text.assemble_sections(c, "Page"), "array<string>")
    assert got == "[Page 1]\na\n\n[Page 4]\nb"


@pytest.mark.parametrize(
    "name, want",
    [
        ("a_b_c.pdf", ("a", "b", "c")),
        ("a__c.pdf", ("a", "Unknown", "c")),
        ("a.pdf", ("a", "Unknown", "Unknown")),
        (".pdf", (".pdf", "Unknown", "Unknown")),
        ("a_b_c_d.pptx", ("a", "b", "c")),
        ("no_ext", ("no", "ext", "Unknown")),
        ("Smith_LinearAlgebra_Ch3.v2.pdf", ("Smith", "LinearAlgebra", "Ch3.v2")),
    ],
)
def test_parse_filename(spark, name, want):
    assert tuple(one(spark, name, text.parse_filename)) == want


def test_sanitise_label(spark):
    given_ = ['"Linear Algebra."\nrest', "  ", "!?", None, "\nBiology"]
    assert many(spark, given_, text.sanitise_label) == ["Linear Algebra", "Unknown", "Unknown", "Unknown", "Biology"]


def test_doc_type(spark):
    assert many(spark, ["a.PDF", "b.Pptx", "c.txt", "pdf"], text.doc_type) == ["pdf", "pptx", "unknown", "unknown"]


def test_preview(spark):
    assert many(spark, ["abc", "abcd", None], lambda c: text.preview(c, 3)) == ["abc", "abc…", None]


def test_time_ago(spark):
    now = dt.datetime(2024, 1, 5)
    ages = [0, 59, 60, 3599, 3600, 86399, 86400, 200000]
    times = [now - dt.timedelta(seconds=s) for s in ages] + [None]
    got = many(spark, times, lambda c: text.time_ago(c, now), "timestamp")
    assert got == ["0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago", "—"]


def test_severity_band(spark):
    assert many(spark, [30.1, 30.0, 15.1, 15.0], text.severity_band, "double") == ["bad", "warn", "warn", "good"]


def test_split_sentences(spark):
    given_ = "One long sentence here. Tiny. هل هذا سؤال طويل بما يكفي؟ The last one has no end"
    want = ["One long sentence here.", "هل هذا سؤال طويل بما يكفي؟", "The last one has no end"]
    assert one(spark, given_, text.split_sentences) == want


def test_is_fallback(spark):
    given_ = ["It is NOT COVERED", "we haven't covered it", "Pas ABORDÉ", "je ne sais pas", "fine"]
    assert many(spark, given_, text.is_fallback) == [True, True, True, True, False]


def test_verdict_and_count(spark):
    assert many(spark, [" Yes.", "no", "partial", "maybe", None], text.parse_verdict) == [
        "correct", "incorrect", "ambiguous", "ambiguous", "ambiguous",
    ]
    assert many(spark, ["7", "0", "99", "x", "7.5", None], text.clamp_count) == [7, 1, 10, 5, 5, 5]


def test_prompts(spark):
    rows = [("correct", "ctx"), ("ambiguous", "ctx"), ("incorrect", "ctx"), ("correct", "")]
    df = spark.createDataFrame(rows, "grade string, ctx string")
    built = [
        r["p"]
        for r in df.select(
            text.build_prompt(F.lit("Q"), F.col("ctx"), F.lit("French"), F.col("grade")).alias("p")
        ).collect()
    ]
    assert "ctx" in built[0] and built[0].endswith("Reply in French.")
    assert "ctx" in built[1] and built[1].endswith(text.HEDGE_NOTE)
    assert "ctx" not in built[2] and built[2].endswith(text.REFUSE_NOTE)
    assert built[3] == "Q\n\nReply in French."


def test_model_prompts(spark):
    df = spark.createDataFrame([("Why?", "ctx", [("user", "hi"), ("assistant", "yes")])], "q string, c string, h array<struct<role: string, content: string>>")
    row = df.select(
        text.rewrite_prompt(F.col("q")).alias("r"), text.pseudo_answer_prompt(F.col("q")).alias("p"),
        text.judge_prompt(F.col("q"), F.col("c")).alias("j"),
        text.quiz_prompt(F.col("q"), F.col("c"), F.lit(3), F.lit("French")).alias("z"),
        text.chat_messages(F.col("h"), F.lit("ask"), F.lit("French")).alias("m"),
    ).first()
    assert "Why?" in row["r"] and "Why?" in row["p"] and "Why?" in row["j"] and "ctx" in row["j"]
    assert "Write 3 multiple choice questions in French" in row["z"] and "ctx" in row["z"]
    assert [m["role"] for m in row["m"]] == ["system", "user", "assistant", "user"]
    assert "French" in row["m"][0]["content"] and row["m"][-1]["content"] == "ask"


def test_session_ids(spark):
    got = many(spark, ["s1", "", None], text.session_id_or_new)
    assert got[0] == "s1" and len(got[1]) == 36 and got[1] != got[2]


# ---- chunking ----------------------------------------------------------------------------


def model_chunks(body: str, size: int) -> list[str]:
    """What chunking means, told with positions in plain Python: fill, flush, go finer."""

    def fill(part, level):
        if level == len(text.SEPARATORS):
            return [part[i : i + size] for i in range(0, len(part), size)]
        sep, out, held = text.SEPARATORS[level], [], []
        for piece in part.split(sep):
            if len(sep.join([*held, piece])) <= size:
                held = [*held, piece] if held or piece else []
                continue
            out += [sep.join(held)] if held else []
            held = []
            if len(piece) > size:
                out += fill(piece, level + 1)
            elif piece:
                held = [piece]
        return out + ([sep.join(held)] if held else [])

    return fill(body, 0)


EDGES = [
    "x" * 40, "x" * 41, "word " * 100, "y" * 5000, "\n\n\n\n", "\n\nab", "a. b. c", "",
    "one two\n\nthree four. five six\nseven", "é" * 90, ". . . ", " lead", "trail ",
]


@pytest.mark.parametrize("size", [5, 40])
def test_chunks_match_the_model(spark, size):
    got = many(spark, EDGES, lambda c: text.recursive_chunk(c, size))
    assert got == [model_chunks(e, size) for e in EDGES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab. \né", max_size=60), min_size=1, max_size=20))
def test_chunk_properties(spark, texts):
    chunks = many(spark, texts, lambda c: text.recursive_chunk(c, 7))
    assert chunks == [model_chunks(t, 7) for t in texts]
    assert all(len(c) <= 7 for listed in chunks for c in listed)
    overlapped = many(spark, texts, lambda c: text.add_overlap(text.recursive_chunk(c, 7), 3))
    for raw, made in zip(chunks, overlapped):
        want = [c if i == 0 else raw[i - 1][-3:] + " " + c for i, c in enumerate(raw)]
        assert made == [w.strip() for w in want]


def test_drop_short(spark):
    got = one(spark, ["x" * 30, "y" * 31], text.drop_short, "array<string>")
    assert got == ["y" * 31]


# ---- language ----------------------------------------------------------------------------


def test_language(spark):
    given_ = [
        "What is the use of a loop in this language?", "Qu'est-ce que les boucles et pour qui ?",
        "Was ist der Unterschied und die Regel?", "", None, "12345",
    ]
    assert many(spark, given_, language.detect_language) == ["en", "fr", "de", "unknown", "unknown", "unknown"]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    right = language.detect_language(F.col("text")) == F.col("lang")
    share = docs.agg(F.avg(right.cast("int"))).first()[0]
    assert share > 0.85


def test_reply_language_defaults(spark):
    df = spark.createDataFrame([("hi",), ("the of and to is that",), ("zzz qqq",), (None,)], "t string")
    rows = language.detect_reply_language(df, "t").collect()
    assert [r["lang_name"] for r in rows] == ["French", "English", "French", "French"]


def test_subject_fallback(spark):
    rows = [("Algebra", "matrix"), ("Unknown", "a matrix and a vector"), ("Unknown", ""), ("Unknown", "zzz")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = [r[0] for r in df.select(language.subject_fallback(F.col("s"), F.col("t"))).collect()]
    assert got == ["Algebra", "Linear Algebra", "Unknown", "Unknown"]
