"""JSON produced by language models, parsed with built-in functions and checked item by item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import bind, strip
from lectern.schemas import QUIZ_PAYLOAD

# Strict JSON: quotes must be double quotes.
STRICT = {"allowSingleQuotes": "false"}


def unpack_metadata(json: Column, fields: Sequence[str]) -> list[Column]:
    """One column per field of a JSON object, read in a single pass over the text."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    parsed = F.from_json(json, schema)
    return [parsed[f].alias(f) for f in fields]


def unpack_by_path(json: Column, fields: Sequence[str]) -> list[Column]:
    """The same by JSON path, for payloads whose nested values must stay JSON text."""
    return [F.get_json_object(json, f"$.{f}").alias(f) for f in fields]


def without_fences(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, "```(json)?", ""))


def parse_rewrites(question: Column, raw: Column, pseudo_answer: Column) -> Column:
    """Query variants in retrieval order: the question, its rewrites, the pseudo answer.

    Each element carries its `kind`, so a missing pseudo answer cannot be mistaken for a
    rewrite. A reply that holds no readable JSON list adds no rewrites.
    """
    listed = F.regexp_extract(without_fences(F.coalesce(raw, F.lit(""))), r"(?s)\[.*\]", 0)
    return variants_in_order(question, F.from_json(listed, T.ArrayType(T.StringType()), STRICT), pseudo_answer)


def variants_in_order(question: Column, items: Column, pseudo_answer: Column) -> Column:
    """The question, the rewrites that are not empty, and the pseudo answer if there is one, each with its kind."""
    rewrites = F.filter(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda r: r.isNotNull() & (r != ""),
    )

    def variant(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    answer = F.when(
        F.length(strip(pseudo_answer)) > 0,
        F.array(variant("pseudo_answer", strip(pseudo_answer))),
    ).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    return F.concat(
        F.array(variant("question", question)),
        F.transform(rewrites, lambda r: variant("rewrite", r)),
        answer,
    )


def parse_quiz(raw: Column) -> Column:
    """The valid questions of a quiz reply; malformed ones are dropped, never repaired."""
    text = without_fences(F.coalesce(raw, F.lit("")))
    whole = F.from_json(text, QUIZ_PAYLOAD, STRICT)["questions"]
    inner = F.from_json(
        F.regexp_extract(text, r"(?s)\{.*\}", 0), QUIZ_PAYLOAD, STRICT
    )["questions"]
    found = F.coalesce(whole, inner)
    checked = F.transform(found, lambda q: validate_question(q))
    return F.filter(
        F.coalesce(checked, F.array().cast(checked_type())), lambda q: q.isNotNull()
    )


def checked_type() -> str:
    return (
        "array<struct<question:string,options:array<string>,correct_index:int,"
        "explanation:string>>"
    )


def validate_question(q: Column) -> Column:
    """A clean question struct, or null when the item breaks a rule."""
    question = strip(q["question"])
    index = F.trim(q["correct_index"]).try_cast("int")
    cleaned = F.filter(
        F.transform(q["options"], lambda o: strip(o)), lambda o: o.isNotNull() & (o != "")
    )

    def check(options: Column) -> Column:
        valid = (
            (F.length(question) > 0)
            & (F.size(q["options"]) >= 2)
            & (F.size(options) >= 2)
            & (index >= 0)
            & (index < F.size(options))
        )
        return F.when(
            valid,
            F.struct(
                question.alias("question"),
                options.alias("options"),
                index.alias("correct_index"),
                F.coalesce(strip(q["explanation"]), F.lit("")).alias("explanation"),
            ),
        )

    return bind(cleaned, check)
