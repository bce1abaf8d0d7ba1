"""Model replies as VARIANT: parsed once, and read field by field whatever types the fields have.

The same results as `jsonops.parse_quiz` and `jsonops.parse_rewrites`, which state the whole shape beforehand. Here an item of
another shape costs that item only, and numbers, nested values and missing fields of a reply stay readable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.jsonops import checked_type, validate_question, variants_in_order, without_fences
from lectern.functions.text import bind

_ITEMS = "array<variant>"


def reply_object(raw: Column) -> Column:
    """The JSON value of a reply: the whole text without code fences, or what lies between its outer braces."""
    text = without_fences(F.coalesce(raw, F.lit("")))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def quiz_items(reply: Column) -> Column:
    """The questions of a parsed reply as they are; null where it is no object with a list of questions."""
    return F.try_variant_get(reply, "$.questions", _ITEMS)


def parse_quiz_variant(raw: Column) -> Column:
    """The valid questions of a quiz reply; malformed ones are dropped, never repaired."""

    def read(item: Column) -> Column:
        def field(name: str, kind: str = "string") -> Column:
            return F.try_variant_get(item, f"$.{name}", kind).alias(name)

        listed = F.struct(field("question"), field("options", "array<string>"), field("correct_index"), field("explanation"))
        return bind(listed, validate_question)

    def checked(reply: Column) -> Column:
        return F.transform(quiz_items(reply), read)

    found = bind(reply_object(raw), checked)
    return F.filter(F.coalesce(found, F.array().cast(checked_type())), lambda q: q.isNotNull())


def parse_rewrites_variant(question: Column, raw: Column, pseudo_answer: Column) -> Column:
    """Query variants in retrieval order, as `parse_rewrites` gives them."""
    listed = F.regexp_extract(without_fences(F.coalesce(raw, F.lit(""))), r"(?s)\[.*\]", 0)
    return variants_in_order(question, F.try_variant_get(F.try_parse_json(listed), "$", "array<string>"), pseudo_answer)
