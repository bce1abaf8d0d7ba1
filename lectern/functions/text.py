"""Scalar text functions: every one takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, DOCUMENT_TYPES, PASSAGE_RULE

# Unicode white space plus the four ASCII separators that also count as blank.
BLANK = r"[\s\x1c-\x1f]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it.

    A column that is used inside a lambda would otherwise be computed for every element.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove every kind of Unicode white space from both ends."""
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def strip_ends(c: Column) -> Column:
    """`strip` for a column that costs nothing: a text without white space at its ends is not searched for it."""
    filled = r"(?U)[^\s\x1c-\x1f]"
    ends = F.substring(c, 1, 1).rlike(filled) & F.right(c, F.lit(1)).rlike(filled)
    return F.when(ends, c).otherwise(strip(c))


def tokens(c: Column) -> Column:
    """Case-sensitive tokens between runs of Unicode white space; null text has none."""
    parts = F.split(F.coalesce(c, F.lit("")), rf"(?U){BLANK}+")
    return F.filter(parts, lambda t: t != "")


# ---- extraction clean-up -----------------------------------------------------------------


def clean_text(c: Column) -> Column:
    """Drop NULs, turn form feeds into newlines, squeeze newlines and blanks, strip."""
    c = F.translate(c, "\f\x00", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "[ \t]{2,}", " ")
    return strip(c)


def assemble_sections(parts: Column, label: str) -> Column:
    """Number the parts from 1, drop the empty ones and join the rest by a blank line."""
    headed = F.transform(
        parts,
        lambda part, i: F.when(
            F.length(part) > 0,
            F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("]\n"), part),
        ),
    )
    return F.array_join(headed, "\n\n")


# ---- names and labels --------------------------------------------------------------------


def parse_filename(filename: Column) -> Column:
    """`Professor_Subject_Chapter.ext` as a struct; what is blank or missing is Unknown."""
    stem = F.regexp_replace(filename, r"^(.+)\.[^.]+$", "$1")
    fields = F.split(stem, "_")

    def part(i: int) -> Column:
        value = strip(F.get(fields, F.lit(i)))
        return F.coalesce(F.nullif(value, F.lit("")), F.lit("Unknown"))

    return F.struct(
        part(0).alias("professor"), part(1).alias("subject"), part(2).alias("chapter")
    )


def sanitise_label(c: Column) -> Column:
    """First line without quotes and sentence punctuation; blank becomes Unknown."""
    first = F.split(strip(c), "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", 2)[0]
    bare = strip(F.regexp_replace(first, "[\"'.,;:!?]", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Unknown"))


def doc_type(filename: Column) -> Column:
    """File type by its suffix, in any letter case."""
    name = F.lower(filename)
    out = reduce(
        lambda acc, ext: acc.when(name.endswith("." + ext), F.lit(ext)),
        DOCUMENT_TYPES[1:],
        F.when(name.endswith("." + DOCUMENT_TYPES[0]), F.lit(DOCUMENT_TYPES[0])),
    )
    return out.otherwise(F.lit("unknown"))


def word_count(c: Column) -> Column:
    """Parts between white-space runs, counting the empty part a padded text starts with."""
    return F.when(c.isNotNull(), F.size(F.split(c, r"\s+")))


# ---- display -----------------------------------------------------------------------------


def preview(c: Column, chars: int = 200) -> Column:
    """The first `chars` characters, with an ellipsis when something was left out."""
    return F.when(
        F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))
    ).otherwise(c)


def instant(at: dt.datetime) -> Column:
    """A point in time; one without a zone is in UTC, whatever the zone of the driver."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc))


def time_ago(ts: Column, as_of: dt.datetime | Column) -> Column:
    """`5s ago`, `3m ago`, `2h ago`, `9d ago`; a dash when there is no time."""
    now = as_of if isinstance(as_of, Column) else instant(as_of)
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    secs = F.floor(micros / F.lit(1_000_000))

    def whole(unit: int) -> Column:
        return F.floor(secs / F.lit(unit)).cast("string")

    return (
        F.when(ts.isNull(), F.lit("—"))
        .when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
        .when(secs < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(secs < 86400, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86400), F.lit("d ago")))
    )


def severity_band(rate: Column) -> Column:
    return F.when(rate > 30, "bad").when(rate > 15, "warn").otherwise("good")


# ---- sentences ---------------------------------------------------------------------------


def split_sentences(c: Column, longer_than: int = 15) -> Column:
    """Sentences ending in . ! ? or the Arabic question mark, kept when long enough."""
    # of a stripped text, cut at whole runs of blanks, no part has a blank at its ends
    parts = F.split(strip(c), rf"(?U)(?<=[.!?؟]){BLANK}+")
    return F.filter(parts, lambda s: F.length(s) > longer_than)


# ---- prompts -----------------------------------------------------------------------------

REFUSE_NOTE = (
    "\n\nNothing in the course material answers this. Say so kindly, point the student to "
    "the instructor or to further reading, and make nothing up."
)
HEDGE_NOTE = (
    "\n\nThe course material answers this only in part. Use what is there and name the "
    "parts that it leaves open."
)


def grade_suffix(grade: Column) -> Column:
    """What a prompt must add for a grade."""
    return (
        F.when(grade == "incorrect", REFUSE_NOTE)
        .when(grade == "ambiguous", HEDGE_NOTE)
        .otherwise("")
    )


def build_prompt(question: Column, context: Column, language: Column, grade: Column) -> Column:
    """Grounded, refusing or pass-through prompt, chosen by grade and context."""
    reply_in = F.when(
        F.length(language) > 0, F.concat(F.lit("Reply in "), language, F.lit("."))
    ).otherwise("")
    ask = F.concat(F.lit("Student question: "), question, F.lit("\n\n"), reply_in)
    grounded = F.concat(
        F.lit("Answer from this course material.\n\n<<<\n"), context, F.lit("\n>>>\n\n"), ask
    )
    return (
        F.when(grade == "incorrect", F.concat(ask, F.lit(REFUSE_NOTE)))
        .when(F.length(context) > 0, F.concat(grounded, grade_suffix(grade)))
        .otherwise(F.concat(question, F.lit("\n\n"), reply_in))
    )


def evaluation_prompt(question: Column, context: Column) -> Column:
    """The short grounded prompt used when answers are generated in bulk."""
    return F.concat(
        F.lit("Answer from this course material.\n\n<<<\n"),
        context,
        F.lit("\n>>>\n\nStudent question: "),
        question,
        F.lit("\n\nKeep the answer short and use nothing but the material."),
    )


def rewrite_prompt(question: Column, rewrites: int = 3) -> Column:
    """Asks a model for rewrites of a question; the reply goes to `parse_rewrites`."""
    return F.concat(
        F.lit(f"Write {rewrites} other full questions that ask the same as the one below, with "
              "other words and the terms a textbook would use. Reply with a JSON array of "
              "strings and nothing else.\n\nQuestion: "),
        question,
    )


def pseudo_answer_prompt(question: Column) -> Column:
    """Asks a model for the textbook passage that would answer a question."""
    return F.concat(
        F.lit("Write the three or four sentences of a textbook that would answer this question. "
              "The wording matters more than the facts.\n\nQuestion: "),
        question,
    )


def judge_prompt(question: Column, passages: Column) -> Column:
    """Asks a model whether passages answer a question; the reply goes to `parse_verdict`."""
    return F.concat(
        F.lit("Do these passages answer the question? Reply with one word: yes, partial or no."
              "\n\nQuestion: "),
        question,
        F.lit("\n\nPassages:\n"),
        passages,
    )


def quiz_prompt(topic: Column, context: Column, count: Column, language: Column) -> Column:
    """Asks a model for a quiz on course material; the reply goes to `parse_quiz`."""
    return F.concat(
        F.lit("Write "), count.cast("string"), F.lit(" multiple choice questions in "), language,
        F.lit(" on the topic \""), strip(topic), F.lit("\", from this material only:\n<<<\n"),
        strip(context),
        F.lit("\n>>>\nEach has four options, one of them right, and a sentence that explains why. "
              "Reply with JSON and nothing else: {\"questions\": [{\"question\": \"\", "
              "\"options\": [\"\"], \"correct_index\": 0, \"explanation\": \"\"}]}"),
    )


def chat_messages(history: Column, prompt: Column, language: Column) -> Column:
    """What a chat model is sent: its role, the past turns (role, content) and the prompt."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    rules = F.concat(
        F.lit("You teach this course. Use the course material and what was said before. Say that "
              "a topic was not covered only when neither holds it. Write all of your reply in "),
        language,
        F.lit(", whatever the language of the material."),
    )
    past = F.transform(history, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return F.concat(F.array(message("system", rules)), past, F.array(message("user", prompt)))


def judge_passages(texts: Column, passages: int = 5, chars: int = 400) -> Column:
    """The numbered passage block a judge model is shown."""
    numbered = F.transform(
        F.slice(texts, 1, passages),
        lambda t, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, chars)
        ),
    )
    return F.array_join(numbered, PASSAGE_RULE)


def parse_verdict(answer: Column) -> Column:
    """A judge model's reply as a grade; what cannot be read is ambiguous."""
    said = F.lower(strip(F.coalesce(answer, F.lit(""))))
    return (
        F.when(said.startswith("yes"), "correct")
        .when(said.startswith("no"), "incorrect")
        .otherwise("ambiguous")
    )


# ---- small values ------------------------------------------------------------------------


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols])


def first_castable(*cols: Column) -> Column:
    return F.coalesce(*[c.try_cast("double") for c in cols])


def session_id_or_new(session_id: Column) -> Column:
    """The given id, or a fresh one. Not deterministic: store the result before using it twice."""
    return F.coalesce(F.nullif(session_id, F.lit("")), F.uuid())


def recent(ts: Column, as_of: dt.datetime, days: int) -> Column:
    """`ts` lies within `days` before `as_of`; the bound is a constant, so scans can prune."""
    return ts > instant(as_of - dt.timedelta(days=days))


def is_fallback(c: Column, phrases: Sequence[str] = DEFAULTS.fallback_phrases) -> Column:
    """The text contains one of the phrases, in any letter case."""
    return reduce(lambda a, b: a | b, [c.ilike(f"%{p}%") for p in phrases])


def clamp_count(c: Column, default: int = 5, low: int = 1, high: int = 10) -> Column:
    """A requested count as an int within bounds; what is no whole number is the default."""
    wanted = F.coalesce(F.trim(c.cast("string")).try_cast("bigint"), F.lit(default))
    return F.greatest(F.lit(low), F.least(F.lit(high), wanted)).cast("int")


# ---- chunking ----------------------------------------------------------------------------

# Separators from coarse to fine; below the last one a text is cut by length.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _cut_by_length(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text), F.lit(size))
    return F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))


def _pack(text: Column, size: int, separators: Sequence[str]) -> Column:
    """Fill buffers with the parts between separators; a part too long is cut finer.

    The fold carries the finished chunks, the open buffer and the buffer's length, so no
    step has to measure the buffer again.
    """
    if not separators:
        return _cut_by_length(text, size)
    sep, finer = separators[0], separators[1:]

    def close(state: Column) -> Column:
        return F.when(
            state["used"] > 0, F.concat(state["done"], F.array(state["open"]))
        ).otherwise(state["done"])

    def state(done: Column, buffer: Column, used: Column) -> Column:
        return F.struct(
            done.alias("done"), buffer.alias("open"), used.cast("int").alias("used")
        )

    def add(acc: Column, part: Column) -> Column:
        gap = F.when(acc["used"] > 0, len(sep)).otherwise(0)
        joined = acc["used"] + gap + F.length(part)
        glued = F.when(acc["used"] > 0, F.concat(acc["open"], F.lit(sep), part)).otherwise(part)
        return (
            F.when(joined <= size, state(acc["done"], glued, joined))
            .when(
                F.length(part) > size,
                state(F.concat(close(acc), _pack(part, size, finer)), F.lit(""), F.lit(0)),
            )
            .otherwise(state(close(acc), part, F.length(part)))
        )

    empty = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    return F.aggregate(F.split(text, sep.replace(".", r"\.")), empty, add, close)


def recursive_chunk(text: Column, size: int = DEFAULTS.chunk_size) -> Column:
    """Array of chunks no longer than `size`, cut at the coarsest separator that fits."""
    return _pack(text, size, SEPARATORS)


def add_overlap(chunks: Column, chars: int = DEFAULTS.chunk_overlap) -> Column:
    """Start every chunk but the first with the tail of the one before it, then strip."""
    if chars <= 0:
        return F.transform(chunks, strip)

    def overlapped(listed: Column) -> Column:
        def with_tail(c: Column, i: Column) -> Column:
            tail = F.right(F.get(listed, i - 1), F.lit(chars))
            return F.when(i > 0, F.concat(tail, F.lit(" "), c)).otherwise(c)

        return F.transform(F.transform(listed, with_tail), strip_ends)

    return bind(chunks, overlapped)


def drop_short(chunks: Column, chars: int = DEFAULTS.min_chunk_chars) -> Column:
    return F.filter(chunks, lambda c: F.length(c) > chars)

