"""Explicit schemas of every stored table, and the one place rows are made to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DOUBLE, _BOOL, _TIME = T.DoubleType(), T.BooleanType(), T.TimestampType()
_VECTOR, _STRINGS = T.ArrayType(T.FloatType()), T.ArrayType(T.StringType())


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def extend(base: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType(base.fields + table(**columns).fields)


LANDING = table(filename=_STRING, path=_STRING)

BRONZE = table(filename=_STRING, path=_STRING, raw_text=_STRING, error=_STRING)

SILVER = extend(
    BRONZE,
    professor=_STRING,
    subject=_STRING,
    chapter=_STRING,
    language=_STRING,
    word_count=_INT,
    doc_type=_STRING,
)

_CHUNK = {
    "chunk_text": _STRING,
    "chunk_pos": _INT,
    "chunk_id": _LONG,
    "embedding": _VECTOR,
    "embed_ok": _BOOL,
}

# The whole text stays in silver: repeated for every chunk it would grow with the square of a
# document's length. GOLD_WITH_TEXT is the shape that does repeat it.
GOLD_WITH_TEXT = extend(SILVER, **_CHUNK)
GOLD = T.StructType([f for f in GOLD_WITH_TEXT.fields if f.name != "raw_text"])

METADATA = table(
    filename=_STRING,
    professor=_STRING,
    subject=_STRING,
    chapter=_STRING,
    language=_STRING,
    doc_type=_STRING,
)

CHUNK_INDEX = table(
    chunk_id=_LONG,
    path=_STRING,
    document=_STRING,
    embedding=_VECTOR,
    embed_ok=_BOOL,
    metadata=METADATA,
    load_ts=_TIME,
)

CHAT_HISTORY = table(
    id=_LONG, session_id=_STRING, role=_STRING, content=_STRING, created_at=_TIME
)

RETRIEVAL_LOG = table(
    session_id=_STRING,
    query=_STRING,
    chunk_id=_STRING,
    chunk_text=_STRING,
    filename=_STRING,
    subject=_STRING,
    chapter=_STRING,
    score=_DOUBLE,
    retrieved_at=_TIME,
)

EVAL_QUESTION = table(question=_STRING, category=_STRING, expected_verdict=_STRING)

EVAL_RESULT = table(
    question=_STRING,
    category=_STRING,
    expected_verdict=_STRING,
    obtained_verdict=_STRING,
    top_score=_DOUBLE,
    match=_BOOL,
    answer=_STRING,
    context_texts=_STRINGS,
    num_sources=_INT,
    error=_STRING,
)

EVAL_SUMMARY = table(
    status=_STRING,
    total_questions=_LONG,
    concordance_matches=_LONG,
    concordance_rate=_DOUBLE,
    eligible_count=_LONG,
    per_question=T.ArrayType(EVAL_RESULT),
)

# The index and the options are read as strings and cast afterwards, so one odd item does not
# void the whole payload.
QUIZ_PAYLOAD = table(
    questions=T.ArrayType(
        table(question=_STRING, options=_STRINGS, correct_index=_STRING, explanation=_STRING)
    )
)

TOKEN_LINE = table(message=table(content=_STRING), done=_BOOL)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select, cast and default the columns of `schema`, in its order."""
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for field in schema.fields:
        col = F.col(field.name) if field.name in have else F.lit(None)
        col = col.cast(field.dataType)
        if field.name in defaults:
            col = F.coalesce(col, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(col.alias(field.name))
    return df.select(*out)
