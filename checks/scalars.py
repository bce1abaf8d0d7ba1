"""Scalar, array and JSON functions on whole tables: P1 to P24, J5, J6, J9, J11."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query
from checks.tables import FILES_SQL, documents, files, table, with_ctes
from lectern.functions import jsonops, language, text, vectors
from lectern.functions.variants import parse_rewrites_variant
from lectern.operators import retrieval
from lectern.session import cut_lineage

# ---- SQL building blocks -----------------------------------------------------------------

STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def strip_sql(expr: str) -> str:
    return STRIP.format(expr)


def words_sql(expr: str) -> str:
    return rf"list_filter(string_split_regex(lower({expr}), '[^\p{{L}}]+'), lambda w: w <> '')"


def most_hits_sql(expr: str, profiles: dict, otherwise: str) -> str:
    """The winning label over the words of `expr`, written as one expression."""
    votes = []
    for label, listed in sorted(profiles.items()):
        quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in listed)
        votes.append(
            f"{{'v': -len(list_filter({words_sql(expr)}, lambda w: w IN ({quoted}))), 'l': '{label}'}}"
        )
    best = f"list_min([{', '.join(votes)}])"
    return f"CASE WHEN ({best}).v < 0 THEN ({best}).l ELSE '{otherwise}' END"


def sentences_sql(expr: str) -> str:
    marked = rf"regexp_replace({strip_sql(expr)}, '([.!?؟])\s+', '\1' || chr(1), 'g')"
    trimmed = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip_sql('s')})"
    return f"list_filter({trimmed}, lambda s: length(s) > 15)"


# ---- cleaning and names ------------------------------------------------------------------


@query(
    "clean_text",
    r"""
WITH noisy AS (SELECT doc_id, concat(replace(text, ' ', '  '), chr(12), chr(10), chr(10), '  end ') AS t FROM documents),
a AS (SELECT doc_id, replace(t, chr(12), chr(10)) AS t FROM noisy),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM a)
SELECT doc_id, md5("""
    + strip_sql("t")
    + ") AS cleaned FROM b",
)
def clean_text(spark, sf_dir):
    noisy = F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\x0c\n\n  end "))
    return documents(spark, sf_dir).select("doc_id", F.md5(text.clean_text(noisy)).alias("cleaned"))


@query(
    "assemble_sections",
    """
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part,
                      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, md5(string_agg(concat('[Page ', i, ']', chr(10), part), chr(10) || chr(10) ORDER BY i)
                   FILTER (WHERE part <> '')) AS sections FROM parts GROUP BY doc_id""",
)
def assemble_sections(spark, sf_dir):
    parts = F.split("text", "\n")
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(text.assemble_sections(parts, "Page")).alias("sections")
    )


@query(
    "parse_filename",
    with_ctes(
        r"""
, p AS (SELECT doc_id, string_split(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), '_') AS f FROM files)
SELECT doc_id, coalesce(nullif(trim(f[1]), ''), 'Unknown') AS professor,
       coalesce(nullif(trim(f[2]), ''), 'Unknown') AS subject,
       coalesce(nullif(trim(f[3]), ''), 'Unknown') AS chapter FROM p""",
        files=FILES_SQL,
    ),
)
def parse_filename(spark, sf_dir):
    parsed = text.parse_filename(F.col("filename"))
    return files(spark, sf_dir).select("doc_id", parsed.alias("m")).select("doc_id", "m.*")


@query(
    "doc_type",
    with_ctes(
        "SELECT doc_id, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' "
        "WHEN lower(filename) LIKE '%.pptx' THEN 'pptx' ELSE 'unknown' END AS doc_type FROM files",
        files=FILES_SQL,
    ),
)
def doc_type(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", text.doc_type(F.col("filename")).alias("doc_type"))


@query("word_count", r"SELECT doc_id, len(string_split_regex(text, '\s+')) AS words FROM documents")
def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("words"))


# The invented texts know no course words, so the subjects here are told by function words.
SUBJECTS = {
    "English Studies": ["the", "of", "and"],
    "French Studies": ["les", "des", "une"],
    "German Studies": ["der", "die", "das"],
}
SAMPLE_800 = strip_sql("substring(raw_text, 1, 800)")


@query(
    "subject_fallback",
    with_ctes(
        r"""
, p AS (SELECT doc_id, raw_text, coalesce(nullif(trim(string_split(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), '_')[2]), ''), 'Unknown') AS s FROM files)
SELECT doc_id, CASE WHEN s = 'Unknown' THEN """
        + most_hits_sql(SAMPLE_800, SUBJECTS, "Unknown")
        + " ELSE s END AS subject FROM p",
        files=FILES_SQL,
    ),
)
def subject_fallback(spark, sf_dir):
    named = text.parse_filename(F.col("filename"))["subject"]
    found = language.subject_fallback(
        named, F.col("raw_text"), lambda c: language.keyword_subject(c, SUBJECTS)
    )
    return files(spark, sf_dir).select("doc_id", found.alias("subject"))


@query(
    "sanitise_label",
    """SELECT doc_id, coalesce(nullif(trim(regexp_replace(string_split(text, chr(10))[1],
       '["''.,;:!?]', '', 'g')), ''), 'Unknown') AS label FROM documents""",
)
def sanitise_label(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.sanitise_label(F.col("text")).alias("label")
    )


# ---- languages ---------------------------------------------------------------------------


@query(
    "detect_language",
    "SELECT doc_id, lang, "
    + most_hits_sql(strip_sql("substring(text, 1, 500)"), language.STOP_WORDS, "unknown")
    + " AS detected FROM documents",
)
def detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", "lang", language.detect_language(F.col("text")).alias("detected")
    )


REPLY_ROWS = ", ".join(
    f"('{code}', '{name}', '{voice}')" for code, (name, voice) in language.REPLY_LANGUAGES.items()
)


@query(
    "reply_language",
    f"""
WITH m AS (SELECT * FROM (VALUES {REPLY_ROWS}) AS t(code, name, voice)),
d AS (SELECT conv_id, turn, CASE WHEN length({strip_sql('text')}) < 3 THEN 'fr'
      ELSE {most_hits_sql(strip_sql('text'), language.STOP_WORDS, 'unknown')} END AS code FROM conversations)
SELECT d.conv_id, d.turn, coalesce(m.code, 'fr') AS lang_code, coalesce(m.name, 'French') AS lang_name,
       coalesce(m.voice, 'fr') AS voice_code FROM d LEFT JOIN m ON m.code = d.code""",
)
def reply_language(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return language.detect_reply_language(turns, "text").select(
        "conv_id", "turn", "lang_code", "lang_name", "voice_code"
    )


# ---- JSON, values, display ---------------------------------------------------------------


@query(
    "unpack_metadata",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, "
    "json_extract_string(props, '$.missing') AS missing FROM events",
)
def unpack_metadata(spark, sf_dir):
    fields = jsonops.unpack_metadata(F.col("props"), ["k", "missing"])
    return table(spark, sf_dir, "events").select("event_id", *fields)


@query("unpack_by_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def unpack_by_path(spark, sf_dir):
    fields = jsonops.unpack_by_path(F.col("props"), ["k"])
    return table(spark, sf_dir, "events").select("event_id", *fields)


@query(
    "preview",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS shown FROM documents",
)
def preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.preview(F.col("text"), 200).alias("shown"))


@query(
    "split_sentences",
    "WITH s AS (SELECT doc_id, " + sentences_sql("text") + " AS s FROM documents) "
    "SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest FROM s",
)
def split_sentences(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return cut.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(
    "cosine",
    """
SELECT a.vec_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same_label,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"),
                 F.col("label").alias("other_label"))
    return a.join(b, "vec_id").select(
        "vec_id",
        (F.col("label") == F.col("other_label")).cast("int").alias("same_label"),
        F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"),
    )


GRADE_SQL = "CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'incorrect' ELSE 'ambiguous' END"


def graded_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    grade = (
        F.when(F.col("quality") == 1, "correct")
        .when(F.col("toxic") == 1, "incorrect")
        .otherwise("ambiguous")
    )
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        "doc_id", "text", "lang", "source", grade.alias("grade")
    )


def sql_text(value: str) -> str:
    """A Python text as a SQL literal, newlines included."""
    return "'" + value.replace("'", "''") + "'"


PROMPT_SQL = f"""
WITH g AS (SELECT d.doc_id, d.text, d.lang, d.source, {GRADE_SQL} AS grade
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
p AS (SELECT *, concat('Student question: ', source, chr(10), chr(10), 'Reply in ', lang, '.') AS ask FROM g)
SELECT doc_id, grade,
  md5(CASE WHEN grade = 'incorrect' THEN concat(ask, {sql_text(text.REFUSE_NOTE)})
   ELSE concat('Answer from this course material.', chr(10), chr(10), '<<<', chr(10), text, chr(10), '>>>',
        chr(10), chr(10), ask, CASE WHEN grade = 'ambiguous' THEN {sql_text(text.HEDGE_NOTE)} ELSE '' END) END) AS prompt,
  md5(concat('Answer from this course material.', chr(10), chr(10), '<<<', chr(10), text, chr(10), '>>>',
        chr(10), chr(10), 'Student question: ', source, chr(10), chr(10),
        'Keep the answer short and use nothing but the material.')) AS short_prompt
FROM p"""


@query("prompts", PROMPT_SQL)
def prompts(spark, sf_dir):
    question, context = F.col("source"), F.col("text")
    return graded_documents(spark, sf_dir).select(
        "doc_id",
        "grade",
        F.md5(text.build_prompt(question, context, F.col("lang"), F.col("grade"))).alias("prompt"),
        F.md5(text.evaluation_prompt(question, context)).alias("short_prompt"),
    )


@query(
    "source_fields",
    """
SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, ''), props) AS shown,
       coalesce(try_cast(json_extract_string(props, '$.none') AS DOUBLE), try_cast(event_type AS DOUBLE), value) AS score
FROM events""",
)
def source_fields(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.first_non_empty(kind, F.col("props")).alias("shown"),
        text.first_castable(
            F.get_json_object("props", "$.none"), F.col("event_type"), F.col("value").cast("string")
        ).alias("score"),
    )


@query(
    "judge_verdicts",
    f"""
WITH v AS (SELECT conv_id, turn, {strip_sql('lower(text)')} AS t, string_split(text, chr(10)) AS p FROM conversations)
SELECT conv_id, turn,
  CASE WHEN t LIKE 'yes%' THEN 'correct' WHEN t LIKE 'no%' THEN 'incorrect' ELSE 'ambiguous' END AS verdict,
  md5(array_to_string(list_transform(p[1:5], lambda x, i: concat('[', i, '] ', substring(x, 1, 400))),
      chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS passages
FROM v""",
)
def judge_verdicts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        text.parse_verdict(F.col("text")).alias("verdict"),
        F.md5(text.judge_passages(F.split("text", "\n"))).alias("passages"),
    )


@query(
    "clamp_count",
    """
SELECT event_id, greatest(1, least(10, coalesce(try_cast(CASE WHEN event_type = 'view' THEN 'many' ELSE
  json_extract_string(props, '$.k') END AS BIGINT), 5))) AS n FROM events""",
)
def clamp_count(spark, sf_dir):
    wanted = F.when(F.col("event_type") == "view", "many").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", text.clamp_count(wanted).alias("n"))


@query(
    "session_ids",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'new' ELSE CAST(conv_id AS VARCHAR) END AS session_id, 1::BIGINT AS holders "
    "FROM conversations",
)
def session_ids(spark, sf_dir):
    """A given id is kept; a missing one becomes an id of its own, of 36 characters, that no other row has."""
    turns = table(spark, sf_dir, "conversations")
    given = F.when(F.col("turn") % 2 == 0, F.when(F.col("turn") % 4 == 0, "")).otherwise(F.col("conv_id").cast("string"))
    named = cut_lineage(turns.select("conv_id", "turn", given.alias("given"), text.session_id_or_new(given).alias("session_id")))
    new = F.coalesce(F.length("given"), F.lit(0)) == 0
    holders = named.filter(new).groupBy("session_id").agg(F.count("*").alias("holders"))
    fresh = F.when(new & (F.length("session_id") == 36), "new").otherwise(F.col("session_id"))
    return named.join(holders, "session_id", "left").select(
        "conv_id", "turn", fresh.alias("session_id"), F.coalesce("holders", F.lit(1)).cast("bigint").alias("holders")
    )


# ---- rewrites ----------------------------------------------------------------------------

# The rewrites of a passage are its sentences, wrapped the way a chat model wraps a list.
REWRITES_SQL = f"""
SELECT item_id AS question_id, 0 AS rewrite_idx, 'question' AS kind, text FROM benchmark
UNION ALL
SELECT item_id, CAST(i AS INTEGER), 'rewrite', s FROM (
  SELECT item_id, unnest({sentences_sql('text')}) AS s, generate_subscripts({sentences_sql('text')}, 1) AS i FROM benchmark)
UNION ALL
SELECT item_id, CAST(len({sentences_sql('text')}) + 1 AS INTEGER), 'pseudo_answer', {strip_sql('lower(text)')} FROM benchmark
"""


def questions(spark, sf_dir):
    """Passages as questions, with model replies made of their sentences."""
    listed = F.to_json(text.split_sentences(F.col("text")))
    reply = F.concat(F.lit("Sure, here they are:\n```json\n"), listed, F.lit("\n```"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.col("text").alias("question"),
        reply.alias("raw_rewrites"),
        F.lower("text").alias("pseudo_answer"),
    )


VARIANTS_SQL = f"""
WITH v AS ({REWRITES_SQL})
SELECT question_id, rewrite_idx, kind, text, rewrite_idx = 0 AS is_origin,
       rewrite_idx > 0 AND rewrite_idx = max(rewrite_idx) OVER (PARTITION BY question_id) AS is_last,
       kind = 'pseudo_answer' AS is_pseudo_answer FROM v"""


@query("query_variants_variant", VARIANTS_SQL)
def query_variants_by_variant(spark, sf_dir):
    listed = parse_rewrites_variant(F.col("question"), F.col("raw_rewrites"), F.col("pseudo_answer"))
    rows = questions(spark, sf_dir).select("question_id", F.posexplode(listed).alias("rewrite_idx", "v"))
    return retrieval.tag_rewrites(rows.select("question_id", "rewrite_idx", "v.kind", "v.text"))


@query("query_variants", VARIANTS_SQL)
def query_variants(spark, sf_dir):
    return retrieval.tag_rewrites(retrieval.query_variants(questions(spark, sf_dir)))
