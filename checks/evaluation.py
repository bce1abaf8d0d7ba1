"""Evaluation and quiz scoring: A8 to A13, A16, W3, J7, J8, J11, S9."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query
from checks.scalars import GRADE_SQL, sentences_sql, strip_sql
from checks.tables import documents, table, with_ctes
from lectern.functions.jsonops import parse_quiz
from lectern.functions.variants import parse_quiz_variant
from lectern.functions.text import split_sentences
from lectern.operators import evaluation as ops
from lectern.plans.quiz import quiz_envelopes, quiz_requests
from lectern.session import shared_folder
from lectern.sources.results import (
    append_eval_rows,
    eval_progress,
    eval_summary,
    invalid_questions,
    read_eval_questions,
    read_eval_results,
    write_eval_results,
)

# A labelled document is an evaluated question; its best score is a hash in [0, 1]. Documents
# whose hash starts with 'f' had no source, those with 'e' failed.
RESULTS_SQL = f"""
SELECT d.doc_id AS seq, d.source AS run, concat('doc ', d.doc_id) AS question, d.lang AS category,
       {GRADE_SQL} AS expected_verdict,
       CASE WHEN substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) = 'f' THEN NULL
            ELSE CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 4) AS INTEGER) / 65535.0 END AS top_score,
       substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) = 'e' AS failed,
       d.text AS answer, {sentences_sql('d.text')} AS context_texts
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

GRADED_SQL = """
SELECT *, obtained_verdict IS NOT NULL AND obtained_verdict = expected_verdict AS match,
       CASE WHEN failed THEN 'failed' END AS error FROM (
  SELECT *, CASE WHEN failed THEN NULL WHEN top_score IS NULL THEN 'incorrect' WHEN top_score > 0.25 THEN 'correct'
                 WHEN top_score < 0.01 THEN 'incorrect' ELSE 'ambiguous' END AS obtained_verdict FROM results)"""


def graded_sql(body: str) -> str:
    return with_ctes(body, results=RESULTS_SQL, graded=GRADED_SQL)


def results(spark, sf_dir):
    digest = F.md5(F.col("doc_id").cast("string"))
    first = F.substring(digest, 1, 1)
    share = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65535
    grade = (
        F.when(F.col("quality") == 1, "correct")
        .when(F.col("toxic") == 1, "incorrect")
        .otherwise("ambiguous")
    )
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("run"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("question"),
        F.col("lang").alias("category"),
        grade.alias("expected_verdict"),
        F.when(first != "f", share).alias("top_score"),
        (first == "e").alias("failed"),
        F.col("text").alias("answer"),
        split_sentences(F.col("text")).alias("context_texts"),
    )


def graded(spark, sf_dir):
    rows = ops.regrade(results(spark, sf_dir))
    obtained = F.when(~F.col("failed"), F.col("obtained_verdict"))
    rows = ops.with_match(rows.withColumn("obtained_verdict", obtained))
    return rows.withColumn("error", F.when(F.col("failed"), "failed"))


RATE = "count(*) FILTER (WHERE match) AS matches, count(*) AS total, round(avg(CASE WHEN match THEN 1.0 ELSE 0.0 END), 6) AS rate"


@query("regrade", graded_sql("SELECT seq, obtained_verdict, match, round(top_score, 6) AS top_score FROM graded"))
def regrade(spark, sf_dir):
    return graded(spark, sf_dir).select("seq", "obtained_verdict", "match", F.round("top_score", 6).alias("top_score"))


@query(
    "eval_results_stored",
    graded_sql(
        "SELECT question, category, expected_verdict, obtained_verdict, match, round(top_score, 6) AS top_score, "
        "md5(answer) AS answer, len(context_texts) AS contexts, error FROM graded"
    ),
)
def eval_results_stored(spark, sf_dir):
    """Written as result files and read again."""
    folder = shared_folder(spark)
    write_eval_results(graded(spark, sf_dir), folder)
    return read_eval_results(spark, folder).select(
        "question", "category", "expected_verdict", "obtained_verdict", "match", F.round("top_score", 6).alias("top_score"),
        F.md5("answer").alias("answer"), F.size("context_texts").alias("contexts"), "error",
    )


@query("eval_progress", graded_sql(f"SELECT {RATE} FROM graded"))
def progress(spark, sf_dir):
    """Finished questions are added in two commits; the running totals are those of all."""
    folder = shared_folder(spark)
    rows = graded(spark, sf_dir)
    for part in (0, 1):
        append_eval_rows(rows.filter(F.pmod(F.xxhash64("question"), F.lit(2)) == part), folder)
    return eval_progress(spark, folder)


@query("eval_questions_stored", graded_sql("SELECT question, category, expected_verdict FROM graded"))
def eval_questions_stored(spark, sf_dir):
    """Written as JSON rows and read with their verdicts checked."""
    folder = shared_folder(spark)
    graded(spark, sf_dir).select("question", "category", "expected_verdict").write.json(folder)
    return read_eval_questions(spark, folder, many_lines=False)


@query("concordance", graded_sql(f"SELECT {RATE} FROM graded"))
def concordance(spark, sf_dir):
    return ops.concordance(graded(spark, sf_dir))


@query("concordance_by_category", graded_sql(f"SELECT category, {RATE} FROM graded GROUP BY category"))
def concordance_by_category(spark, sf_dir):
    return ops.concordance(graded(spark, sf_dir), ["category"])


@query(
    "running_concordance",
    graded_sql(
        "SELECT run, seq, CAST(m AS BIGINT) AS matches_so_far, n AS total_so_far, round(m / n, 6) AS rate_so_far FROM ("
        "SELECT run, seq, sum(CASE WHEN match THEN 1 ELSE 0 END) OVER w AS m, count(*) OVER w AS n FROM graded "
        "WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING))"
    ),
)
def running_concordance(spark, sf_dir):
    return ops.running_concordance(graded(spark, sf_dir), stretch=100)


ELIGIBLE = "length(answer) > 0 AND len(context_texts) > 0"


@query(
    "eligible_samples",
    graded_sql(f"SELECT question, md5(answer) AS answer, len(context_texts) AS contexts FROM graded WHERE {ELIGIBLE}"),
)
def eligible_samples(spark, sf_dir):
    rows = ops.judge_dataset(graded(spark, sf_dir))
    return rows.select("question", F.md5("answer").alias("answer"), F.size("contexts").alias("contexts"))


@query(
    "eligibility_counts",
    graded_sql(
        f"SELECT category, count(*) FILTER (WHERE {ELIGIBLE}) AS kept, "
        f"count(*) FILTER (WHERE NOT ({ELIGIBLE})) AS skipped FROM graded GROUP BY category"
    ),
)
def eligibility_counts(spark, sf_dir):
    return ops.eligibility_counts(graded(spark, sf_dir), ["category"])


@query(
    "mismatch_report",
    graded_sql(
        "SELECT question, category, expected_verdict, obtained_verdict, round(top_score, 6) AS top_score "
        "FROM graded WHERE NOT match AND error IS NULL"
    ),
)
def mismatch_report(spark, sf_dir):
    return ops.mismatch_report(graded(spark, sf_dir)).withColumn("top_score", F.round("top_score", 6))


@query(
    "eval_summary",
    graded_sql(
        "SELECT 'complete' AS status, count(*) AS total_questions, count(*) FILTER (WHERE match) AS concordance_matches, "
        "round(avg(CASE WHEN match THEN 1.0 ELSE 0.0 END), 6) AS concordance_rate, "
        f"count(*) FILTER (WHERE {ELIGIBLE}) AS eligible_count FROM graded"
    ),
)
def summary(spark, sf_dir):
    return eval_summary(graded(spark, sf_dir))


CORRECT_ABOVE, INCORRECT_BELOW = [0.1, 0.25, 0.7, 2.0], [-2.0, 0.01, 0.1, 0.3]
RECALIBRATED_SQL = f"""
SELECT correct_above, incorrect_below, count(*) FILTER (WHERE hit) AS matches, count(*) AS total,
       round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (
  SELECT correct_above, incorrect_below, expected_verdict = CASE WHEN top_score IS NULL THEN 'incorrect'
         WHEN top_score > correct_above THEN 'correct' WHEN top_score < incorrect_below THEN 'incorrect' ELSE 'ambiguous' END AS hit
  FROM results, (SELECT CAST(unnest({CORRECT_ABOVE}) AS DOUBLE) AS correct_above),
                (SELECT CAST(unnest({INCORRECT_BELOW}) AS DOUBLE) AS incorrect_below)
  WHERE incorrect_below <= correct_above) GROUP BY ALL"""


@query("recalibrate", with_ctes(RECALIBRATED_SQL, results=RESULTS_SQL))
def recalibrate(spark, sf_dir):
    return ops.recalibrate(results(spark, sf_dir), CORRECT_ABOVE, INCORRECT_BELOW)


@query(
    "best_thresholds",
    with_ctes(
        f"SELECT * FROM ({RECALIBRATED_SQL}) ORDER BY rate DESC, correct_above, incorrect_below LIMIT 1",
        results=RESULTS_SQL,
    ),
)
def best_thresholds(spark, sf_dir):
    return ops.best_thresholds(ops.recalibrate(results(spark, sf_dir), CORRECT_ABOVE, INCORRECT_BELOW))


# Every pair of stored scores, and of a value below and one above them all, counted one by one.
EXACT_THRESHOLDS_SQL = """
SELECT correct_above, incorrect_below, matches, total, round(matches / total, 6) AS rate FROM (
  SELECT u.cut AS correct_above, l.cut AS incorrect_below, (SELECT count(*) FROM results) AS total,
    (SELECT count(*) FROM results WHERE top_score IS NULL AND expected_verdict = 'incorrect')
    + (SELECT count(*) FROM results WHERE expected_verdict = 'correct' AND top_score IS NOT NULL) - u.correct
    + u.ambiguous - l.ambiguous_below + l.incorrect_below_ AS matches
  FROM cands u JOIN cands l ON l.cut <= u.cut)
ORDER BY matches DESC, correct_above, incorrect_below LIMIT 1"""
CANDS_SQL = """
SELECT cut, (SELECT count(*) FROM results WHERE expected_verdict = 'correct' AND top_score <= cut) AS correct,
  (SELECT count(*) FROM results WHERE expected_verdict = 'ambiguous' AND top_score <= cut) AS ambiguous,
  (SELECT count(*) FROM results WHERE expected_verdict = 'ambiguous' AND top_score < cut) AS ambiguous_below,
  (SELECT count(*) FROM results WHERE expected_verdict = 'incorrect' AND top_score < cut) AS incorrect_below_
FROM (SELECT DISTINCT top_score AS cut FROM results WHERE top_score IS NOT NULL
  UNION ALL SELECT min(top_score) - 1 FROM results UNION ALL SELECT max(top_score) + 1 FROM results)"""


@query("best_thresholds_exact", with_ctes(EXACT_THRESHOLDS_SQL, results=RESULTS_SQL, cands=CANDS_SQL))
def best_thresholds_exact(spark, sf_dir):
    return ops.best_thresholds_exact(results(spark, sf_dir))


@query(
    "metric_means",
    with_ctes(
        """
SELECT metric, round(avg(v), 6) AS mean, count(v) AS scored, count(*) - count(v) AS missing FROM (
  SELECT 'faithfulness' AS metric, top_score AS v FROM results
  UNION ALL SELECT 'answer_relevancy', CASE WHEN failed THEN NULL ELSE len(context_texts) / 1000.0 END FROM results)
GROUP BY metric""",
        results=RESULTS_SQL,
    ),
)
def metric_means(spark, sf_dir):
    relevancy = F.when(~F.col("failed"), F.size("context_texts") / 1000.0).otherwise(F.lit(float("nan")))
    scores = results(spark, sf_dir).select(
        "seq", F.col("top_score").alias("faithfulness"), relevancy.alias("answer_relevancy")
    )
    return ops.metric_means(scores, ["seq"], ["faithfulness", "answer_relevancy"])


# The sources of a document are its sentences; a score can be read where one is long enough.
@query(
    "top_score",
    f"""
WITH s AS (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)
SELECT doc_id, list_max(list_transform(s, lambda x: CASE WHEN length(x) >= 50 THEN CAST(length(x) AS DOUBLE) / 100 END)) AS top_score,
       len(s) AS sources FROM s""",
)
def top_score(spark, sf_dir):
    def source(sentence):
        chars = F.length(sentence)
        return F.struct(F.when(chars >= 50, (chars / 100).cast("string")).otherwise("n/a").alias("score"))

    rows = documents(spark, sf_dir).select(
        "doc_id", F.transform(split_sentences(F.col("text")), source).alias("s")
    )
    return rows.select("doc_id", ops.top_score(F.col("s")).alias("top_score"), F.size("s").alias("sources"))


@query(
    "zip_judge_dataset",
    f"""
WITH s AS (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s[i] AS question, md5(s[i]) AS answer, concat(length(s[i]), ',', i - 1) AS contexts
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
)
def zip_judge_dataset(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", split_sentences(F.col("text")).alias("questions"))
    lists = cut.select(
        "doc_id",
        "questions",
        F.transform("questions", lambda x: F.md5(x)).alias("answers"),
        F.transform(
            "questions", lambda x, i: F.array(F.length(x).cast("string"), i.cast("string"))
        ).alias("contexts"),
    )
    return ops.zip_judge_dataset(lists).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "question", "answer",
        F.array_join("contexts", ",").alias("contexts"),
    )


@query(
    "invalid_questions",
    "SELECT doc_id FROM documents WHERE lang NOT IN ('correct', 'ambiguous', 'incorrect') "
    "AND source <> 'src1'",
)
def invalid(spark, sf_dir):
    # languages are no verdicts; one source gets a valid verdict instead
    verdict = F.when(F.col("source") == "src1", "correct").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").withColumn("expected_verdict", verdict)
    return invalid_questions(rows).select("doc_id")


# ---- quizzes -----------------------------------------------------------------------------

QUIZ_SQL = """
SELECT concat(a.lang, '-', a.source) AS attempt_id, a.source AS quiz_id, count(*) FILTER (WHERE a.chosen = a.correct_index) AS correct,
       any_value(k.total) AS total
FROM (SELECT doc_id, lang, source, n_chars % 4 AS correct_index, length(text) * 3 % 4 AS chosen FROM documents) a
JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) k ON k.source = a.source GROUP BY 1, 2"""


@query(
    "grade_quiz",
    f"""
SELECT *, CASE WHEN percent = 100 THEN 'All correct.' WHEN percent >= 70 THEN 'Well understood.'
  WHEN percent >= 40 THEN 'Review this once more.' ELSE 'Go back to this topic.' END AS message FROM (
SELECT *, CAST(floor(correct * 100.0 / total + 0.5) AS INTEGER) AS percent FROM ({QUIZ_SQL}))""",
)
def grade_quiz(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = docs.select(
        F.col("source").alias("quiz_id"), F.col("doc_id").alias("q_idx"),
        (F.col("n_chars") % 4).alias("correct_index"),
    )
    answers = docs.select(
        F.concat_ws("-", "lang", "source").alias("attempt_id"), F.col("source").alias("quiz_id"),
        F.col("doc_id").alias("q_idx"), (F.length("text") * 3 % 4).alias("chosen"),
    )
    return ops.grade_quiz(answers, key)


def quiz_replies(spark, sf_dir):
    """Each document as a quiz reply: one good question, and one whose index is out of range."""
    options = F.split("text", r"\. ")
    good = F.struct(
        F.concat(F.lit(" "), "source", F.lit("? ")).alias("question"),
        options.alias("options"),
        F.lit("1").alias("correct_index"),
        F.lit(" why ").alias("explanation"),
    )
    bad = F.struct(
        F.lit("out of range").alias("question"), options.alias("options"),
        F.lit("100000").alias("correct_index"), F.lit("").alias("explanation"),
    )
    payload = F.to_json(F.struct(F.array(good, bad).alias("questions")))
    raw = F.concat(F.lit("Here you go: ```json\n"), payload, F.lit("\n```"))
    return documents(spark, sf_dir).select("doc_id", "lang", "source", raw.alias("raw"))


OPTIONS = f"list_filter(list_transform(string_split(text, '. '), lambda o: {strip_sql('o')}), lambda o: o <> '')"


PARSED_SQL = f"""
SELECT doc_id, concat(source, '?') AS question, len(o) AS options, o[2] AS answer, 'why' AS explanation
FROM (SELECT doc_id, source, {OPTIONS} AS o, string_split(text, '. ') AS raw FROM documents) WHERE len(o) >= 2 AND len(raw) >= 2"""


@query("parse_quiz", PARSED_SQL)
def quiz_questions(spark, sf_dir):
    return parsed_questions(spark, sf_dir, parse_quiz)


@query("parse_quiz_variant", PARSED_SQL)
def quiz_questions_by_variant(spark, sf_dir):
    return parsed_questions(spark, sf_dir, parse_quiz_variant)


def parsed_questions(spark, sf_dir, parse):
    rows = quiz_replies(spark, sf_dir).select("doc_id", F.explode(parse(F.col("raw"))).alias("q"))
    return rows.select(
        "doc_id", "q.question", F.size("q.options").alias("options"),
        F.get("q.options", F.col("q.correct_index")).alias("answer"), "q.explanation",
    )


@query(
    "quiz_envelopes",
    f"""
SELECT request_id, topic, grounded, questions, CASE WHEN topic = '' THEN 'no topic given' WHEN NOT covered THEN
  'the course material does not cover this topic' WHEN usable = 0 THEN 'no usable question was generated' END AS error FROM (
SELECT *, topic <> '' AND covered AND usable > 0 AS grounded, CASE WHEN topic <> '' AND covered THEN usable ELSE 0 END AS questions FROM (
SELECT d.doc_id AS request_id, CASE WHEN lang = 'es' THEN '' ELSE source END AS topic,
  coalesce({GRADE_SQL}, '') <> 'incorrect' AND l.doc_id IS NOT NULL AS covered,
  CASE WHEN len({OPTIONS}) >= 2 AND len(string_split(text, '. ')) >= 2 THEN 1 ELSE 0 END AS usable
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))""",
)
def envelopes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("lang") == "es", "  ").otherwise(F.col("source")).alias("topic"),
        F.lit("12").alias("num_questions"),
        F.lit("French").alias("language"),
    )
    grade = (
        F.when(F.col("quality") == 1, "correct")
        .when(F.col("toxic") == 1, "incorrect")
        .otherwise("ambiguous")
    )
    retrieved = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("request_id"), grade.alias("grade"), F.col("text").alias("context"),
        F.array(F.struct("source")).alias("sources"),
    )
    replies = quiz_replies(spark, sf_dir).withColumnRenamed("doc_id", "request_id")
    out = quiz_envelopes(quiz_requests(asked), retrieved, replies)
    return out.select("request_id", "topic", "grounded", F.size("questions").alias("questions"), "error")
