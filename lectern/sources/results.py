"""Evaluation questions in, evaluation results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import GRADES
from lectern.operators.evaluation import concordance, eligibility_counts
from lectern.schemas import EVAL_QUESTION, EVAL_RESULT, EVAL_SUMMARY, conform


def invalid_questions(questions: DataFrame) -> DataFrame:
    """Questions whose expected verdict lies outside the closed set."""
    known = F.coalesce(F.col("expected_verdict").isin(*GRADES), F.lit(False))
    return questions.filter(~known)


def read_eval_questions(spark: SparkSession, path: str, many_lines: bool = True) -> DataFrame:
    """A JSON array of questions, or a question a line; reading a row with an unknown verdict fails."""
    raw = spark.read.schema(EVAL_QUESTION).option("multiLine", str(many_lines).lower()).json(path)
    verdict = F.col("expected_verdict")
    problem = F.concat(
        F.lit("invalid expected_verdict for "), F.coalesce("question", F.lit("null")),
        F.lit(": "), F.coalesce(verdict, F.lit("null")),
    )
    checked = F.when(verdict.isin(*GRADES), verdict).otherwise(F.raise_error(problem))
    return raw.withColumn("expected_verdict", checked)


def append_eval_rows(rows: DataFrame, path: str) -> None:
    """Add finished questions to the running results; a commit is all or nothing."""
    conform(rows, EVAL_RESULT).write.mode("append").parquet(path)


def eval_progress(spark: SparkSession, path: str) -> DataFrame:
    """Matches, total and rate of what has been appended so far."""
    return concordance(spark.read.schema(EVAL_RESULT).parquet(path))


def eval_summary(results: DataFrame) -> DataFrame:
    """Status, totals, rate and eligible samples of a run, as one row."""
    totals = concordance(results)
    kept = eligibility_counts(results).select("kept").scalar()
    return totals.select(
        F.lit("complete").alias("status"),
        F.col("total").alias("total_questions"),
        F.col("matches").alias("concordance_matches"),
        F.col("rate").alias("concordance_rate"),
        kept.alias("eligible_count"),
    )


def write_eval_results(results: DataFrame, path: str) -> None:
    """Summary and question rows as JSON lines under `path`, written in parallel."""
    eval_summary(results).write.mode("overwrite").json(f"{path}/summary")
    conform(results, EVAL_RESULT).write.mode("overwrite").json(f"{path}/per_question")


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_RESULT).json(f"{path}/per_question")


def read_eval_document(spark: SparkSession, path: str) -> DataFrame:
    """The question rows of result files that nest them in one JSON document."""
    saved = spark.read.schema(EVAL_SUMMARY).option("multiLine", "true").json(path)
    return saved.select(F.inline("per_question"))
