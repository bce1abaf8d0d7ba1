"""Evaluation of retrieval over a whole question set, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import SOURCE_TEXT_FIELDS
from lectern.functions.text import first_non_empty
from lectern.operators.evaluation import with_match
from lectern.operators.retrieval import PairScorer, SearchCorpus
from lectern.plans.search import retrieve_multistage
from lectern.schemas import EVAL_RESULT, conform


def evaluate(
    questions: DataFrame,
    corpus: SearchCorpus,
    answers: DataFrame | None = None,
    scorer: PairScorer | None = None,
    variants: DataFrame | None = None,
) -> DataFrame:
    """One result row per question, with the verdict obtained and what is needed to judge it.

    `answers` (question_id, answer) are generated elsewhere from `evaluation_prompt`; without
    them no row is eligible for judging. The best score is kept for refused questions as well,
    so other thresholds can be tried on the stored rows.
    """
    found = retrieve_multistage(questions, corpus, scorer, variants)
    expected = questions.select("question_id", "category", "expected_verdict")
    rows = found.join(expected, "question_id")
    if answers is not None:
        rows = rows.join(answers.select("question_id", "answer"), "question_id", "left")
    else:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    fields = rows.schema["sources"].dataType.elementType.names
    named = [f for f in SOURCE_TEXT_FIELDS if f in fields]
    texts = F.transform("sources", lambda s: first_non_empty(*[s[f] for f in named]))
    answered = (F.col("grade") != "incorrect") & (F.col("context") != "")
    contexts = F.when(answered, F.filter(texts, lambda t: F.length(t) > 0)).otherwise(
        F.array().cast("array<string>")
    )
    shaped = (
        rows.withColumn("obtained_verdict", F.col("grade"))
        .withColumn("num_sources", F.coalesce(F.size("sources"), F.lit(0)))
        .withColumn("context_texts", contexts)
        .withColumn("answer", F.when(answered, F.col("answer")))
    )
    incomplete = answered & ((F.coalesce(F.length("answer"), F.lit(0)) == 0) | (F.size("context_texts") == 0))
    shaped = shaped.withColumn(
        "error", F.when(incomplete, F.lit("no answer or no context, so not judged"))
    )
    return conform(with_match(shaped), EVAL_RESULT)
