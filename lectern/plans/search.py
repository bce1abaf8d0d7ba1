"""Complete retrieval plans over a batch of questions, one row per question out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import PASSAGE_RULE, Settings
from lectern.functions.text import preview
from lectern.functions.vectors import embed
from lectern.operators.retrieval import (
    PairScorer,
    SearchCorpus,
    assemble_context,
    best_of_simple,
    compress,
    compression_stats,
    grade_by_score,
    grade_by_verdict,
    hybrid_candidates,
    merge_candidates,
    multi_query_candidates,
    project_sources,
    query_variants,
    rerank,
    retrieval_stats,
    retrieval_totals,
    single_variant,
    tag_rewrites,
    term_overlap_scorer,
)
from lectern.operators.vector_search import vector_top_k
from lectern.session import cut_lineage

QUESTION_COLUMNS = ("question_id", "question")


def _scorer(questions: DataFrame, corpus: SearchCorpus, scorer: PairScorer | None) -> PairScorer:
    if scorer is not None:
        return scorer
    if corpus.bm25 is None:
        raise ValueError("the default pair score needs a BM25 index; give a scorer")
    return term_overlap_scorer(questions, corpus.bm25)


def _with_question(rows: DataFrame, questions: DataFrame) -> DataFrame:
    return rows.join(questions.select(*QUESTION_COLUMNS), "question_id")


def _answer_rows(questions, graded, compressed, columns) -> DataFrame:
    """Every question keeps its row: what is graded incorrect, or found nothing, has no context."""
    context = assemble_context(compressed, "compressed")
    sources = project_sources(compressed, columns)
    return (
        questions.select(*QUESTION_COLUMNS)
        .join(graded, "question_id")
        .join(context, "question_id", "left")
        .join(sources, "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumnRenamed("max_score", "top_score")
    )


def retrieve_multistage(
    questions: DataFrame,
    corpus: SearchCorpus,
    scorer: PairScorer | None = None,
    variants: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """question_id, question, num_docs, top_score, grade, context, sources.

    `questions` has question_id, question and, unless `variants` is given, raw_rewrites and
    pseudo_answer. Only reranked rows of questions that pass the grade reach compression, the
    costly stage. `top_score` is kept for refused questions too. With `verdicts`, a judge's replies
    to `judge_requests`, those grade the questions instead of the score thresholds.
    """
    variants = variants if variants is not None else query_variants(questions)
    candidates = multi_query_candidates(variants, corpus)
    ranked = rerank(candidates, _scorer(questions, corpus, scorer), corpus.settings.rerank_k)
    # both the grades and the passages read these few rows; the corpus is scanned once for them
    ranked = cut_lineage(ranked)
    if verdicts is not None:
        graded = grade_by_verdict(questions, ranked, verdicts)
    else:
        graded = grade_by_score(questions, ranked, settings=corpus.settings)
    passed = graded.filter(F.col("grade") != "incorrect").select("question_id")
    relevant = _with_question(ranked.join(passed, "question_id"), questions)
    compressed = compress(relevant, "question", corpus.embedder, corpus.settings)
    return _answer_rows(questions, graded, compressed, corpus.source_columns)


def retrieve_simple(questions: DataFrame, corpus: SearchCorpus) -> DataFrame:
    """One hybrid round, the first vector_k candidates, no grading (always correct)."""
    k = corpus.settings.vector_k
    candidates = merge_candidates(
        hybrid_candidates(single_variant(questions), corpus, k), corpus.settings
    )
    return _plain_rows(questions, best_of_simple(candidates, k), corpus)


def retrieve_vector_only(questions: DataFrame, corpus: SearchCorpus, k: int = 5) -> DataFrame:
    """Nearest chunks only, their texts joined as they are."""
    asked = questions.withColumn("embedding", embed(F.col("question"), corpus.embedder))
    hits = vector_top_k(asked, corpus.chunks, k, query_id="question_id")
    texts = corpus.chunks.select("chunk_id", "chunk_text", *corpus.source_columns)
    return _plain_rows(questions, texts.join(hits, "chunk_id"), corpus)


def _plain_rows(questions: DataFrame, ranked: DataFrame, corpus: SearchCorpus) -> DataFrame:
    source = F.struct("rank", "chunk_id", *corpus.source_columns)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_text").alias("_text"))))
    found = ranked.groupBy("question_id").agg(
        F.array_join(F.transform(listed, lambda x: x["_text"]), PASSAGE_RULE).alias("context"),
        F.array_sort(F.collect_list(source)).alias("sources"),
    )
    return (
        questions.select(*QUESTION_COLUMNS)
        .join(found, "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumn("grade", F.lit("correct"))
    )


@dataclass(frozen=True)
class Trace:
    """Every stage of the multistage plan as a table of its own."""

    rewrites: DataFrame
    retrieval: DataFrame
    totals: DataFrame
    candidates: DataFrame
    reranked: DataFrame
    grades: DataFrame
    compressed: DataFrame
    answers: DataFrame
    timings: dict[str, int]  # milliseconds per stage, as run
    settings: Settings


def trace(
    questions: DataFrame,
    corpus: SearchCorpus,
    scorer: PairScorer | None = None,
    variants: DataFrame | None = None,
) -> Trace:
    """`retrieve_multistage` with its intermediate tables, each computed once."""
    settings = corpus.settings
    timings: dict[str, int] = {}

    def timed(stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        started = time.perf_counter()
        table = cut_lineage(make())
        timings[stage] = int((time.perf_counter() - started) * 1000)
        return table

    given = variants if variants is not None else query_variants(questions)
    variants = timed("rewrite_ms", lambda: given)
    per_variant = timed(
        "retrieval_ms", lambda: hybrid_candidates(variants, corpus, settings.candidates_per_query)
    )
    candidates = merge_candidates(per_variant, settings)
    ranked = timed(
        "rerank_ms", lambda: rerank(candidates, _scorer(questions, corpus, scorer), settings.rerank_k)
    )
    graded = grade_by_score(questions, ranked, settings=settings)
    passed = graded.filter(F.col("grade") != "incorrect").select("question_id")
    relevant = _with_question(ranked.join(passed, "question_id"), questions)
    compressed = timed(
        "compress_ms", lambda: compress(relevant, "question", corpus.embedder, settings)
    )
    timings["total_ms"] = sum(timings.values())
    stats = retrieval_stats(variants, per_variant, candidates)
    shown = preview(F.col("chunk_text"), 200)
    return Trace(
        rewrites=tag_rewrites(variants),
        retrieval=stats.withColumn("query", preview(F.col("text"), 120)).drop("text"),
        totals=retrieval_totals(stats),
        candidates=candidates.select(
            "question_id", "cand_index", "chunk_id", shown.alias("preview"),
            F.length("chunk_text").alias("length"), *corpus.source_columns,
        ),
        reranked=ranked.select(
            "question_id", "rank", F.col("cand_index").alias("original_index"), "chunk_id",
            F.round("score", 4).alias("score"), shown.alias("preview"),
        ),
        grades=graded,
        compressed=compression_stats(compressed),
        answers=_answer_rows(questions, graded, compressed, corpus.source_columns),
        timings=timings,
        settings=settings,
    )
