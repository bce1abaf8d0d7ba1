"""From query variants to graded, compressed passages; every stage handles all questions at once.

Shapes:
  variants    question_id, rewrite_idx, kind, text
  candidates  question_id, cand_index, rewrite_idx, src_ord, leg_rank, chunk_id, chunk_text, ...
  ranked      candidates plus score, rank (1..k)
A question never yields more than variants x 2k candidates, so all sizes after the corpus scans
are bounded by the number of questions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, PASSAGE_RULE, Settings
from lectern.functions.jsonops import parse_rewrites
from lectern.functions.text import (
    bind,
    judge_passages,
    parse_verdict,
    split_sentences,
    tokens,
)
from lectern.functions.vectors import (
    Embedder,
    PairModel,
    embed,
    pair_score,
    sentence_similarity,
)
from lectern.operators.bm25 import Bm25Index, bm25_top_k, weights_of
from lectern.operators.postings import PostingIndex, postings_top_k
from lectern.operators.ranking import dedupe_by_prefix, ordered_union, top_k
from lectern.operators.vector_index import VectorIndex, probe_top_k
from lectern.operators.vector_search import vector_top_k
from lectern.session import at_most

# Up to this many query variants, their hits are broadcast to the scan that fetches the texts.
BROADCAST_VARIANTS = 20_000


@dataclass(frozen=True)
class SearchCorpus:
    """Chunks with vectors, and their BM25 index. `bm25=None` switches that leg off.

    With `vectors`, the vector leg probes the cells of that index instead of reading all chunks; with posting blocks
    as `bm25`, that leg reads blocks of the asked terms instead of all texts.
    """

    chunks: DataFrame  # chunk_id, chunk_text, embedding and any source columns
    bm25: Bm25Index | PostingIndex | None
    source_columns: tuple[str, ...] = ()
    embedder: Embedder | None = None
    settings: Settings = field(default=DEFAULTS)
    vectors: VectorIndex | None = None


PairScorer = Callable[[DataFrame], DataFrame]


# ---- query variants ----------------------------------------------------------------------


def query_variants(
    questions: DataFrame,
    question: str = "question",
    raw_rewrites: str = "raw_rewrites",
    pseudo_answer: str = "pseudo_answer",
) -> DataFrame:
    """One row per query variant of every question, in retrieval order."""
    listed = parse_rewrites(F.col(question), F.col(raw_rewrites), F.col(pseudo_answer))
    return questions.select("question_id", F.posexplode(listed)).select(
        "question_id", F.col("pos").alias("rewrite_idx"), "col.kind", "col.text"
    )


def single_variant(questions: DataFrame, question: str = "question") -> DataFrame:
    return questions.select(
        "question_id", F.lit(0).alias("rewrite_idx"), F.lit("question").alias("kind"),
        F.col(question).alias("text"),
    )


def tag_rewrites(variants: DataFrame) -> DataFrame:
    """Mark the original question, and the last variant the way a position-only view would."""
    last = F.max("rewrite_idx").over(W.partitionBy("question_id"))
    return variants.select(
        "*",
        (F.col("rewrite_idx") == 0).alias("is_origin"),
        ((F.col("rewrite_idx") == last) & (last > 0)).alias("is_last"),
        (F.col("kind") == "pseudo_answer").alias("is_pseudo_answer"),
    )


# ---- candidates --------------------------------------------------------------------------


def hybrid_hits(variants: DataFrame, corpus: SearchCorpus, k: int) -> DataFrame:
    """Vector hits then BM25 hits of every variant, with text; repeats within a leg pair kept."""
    key = F.concat_ws(":", F.col("question_id").cast("string"), F.col("rewrite_idx").cast("string"))
    keyed = variants.withColumn("variant_id", key)
    with_vector = keyed.withColumn("embedding", embed(F.col("text"), corpus.embedder))
    to_variant = {"query_id": "variant_id", "rank": "leg_rank"}
    if corpus.vectors is not None:
        legs = [probe_top_k(with_vector, corpus.vectors, k, corpus.settings.probes, **to_variant)]
    else:
        legs = [vector_top_k(with_vector, corpus.chunks, k, **to_variant)]
    if corpus.bm25 is not None:
        search = postings_top_k if isinstance(corpus.bm25, PostingIndex) else bm25_top_k
        legs.append(search(keyed, corpus.bm25, k, settings=corpus.settings, **to_variant))
    hits = ordered_union(*legs).withColumnRenamed("score", "leg_score")
    hits = hits.join(keyed.select("variant_id", "question_id", "rewrite_idx"), "variant_id")
    if at_most(variants, BROADCAST_VARIANTS):
        # at most variants x 2k narrow rows, checked just above
        hits = F.broadcast(hits)
    texts = corpus.chunks.select("chunk_id", "chunk_text", *corpus.source_columns)
    return texts.join(hits, "chunk_id").drop("variant_id")


_IN_ORDER = ("rewrite_idx", "src_ord", "leg_rank", "chunk_id")


def _in_order() -> list[Column]:
    return [F.col(c).asc() for c in _IN_ORDER]


def hybrid_candidates(variants: DataFrame, corpus: SearchCorpus, k: int) -> DataFrame:
    """The hits of each variant, without those whose text starts like an earlier one."""
    hits = hybrid_hits(variants, corpus, k)
    return _first_seen_texts(hits, ["question_id", "rewrite_idx"], corpus.settings)


def _first_seen_texts(hits: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    on = settings.dedupe_on
    chars = settings.dedupe_prefix_chars if on == "chunk_text" else None
    return dedupe_by_prefix(hits, keys, on, _in_order(), chars)


def merge_candidates(per_variant: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First-seen merge over the variants of a question, numbered from 0 in retrieval order."""
    merged = _first_seen_texts(per_variant, ["question_id"], settings)
    index = F.row_number().over(W.partitionBy("question_id").orderBy(*_in_order())) - 1
    return merged.withColumn("cand_index", index)


def multi_query_candidates(variants: DataFrame, corpus: SearchCorpus, k: int | None = None) -> DataFrame:
    """First-seen candidates over all variants of a question.

    The first row of a question and text start is also the first of its variant, so one pass
    over the hits does the work of deduplicating each variant and then their union.
    """
    k = k or corpus.settings.candidates_per_query
    return merge_candidates(hybrid_hits(variants, corpus, k), corpus.settings)


def retrieval_stats(variants: DataFrame, per_variant: DataFrame, merged: DataFrame) -> DataFrame:
    """Per variant: rows retrieved and rows no earlier variant had found."""
    retrieved = per_variant.groupBy("question_id", "rewrite_idx").agg(
        F.count("*").alias("retrieved")
    )
    fresh = merged.groupBy("question_id", "rewrite_idx").agg(F.count("*").alias("new"))
    keys = ["question_id", "rewrite_idx"]
    return (
        variants.select(*keys, "text")
        .join(retrieved, keys, "left")
        .join(fresh, keys, "left")
        .fillna(0, ["retrieved", "new"])
    )


def retrieval_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("question_id").agg(
        F.sum("retrieved").alias("total_with_dupes"), F.sum("new").alias("unique_candidates")
    )


# ---- reranking and grading ---------------------------------------------------------------


def term_overlap_scorer(
    questions: DataFrame,
    index: Bm25Index | PostingIndex,
    question: str = "question",
    broadcast_rows: int = DEFAULTS.broadcast_rows,
) -> PairScorer:
    """Default pair score: the share of a question's idf weight that a text contains (0 to 1)."""
    asked = questions.select(
        "question_id", F.explode(F.array_distinct(tokens(F.col(question)))).alias("term")
    )
    n_docs = index.stats.select("n_docs").scalar()
    df = F.coalesce(F.col("df"), F.lit(0))
    weight = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    known = weights_of(asked, index, broadcast_rows).select("term", "df")
    weighed = (
        asked.join(known, "term", "left")
        .select("question_id", "term", weight.alias("weight"))
        .groupBy("question_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_terms"),
            F.sum("weight").alias("_total"),
        )
    )

    def score(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(weighed, "question_id", "left")
        shared = F.array_intersect(
            F.transform("_terms", lambda t: t["term"]), tokens(F.col("chunk_text"))
        )

        def weigh(found: Column) -> Column:
            kept = F.filter("_terms", lambda t: F.array_contains(found, t["term"]))
            return F.aggregate(kept, F.lit(0.0), lambda acc, t: acc + t["weight"])

        share = F.round(F.coalesce(bind(shared, weigh) / F.col("_total"), F.lit(0.0)), 6)
        return joined.withColumn("score", share).drop("_terms", "_total")

    return score


def model_scorer(questions: DataFrame, model: PairModel, question: str = "question") -> PairScorer:
    """Pair score of a model that reads question and text together."""
    asked = questions.select("question_id", F.col(question).alias("_asked"))

    def score(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(asked, "question_id")
        scored = pair_score(F.col("_asked"), F.col("chunk_text"), model)
        return joined.withColumn("score", scored).drop("_asked")

    return score


def no_model_scorer(pairs: DataFrame) -> DataFrame:
    """Stands in for a missing model: no score, retrieval order kept."""
    return pairs.withColumn("score", F.lit(None).cast("double"))


def rerank(candidates: DataFrame, scorer: PairScorer, k: int = DEFAULTS.rerank_k) -> DataFrame:
    """The k best candidates of each question by pair score; ties keep retrieval order."""
    best = [F.col("score").desc_nulls_last(), F.col("cand_index").asc()]
    return top_k(scorer(candidates), ["question_id"], best, k)


def grade(score: Column, settings: Settings = DEFAULTS) -> Column:
    """Grade of a best score; a missing score is ambiguous."""
    return (
        F.when(score > settings.correct_above, "correct")
        .when(score < settings.incorrect_below, "incorrect")
        .otherwise("ambiguous")
    )


def grade_by_score(
    questions: DataFrame,
    ranked: DataFrame,
    key: str = "question_id",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(question, num_docs, max_score, grade) for every question; none found is incorrect."""
    best = ranked.groupBy(key).agg(
        F.count("*").alias("num_docs"), F.max("score").alias("max_score")
    )
    return (
        questions.select(key)
        .join(best, key, "left")
        .withColumn("num_docs", F.coalesce("num_docs", F.lit(0)))
        .withColumn(
            "grade",
            F.when(F.col("num_docs") == 0, "incorrect").otherwise(
                grade(F.col("max_score"), settings)
            ),
        )
    )


def judge_requests(ranked: DataFrame) -> DataFrame:
    """(question, passages): what a judge model is shown of each question's ranked passages."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
    texts = F.transform(listed, lambda x: x["chunk_text"])
    return ranked.groupBy("question_id").agg(judge_passages(texts).alias("passages"))


def grade_by_verdict(questions: DataFrame, ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`grade_by_score` with a judge's replies (question_id, verdict) in place of thresholds.

    A question without passages is incorrect, one without a readable reply ambiguous.
    """
    said = verdicts.select("question_id", parse_verdict(F.col("verdict")).alias("_said"))
    graded = grade_by_score(questions, ranked).join(said, "question_id", "left")
    judged = F.when(F.col("num_docs") == 0, "incorrect").otherwise(
        F.coalesce("_said", F.lit("ambiguous"))
    )
    return graded.withColumn("grade", judged).drop("_said")


# ---- compression and assembly ------------------------------------------------------------


def keep_sentences(
    text: Column,
    sentences: Column,
    scores: Column,
    threshold: float = DEFAULTS.compress_threshold,
    at_least: int = DEFAULTS.compress_min_sentences,
    document_order: bool = False,
) -> Column:
    """The relevant sentences of a text, joined by blanks.

    Texts of one sentence and questions without a vector (null scores) pass unchanged. When
    fewer than `at_least` sentences reach the threshold, the best ones are taken instead, best
    first, or in their place in the text with `document_order`.
    """
    scored = F.transform(
        F.arrays_zip(sentences.alias("s"), scores.alias("v")),
        lambda x, i: F.struct((-x["v"]).alias("minus"), i.alias("pos"), x["s"].alias("s")),
    )

    def choose(all_scored: Column) -> Column:
        passed = F.filter(all_scored, lambda x: -x["minus"] >= threshold)
        best = F.slice(F.array_sort(all_scored), 1, at_least)
        if document_order:
            best = F.array_sort(
                best, lambda a, b: (a["pos"] - b["pos"]).cast("int")
            )
        kept = F.when(F.size(passed) >= at_least, passed).otherwise(best)
        return F.array_join(F.transform(kept, lambda x: x["s"]), " ")

    return F.when((F.size(sentences) <= 1) | scores.isNull(), text).otherwise(
        bind(scored, choose)
    )


def compress(
    ranked: DataFrame,
    question: str = "question",
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add `compressed`: each passage cut to its relevant sentences, without leaving its row."""
    split = ranked.withColumn("_sentences", split_sentences(F.col("chunk_text")))
    scored = split.withColumn(
        "_scores", sentence_similarity(F.col(question), F.col("_sentences"), embedder)
    )
    kept = keep_sentences(
        F.col("chunk_text"), F.col("_sentences"), F.col("_scores"),
        settings.compress_threshold, settings.compress_min_sentences,
        settings.compress_document_order,
    )
    return scored.withColumn("compressed", kept).drop("_sentences", "_scores")


def assemble_context(
    ranked: DataFrame, text: str, keys: Sequence[str] = ("question_id",), rank: str = "rank"
) -> DataFrame:
    """One context per question: its few passages in rank order between rules."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(text).alias("_text"))))
    return ranked.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["_text"]), PASSAGE_RULE).alias("context")
    )


def project_sources(
    ranked: DataFrame,
    columns: Sequence[str],
    text: str = "compressed",
    keys: Sequence[str] = ("question_id",),
) -> DataFrame:
    """One ordered array of source structs per question: metadata, rounded score, shown text."""
    source = F.struct(
        F.col("rank"),
        F.col("chunk_id"),
        *[F.col(c) for c in columns],
        F.round("score", 3).alias("score"),
        F.col(text).alias("chunk_text"),
    )
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(source)).alias("sources"))


def compression_stats(compressed: DataFrame) -> DataFrame:
    """Lengths before and after, and the reduction in percent."""
    before, after = F.length("chunk_text"), F.length("compressed")
    return compressed.select(
        "question_id", "rank", "chunk_id",
        before.alias("before_length"),
        after.alias("after_length"),
        F.round(100 * (1 - after / F.greatest(before, F.lit(1))), 1).alias("reduction_pct"),
    )


def best_of_simple(candidates: DataFrame, k: int = DEFAULTS.vector_k) -> DataFrame:
    """The first k merged candidates in retrieval order, ranked from 1."""
    return top_k(candidates, ["question_id"], _in_order(), k)


