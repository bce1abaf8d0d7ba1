"""Search and retrieval over the documents as chunks: R2 to R12, W2, W4, W5, W8, W9, A7, A14, A15."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import query
from checks.ingest import word_place_sql
from checks.scalars import (
    REWRITES_SQL,
    most_hits_sql,
    questions,
    sentences_sql,
    sql_text,
    strip_sql,
)
from checks.tables import HISTORY_SQL, documents, history, table, with_ctes
from lectern.config import REPLY_LANGUAGES, Settings
from lectern.functions.language import STOP_WORDS
from lectern.functions.text import HEDGE_NOTE, REFUSE_NOTE
from lectern.operators import bm25, postings, ranking, retrieval
from lectern.operators.chunks import with_embedding
from lectern.operators.conversation import history_before
from lectern.operators.vector_index import build_vector_index, probe_top_k
from lectern.operators.vector_search import vector_top_k
from lectern.plans import search
from lectern.plans.chat import prepare_replies
from lectern.plans.evaluate import evaluate
from lectern.session import cut_lineage, shared_folder, stored_table

# ---- SQL ---------------------------------------------------------------------------------

RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def tokens_sql(expr: str) -> str:
    return rf"list_filter(string_split_regex({expr}, '\s+'), lambda w: w <> '')"


INDEX_CTES = {
    "docs": f"SELECT doc_id, text, source, lang, {tokens_sql('text')} AS toks FROM documents WHERE length(text) > 0",
    "tf": "SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM docs) GROUP BY ALL",
    "df": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "sizes": "SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM docs",
    "raw_idf": "SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS r FROM df, sizes",
    "mean_idf": "SELECT avg(r) AS mean FROM raw_idf",
    "idf": "SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw_idf, mean_idf",
}

# variants: question_id, rewrite_idx, text
LEG_CTES = {
    "vtok": f"SELECT question_id, rewrite_idx, term, count(*) AS times FROM (SELECT question_id, rewrite_idx, unnest({tokens_sql('text')}) AS term FROM variants) GROUP BY ALL",
    "bm_all": "SELECT question_id, rewrite_idx, doc_id, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score "
    "FROM vtok JOIN idf USING (term) JOIN tf USING (term), sizes GROUP BY ALL",
    "bm": "SELECT *, row_number() OVER (PARTITION BY question_id, rewrite_idx ORDER BY score DESC, doc_id) AS leg_rank FROM bm_all",
    "dvec": f"SELECT doc_id, dim, sum(sign) AS x FROM (SELECT doc_id, {word_place_sql('w')} FROM (SELECT doc_id, unnest(toks) AS w FROM docs)) GROUP BY ALL",
    "dnorm": "SELECT doc_id, sqrt(sum(x * x)) AS norm FROM dvec GROUP BY doc_id HAVING sum(x * x) > 0",
    "vvec": f"SELECT question_id, rewrite_idx, dim, sum(sign) AS x FROM (SELECT question_id, rewrite_idx, {word_place_sql('w')} FROM (SELECT question_id, rewrite_idx, unnest({tokens_sql('text')}) AS w FROM variants)) GROUP BY ALL",
    "vnorm": "SELECT question_id, rewrite_idx, sqrt(sum(x * x)) AS norm FROM vvec GROUP BY ALL HAVING sum(x * x) > 0",
    "vec_all": "SELECT question_id, rewrite_idx, doc_id, round(CAST(dot AS DOUBLE) / (d.norm * v.norm), 6) AS score FROM "
    "(SELECT question_id, rewrite_idx, doc_id, sum(v.x * d.x) AS dot FROM vvec v JOIN dvec d USING (dim) GROUP BY ALL) "
    "JOIN dnorm d USING (doc_id) JOIN vnorm v USING (question_id, rewrite_idx)",
    "vec": "SELECT *, row_number() OVER (PARTITION BY question_id, rewrite_idx ORDER BY score DESC, doc_id) AS leg_rank FROM vec_all",
}


def hits_ctes(k: int, same: str = "d.doc_id") -> dict[str, str]:
    """`same`: what makes two hits one; parity with comparing texts by their beginning is an option."""
    return {
        "hits": f"SELECT h.*, d.text, d.source, {same} AS start FROM ("
        f"SELECT question_id, rewrite_idx, 0 AS src_ord, leg_rank, doc_id FROM vec WHERE leg_rank <= {k} UNION ALL "
        f"SELECT question_id, rewrite_idx, 1, leg_rank, doc_id FROM bm WHERE leg_rank <= {k}) h JOIN docs d USING (doc_id)",
        "per_variant": "SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY question_id, rewrite_idx, start ORDER BY src_ord, leg_rank, doc_id) = 1",
        "cand": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rewrite_idx, src_ord, leg_rank, doc_id) - 1 AS cand_index FROM "
        "(SELECT * FROM per_variant QUALIFY row_number() OVER (PARTITION BY question_id, start ORDER BY rewrite_idx, src_ord, leg_rank, doc_id) = 1)",
    }


RANK_CTES = {
    "qterms": f"SELECT question_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM "
    f"(SELECT DISTINCT question_id, unnest({tokens_sql('text')}) AS term FROM asked) LEFT JOIN df USING (term), sizes",
    "scored": "SELECT c.*, coalesce(round(f.found / t.total, 6), 0) AS score FROM cand c "
    "JOIN (SELECT question_id, sum(w) AS total FROM qterms GROUP BY question_id) t USING (question_id) "
    "LEFT JOIN (SELECT c.question_id, c.doc_id, sum(q.w) AS found FROM cand c JOIN qterms q USING (question_id) "
    "JOIN tf ON tf.doc_id = c.doc_id AND tf.term = q.term GROUP BY ALL) f ON f.question_id = c.question_id AND f.doc_id = c.doc_id",
    "ranked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, cand_index) AS rank FROM scored) WHERE rank <= 5",
    "grades": "SELECT b.question_id, count(r.doc_id) AS num_docs, max(r.score) AS max_score, "
    "CASE WHEN count(r.doc_id) = 0 THEN 'incorrect' WHEN max(r.score) > 0.25 THEN 'correct' WHEN max(r.score) < 0.01 THEN 'incorrect' ELSE 'ambiguous' END AS grade "
    "FROM asked b LEFT JOIN ranked r ON r.question_id = b.question_id GROUP BY b.question_id",
    "relevant": "SELECT r.* FROM ranked r JOIN grades g USING (question_id) WHERE g.grade <> 'incorrect'",
    "sent": f"SELECT question_id, rank, n, s[i] AS s, i FROM (SELECT question_id, rank, len(s) AS n, s, unnest(range(1, len(s) + 1)) AS i FROM "
    f"(SELECT question_id, rank, {sentences_sql('text')} AS s FROM relevant))",
    "svec": f"SELECT question_id, rank, i, dim, sum(sign) AS x FROM (SELECT question_id, rank, i, {word_place_sql('w')} FROM "
    f"(SELECT question_id, rank, i, unnest({tokens_sql('s')}) AS w FROM sent)) GROUP BY ALL",
    "snorm": "SELECT question_id, rank, i, sqrt(sum(x * x)) AS norm FROM svec GROUP BY ALL",
    "sscore": "SELECT s.question_id, s.rank, s.i, s.n, s.s, CASE WHEN coalesce(sn.norm, 0) = 0 THEN 0 ELSE round(coalesce(d.dot, 0) / (sn.norm * qn.norm), 6) END AS score "
    "FROM sent s LEFT JOIN snorm sn USING (question_id, rank, i) "
    "LEFT JOIN (SELECT v.question_id, v.rank, v.i, CAST(sum(v.x * q.x) AS DOUBLE) AS dot FROM svec v JOIN vvec q ON q.question_id = v.question_id AND q.rewrite_idx = 0 AND q.dim = v.dim GROUP BY ALL) d USING (question_id, rank, i) "
    "JOIN vnorm qn ON qn.question_id = s.question_id AND qn.rewrite_idx = 0",
    "marked": "SELECT *, count(*) FILTER (WHERE score >= 0.55) OVER (PARTITION BY question_id, rank) AS passed, "
    "row_number() OVER (PARTITION BY question_id, rank ORDER BY score DESC, i) AS place FROM sscore",
    "shortened": "SELECT question_id, rank, string_agg(s, ' ' ORDER BY CASE WHEN passed >= 2 THEN i ELSE place END) AS t FROM marked "
    "WHERE n > 1 AND CASE WHEN passed >= 2 THEN score >= 0.55 ELSE place <= 2 END GROUP BY question_id, rank",
    "compressed": "SELECT r.*, coalesce(s.t, r.text) AS compressed FROM relevant r LEFT JOIN shortened s USING (question_id, rank)",
}

ONE_VARIANT = "SELECT item_id AS question_id, 0 AS rewrite_idx, text FROM benchmark"


ASKED = "SELECT item_id AS question_id, text FROM benchmark"


def search_sql(
    body: str, k: int = 10, variants: str = REWRITES_SQL, asked: str = ASKED, same: str = "d.doc_id", **first: str
) -> str:
    return with_ctes(
        body, **first, asked=asked, variants=variants, **INDEX_CTES, **LEG_CTES, **hits_ctes(k, same), **RANK_CTES
    )


# ---- Spark -------------------------------------------------------------------------------


def chunk_table(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), "source", "lang"
    )
    # stands for the stored gold table: vectors are made once, not once per scan
    return stored_table(with_embedding(rows))


def corpus(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir)
    return search_corpus(chunks)


def search_corpus(chunks):
    return retrieval.SearchCorpus(chunks, bm25.bm25_index(chunks).stored(), ("source",))


def indexed_corpus(spark, sf_dir):
    """The same with posting blocks, as the jobs have it; they pay off where one index serves many batches."""
    chunks = chunk_table(spark, sf_dir)
    return retrieval.SearchCorpus(chunks, postings.stored_postings(chunks), ("source",))


def plain_index(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return bm25.bm25_index(rows, "doc_id", "text")


@query(
    "vector_neighbors",
    """
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b)) WHERE rank <= 5""",
)
def vector_neighbors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    return vector_top_k(asked, vectors, 5, item_id="vec_id")


@query(
    "vector_neighbors_probed",
    """
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b)) WHERE rank <= 5""",
)
def vector_neighbors_probed(spark, sf_dir):
    """Two cells are read first, and of the others those that can hold a nearer vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    index = build_vector_index(vectors, shared_folder(spark), 16, "vec_id")
    return probe_top_k(asked, index, 5, probes=2)


@query(
    "vector_neighbors_all_cells",
    """
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b)) WHERE rank <= 5""",
)
def vector_neighbors_all_cells(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = build_vector_index(vectors, shared_folder(spark), 8, "vec_id")
    return probe_top_k(vectors.withColumnRenamed("vec_id", "query_id"), index, 5, probes=8)


TERM_CTES = INDEX_CTES | {"docs": f"SELECT doc_id, {tokens_sql('text')} AS toks FROM documents WHERE length(text) > 0"}


@query("bm25_terms", with_ctes("SELECT term, df, round(idf, 6) AS idf FROM idf", **TERM_CTES))
def bm25_terms(spark, sf_dir):
    return plain_index(spark, sf_dir).terms.withColumn("idf", F.round("idf", 6))


@query(
    "bm25_stats",
    with_ctes(
        "SELECT n AS n_docs, round(avg_len, 6) AS avg_len, round(0.25 * (SELECT avg(r) FROM raw_idf), 6) AS floor_idf FROM sizes",
        **INDEX_CTES,
    ),
)
def bm25_stats(spark, sf_dir):
    stats = plain_index(spark, sf_dir).stats
    return stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("floor_idf", 6).alias("floor_idf"))


@query("bm25_postings", with_ctes("SELECT term, doc_id, dl AS doc_len, tf FROM tf", **INDEX_CTES))
def bm25_postings(spark, sf_dir):
    return bm25.postings(plain_index(spark, sf_dir))


BEST_SQL = with_ctes(
    "SELECT question_id AS query_id, doc_id, score, leg_rank AS rank FROM bm WHERE leg_rank <= 5",
    variants=ONE_VARIANT, **INDEX_CTES, vtok=LEG_CTES["vtok"], bm_all=LEG_CTES["bm_all"], bm=LEG_CTES["bm"],
)
BEST_WITH_ZERO_SQL = with_ctes(
    "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
    "FROM (SELECT v.question_id AS query_id, d.doc_id, coalesce(b.score, 0) AS score FROM variants v CROSS JOIN docs d "
    "LEFT JOIN bm_all b ON b.question_id = v.question_id AND b.doc_id = d.doc_id)) WHERE rank <= 5",
    variants=ONE_VARIANT, **INDEX_CTES, vtok=LEG_CTES["vtok"], bm_all=LEG_CTES["bm_all"],
)


def asked_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_search", BEST_SQL)
def bm25_search(spark, sf_dir):
    index = postings.stored_postings(documents(spark, sf_dir), "doc_id", "text")
    return postings.postings_top_k(asked_items(spark, sf_dir), index, 5)


@query("bm25_search_with_zero", BEST_WITH_ZERO_SQL)
def bm25_search_with_zero(spark, sf_dir):
    """Always k rows: documents that share no term fill up with a score of 0."""
    index = postings.stored_postings(documents(spark, sf_dir), "doc_id", "text")
    return postings.postings_top_k(asked_items(spark, sf_dir), index, 5, with_zero=True)


@query("bm25_scan", BEST_SQL)
def bm25_scan(spark, sf_dir):
    """The same by scoring every text where it lies."""
    return bm25.bm25_top_k(asked_items(spark, sf_dir), plain_index(spark, sf_dir).stored(), 5)


@query("bm25_scan_with_zero", BEST_WITH_ZERO_SQL)
def bm25_scan_with_zero(spark, sf_dir):
    return bm25.bm25_top_k(asked_items(spark, sf_dir), plain_index(spark, sf_dir).stored(), 5, with_zero=True)


def single(spark, sf_dir):
    return retrieval.single_variant(questions(spark, sf_dir))


HYBRID_SQL = search_sql("SELECT question_id, src_ord, leg_rank, doc_id AS chunk_id FROM per_variant", 5, ONE_VARIANT)


@query("hybrid_candidates", HYBRID_SQL)
def hybrid_candidates(spark, sf_dir):
    rows = retrieval.hybrid_candidates(single(spark, sf_dir), corpus(spark, sf_dir), 5)
    return rows.select("question_id", "src_ord", "leg_rank", "chunk_id")


@query("hybrid_candidates_by_postings", HYBRID_SQL)
def hybrid_candidates_by_postings(spark, sf_dir):
    rows = retrieval.hybrid_candidates(single(spark, sf_dir), indexed_corpus(spark, sf_dir), 5)
    return rows.select("question_id", "src_ord", "leg_rank", "chunk_id")


@query(
    "hybrid_candidates_by_prefix",
    search_sql(
        "SELECT question_id, src_ord, leg_rank, doc_id AS chunk_id FROM per_variant", 5, ONE_VARIANT, same="substring(d.text, 1, 100)"
    ),
)
def hybrid_candidates_by_prefix(spark, sf_dir):
    """Texts that start alike count as one."""
    by_prefix = replace(corpus(spark, sf_dir), settings=Settings(dedupe_on="chunk_text"))
    rows = retrieval.hybrid_candidates(single(spark, sf_dir), by_prefix, 5)
    return rows.select("question_id", "src_ord", "leg_rank", "chunk_id")


@query(
    "multi_query_candidates",
    search_sql("SELECT question_id, rewrite_idx, src_ord, leg_rank, doc_id AS chunk_id, cand_index FROM cand"),
)
def multi_query_candidates(spark, sf_dir):
    variants = retrieval.query_variants(questions(spark, sf_dir))
    rows = retrieval.multi_query_candidates(variants, corpus(spark, sf_dir))
    return rows.select("question_id", "rewrite_idx", "src_ord", "leg_rank", "chunk_id", "cand_index")


@query(
    "rerank",
    search_sql("SELECT question_id, rank, doc_id AS chunk_id, score, cand_index AS original_index FROM ranked"),
)
def rerank(spark, sf_dir):
    asked, searched = questions(spark, sf_dir), corpus(spark, sf_dir)
    candidates = retrieval.multi_query_candidates(retrieval.query_variants(asked), searched)
    scorer = retrieval.term_overlap_scorer(asked, searched.bm25)
    return retrieval.rerank(candidates, scorer).select(
        "question_id", "rank", "chunk_id", "score", F.col("cand_index").alias("original_index")
    )


@query("grades", search_sql("SELECT question_id, num_docs, max_score, grade FROM grades"))
def grades(spark, sf_dir):
    return search.trace(questions(spark, sf_dir), corpus(spark, sf_dir)).grades


@query(
    "retrieval_stats",
    search_sql(
        "SELECT v.question_id, v.rewrite_idx, coalesce(p.n, 0) AS retrieved, coalesce(c.n, 0) AS new, "
        "CASE WHEN length(v.text) > 120 THEN substring(v.text, 1, 120) || '…' ELSE v.text END AS query FROM variants v "
        "LEFT JOIN (SELECT question_id, rewrite_idx, count(*) AS n FROM per_variant GROUP BY ALL) p USING (question_id, rewrite_idx) "
        "LEFT JOIN (SELECT question_id, rewrite_idx, count(*) AS n FROM cand GROUP BY ALL) c USING (question_id, rewrite_idx)"
    ),
)
def retrieval_stats(spark, sf_dir):
    return search.trace(questions(spark, sf_dir), corpus(spark, sf_dir)).retrieval


@query(
    "retrieval_totals",
    search_sql(
        "SELECT question_id, t AS total_with_dupes, u AS unique_candidates FROM "
        "(SELECT question_id, count(*) AS t FROM per_variant GROUP BY ALL) JOIN (SELECT question_id, count(*) AS u FROM cand GROUP BY ALL) USING (question_id)"
    ),
)
def retrieval_totals(spark, sf_dir):
    return search.trace(questions(spark, sf_dir), corpus(spark, sf_dir)).totals


@query(
    "trace_candidates",
    search_sql(
        "SELECT question_id, cand_index, doc_id AS chunk_id, length(text) AS length, source, "
        "CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS preview FROM cand"
    ),
)
def trace_candidates(spark, sf_dir):
    return search.trace(questions(spark, sf_dir), corpus(spark, sf_dir)).candidates


@query(
    "compression_stats",
    search_sql(
        "SELECT question_id, rank, doc_id AS chunk_id, length(text) AS before_length, length(compressed) AS after_length, "
        "round(100 * (1 - length(compressed) / greatest(length(text), 1)), 1) AS reduction_pct FROM compressed"
    ),
)
def compression_stats(spark, sf_dir):
    return search.trace(questions(spark, sf_dir), corpus(spark, sf_dir)).compressed


ANSWER_SQL = (
    "SELECT b.item_id AS question_id, g.num_docs, g.max_score AS top_score, g.grade, md5(coalesce(c.context, '')) AS context, "
    "coalesce(c.sources, '') AS sources FROM benchmark b JOIN grades g ON g.question_id = b.item_id LEFT JOIN "
    f"(SELECT question_id, string_agg(compressed, {RULE} ORDER BY rank) AS context, "
    "string_agg(concat(rank, ':', doc_id, ':', source, ':', CAST(round(score * 1000) AS BIGINT), ':', md5(compressed)), ',' ORDER BY rank) AS sources "
    "FROM compressed GROUP BY question_id) c ON c.question_id = b.item_id"
)


def shown_answers(answers):
    """Answers with their nested parts as text, to be compared with SQL."""
    line = F.transform(
        "sources",
        lambda s: F.concat_ws(
            ":", s["rank"].cast("string"), s["chunk_id"].cast("string"), s["source"],
            F.round(s["score"] * 1000).cast("bigint").cast("string"), F.md5(s["chunk_text"]),
        ),
    )
    return answers.select(
        "question_id", "num_docs", "top_score", "grade", F.md5("context").alias("context"),
        F.coalesce(F.array_join(line, ","), F.lit("")).alias("sources"),
    )


@query("retrieve_multistage", search_sql(ANSWER_SQL))
def retrieve_multistage(spark, sf_dir):
    return shown_answers(search.retrieve_multistage(questions(spark, sf_dir), corpus(spark, sf_dir)))


@query("retrieve_multistage_by_postings", search_sql(ANSWER_SQL))
def retrieve_multistage_by_postings(spark, sf_dir):
    return shown_answers(search.retrieve_multistage(questions(spark, sf_dir), indexed_corpus(spark, sf_dir)))


@query("trace_answers", search_sql(ANSWER_SQL))
def trace_answers(spark, sf_dir):
    return shown_answers(search.trace(questions(spark, sf_dir), corpus(spark, sf_dir)).answers)


# The passages themselves are the questions, so every verdict expected is "correct"; every question has an answer.
@query(
    "evaluate",
    search_sql(
        "SELECT b.text AS question, 'in_scope' AS category, g.grade AS obtained_verdict, g.max_score AS top_score, "
        "g.grade = 'correct' AS match, CAST(coalesce(c.n, 0) AS BIGINT) AS num_sources, "
        "CASE WHEN g.grade <> 'incorrect' THEN concat('So: ', b.text) END AS answer, coalesce(c.contexts, '') AS contexts, "
        "CASE WHEN g.grade <> 'incorrect' AND coalesce(c.n, 0) = 0 THEN 'no answer or no context, so not judged' END AS error "
        "FROM benchmark b JOIN grades g ON g.question_id = b.item_id LEFT JOIN (SELECT question_id, count(*) AS n, "
        "md5(string_agg(compressed, '|' ORDER BY rank)) AS contexts FROM compressed GROUP BY question_id) c ON c.question_id = b.item_id"
    ),
)
def evaluation_run(spark, sf_dir):
    asked = questions(spark, sf_dir).withColumns(
        {"category": F.lit("in_scope"), "expected_verdict": F.lit("correct")}
    )
    answers = asked.select("question_id", F.concat(F.lit("So: "), "question").alias("answer"))
    rows = evaluate(asked, corpus(spark, sf_dir), answers)
    texts = F.when(F.size("context_texts") > 0, F.md5(F.array_join("context_texts", "|"))).otherwise("")
    return rows.select(
        "question", "category", "obtained_verdict", "top_score", "match",
        F.col("num_sources").cast("bigint").alias("num_sources"), "answer", texts.alias("contexts"), "error",
    )


# A judge answers by the length of the question.
@query(
    "judged_grades",
    search_sql(
        "SELECT g.question_id, g.num_docs, g.max_score, CASE WHEN g.num_docs = 0 THEN 'incorrect' "
        "WHEN length(b.text) % 4 = 0 THEN 'correct' WHEN length(b.text) % 4 = 1 THEN 'incorrect' ELSE 'ambiguous' END AS grade, "
        "md5(p.passages) AS passages FROM grades g JOIN benchmark b ON b.item_id = g.question_id JOIN (SELECT question_id, "
        f"string_agg(concat('[', rank, '] ', substring(text, 1, 400)), {RULE} ORDER BY rank) AS passages FROM ranked GROUP BY question_id) p "
        "ON p.question_id = g.question_id"
    ),
)
def judged_grades(spark, sf_dir):
    asked, searched = questions(spark, sf_dir), corpus(spark, sf_dir)
    candidates = retrieval.multi_query_candidates(retrieval.query_variants(asked), searched)
    ranked = cut_lineage(retrieval.rerank(candidates, retrieval.term_overlap_scorer(asked, searched.bm25)))
    kind = F.length("question") % 4
    reply = F.when(kind == 0, "Yes, they do.").when(kind == 1, " no").when(kind == 2, "Partial")
    verdicts = asked.select("question_id", reply.alias("verdict"))
    shown = retrieval.judge_requests(ranked).withColumn("passages", F.md5("passages"))
    return retrieval.grade_by_verdict(asked, ranked, verdicts).join(shown, "question_id")


PLAIN_SQL = (
    "SELECT b.item_id AS question_id, 'correct' AS grade, md5(coalesce(c.context, '')) AS context, coalesce(c.sources, '') AS sources "
    "FROM benchmark b LEFT JOIN (SELECT question_id, string_agg(text, {rule} ORDER BY rank) AS context, "
    "string_agg(concat(rank, ':', doc_id), ',' ORDER BY rank) AS sources FROM ({rows}) GROUP BY question_id) c ON c.question_id = b.item_id"
)


def plain_answers(answers):
    line = F.transform(
        "sources", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["chunk_id"].cast("string"))
    )
    return answers.select(
        "question_id", "grade", F.md5("context").alias("context"),
        F.coalesce(F.array_join(line, ","), F.lit("")).alias("sources"),
    )


@query(
    "retrieve_simple",
    search_sql(
        PLAIN_SQL.format(rule=RULE, rows="SELECT question_id, doc_id, text, cand_index + 1 AS rank FROM cand WHERE cand_index < 5"),
        5, ONE_VARIANT,
    ),
)
def retrieve_simple(spark, sf_dir):
    return plain_answers(search.retrieve_simple(questions(spark, sf_dir), corpus(spark, sf_dir)))


@query(
    "retrieve_vector_only",
    search_sql(
        PLAIN_SQL.format(rule=RULE, rows="SELECT v.question_id, v.doc_id, d.text, v.leg_rank AS rank FROM vec v JOIN docs d USING (doc_id) WHERE v.leg_rank <= 5"),
        5, ONE_VARIANT,
    ),
)
def retrieve_vector_only(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir)
    plain = retrieval.SearchCorpus(chunks, None)
    return plain_answers(search.retrieve_vector_only(questions(spark, sf_dir), plain))


# ---- ranking on its own ------------------------------------------------------------------


@query(
    "top_k_per_key",
    "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents "
    "QUALIFY rank <= 3",
)
def top_k_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ranking.top_k(rows, ["source"], [F.col("n_chars").desc(), F.col("doc_id").asc()], 3, spread_by="doc_id")


@query(
    "dedupe_by_prefix",
    "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, substring(text, 1, 100) ORDER BY doc_id) = 1",
)
def dedupe_by_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return ranking.dedupe_by_prefix(rows, ["lang"], "text", [F.col("doc_id").asc()]).select("lang", "doc_id")


@query(
    "rank_with_origin",
    """
SELECT user_id, event_id, original_index, rank FROM (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS original_index,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""",
)
def rank_with_origin(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    ranked = ranking.rank_with_origin(
        rows, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()],
        [F.col("value").desc(), F.col("event_id").asc()], 5,
    )
    return ranked.select("user_id", "event_id", "original_index", "rank")


@query(
    "ordered_union",
    "SELECT doc_id AS id, 0 AS src_ord FROM documents UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT page_id, 2 FROM pages",
)
def ordered_union(spark, sf_dir):
    legs = [
        table(spark, sf_dir, name).select(F.col(key).alias("id"))
        for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"))
    ]
    return ranking.ordered_union(*legs)


@query(
    "grade_by_score",
    """
SELECT d.doc_id AS question_id, count(l.doc_id) AS num_docs, max(l.s) AS max_score,
       CASE WHEN count(l.doc_id) = 0 THEN 'incorrect' WHEN max(l.s) > 0.25 THEN 'correct'
            WHEN max(l.s) < 0.01 THEN 'incorrect' ELSE 'ambiguous' END AS grade
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 0 THEN quality / 4.0 + 0.005 END AS s FROM labels) l ON l.doc_id = d.doc_id
GROUP BY d.doc_id""",
)
def grade_by_score(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    score = F.when(F.col("toxic") == 0, F.col("quality") / 4.0 + 0.005)
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), score.alias("score"))
    return retrieval.grade_by_score(asked, found)


@query(
    "latest_events",
    "SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 20)",
)
def latest_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ranking.latest(rows, [F.col("ts").desc(), F.col("event_id").asc()], 20).drop("ts")


# ---- conversations -----------------------------------------------------------------------

# Every question of the conversations is a message that is answered from the documents.
MESSAGES_SQL = "SELECT id AS question_id, content AS text FROM history WHERE role = 'user' AND length(content) > 0"
LANGUAGE_SQL = (
    f"CASE WHEN length({strip_sql('m.text')}) < 3 THEN 'French' ELSE CASE "
    f"{most_hits_sql(strip_sql('m.text'), STOP_WORDS, 'unknown')} "
    + " ".join(f"WHEN '{code}' THEN '{name}'" for code, (name, _) in REPLY_LANGUAGES.items())
    + " ELSE 'French' END END"
)


@query(
    "prepare_replies",
    search_sql(
        f""", rows AS (SELECT m.question_id, g.grade, m.text, {LANGUAGE_SQL} AS lang_name, c.context FROM asked m JOIN grades g USING (question_id)
  LEFT JOIN (SELECT question_id, string_agg(compressed, {RULE} ORDER BY rank) AS context FROM compressed GROUP BY question_id) c USING (question_id)),
asking AS (SELECT *, concat('Student question: ', text, chr(10), chr(10), 'Reply in ', lang_name, '.') AS ask FROM rows),
past AS (SELECT u.id AS question_id, t.role, t.content, row_number() OVER (PARTITION BY u.id ORDER BY t.created_at DESC, t.id DESC) AS age,
  row_number() OVER (PARTITION BY u.id ORDER BY t.created_at, t.id) AS nr
  FROM history u JOIN history t ON t.session_id = u.session_id AND t.created_at < u.created_at WHERE u.role = 'user'),
told AS (SELECT question_id, count(*) AS turns, md5(string_agg(concat(role, ':', content), '|' ORDER BY nr)) AS digest FROM past WHERE age <= 20 GROUP BY question_id)
SELECT a.question_id AS message_id, a.lang_name, a.grade, coalesce(t.turns, 0) AS turns, coalesce(t.digest, md5('')) AS past,
  md5(CASE WHEN grade = 'incorrect' THEN concat(ask, {sql_text(REFUSE_NOTE)})
   WHEN coalesce(context, '') <> '' THEN concat('Answer from this course material.', chr(10), chr(10), '<<<', chr(10), context, chr(10), '>>>',
        chr(10), chr(10), ask, CASE WHEN grade = 'ambiguous' THEN {sql_text(HEDGE_NOTE)} ELSE '' END)
   ELSE concat(text, chr(10), chr(10), 'Reply in ', lang_name, '.') END) AS prompt
FROM asking a LEFT JOIN told t USING (question_id)""",
        variants="SELECT question_id, 0 AS rewrite_idx, text FROM asked", asked=MESSAGES_SQL, history=HISTORY_SQL,
    ),
)
def replies(spark, sf_dir):
    turns = history(spark, sf_dir)
    messages = turns.filter(F.col("role") == "user").select(
        F.col("id").alias("message_id"), "session_id", F.col("content").alias("text"),
        F.col("created_at").alias("asked_at"),
    )
    prepared = prepare_replies(messages, turns, corpus(spark, sf_dir))
    told = F.array_join(F.transform("history", lambda t: F.concat_ws(":", t["role"], t["content"])), "|")
    return prepared.select(
        "message_id", "lang_name", "grade", F.size("history").cast("bigint").alias("turns"),
        F.md5(told).alias("past"), F.md5("prompt").alias("prompt"),
    )


@query(
    "history_before",
    with_ctes(
        """
SELECT u.id AS message_id, count(t.id) AS turns, coalesce(md5(string_agg(CAST(t.id AS VARCHAR), ',' ORDER BY t.created_at, t.id)), '') AS past
FROM history u LEFT JOIN (SELECT u.id AS message_id, t.id, t.created_at, row_number() OVER (PARTITION BY u.id ORDER BY t.created_at DESC, t.id DESC) AS age
  FROM history u JOIN history t ON t.session_id = u.session_id AND t.created_at < u.created_at) t ON t.message_id = u.id AND t.age <= 4
GROUP BY u.id""",
        history=HISTORY_SQL,
    ),
)
def turns_before(spark, sf_dir):
    """Here every turn is a message, the contents are ids, and only four turns are kept."""
    turns = history(spark, sf_dir).withColumn("content", F.col("id").cast("string"))
    messages = turns.select(
        F.col("id").alias("message_id"), "session_id", F.col("created_at").alias("asked_at")
    )
    past = history_before(messages, turns, turns=2)
    listed = F.array_join(F.transform("history", lambda t: t["content"]), ",")
    return past.select(
        "message_id", F.size("history").cast("bigint").alias("turns"),
        F.when(F.size("history") > 0, F.md5(listed)).otherwise("").alias("past"),
    )
