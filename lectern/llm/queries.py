"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, conversation_repair, decontaminate, language_id, licences, line_dedup, lm_scoring, neighbours, token_counts, token_files, toxicity, whitening
from lectern.llm.jaccard_join import near_duplicates
from lectern.session import shared_folder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.filter(_remainder("doc_id", 5) != 0)
    found = language_id.identify(docs.select("doc_id", "text"), PIECES, labelled)
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


#: Not registered as an oracle, since the last digits of a sum of doubles depend on its order; the tests compare with it.
NEAREST_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_reduce(list_transform(
        CAST(embedding AS DOUBLE[]), lambda x: x * x), lambda s, x: s + x)) AS norm FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(
        range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda s, x: s + x) / (q.norm * c.norm) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op2_nearest_vectors")
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


#: A line of a later copy: it matches an earlier line, and the matching lines around it on the same diagonal have 50 words.
LINES_SQL = r"""
WITH cut AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
counted AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS words FROM cut),
numbered AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos FROM counted WHERE words > 0),
matches AS (
    SELECT x.doc_id, x.no, x.pos, x.words, y.doc_id AS other, x.pos - y.pos AS diagonal
    FROM numbered x JOIN numbered y ON x.line = y.line AND (y.doc_id < x.doc_id OR (y.doc_id = x.doc_id AND y.pos < x.pos))),
stretches AS (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY pos) AS stretch FROM matches),
runs AS (
    SELECT *, sum(words) OVER (PARTITION BY doc_id, other, diagonal, stretch) AS total FROM stretches),
gone AS (SELECT DISTINCT doc_id, no FROM runs WHERE total >= 50)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
    (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_deleted,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(
        (SELECT string_agg(c.line, chr(10) ORDER BY c.no) FROM cut c
         WHERE c.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = c.doc_id AND g.no = c.no)), '') END AS text
FROM documents d
"""


@_query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_words=50).select("doc_id", "n_lines", "n_deleted", "text")


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Number of ids, and digests of the ids and of the text that they decode to."""
    return bpe.encode_and_decode(docs, WORD_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@_query("op4_bpe_encode_decode")
def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_table(spark, sf_dir, "documents"))


@_query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), _remainder("doc_id", 3) == 1
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    # the language chooses the threshold of the further column `flagged` only
    scored = toxicity.flag_by_language(toxicity.score(docs.select("doc_id", "text", "lang"), model), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "flagged")


@_query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.line_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE, rule="most")


@_query("op7_licence_scan")
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


JACCARD_SQL = r"""
WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM words
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM words w LEFT JOIN sizes z ON z.doc_id = w.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
"""


@_query("op8_ngram_jaccard_join", JACCARD_SQL)
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = whitening.fit(vectors)
    return whitening.component_rows(whitening.whiten(vectors, models), models, "vec_id")


#: The checksum by a table of 256 entries; then the best edits from each place (start, system, user, assistant), last row first.
REPAIR_SQL = r"""
WITH RECURSIVE
checksum AS (
    SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
drawn AS (
    SELECT k.*, xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS h FROM keyed k, checksum),
rows_ AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE h <> 0),
numbered AS (
    SELECT *, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows_),
faulty AS MATERIALIZED (
    SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
        lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
        count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
        count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
    FROM faulty GROUP BY conv_id),
walk AS (
    SELECT conv_id, last + 1 AS n, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS v1, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']} AS v2,
        {'c': 3, 'a': 'I', 'r': ['assistant:']} AS v3, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS v4 FROM counts
    UNION ALL
    SELECT conv_id, n, least(b1, {'c': v3.c + 3, 'a': 'I' || v3.a, 'r': list_prepend('user:', v3.r)}), least(b2, {'c': v3.c + 3, 'a': 'I' || v3.a, 'r': list_prepend('user:', v3.r)}), v3,
        least(b4, {'c': b3.c + 3, 'a': 'I' || b3.a, 'r': list_prepend('user:', b3.r)})
    FROM (SELECT *, least(b3, {'c': b4.c + 3, 'a': 'I' || b4.a, 'r': list_prepend('assistant:', b4.r)}) AS v3 FROM (
        SELECT w.conv_id, w.n - 1 AS n, CASE WHEN f = 't' THEN 3 ELSE 0 END AS extra,
            least({'c': v1.c + 4, 'a': 'D' || v1.a, 'r': v1.r},
            CASE WHEN f IN ('', 't') THEN {'c': v3.c + 3 + extra, 'a': 'R' || v3.a, 'r': list_prepend('user:' || text, v3.r)} END,
            CASE WHEN f IN ('', 't') AND i = 's' THEN {'c': v2.c + extra, 'a': 'K' || v2.a, 'r': list_prepend(role || ':' || text, v2.r)} END,
            CASE WHEN f IN ('', 't') AND i = 'u' THEN {'c': v3.c + extra, 'a': 'K' || v3.a, 'r': list_prepend(role || ':' || text, v3.r)} END) AS b1,
            least({'c': v2.c + 4, 'a': 'D' || v2.a, 'r': v2.r},
            CASE WHEN f IN ('', 't') THEN {'c': v3.c + 3 + extra, 'a': 'R' || v3.a, 'r': list_prepend('user:' || text, v3.r)} END,
            CASE WHEN f IN ('', 't') AND i = 'u' THEN {'c': v3.c + extra, 'a': 'K' || v3.a, 'r': list_prepend(role || ':' || text, v3.r)} END) AS b2,
            least({'c': v3.c + 4, 'a': 'D' || v3.a, 'r': v3.r},
            CASE WHEN f IN ('', 't') THEN {'c': v4.c + 3 + extra, 'a': 'R' || v4.a, 'r': list_prepend('assistant:' || text, v4.r)} END,
            CASE WHEN f IN ('', 't') AND i = 'a' THEN {'c': v4.c + extra, 'a': 'K' || v4.a, 'r': list_prepend(role || ':' || text, v4.r)} END) AS b3,
            least({'c': v4.c + 4, 'a': 'D' || v4.a, 'r': v4.r},
            CASE WHEN f IN ('', 't') THEN {'c': v3.c + 3 + extra, 'a': 'R' || v3.a, 'r': list_prepend('user:' || text, v3.r)} END,
            CASE WHEN f IN ('', 't') AND i = 'u' THEN {'c': v3.c + extra, 'a': 'K' || v3.a, 'r': list_prepend(role || ':' || text, v3.r)} END) AS b4
        FROM walk w JOIN faulty x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.n = w.n - 1)))
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
    coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(w.v1.c, 0) AS BIGINT) AS cost,
    coalesce(w.v1.a, '') AS audit, sha256(coalesce(array_to_string(w.v1.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.n = 1
"""


@_query("op11_conversation_repair", REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.summaries(conversation_repair.damaged(rows)).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    lost = F.col("audit").isNull()  # no row of the conversation is left
    columns = [n for n in found.columns if n != "found_id"]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *(F.when(lost, none.get(n, F.lit(0))).otherwise(F.col(n)).alias(n) for n in columns)
    )


@_query("op12_lm_scoring")
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learned = _table(spark, sf_dir, "documents").select("doc_id", "text"), _remainder("doc_id", 10) != 0
    return lm_scoring.score(docs, learned, BYTE_BPE_MULTI, lm_scoring.train(docs, learned, BYTE_BPE_MULTI))
