"""BM25 ranking over white-space tokens.

The index is the document frequency of every term and one row of corpus numbers; both are small
beside the corpus and are kept as tables. The documents themselves are not copied: they are
tokenised where they lie, one row per document, while they are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.functions.text import tokens
from lectern.operators.blocks import best_per_query
from lectern.session import checked_broadcast, stored_table

@dataclass(frozen=True)
class Bm25Index:
    docs: DataFrame  # item id, tokens; made from the corpus on every read
    frequencies: DataFrame  # term, df
    stats: DataFrame  # n_docs, avg_len, floor_idf
    item_id: str = "chunk_id"
    epsilon: float = DEFAULTS.bm25_epsilon

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf); a negative weight is replaced by the floor."""
        return with_idf(self.frequencies, self.stats).select("term", "df", "idf")

    def write(self, path: str) -> Bm25Index:
        """Store the two tables under `path` and return the index that reads them."""
        spark = self.docs.sparkSession

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        return self._kept(keep)

    def stored(self) -> Bm25Index:
        """The same index with its tables made once, in the shared folder."""
        return self._kept(lambda df, _: stored_table(df))

    def _kept(self, keep: Callable[[DataFrame, str], DataFrame]) -> Bm25Index:
        # each table is derived from the stored ones before it, so the corpus is read twice in all
        frequencies = keep(self.frequencies, "frequencies")
        sizes = keep(_sizes(self.docs), "sizes")
        stats = keep(_with_floor(sizes, frequencies, self.epsilon), "stats")
        return replace(self, frequencies=frequencies, stats=stats)


def corpus_mark(corpus: DataFrame, item_id: str, text: str) -> str:
    """Count and hash over ids and texts: it also changes when texts change and the count stays."""
    row = corpus.filter(F.length(text) > 0).agg(
        F.count("*"), F.expr(f"bit_xor(xxhash64(`{item_id}`, `{text}`))")
    ).first()
    return f"{row[0]}:{row[1]}"


def cached_index(
    corpus: DataFrame,
    path: str,
    item_id: str = "chunk_id",
    text: str = "chunk_text",
    settings: Settings = DEFAULTS,
    mark: str | None = None,
) -> Bm25Index:
    """The index stored under `path`, or a new one where the corpus has changed since.

    A corpus is known by `mark`, for instance the name of its stored version. Without one, the
    texts are read once to make a mark.
    """
    spark = corpus.sparkSession
    fresh = bm25_index(corpus, item_id, text, settings)
    mark = mark or corpus_mark(corpus, item_id, text)
    try:
        seen = spark.read.schema("mark string").parquet(f"{path}/corpus").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        seen = []
    if [r["mark"] for r in seen] == [mark]:
        names = ("frequencies", "stats")
        kept = {n: spark.read.schema(getattr(fresh, n).schema).parquet(f"{path}/{n}") for n in names}
        return replace(fresh, **kept)
    index = fresh.write(path)
    marked = spark.createDataFrame([(mark,)], "mark string")
    marked.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return index


def _raw_idf(n_docs):
    return F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def with_idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequencies with the weight `idf`; a negative one is replaced by the floor."""
    raw = _raw_idf(stats.select("n_docs").scalar())
    return frequencies.withColumn("idf", F.when(raw < 0, stats.select("floor_idf").scalar()).otherwise(raw))


def _document_frequencies(docs: DataFrame) -> DataFrame:
    """Counting is combined before the shuffle: a term costs one row per partition."""
    each = docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


def _with_floor(sizes: DataFrame, frequencies: DataFrame, epsilon: float) -> DataFrame:
    raw = _raw_idf(sizes.select("n_docs").scalar())
    return sizes.withColumn("floor_idf", frequencies.agg(F.lit(epsilon) * F.avg(raw)).scalar())


def bm25_index(
    corpus: DataFrame,
    item_id: str = "chunk_id",
    text: str = "chunk_text",
    settings: Settings = DEFAULTS,
) -> Bm25Index:
    """Index the rows of `corpus` whose text is not empty. Nothing is computed yet."""
    docs = corpus.filter(F.length(text) > 0).select(item_id, tokens(F.col(text)).alias("tokens"))
    frequencies = _document_frequencies(docs)
    stats = _with_floor(_sizes(docs), frequencies, settings.bm25_epsilon)
    return Bm25Index(docs, frequencies, stats, item_id, settings.bm25_epsilon)


def postings(index: Bm25Index) -> DataFrame:
    """(term, item, tf, document length): the inverted form of the index."""
    exploded = index.docs.select(
        index.item_id, F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term")
    )
    # a document's rows are together, so the counts are complete before the shuffle
    return exploded.groupBy("term", index.item_id, "doc_len").agg(F.count("*").alias("tf"))


def weights_of(asked: DataFrame, index: Bm25Index, broadcast_rows: int) -> DataFrame:
    """The rows of `index.terms` for the terms in `asked`.

    A vocabulary grows with the corpus. Where the asked terms are few, which is checked, they go
    to the vocabulary and it is read in place; otherwise both sides are shuffled by term.
    """
    wanted = checked_broadcast(asked.select("term").distinct(), broadcast_rows)
    return index.terms.join(wanted, "term", "left_semi")


def query_terms(
    queries: DataFrame, index: Bm25Index, query_id: str, text: str, broadcast_rows: int
) -> DataFrame:
    """(query, term, weight): weight is idf times how often the query repeats the term."""
    asked = (
        queries.select(query_id, F.explode(tokens(F.col(text))).alias("term"))
        .groupBy(query_id, "term")
        .agg(F.count("*").alias("times"))
    )
    return asked.join(weights_of(asked, index, broadcast_rows), "term").select(
        query_id, "term", (F.col("idf") * F.col("times")).alias("weight")
    )


# A term of at least one in `SHARE` of many queries is common: common terms, `COMMON` at most, are scored by a product of matrices.
SHARE, COMMON, MANY = 64, 256, 256


class Bm25Scorer:
    def __init__(self, terms: pa.Table, avg_len: float, k1: float, b: float, with_zero: bool):
        self.avg_len, self.k1, self.b, self.with_zero = avg_len, k1, b, with_zero
        query = terms.column(0).combine_chunks().dictionary_encode()
        term = terms.column("term").combine_chunks().dictionary_encode()
        self.query_ids = query.dictionary.to_pylist()
        self.vocabulary = term.dictionary
        term_of = term.indices.to_numpy()
        order = np.argsort(term_of, kind="stable")
        self.query_of = query.indices.to_numpy()[order]
        self.weight = terms.column("weight").to_numpy()[order]
        self.positive = bool((self.weight > 1e-12).all())
        # entries of term t are first[t] : first[t + 1]
        self.first = np.searchsorted(term_of[order], np.arange(len(self.vocabulary) + 1))
        self.common = np.full(len(self.vocabulary), -1)  # number of a common term
        self.weights = np.zeros((0, len(self.query_ids)))  # [common terms, queries]
        if self.positive and len(self.query_ids) >= MANY:
            asking = np.diff(self.first)
            terms = np.argsort(-asking, kind="stable")[:COMMON]
            terms = terms[asking[terms] * SHARE >= len(self.query_ids)]
            self.common[terms] = np.arange(len(terms))
            self.weights = np.zeros((len(terms), len(self.query_ids)))
            for number, term in enumerate(terms):
                entries = slice(self.first[term], self.first[term + 1])
                np.add.at(self.weights[number], self.query_of[entries], self.weight[entries])

    def score(self, corpus: pa.Table, cells: int) -> Iterator[tuple]:
        listed = corpus.column(1).combine_chunks()
        n, q = len(listed), len(self.query_ids)
        lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        hit = pc.index_in(listed.flatten(), value_set=self.vocabulary)
        found = hit.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(n), lengths)[found]
        term = hit.drop_null().to_numpy().astype(np.int64)
        pairs, tf = np.unique(doc * len(self.vocabulary) + term, return_counts=True)
        doc, term = np.divmod(pairs, max(1, len(self.vocabulary)))
        norm = self.k1 * (1 - self.b + self.b * lengths[doc] / self.avg_len)
        part = tf * (self.k1 + 1) / (tf + norm)
        # every (document, term) meets the queries that hold the term; whole documents, about `cells` meetings at a time
        many = np.where(self.common[term] < 0, self.first[term + 1] - self.first[term], 0)
        ends = np.searchsorted(doc, np.arange(n + 1))
        so_far = np.append(0, np.cumsum(many))[ends]
        at, rows = 0, max(1, cells // max(1, q))
        while at < n:
            to = int(np.searchsorted(so_far, so_far[at] + cells, "right")) - 1
            to = max(at + 1, min(to, at + rows, n))
            some = slice(ends[at], ends[to])
            yield slice(at, to), None, self._met(doc[some] - at, term[some], part[some], many[some], to - at)
            at = to

    def _met(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
        q = len(self.query_ids)
        owner = np.repeat(np.arange(len(doc)), many)
        entry = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        entry += self.first[term][owner]
        cell = doc[owner] * q + self.query_of[entry]
        scores = np.bincount(cell, part[owner] * self.weight[entry], n * q).astype(float, copy=False)
        scores = scores.reshape(n, q)  # without any hit the counts are whole numbers
        if len(self.weights):
            shared = np.flatnonzero(self.common[term] >= 0)
            parts = np.zeros((n, len(self.weights)))
            parts[doc[shared], self.common[term[shared]]] = part[shared]
            scores += parts @ self.weights
        if not self.with_zero:
            # above weights of more than 0, only what is not hit has a score of 0
            missed = scores == 0 if self.positive else np.bincount(cell, minlength=n * q).reshape(n, q) == 0
            scores[missed] = np.nan
        return scores


def bm25_top_k(
    queries: DataFrame,
    index: Bm25Index,
    k: int = DEFAULTS.bm25_k,
    query_id: str = "query_id",
    text: str = "text",
    with_zero: bool = False,
    settings: Settings = DEFAULTS,
    broadcast_rows: int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The k best documents of each query: (query id, item id, score, rank).

    Documents that share no term with a query are left out, unless `with_zero` asks for them
    to fill up to k.
    """
    stats = index.stats.first()
    avg_len = stats["avg_len"] or 1.0
    k1, b = settings.bm25_k1, settings.bm25_b
    rows = broadcast_rows if broadcast_rows is not None else settings.broadcast_rows
    terms = query_terms(queries, index, query_id, text, rows)
    return best_per_query(
        terms,
        index.docs.select(index.item_id, "tokens"),
        lambda block: Bm25Scorer(block, avg_len, k1, b, with_zero),
        k,
        rows,
        rank=rank,
    )
