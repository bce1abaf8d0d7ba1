"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions.vectors import has_length
from lectern.operators.blocks import best_per_query


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors; a zero vector becomes NaN, which is never found."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, np.nan, norms)


QUERIES = 4_096  # scored at a time, so that they and their scores stay near the processor
PAIRS = 16_384  # scored again at a time


class CosineScorer:
    """Scores in single precision, and in double precision the few pairs that can be among the best."""

    def __init__(self, queries: pa.Table):
        self.query_ids = queries.column(0).to_pylist()
        self.queries = unit_rows(queries.column(1)) if self.query_ids else np.empty((0, 0))

    def score(self, corpus: pa.Table, cells: int) -> Iterator[tuple]:
        if not self.query_ids:
            return
        units = unit_rows(corpus.column(1))
        near, asked = units.astype(np.float32), self.queries.astype(np.float32)
        off = (units.shape[1] + 4) * 2.0**-24  # of a sum of products of unit vectors
        rows = max(1, cells // min(QUERIES, len(asked)))
        for at in range(0, len(units), rows):
            for first in range(0, len(asked), QUERIES):
                numbers = np.arange(first, min(first + QUERIES, len(asked)))
                scores = near[at : at + rows] @ asked[first : first + QUERIES].T
                yield slice(at, at + rows), numbers, scores, off, partial(self._exact, units[at : at + rows], self.queries[first : first + QUERIES])

    @staticmethod
    def _exact(units: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), PAIRS):
            some = slice(at, at + PAIRS)
            out[some] = np.einsum("ij,ij->i", units[row[some]], queries[query[some]])
        return out


def vector_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULTS.vector_k,
    query_id: str = "query_id",
    item_id: str = "chunk_id",
    vector: str = "embedding",
    broadcast_rows: int = 20_000,
    rank: str = "rank",
) -> DataFrame:
    """The k corpus rows nearest to each query: (query id, item id, score, rank).

    Zero vectors stand for failed embeddings; they are neither searched for nor found.
    """
    asked = queries.filter(has_length(F.col(vector))).select(query_id, vector)
    items = corpus.filter(F.col(vector).isNotNull()).select(item_id, vector)
    return best_per_query(asked, items, CosineScorer, k, broadcast_rows, rank=rank)
