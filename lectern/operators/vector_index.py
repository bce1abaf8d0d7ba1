"""Nearest neighbours by cell: a query reads the cells that can hold one of its k nearest rows.

Cells are the regions around k-means centres; the table is partitioned by cell, and each cell knows
the largest angle between its centre and a row. A query reads its `probes` nearest cells first. By
the triangle inequality of angles a row of another cell is at most as near as the angle to its
centre less the cell's reach allows, and only cells where that reaches the k-th score found so far
are read after. The result is that of `vector_search.vector_top_k`; `probes` only sets the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions.vectors import has_length
from lectern.operators.blocks import BROADCAST_BYTES, best_per_query
from lectern.operators.ranking import top_k
from lectern.operators.vector_search import CosineScorer, unit_rows
from lectern.session import cut_lineage


@dataclass(frozen=True)
class VectorIndex:
    cells: DataFrame  # item id, vector, closeness to the centre, cell; partitioned by cell
    centres: DataFrame  # cell, centre, reach: as many rows as cells
    item_id: str
    vector: str

    def centre_matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit centres in cell order, and the largest angle of a row in each; fixed with the index."""
        rows = self.centres.orderBy("cell").toArrow()
        return unit_rows(rows.column("centre")), rows.column("reach").to_numpy()


def build_vector_index(
    corpus: DataFrame,
    path: str,
    n_cells: int,
    item_id: str = "chunk_id",
    vector: str = "embedding",
    seed: int = 17,
    rounds: int = 15,
) -> VectorIndex:
    """Learn the cells on all vectors, put each into its nearest cell, store by cell."""
    spark = corpus.sparkSession
    rows = corpus.select(item_id, vector).filter(has_length(F.col(vector)))
    features = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=rounds).fit(features)
    centres = np.asarray(model.clusterCenters(), dtype=np.float64)
    # rebalancing splits a cell that holds a large part of all vectors into several files
    placed = _with_cell(rows, centres, vector).hint("rebalance", F.col("cell"))
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    far = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.acos(F.least(F.min("closeness"), F.lit(1.0))).alias("reach"))
    listed = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    reach = listed.join(far, "cell", "left").fillna({"reach": 0.0})
    reach.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return read_vector_index(spark, path, item_id, vector)


def read_vector_index(
    spark: SparkSession, path: str, item_id: str = "chunk_id", vector: str = "embedding"
) -> VectorIndex:
    return VectorIndex(
        spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centres"), item_id, vector
    )


def _with_cell(rows: DataFrame, centres: np.ndarray, vector: str) -> DataFrame:
    """Each row with its nearest centre; centres go out in blocks of bounded size, one pass each."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    step = max(1, BROADCAST_BYTES // unit[:1].nbytes)
    out = rows.withColumns({"closeness": F.lit(-2.0), "cell": F.lit(-1)})
    for first in range(0, len(unit), step):
        out = out.mapInArrow(_nearer(rows.sparkSession.sparkContext.broadcast(unit[first : first + step]), first, vector), out.schema)
    return out


def _nearer(sent, first: int, vector: str):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = unit_rows(batch.column(vector)) @ sent.value.T
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(best)), best]
            seen, cell = batch.column("closeness").to_numpy(), batch.column("cell").to_numpy()
            better = top > seen
            columns = [
                *batch.columns[:-2],
                pa.array(np.where(better, top, seen)), pa.array(np.where(better, best + first, cell).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return place


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """[cells, vectors]: whether a cell is among the `probes` nearest of a vector."""
    probes = min(probes, len(centres))
    near = np.argpartition(-(vectors @ centres.T), probes - 1, axis=1)[:, :probes]
    out = np.zeros((len(centres), len(vectors)), dtype=bool)
    out[near.ravel(), np.repeat(np.arange(len(vectors)), probes)] = True
    return out


def open_cells(vectors: np.ndarray, bars: np.ndarray, centres: np.ndarray, reach: np.ndarray, probes: int) -> np.ndarray:
    """[cells, vectors]: cells beyond the nearest that can hold a row as near as the bar of a vector."""
    angle = np.arccos(np.clip(centres @ vectors.T, -1, 1))
    nearest = np.cos(np.maximum(0, angle - reach[:, None]))
    return (nearest >= bars - 2e-6) & ~nearest_cells(vectors, centres, probes)  # scores are rounded to 6 decimals


class ProbedScorer(CosineScorer):
    """Scores only the pairs whose row lies in a cell that its query reads, cell by cell; a third column holds the bars."""

    def __init__(self, queries: pa.Table, centres: np.ndarray, reach: np.ndarray, probes: int):
        super().__init__(queries)
        self.read = np.zeros((len(centres), 0), dtype=bool)
        if self.query_ids:
            self.read = _read(queries, self.queries, centres, reach, probes)

    def score(self, corpus: pa.Table, cells: int) -> Iterator[tuple]:
        if not self.query_ids:
            return
        units, cell = unit_rows(corpus.column(1)), corpus.column("cell").to_numpy()
        for number in np.unique(cell):
            asking = np.flatnonzero(self.read[number])
            if not len(asking):
                continue
            rows, vectors = np.flatnonzero(cell == number), self.queries[asking].T
            step = max(1, cells // len(asking))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                yield some, asking, units[some] @ vectors


def _read(queries, vectors: np.ndarray, centres: np.ndarray, reach: np.ndarray, probes: int) -> np.ndarray:
    if queries.num_columns < 3:
        return nearest_cells(vectors, centres, probes)
    return open_cells(vectors, np.asarray(queries.column(2)), centres, reach, probes)


def probe_top_k(
    queries: DataFrame,
    index: VectorIndex,
    k: int = DEFAULTS.vector_k,
    probes: int = 8,
    query_id: str = "query_id",
    vector: str = "embedding",
    broadcast_rows: int = 20_000,
    rank: str = "rank",
) -> DataFrame:
    """The k nearest rows of each query, from the cells that can hold them."""
    centres, reach = index.centre_matrix()
    sent = queries.sparkSession.sparkContext.broadcast((centres, reach))
    asked = queries.filter(has_length(F.col(vector))).select(query_id, vector)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(sent.value[0]), dtype=bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found |= _read(part, unit_rows(part.column(1)), *sent.value, probes).any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int32())], ["cell"])

    def search(block: DataFrame) -> DataFrame:
        # no more numbers than cells; the directories of the others are not even listed
        cells = [r["cell"] for r in block.mapInArrow(wanted, "cell int").distinct().collect()]
        items = index.cells.select(index.item_id, index.vector, "cell")
        items = items.filter(F.col("cell").isin(cells)) if cells else items.filter("false")
        return best_per_query(block, items, lambda b: ProbedScorer(b, centres, reach, probes), k, broadcast_rows, rank="_no")

    first = cut_lineage(search(asked).drop("_no"))
    bars = first.groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("score")).alias("_bar"))
    second = search(asked.join(bars, query_id, "left").fillna({"_bar": -2.0}).select(query_id, vector, "_bar"))
    best = [F.col("score").desc(), F.col(index.item_id).asc()]
    return top_k(first.unionByName(second.drop("_no")), [query_id], best, k, rank)


def recall(found: DataFrame, exact: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """One row: the share of the exact rows that were found."""
    hits = exact.select(query_id, item_id).join(
        found.select(query_id, item_id, F.lit(1).alias("_hit")), [query_id, item_id], "left"
    )
    return hits.agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))
