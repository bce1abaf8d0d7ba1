"""Nearest vectors by cosine: randomly rotated one-bit codes choose what is compared exactly.

Method: every unit vector is turned by a random rotation and kept as the signs of its
coordinates, packed to bits, and one correction scalar, its inner product with the unit vector of
the signs. A query's inner product with that sign vector, divided by the scalar, is an unbiased
estimate of the cosine, and the scalar bounds its error:
`margin * sqrt((1 - s * s) / (s * s)) / sqrt(dimensions - 1)` holds for nearly every pair. Vectors of
few dimensions are turned several times, until they have `BITS` bits, and the mean of the estimates
counts, whose error is smaller by the root of the number of turns. A first pass over the codes takes the best estimates and compares them exactly, which gives every query a
score to beat; the second keeps each vector whose upper bound reaches it. Those are compared exactly,
in double precision on the given vectors.

How it scales: equal vectors are one class with the k + 1 smallest ids, found before the shuffle,
so a vector that a third of all rows hold is one code and emits no pairs. Queries and codes meet in
blocks of bounded size; only codes (`BITS` bits, or one for each dimension) are sent to every block of queries. What
passes a bound follows the data: no number of candidates is fixed.

Edge cases: vectors that are null, zero or hold a null or non-finite component take no part,
neither do rows with a null id; vectors of different lengths never meet; rows repeated in full count
once; with fewer than k others all are returned; equal scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.textblocks import process_cache
from lectern.session import stored_table

#: Vectors in a block of codes, and queries in a block of queries.
CODES, QUERIES = 8_192, 2_048
MARGIN = 2.5
BITS = 512
FOUND = "q long, c long, estimate double, upper double"


def turns(dim: int) -> int:
    return max(1, -(-BITS // dim))


def rotations(dim: int, seed: int) -> np.ndarray:
    """The rotations of a dimension below each other."""
    cache = process_cache()
    key = ("rotations", dim, seed)
    if key not in cache:
        found = []
        for t in range(turns(dim)):
            q, r = np.linalg.qr(np.random.default_rng([seed, dim, t]).standard_normal((dim, dim)))
            found.append(q * np.sign(np.diag(r)))
        cache[key] = np.concatenate(found)
    return cache[key]


def _turned(lists, dim: int, seed: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    v = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotations(dim, seed).T


def pack_codes(vectors: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(dim, shard, ids, bits, scalars): blocks of packed signs with their correction scalars."""

    def pack(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        turned = _turned(table.column("v"), dim, seed)
        bits = np.packbits(turned > 0, axis=1)
        scalars = np.abs(turned).reshape(len(turned), -1, dim).sum(axis=2) / np.sqrt(dim)
        ids = table.column("c").to_numpy().astype(np.int64)
        row = ([dim], [shard], [ids.tobytes()], [bits.tobytes()], [scalars.tobytes()])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["dim", "shard", "ids", "bits", "scalars"])

    shard = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    return vectors.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(pack, "dim int, shard int, ids binary, bits binary, scalars binary")


def pack_queries(queries: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(dim, block, qids, turned, beat): blocks of rotated queries and the score that each has to beat."""

    def pack(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        turned = _turned(table.column("v"), dim, seed).astype(np.float32)
        ids = table.column("q").to_numpy().astype(np.int64)
        beat = table.column("beat").to_numpy().astype(np.float64)
        row = ([dim], [block], [ids.tobytes()], [turned.tobytes()], [beat.tobytes()])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["dim", "block", "qids", "turned", "beat"])

    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    return queries.withColumn("block", block).groupBy("dim", "block").applyInArrow(pack, "dim int, block int, qids binary, turned binary, beat binary")


def _meet(codes: DataFrame, queries: DataFrame, blocks: int, best: int | None, margin: float) -> DataFrame:
    """Pairs from blocks of codes and queries: the `best` estimates of each query and block, or all whose bound beats its score."""

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
                bits = np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1)
                scalars = np.frombuffer(row["scalars"], np.float64).reshape(len(ids), -1)
                turned = np.frombuffer(row["turned"], np.float32).reshape(len(qids), -1)
                beat = np.frombuffer(row["beat"], np.float64)
                signs = np.unpackbits(bits, axis=1, count=turned.shape[1]).astype(np.float32) * 2 - 1
                # each turn counts by its own scalar, and the turns in equal parts
                signs /= np.repeat(scalars * (np.sqrt(dim) * scalars.shape[1]), dim, axis=1).astype(np.float32)
                spread = np.maximum(0, 1 / scalars**2 - 1).sum(axis=1)
                error = margin * np.sqrt(spread / max(dim - 1, 1)) / scalars.shape[1] + 1e-5
                for k in range(0, len(qids), 256):
                    estimate = (turned[k : k + 256] @ signs.T).astype(np.float64)
                    upper = estimate + error
                    if best is None:
                        q, c = np.nonzero(upper >= beat[k : k + 256, None])
                    else:
                        n = min(best, len(ids))
                        c = np.argpartition(-estimate, n - 1, axis=1)[:, :n].reshape(-1)
                        q = np.repeat(np.arange(len(estimate)), n)
                    for a in range(0, len(q), 100_000):
                        some = slice(a, a + 100_000)
                        columns = [qids[k + q[some]], ids[c[some]], estimate[q[some], c[some]], upper[q[some], c[some]]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["q", "c", "estimate", "upper"])

    spread = codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(queries, ["dim", "block"]).mapInArrow(scan, FOUND)


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, c, score) with the cosine of the given vectors in double precision."""
    a = vectors.select(F.col("c").alias("q"), F.col("v").alias("a"), F.col("norm").alias("na"))
    b = vectors.select("c", F.col("v").alias("b"), F.col("norm").alias("nb"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("q", "c").join(a, "q").join(b, "c").select("q", "c", (product / (F.col("na") * F.col("nb"))).alias("score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, margin: float = MARGIN, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose vec_id is divisible by `every`."""
    whole = (
        vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
        .filter("id is not null and v is not null and size(v) > 0")
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast("double")).otherwise(x.cast("double"))))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
        .filter("norm > 0")
    )
    classes = whole.groupBy("v", "norm").agg(F.min("id").alias("c")).withColumn("dim", F.size("v"))
    classes = stored_table(classes.select("c", "dim", "v", "norm"))
    order = Window.partitionBy("v").orderBy("id")
    few = whole.select("id", "v").distinct().withColumn("no", F.row_number().over(order)).filter(F.col("no") <= k + 1)
    members = stored_table(few.join(classes.select("v", "c"), "v").select("c", "id"))
    asked = stored_table(
        whole.filter(F.col("id") % every == 0).select("id", "v").distinct().join(classes.select("v", "c"), "v").select("id", F.col("c").alias("q"))
    )
    queries = asked.select("q").distinct().join(classes, F.col("q") == F.col("c")).select("q", "dim", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    codes = stored_table(pack_codes(classes, max(1, -(-classes.count() // CODES)), seed))

    first = pack_queries(queries.withColumn("beat", F.lit(float("-inf"))), blocks, seed)
    by_estimate = Window.partitionBy("q").orderBy(F.col("estimate").desc(), "c")
    tried = _meet(codes, first, blocks, 4 * (k + 1), margin).withColumn("no", F.row_number().over(by_estimate)).filter(F.col("no") <= 4 * (k + 1))
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
    scored = stored_table(_exact(tried, classes))
    ranked = scored.withColumn("no", F.row_number().over(by_score)).filter(F.col("no") <= k + 1)
    beat = ranked.groupBy("q").agg(F.max("no").alias("n"), F.min("score").alias("least"))
    beat = beat.select("q", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("beat"))

    second = pack_queries(queries.join(beat, "q"), blocks, seed)
    passed = _meet(codes, second, blocks, None, margin).join(scored.select("q", "c"), ["q", "c"], "left_anti")
    found = scored.unionByName(_exact(passed, classes)).withColumn("no", F.row_number().over(by_score)).filter(F.col("no") <= k + 1)
    rows = found.join(members, "c").select("q", F.col("id").alias("vec_id"), "score")
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        asked.select(F.col("id").alias("query_id"), "q").join(rows, "q").filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
