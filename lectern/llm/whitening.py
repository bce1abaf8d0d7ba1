"""Whitening of embeddings: covariances by polarisation, components by `eigh`, all rows projected.

Method: a vector becomes whole numbers x = floor(scale * c). Over the distinct vectors, with n of them and sums S,
the centred values y = n * x - S are whole as well. One pass sums the squares of y for every dimension and
of y_i + y_j for every pair of dimensions; since (a + b)^2 = a^2 + b^2 + 2ab, half the difference of these sums is the
cross-covariance, exact to the last unit. The matrix is divided once, goes through `numpy.linalg.eigh` on the driver, and
every row is projected on the leading components.

How it scales: the distinct vectors are a grouped aggregate (repeats are dropped before the shuffle) and stored once;
sums leave a task as one row per pair of dimensions, whatever its rows; the driver sees d * (d + 1) / 2 numbers
for vectors of d dimensions and d per component, never vectors. Squares are summed in limbs of 20 bits and
partial sums travel as two decimals, so no size of n or of the values overflows or rounds.

Edge cases: null vectors and vectors with null or non-finite entries take no part; vectors of different lengths
are separate tables, each with its own fit (numbers of dimensions are few); a vector of no entries has no component;
repeated rows each have their row and count once in the fit; components beyond the number of dimensions do not exist; where the
variance along a component is zero up to rounding, `whitened` is null and the component is left out of
`identity_error`; explained is null where nothing varies; a deviation beyond 64 bits is null; an empty table gives no
rows; null ids stay null; further columns are kept by `whiten`, and columns named like its own give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textblocks import unused
from lectern.session import stored_table

#: Entries of an array that are worked on at once.
CELLS = 1 << 21
LIMB, LIMBS = 20, 4
CUT = 1 << 96
SUMS = pa.schema([("dim", pa.int32()), ("pair", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])


def whole_numbers(vectors: DataFrame, column: str, scale: int, name: str) -> DataFrame:
    """Rows whose vector is finite, and floor(scale * c) of its entries as `name`."""
    c = F.col(column)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.filter(c.isNotNull() & ~F.coalesce(bad, F.lit(False))).withColumn(name, whole)


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows x dimensions) for each length in a column of lists, a bounded number of rows at a time."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        some = np.flatnonzero(sizes == d)
        for k in range(0, len(some), max(1, CELLS // (d * d))):
            rows = some[k : k + max(1, CELLS // (d * d))]
            yield rows, flat[starts[rows][:, None] + np.arange(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit numbers where they fit and as Python's otherwise."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * top + max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def sum_of_squares(z: np.ndarray) -> list[int]:
    """Exact sums over the rows of the squares of each column."""
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(axis=0)]
    if float(np.abs(z).max(initial=0)) ** 2 * max(1, len(z)) < 2.0**62:
        return (z * z).sum(axis=0).tolist()
    z = np.abs(z)
    limbs = [(z >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS)]
    out = [0] * z.shape[1]
    for a in range(LIMBS):
        for b in range(a, LIMBS):
            part = (limbs[a] * limbs[b]).sum(axis=0).tolist()
            out = [o + (v << (LIMB * (a + b) + (a != b))) for o, v in zip(out, part, strict=True)]
    return out


def pairs(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions i <= j of each pair, in the order of its number; i = j stands for the dimension itself."""
    return np.triu_indices(d)


def _square_sums(fits: dict[int, tuple[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                y = centred(x, *fits[x.shape[1]])
                i, j = pairs(x.shape[1])
                found = sum_of_squares(np.where(i == j, y[:, i], y[:, i] + y[:, j]))
                old = totals.get(x.shape[1])
                totals[x.shape[1]] = found if old is None else [a + b for a, b in zip(old, found, strict=True)]
        for d, values in totals.items():
            parts = [divmod(v, CUT) for v in values]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d] * len(parts), pa.int32()),
                    pa.array(range(len(parts)), pa.int32()),
                    pa.array([Decimal(h) for h, _ in parts], pa.decimal128(38, 0)),
                    pa.array([Decimal(r) for _, r in parts], pa.decimal128(38, 0)),
                ],
                schema=SUMS,
            )

    return run


def components(squares: list[int], d: int, n: int, keep: int) -> dict:
    """Eigenvalues, components by falling eigenvalue and share of the trace from the sums of squares of all pairs."""
    i, j = pairs(d)
    single = {a: v for a, b, v in zip(i.tolist(), j.tolist(), squares, strict=True) if a == b}
    v = np.zeros((d, d))
    for a, b, total in zip(i.tolist(), j.tolist(), squares, strict=True):
        both = single[a] if a == b else (total - single[a] - single[b]) // 2
        v[a, b] = v[b, a] = both / n**3  # whole numbers divide to the nearest double
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    trace = sum(single.values()) / n**3
    flat = values <= trace * d * 1e-14
    return {
        "values": [None if f else float(e) for e, f in zip(values[:keep], flat, strict=False)],
        "columns": np.ascontiguousarray(columns[:, :keep]),
        "explained": [float(e) / trace if trace else None for e in np.maximum(values[:keep], 0)],
    }


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened values, one column per component; nan where the component has no variance."""
    y = centred(x, model["n"], model["sums"]).astype(np.float64)
    spread = np.array([np.nan if e is None else np.sqrt(e) for e in model["values"]])
    return (y @ model["columns"]) / model["n"] / spread


def _whitened(models: dict[int, dict], column: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(column).offsets.to_numpy())
            counts = np.array([len(models[d]["values"]) if d else 0 for d in sizes.tolist()], np.int32)
            at = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)))
            flat, far, beyond = np.zeros(at[-1]), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
            for rows, x in _matrices(batch.column(column)):
                model = models[x.shape[1]]
                flat[at[rows][:, None] + np.arange(len(model["values"]))] = project(x, model)
                y = centred(x, model["n"], model["sums"])
                if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
                    far[rows] = (y * y).sum(axis=1)
                else:
                    exact = [sum(v * v for v in row) for row in y.tolist()]
                    beyond[rows] = [v >> 63 > 0 for v in exact]
                    far[rows] = [0 if v >> 63 else v for v in exact]
            arrays = [batch.column(k) for k in range(batch.num_columns)]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([*arrays, lists, pa.array(far, mask=beyond)], [*batch.schema.names, *names])

    return run


def fit(vectors: DataFrame, column: str = "embedding", scale: int = 256, keep: int = 4) -> dict[int, dict]:
    """For each number of dimensions: n, sums, the `keep` leading components and `identity_error`."""
    distinct = stored_table(whole_numbers(vectors.select(column), column, scale, "x").select("x").distinct())
    size = F.size("x").cast("int").alias("dim")
    counts = {r.dim: r.n for r in distinct.groupBy(size).agg(F.count("*").alias("n")).collect()}
    sums: dict[int, dict[int, int]] = {}
    entries = distinct.select(size, F.posexplode("x").alias("pos", "v")).groupBy("dim", "pos")
    for r in entries.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():
        sums.setdefault(r.dim, {})[r.pos] = int(r.s)
    fits = {d: (n, [sums[d][k] for k in range(d)]) for d, n in counts.items() if d > 0}
    squares: dict[int, list[int]] = {d: [0] * (d * (d + 1) // 2) for d in fits}
    found = distinct.mapInArrow(_square_sums(fits), "dim int, pair int, high decimal(38,0), low decimal(38,0)")
    for r in found.groupBy("dim", "pair").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        squares[r.dim][r.pair] = int(r.high) * CUT + int(r.low)
    models = {d: {"n": n, "sums": s, **components(squares[d], d, n, keep), "identity_error": None} for d, (n, s) in fits.items()}
    for d, error in _identity_errors(distinct, models, keep).items():
        models[d]["identity_error"] = error
    return models


def _identity_errors(distinct: DataFrame, models: dict[int, dict], keep: int) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit rows less the identity, as measured on them."""
    schema = T.StructType([*distinct.schema.fields, T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("far", T.LongType())])
    rows = distinct.mapInArrow(_whitened(models, "x", ("w", "far")), schema).filter("size(w) > 0").select(F.size("x").alias("dim"), "w")
    at = [(a, b) for a in range(keep) for b in range(a, keep)]
    entry = lambda k: F.get("w", F.lit(k))
    moments = [F.covar_pop(entry(a), entry(b)).alias(f"c{a}_{b}") for a, b in at]
    out = {}
    for r in rows.groupBy("dim").agg(*moments).collect():
        known = [abs(r[f"c{a}_{b}"] - (a == b)) for a, b in at if r[f"c{a}_{b}"] is not None]
        if known:
            out[r.dim] = max(known)
    return out


def whiten(vectors: DataFrame, models: dict[int, dict], column: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows that take part with all their columns, and `whitened` (one entry per component) and `deviation`."""
    x = unused(vectors.columns, "x")
    given = whole_numbers(vectors.drop("whitened", "deviation"), column, scale, x)
    schema = T.StructType(
        [*given.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    )
    return given.mapInArrow(_whitened(models, x, ("whitened", "deviation")), schema).drop(x)


def component_rows(whitened: DataFrame, models: dict[int, dict], key: str, column: str = "embedding") -> DataFrame:
    """One row per row and component, with the figures of its fit beside it."""
    facts = whitened.sparkSession.createDataFrame(
        [(d, k + 1, m["n"], m["explained"][k], m["identity_error"]) for d, m in models.items() for k in range(len(m["values"]))],
        "dim int, component int, n long, explained double, identity_error double",
    )
    rows = whitened.select(
        F.col(key), "deviation", F.size(column).alias("dim"), F.posexplode("whitened").alias("no", "whitened")
    ).withColumn("component", F.col("no") + 1)
    # a handful of rows for each number of dimensions
    return rows.join(F.broadcast(facts), ["dim", "component"]).select(
        key, "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
