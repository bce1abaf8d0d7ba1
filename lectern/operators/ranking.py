"""Top-k, first-seen and ranking: order is always carried by explicit columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_by: str | None = None,
    slices: int = 16,
) -> DataFrame:
    """The first `k` rows of every key in `order`, with their 1-based rank.

    Spark cuts each input partition to k rows per key before the shuffle. With `spread_by`, a
    first round runs on slices of each key, made by a hash of that column, so a key that every
    partition holds does not send all their survivors to one task. (A hash, not a random
    number: a task that is run again must deal its rows out the same way.)
    """
    if spread_by is not None:
        dealt = df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)))
        df = top_k(dealt, [*keys, "_slice"], order, k, "_in_slice").drop("_slice", "_in_slice")
    numbered = F.row_number().over(W.partitionBy(*_keys(keys)).orderBy(*order))
    return df.withColumn(rank, numbered).filter(F.col(rank) <= k)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`; also cut to one per partition before the shuffle."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def dedupe_by_prefix(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    order: Sequence[Column],
    chars: int | None = 100,
) -> DataFrame:
    """Keep the first row of each key among those whose text starts alike.

    `chars=None` compares whole texts.
    """
    start = F.col(text) if chars is None else F.substring(F.col(text), 1, chars)
    marked = df.withColumn("_start", start)
    return first_seen(marked, [*keys, "_start"], order).drop("_start")


def ordered_union(*legs: DataFrame) -> DataFrame:
    """Bag union that remembers which leg a row came from in `src_ord` (0, 1, ...)."""
    marked = [leg.withColumn("src_ord", F.lit(i)) for i, leg in enumerate(legs)]
    out = marked[0]
    for leg in marked[1:]:
        out = out.unionByName(leg)
    return out


def rank_with_origin(
    df: DataFrame,
    keys: Sequence[str],
    before: Sequence[Column],
    after: Sequence[Column],
    k: int,
) -> DataFrame:
    """Rank 1..k in the order `after`, with the 0-based place the row had in `before`."""
    place = F.row_number().over(W.partitionBy(*_keys(keys)).orderBy(*before)) - 1
    return top_k(df.withColumn("original_index", place), keys, after, k)


def latest(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """A whole-table top list; Spark keeps `limit` rows per partition and merges those."""
    return df.orderBy(*order).limit(limit)
