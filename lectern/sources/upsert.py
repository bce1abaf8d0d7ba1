"""Upsert by key into a table whose keys are unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.operators.ranking import first_seen
from lectern.session import checked_broadcast


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: str = "load_ts") -> DataFrame:
    """The last written row of every key; equal times are settled by content, not by chance."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    if not rest:
        return first_seen(rows, keys, [F.col(order).desc()])
    # a hash of whole rows takes longer than all else, so only rows that have a rival get one
    rivals = F.count("*").over(W.partitionBy(*keys))
    tie = F.when(F.col("_rivals") > 1, F.xxhash64(*[F.col(c).cast("string") for c in rest]))
    return first_seen(rows.withColumn("_rivals", rivals), keys, [F.col(order).desc(), tie]).drop("_rivals")


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    order: str = "load_ts",
    broadcast_rows: int = DEFAULTS.broadcast_rows,
) -> DataFrame:
    """Rows of `old` whose key is not in `new`, and the newest row of every key in `new`.

    Only the increment is deduplicated and sorted. The stored side meets nothing but the keys of
    the increment; while they are few it is read in place, without a shuffle.
    """
    written = checked_broadcast(new.select(*keys).distinct(), broadcast_rows)
    kept = old.join(written, list(keys), "left_anti")
    return kept.unionByName(newest_per_key(new, keys, order))


def replace_documents(
    old: DataFrame,
    new: DataFrame,
    document: str = "path",
    keys: Sequence[str] = ("chunk_id",),
    order: Sequence[str] = ("load_ts",),
    broadcast_rows: int = DEFAULTS.broadcast_rows,
) -> DataFrame:
    """Upsert whole documents: of each document only the rows of its newest load stay.

    Chunks that the newest load no longer has disappear, whether they are stored or come with an
    older load in `new`; a stored document that is newer than all its loads in `new` stays as it
    is. Loads are compared by the columns of `order`; a missing value is the oldest.
    """
    at = F.struct(*order)
    loads = new.groupBy(document).agg(F.max(at).alias("_load"))
    written = checked_broadcast(loads, broadcast_rows)
    kept = old.join(written, document, "left").filter(F.col("_load").isNull() | (at > F.col("_load")))
    ahead = old.join(written, document).filter(at > F.col("_load")).select(document).distinct()
    fresh = new.join(loads, document).filter(at == F.col("_load")).drop("_load")
    fresh = fresh.join(checked_broadcast(ahead, broadcast_rows), document, "left_anti")
    return kept.select(*old.columns).unionByName(newest_per_key(fresh, keys, order[0]).select(*old.columns))
