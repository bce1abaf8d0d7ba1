"""Summaries of the logs by hour and by day that answer dashboard questions for any number of days.

Sessions: a HyperLogLog sketch of the sessions of each hour, beside exact counts of turns. Sketches are merged, so distinct
sessions of any range of hours cost one row per hour; the estimate is within a known share of the truth.

Most retrieved chunks: for each day the `size` most frequent keys with their counts, and `floor`, the largest count that was
left out. For a range of days a key lies between the sum of its kept counts and that plus the floors of the days that do
not list it. Keys whose upper end reaches the k-th best lower end are counted again from the log, and only they; the
result is exact. Where even a key that no day lists could reach it, the log is counted as a whole.

An hour or a day ends with its last instant included, as `recent` leaves its first instant out, so whole
ones add up to exactly the rows of a range that begins on their edge. A range that begins inside one reads those rows.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import instant, recent
from lectern.operators.conversation import top_chunks
from lectern.operators.ranking import top_k
from lectern.session import checked_broadcast

#: Sketches have 2 ** this registers, and their relative standard error is 1.04 over the root of that.
REGISTERS = 12
SESSION_ERROR = 3 * 1.04 / math.sqrt(2**REGISTERS)  # three standard errors

DESCRIBED = ("chunk_id", "chunk_text", "filename", "subject", "chapter")


def _end(ts: Column, unit: str, seconds: int) -> Column:
    """The end of the hour or day that a time belongs to; an edge belongs to what it ends."""
    micros = seconds * 1_000_000
    return F.timestamp_micros(F.ceil(F.unix_micros(ts) / F.lit(micros)) * F.lit(micros)).alias(unit)


def _ceil(t: dt.datetime, seconds: int) -> dt.datetime:
    since = t - dt.datetime(1970, 1, 1, tzinfo=t.tzinfo)
    whole = -(-since // dt.timedelta(seconds=seconds))
    return dt.datetime(1970, 1, 1, tzinfo=t.tzinfo) + whole * dt.timedelta(seconds=seconds)


# ---- sessions ----------------------------------------------------------------------------


def hourly_activity(history: DataFrame) -> DataFrame:
    """(hour, questions, turns, sessions): counts of each hour and the sketch of its sessions."""
    return history.groupBy(_end(F.col("created_at"), "hour", 3600)).agg(
        F.count_if(F.col("role") == "user").alias("questions"),
        F.count("*").alias("turns"),
        F.hll_sketch_agg("session_id", REGISTERS).alias("sessions"),
    )


def activity_from_sketches(hourly: DataFrame, history: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """One row: total_questions and questions_today, exact, and `sessions_estimate`.

    `history` is read where a range begins inside an hour, for the rest of that hour.
    """

    def since(bound: dt.datetime) -> DataFrame:
        edge = _ceil(bound, 3600)
        whole = hourly.filter(F.col("hour") > instant(edge))
        if edge == bound:
            return whole
        part = history.filter((F.col("created_at") > instant(bound)) & (F.col("created_at") <= instant(edge)))
        return whole.unionByName(hourly_activity(part))

    total = since(as_of - dt.timedelta(days=days)).agg(
        F.coalesce(F.sum("questions"), F.lit(0)).alias("total_questions"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sessions")), F.lit(0)).alias("sessions_estimate"),
    )
    today = since(max(as_of - dt.timedelta(hours=24), as_of - dt.timedelta(days=days)))
    return total.crossJoin(today.agg(F.coalesce(F.sum("questions"), F.lit(0)).alias("questions_today")))  # two single rows


def within_error(estimate: Column, exact: Column) -> Column:
    """Whether an estimate of distinct sessions is as near as three standard errors, or one session."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * F.lit(SESSION_ERROR))


# ---- most retrieved chunks ---------------------------------------------------------------


def daily_chunks(log: DataFrame, size: int = 1_000, keys: Sequence[str] = DESCRIBED) -> DataFrame:
    """(day, keys..., n, floor): the `size` most frequent keys of each day; `floor` is the largest count of its other keys."""
    counted = log.groupBy(_end(F.col("retrieved_at"), "day", 86_400), *keys).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), *(F.col(k) for k in keys)]
    ranked = top_k(counted, ["day"], order, size + 1, "_no", spread_by=keys[0])
    floor = F.coalesce(F.max(F.when(F.col("_no") > size, F.col("n"))).over(W.partitionBy("day")), F.lit(0))
    return ranked.withColumn("floor", floor).filter(F.col("_no") <= size).select("day", *keys, "n", "floor")


def _bounds(daily: DataFrame, as_of: dt.datetime, days: int, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys..., low, high) of the keys that some day lists, and the most that any other key can have."""
    start = as_of - dt.timedelta(days=days)
    edge = _ceil(start, 86_400)
    rows = daily.filter(F.col("day") >= instant(edge)) if edge != start else daily.filter(F.col("day") > instant(start))
    # of a day that begins before the range the counts are upper ends only
    whole = F.lit(True) if edge == start else F.col("day") > instant(edge)
    floors = rows.select("day", "floor").distinct().agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("rest")).first()["rest"]
    listed = rows.groupBy(*keys).agg(
        F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("low"),
        (F.sum("n") + F.lit(floors) - F.sum("floor")).alias("high"),
    )
    return listed, floors


def top_chunks_from_summaries(
    daily: DataFrame, log: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 20, by_chunk: bool = False
) -> DataFrame:
    """What `top_chunks` returns, counting only the keys that can be among the best.

    `daily` is `daily_chunks` of the log with the same keys: `("chunk_id",)` for `by_chunk`.
    """
    keys = DESCRIBED[:1] if by_chunk else DESCRIBED
    listed, others = _bounds(daily, as_of, days, keys)
    best = listed.filter("low > 0").orderBy(F.col("low").desc()).limit(limit).agg(F.min("low").alias("bar"), F.count("*").alias("n")).first()
    if best["n"] < limit or others >= best["bar"]:
        # a key that no day lists may be among the best, unless no day has left one out
        if others:
            return top_chunks(log, as_of, days, limit, by_chunk)
        candidates = listed
    else:
        candidates = listed.filter(F.col("high") >= best["bar"])
    wanted = candidates.select(*(F.col(k).alias(f"_{k}") for k in keys))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    rows = log.filter(recent(F.col("retrieved_at"), as_of, days)).join(checked_broadcast(wanted, 100_000), on, "left_semi")
    return top_chunks(rows, as_of, days, limit, by_chunk)
