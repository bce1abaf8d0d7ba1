"""The heatmap of unanswered questions kept up to date by changes: late, wrong and deleted rows correct earlier counts.

Turns and log rows come as signed rows: `change` is 1 for a row that is added and -1 for one that goes. What the batch form
(`confusion_heatmap`) computes is a join and two sums, and each has a rule for signed rows:

* pairs: a changed question meets the replies held so far within the window, a changed reply the questions, and each pair
  that appears or disappears has the product of their signs. Turns are held by session and time bucket.
* counts: for each session and question text, questions by day (q) and logged chunks by subject (l) are held; the part of the
  heatmap that they make up is q x l, or q under Unknown while nothing is logged. A change emits the new part less the old.
* totals: the emitted differences are stored by micro-batch, so a batch that runs again replaces its own; the
  heatmap is their sum by day and subject.

Days need not be closed, no row comes too late, and no stored log is read: a micro-batch touches the keys of its own rows in
the state store. `keep` lets turns be forgotten some time after they came; corrections of older turns are then lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.config import DEFAULTS
from lectern.functions.text import is_fallback
from lectern.operators.conversation import NO_SUBJECT, subject_or_unknown
from lectern.session import need_named_state

QUESTION, REPLY = "question", "reply"
PAIRS = "session_id string, query string, day date, n long"
CELLS = "day date, subject string, n long"


def _changes(rows: DataFrame) -> DataFrame:
    """With `change`, 1 where the rows have none."""
    return rows if "change" in rows.columns else rows.withColumn("change", F.lit(1))


class _Pairs(StatefulProcessor):
    """Turns of one session and time bucket; emits pairs that appear (n > 0) or disappear (n < 0)."""

    def __init__(self, micros: int, keep_ms: int | None):
        self.micros, self.keep_ms = micros, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "kind string, at long, query string, day date", "n long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(k): v[0] for k, v in self.turns.iterator()}
        before, pairs = dict(held), Counter()
        for frame in rows:
            for kind, at, query, day, change in zip(frame["kind"], frame["at"], frame["query"], frame["day"], frame["change"], strict=True):
                at, change, question = int(at), int(change), kind == QUESTION
                query, day = (query, day) if question else (None, None)
                for (other, when, q, d), n in held.items():
                    if other != kind and 0 < (when - at if question else at - when) < self.micros:
                        pairs[(query, day) if question else (q, d)] += change * n
                turn = (kind, at, query, day)
                held[turn] = held.get(turn, 0) + change
        for turn, n in held.items():
            if n and n != before.get(turn):
                self.turns.updateValue(turn, (n,))
            elif not n and turn in before:
                self.turns.removeKey(turn)
        found = [(key[0], q, d, n) for (q, d), n in pairs.items() if n]
        yield pd.DataFrame(found, columns=["session_id", "query", "day", "n"])

    def close(self) -> None:
        pass


def part(asked: dict, logged: dict) -> Counter:
    """What a question text of a session adds to the heatmap: (day, subject) -> count."""
    if not any(logged.values()):
        logged = {NO_SUBJECT: 1}
    return Counter({(d, s): q * c for d, q in asked.items() for s, c in logged.items() if q * c})


class _Cells(StatefulProcessor):
    """Counts of one session and question text; emits the change of its part of the heatmap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asked = handle.getMapState("asked", "day date", "n long")
        self.logged = handle.getMapState("logged", "subject string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, logged = ({k[0]: v[0] for k, v in state.iterator()} for state in (self.asked, self.logged))
        old, before = part(asked, logged), (dict(asked), dict(logged))
        for frame in rows:
            for subject, day, n in zip(frame["subject"], frame["day"], frame["n"], strict=True):
                counts, at = (logged, subject) if subject is not None else (asked, day)
                counts[at] = counts.get(at, 0) + int(n)
        for state, now, then in zip((self.asked, self.logged), (asked, logged), before, strict=True):
            for at, n in now.items():
                if n and n != then.get(at):
                    state.updateValue((at,), (n,))
                elif not n and at in then:
                    state.removeKey((at,))
        new = part(asked, logged)
        found = [(d, s, new[d, s] - old[d, s]) for d, s in {*new, *old} if new[d, s] != old[d, s]]
        yield pd.DataFrame(found, columns=["day", "subject", "n"])

    def close(self) -> None:
        pass


def heatmap_changes(
    turns: DataFrame,
    log: DataFrame,
    phrases: Sequence[str] = DEFAULTS.fallback_phrases,
    query_chars: int = DEFAULTS.query_chars,
    seconds: int = DEFAULTS.reply_window_seconds,
    keep: int | None = None,
) -> DataFrame:
    """Signed changes (day, subject, n) of the heatmap from streams of turns and of log rows, each with an optional `change`.

    `keep` is the number of days for which turns are held; with it a query goes on until it is stopped (`token_state.drain`).
    """
    need_named_state(turns.sparkSession)
    micros = seconds * 1_000_000
    at = F.unix_micros("created_at")
    bucket = F.floor(at / F.lit(micros))
    shared = ["session_id", at.alias("at"), F.substring("content", 1, query_chars).alias("query"), F.to_date("created_at").alias("day")]
    turns = _changes(turns)
    # a reply lies in the bucket of its question or in the next one
    asked = turns.filter("role = 'user'").select(
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.lit(QUESTION).alias("kind"), *shared, "change"
    )
    replies = turns.filter((F.col("role") == "assistant") & is_fallback(F.col("content"), phrases)).select(
        bucket.alias("bucket"), F.lit(REPLY).alias("kind"), *shared, "change"
    )
    held = None if keep is None else keep * 86_400_000
    pairs = (
        asked.unionByName(replies).groupBy("session_id", "bucket")
        .transformWithStateInPandas(_Pairs(micros, held), PAIRS, "Append", "None" if held is None else "ProcessingTime")
    )
    counted = pairs.select("session_id", "query", "day", F.lit(None).cast("string").alias("subject"), "n")
    logged = _changes(log).select(
        "session_id", "query", F.lit(None).cast("date").alias("day"), subject_or_unknown(F.col("subject")).alias("subject"),
        F.col("change").cast("long").alias("n"),
    )
    changes = counted.unionByName(logged).filter("session_id is not null and query is not null")
    return changes.groupBy("session_id", "query").transformWithStateInPandas(_Cells(), CELLS, "Append", "None" if held is None else "ProcessingTime")


def maintain_heatmap(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Store the changes of each micro-batch, summed by cell, under the number of the batch."""

    def store(batch: DataFrame, number: int) -> None:
        cells = batch.groupBy("day", "subject").agg(F.sum("n").alias("n")).filter("n != 0")
        cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_heatmap(spark: SparkSession, path: str) -> DataFrame:
    """The heatmap as of the last micro-batch, open days included: (day, subject, confusion_count)."""
    stored = spark.read.schema(CELLS).parquet(f"{path}/batch=*")
    totals = stored.groupBy("day", "subject").agg(F.sum("n").alias("confusion_count")).filter("confusion_count != 0")
    return totals.orderBy(F.col("day").desc(), F.col("confusion_count").desc(), "subject")
