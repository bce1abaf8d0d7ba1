"""Model output as a stream of tokens: reading the lines and cutting speakable segments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.text import strip
from lectern.schemas import TOKEN_LINE

# Characters after which a segment may end, and its least stripped length.
SEGMENT_ENDS = ".!?;:,*•-"
MIN_SEGMENT_CHARS = 20
_ENDS = "[" + re.escape(SEGMENT_ENDS) + "]"

REPLY = ("session_id", "reply_id")


def parse_token_lines(lines: DataFrame, keep_gaps: bool = False) -> DataFrame:
    """`token` and `done` of JSON lines; blank and malformed lines are dropped.

    Works on tables and on streams. `lines` has session_id, reply_id, seq and line. With
    `keep_gaps` the dropped lines stay as empty tokens, so that `seq` has no holes.
    """
    # to find out that a line is broken costs more than to read one, and no object is without its end
    parsed = F.from_json(F.when(F.col("line").contains("}"), F.col("line")), TOKEN_LINE, {"mode": "PERMISSIVE"})
    kept = [c for c in lines.columns if c != "line"]
    whole = F.lit(True) if keep_gaps else F.col("_p.message").isNotNull() | F.col("_p.done").isNotNull()
    return (
        lines.select(*kept, parsed.alias("_p"))
        .filter(whole)
        .select(
            *kept,
            F.coalesce("_p.message.content", F.lit("")).alias("token"),
            F.coalesce("_p.done", F.lit(False)).alias("done"),
        )
    )


def until_done(parsed: DataFrame) -> DataFrame:
    """The non-empty tokens before the first `done` of each reply (tables only)."""
    first_done = F.min(F.when(F.col("done"), F.col("seq"))).over(W.partitionBy(*REPLY))
    return (
        parsed.withColumn("_end", first_done)
        .filter((F.col("_end").isNull() | (F.col("seq") < F.col("_end"))) & (F.col("token") != ""))
        .drop("_end", "done")
    )


def segment_array(tokens: Column) -> Column:
    """The segments of one reply, given its tokens in order; the rest is flushed at the end."""

    def state(segments: Column, buffer: Column) -> Column:
        return F.struct(segments.alias("segments"), buffer.alias("buffer"))

    def add(acc: Column, token: Column) -> Column:
        buffer = F.concat(acc["buffer"], token)
        whole = token.rlike(_ENDS) & (F.length(strip(buffer)) >= MIN_SEGMENT_CHARS)
        return F.when(
            whole, state(F.concat(acc["segments"], F.array(strip(buffer))), F.lit(""))
        ).otherwise(state(acc["segments"], buffer))

    def flush(acc: Column) -> Column:
        rest = strip(acc["buffer"])
        return F.when(
            F.length(rest) > 0, F.concat(acc["segments"], F.array(rest))
        ).otherwise(acc["segments"])

    return F.aggregate(tokens, state(F.array().cast("array<string>"), F.lit("")), add, flush)


def segment_tokens(tokens: DataFrame) -> DataFrame:
    """(session_id, reply_id, segment_no, segment) of a token table.

    A group is one reply of a model, whose length the model bounds; sessions are not gathered.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "token")))
    return (
        tokens.groupBy(*REPLY)
        .agg(F.transform(ordered, lambda x: x["token"]).alias("_tokens"))
        .select(*REPLY, F.posexplode(segment_array(F.col("_tokens"))).alias("segment_no", "segment"))
    )


# ---- packing -----------------------------------------------------------------------------

PACK_BYTES = 32 << 20  # of the tokens of a task, about so much is packed at a time


def pack_replies(tokens: DataFrame) -> DataFrame:
    """session_id, reply_id, tokens: the tokens of a reply as bytes in few rows, usually one for each micro-batch.

    What handles the replies in Python pays for each row and column, and far more than for a token. Works on streams: lines
    are dealt out by reply and each task packs what it gets, about `PACK_BYTES` at a time. Of a token that is there twice one
    is kept. `unpacked` reads the bytes.
    """
    kept = tokens.select(
        *REPLY, F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"),
        F.coalesce("token", F.lit("")).alias("token"), F.coalesce("done", F.lit(False)).alias("done"),
    )
    keys = [f"{name} {kept.schema[name].dataType.simpleString()}" for name in REPLY]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield from _packed(held)
                held, size = [], 0
        if held:
            yield from _packed(held)

    return kept.repartition(*REPLY).mapInArrow(pack, ", ".join([*keys, "tokens binary"]))


def _packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return
    reply = np.zeros(table.num_rows, np.int64)
    for name in REPLY:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        reply = reply * len(codes.dictionary) + codes.indices.to_numpy()
    seq = table["seq"].to_numpy()
    order = np.lexsort((seq, reply))
    reply, seq = reply[order], seq[order]
    last = np.append((reply[1:] != reply[:-1]) | (seq[1:] != seq[:-1]), True)  # of equal ones
    order, reply, seq = order[last], reply[last], seq[last]
    starts = np.append(0, np.flatnonzero(reply[1:] != reply[:-1]) + 1)
    texts = [t.encode() for t in table["token"].combine_chunks().take(pa.array(order)).to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int32, len(texts))
    done = table["done"].to_numpy()[order]
    packs = [
        b"".join([(b - a).to_bytes(8, "little"), seq[a:b].tobytes(), sizes[a:b].tobytes(), done[a:b].tobytes(), *texts[a:b]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])
    ]
    names = table.select(list(REPLY)).take(pa.array(order[starts]))
    yield from names.append_column("tokens", pa.array(packs, pa.binary())).to_batches(max_chunksize=1_000)


def unpacked(pack: bytes) -> Iterator[tuple[int, str, bool]]:
    """(seq, token, done) of the tokens of a pack, by their places."""
    n = int.from_bytes(pack[:8], "little")
    seqs, sizes = np.frombuffer(pack, np.int64, n, 8).tolist(), np.frombuffer(pack, np.int32, n, 8 + 8 * n).tolist()
    at = 8 + 13 * n
    for seq, size, done in zip(seqs, sizes, pack[8 + 12 * n : at]):
        yield seq, pack[at : at + size].decode() if size else "", done == 1
        at += size


# ---- segments of a stream ----------------------------------------------------------------

_OUT = "session_id string, reply_id bigint, segment_no int, segment string"
_STATE = "buffer string, segments int, closed boolean, next bigint, waiting string"


class _Reply:
    """The open buffer of a reply, the next `seq`, and the tokens that came before their turn."""

    def __init__(self, held: tuple | None):
        buffer, count, closed, following, waiting = held or ("", 0, False, 0, "[]")
        self.buffer, self.count, self.closed, self.next = buffer, count, closed, following
        self.waiting = {seq: (token, done) for seq, token, done in json.loads(waiting)}
        self.out: list[tuple[int, str]] = []

    def state(self) -> tuple:
        early = [] if self.closed else sorted((seq, *x) for seq, x in self.waiting.items())
        return self.buffer, self.count, self.closed, self.next, json.dumps(early)

    def cut(self) -> None:
        text = self.buffer.strip()
        if text:
            self.out.append((self.count, text))
            self.count += 1
        self.buffer = ""

    def take(self, token: str, done: bool) -> None:
        if done:
            self.closed = True
            self.cut()
        elif token:
            self.buffer += token
            if ends_segment(token) and len(self.buffer.strip()) >= MIN_SEGMENT_CHARS:
                self.cut()

    def advance(self, whatever_is_there: bool = False) -> None:
        """Takes the tokens whose turn it is; at the end, all that have come."""
        while not self.closed and self.waiting:
            if self.next not in self.waiting:
                if not whatever_is_there:
                    return
                self.next = min(self.waiting)
            self.take(*self.waiting.pop(self.next))
            self.next += 1


_ENDED = re.compile(_ENDS)


def ends_segment(token: str) -> bool:
    """Whether a segment may end with this token."""
    return _ENDED.search(token) is not None


def segment_stream(tokens: DataFrame, idle_seconds: int = 600) -> DataFrame:
    """The streaming form of `segment_tokens`: segments come out as soon as they are whole.

    `tokens` is a stream of session_id, reply_id, seq, token, done, with `seq` counting from 0
    without holes. A token that is ahead of its turn waits in the state, whatever batch brings
    the missing one; one that comes twice counts once. `done` flushes the buffer, and what comes
    after it is ignored. A reply that has had no token for `idle_seconds` is flushed, if it is
    still open, and its state is removed, so the state holds the replies of that time only. Time
    is that of arrival, the start of a micro-batch, and moves on with newer batches.
    """
    arriving = pack_replies(tokens).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "1 second")

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], held: GroupState
    ) -> Iterator[pd.DataFrame]:
        reply = _Reply(held.get if held.exists else None)
        if held.hasTimedOut:
            reply.advance(whatever_is_there=True)
            if not reply.closed:
                reply.cut()
            held.remove()
        else:
            for rows in batches:
                for pack in rows["tokens"]:
                    if not reply.closed:
                        reply.waiting.update((seq, (token, done)) for seq, token, done in unpacked(pack) if seq >= reply.next)
            reply.advance()
            held.update(reply.state())
            # the time that `_arrived` has in this micro-batch
            held.setTimeoutTimestamp(held.getCurrentProcessingTimeMs() + idle_seconds * 1000)
        if reply.out:
            numbers, texts = zip(*reply.out)
            yield pd.DataFrame({"session_id": key[0], "reply_id": key[1], "segment_no": numbers, "segment": texts})

    return arriving.groupBy(*REPLY).applyInPandasWithState(
        advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
