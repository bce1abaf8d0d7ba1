"""Segments of token streams on named state, timers and time to live.

The same segments as `tokens.segment_stream`, held by Spark as separate variables of each reply: `front` (the open buffer,
the number of segments, the next place, the time of the last token), `early` (tokens ahead of their turn, a list of one row: place -1
and a JSON list of [seq, token, done], since each row of a list costs as much as many tokens) and `closed` (that
the reply has ended). A reply has one timer: when it fires, a reply that was idle since is flushed and forgotten, and another
gets a timer for the rest of its time. `closed` goes by itself after `remember_seconds`, so lines that come again for an
ended reply are ignored as long, without a timer. The variables can be looked at with Spark's state reader.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.session import need_named_state
from lectern.streaming.tokens import MIN_SEGMENT_CHARS, REPLY, ends_segment, pack_replies, unpacked

_OUT = "session_id string, reply_id bigint, segment_no int, segment string"


class _Segments(StatefulProcessor):
    def __init__(self, idle_ms: int, remember_ms: int):
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.front = handle.getValueState("front", "buffer string, segments int, next long, last long")
        self.early = handle.getListState("early", "seq long, token string, done boolean")
        self.closed = handle.getValueState("closed", "segments int", self.remember_ms)

    def _load(self) -> tuple[list, dict]:
        front = self.front.get()
        if front is None:
            return ["", 0, 0, -1], {}  # `early` is never without `front`
        held = {}
        for seq, token, done in self.early.get():
            # older checkpoints have a row for each token
            held |= {seq: (token, done)} if seq >= 0 else {at: (text, end) for at, text, end in json.loads(token)}
        return list(front), held

    @staticmethod
    def _cut(front: list, out: list) -> None:
        text = front[0].strip()
        if text:
            out.append((front[1], text))
            front[1] += 1
        front[0] = ""

    def _advance(self, front: list, early: dict, out: list) -> bool:
        """Takes the tokens whose turn it is; true when the reply has ended."""
        while front[2] in early:
            token, done = early.pop(front[2])
            front[2] += 1
            if done:
                self._cut(front, out)
                return True
            front[0] += token
            if token and ends_segment(token) and len(front[0].strip()) >= MIN_SEGMENT_CHARS:
                self._cut(front, out)
        return False

    def _forget(self) -> None:
        self.front.clear()
        self.early.clear()

    @staticmethod
    def _rows(key, out: list) -> Iterator[Row]:
        return (Row(session_id=key[0], reply_id=key[1], segment_no=n, segment=text) for n, text in out)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out: list = []
        front, early = self._load()
        # each question to the state costs much; an open reply has a front
        if front[3] >= 0 or not self.closed.exists():
            waiting = set(early)
            for row in rows:
                early.update((seq, (token, done)) for seq, token, done in unpacked(row["tokens"]) if seq >= front[2])
            if self._advance(front, early, out):
                self._forget()
                self.closed.update((front[1],))
            else:
                now = timerValues.getCurrentProcessingTimeInMs()
                if front[3] < 0:
                    self.handle.registerTimer(now + self.idle_ms)
                self.front.update((*front[:3], now))
                if early.keys() != waiting:
                    if early:
                        self.early.put([(-1, json.dumps([(seq, *x) for seq, x in sorted(early.items())]), False)])
                    else:
                        self.early.clear()
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Of an idle reply, what has come is taken in order, gaps or not, and nothing is kept."""
        out: list = []
        front, early = self._load()
        due = front[3] + self.idle_ms
        if front[3] >= 0 and due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
            return
        ended = False
        while early and not ended:
            front[2] = min(early)
            ended = self._advance(front, early, out)
        self._cut(front, out)
        self._forget()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def segment_stream_timers(tokens: DataFrame, idle_seconds: int = 600, remember_seconds: int = 3_600) -> DataFrame:
    """The streaming form of `segment_tokens`; `tokens` as in `tokens.segment_stream`.

    `idle_seconds` without a token flush a reply and remove its state; an ended reply is known for `remember_seconds` more.
    Time is that of processing, and timers fire with the next micro-batch.
    """
    need_named_state(tokens.sparkSession)
    return pack_replies(tokens).groupBy(*REPLY).transformWithState(
        _Segments(idle_seconds * 1000, remember_seconds * 1000), _OUT, "Append", "ProcessingTime"
    )


def drain(query: StreamingQuery) -> None:
    """Wait until two micro-batches in a row find no new rows, and stop the query.

    A query with processing-time timers does not end by itself, whatever its trigger: it goes on for their sake. (The first
    batch after a restart may be one without rows that is done again.)
    """
    while query.isActive:
        last = query.recentProgress[-2:]
        if len(last) == 2 and all(p["numInputRows"] == 0 for p in last):
            query.stop()
            break
        time.sleep(0.2)
    if query.exception() is not None:
        raise query.exception()
