"""Repair of the turn structure of conversations by the cheapest edits.

A conversation is right when the initials of its roles give `(s?(ua)+)?`: nothing, or an optional system row and then
users and assistants in turn. Rows are kept (0), given another role (3), deleted (4; required for blank rows and
repeats), and rows without text may be put in anywhere (3); a row whose text breaks off and that stays costs 3 more. Of
the cheapest ways the one whose edits read least in ASCII (D, I, K, R) is taken.

Method: rows are dealt out by conversation and sorted by turn; `mapInArrow` (the Arrow form of `mapInPandas`) streams
them and carries the state of a dynamic program across batches. Its first pass goes backwards: the state is what the
rest of the conversation costs from each of four places in the pattern, and a row gets one byte, the best edit from
each place. The second pass goes forwards and follows these bytes, and a digest goes over its rows in the same
order. The bytes are the spilled backpointers: they ride on the rows through Spark's sorter, which spills to disk, so
that a conversation of any length is repaired in memory that does not grow with it (but for its audit, one byte a row).

How it scales: two shuffles of the rows, one to find repeats by (conversation, role, text) and one by conversation;
both sorts of the second stay inside a partition. Costs differ by a bounded amount between places, so
each step is a look-up in a small table. One conversation is one stream: its digest reads its texts in order, so a
giant one takes one task as long as it takes to read it, without holding it.

Edge cases: null roles and texts are read as one space; a null conversation id is a conversation of its own; null
turns come first; rows with equal turns are ordered by role and text, so the result does not depend on how rows are
dealt; equal rows are repeats; texts of any length are whole; an empty table gives no rows; further columns are kept on
the rows of `edits` (null on rows put in), columns named like its own give way to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
#: Places in the pattern: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the next row leads, by its initial; and the one role that may be put in at each place.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GIVEN = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
EDITS = "DIKR"
AT_END = (0, 2 * INSERT, INSERT, 0)
EDIT_FIELDS = [
    T.StructField("place", T.LongType()),
    T.StructField("edit", T.StringType()),
    T.StructField("fault", T.StringType()),
    T.StructField("repaired_role", T.StringType()),
    T.StructField("repaired_text", T.StringType()),
    T.StructField("edit_cost", T.LongType()),
]


#: Columns that a row brings along; null on rows put in.
KEPT = ("_row", "_turn", "_initial")


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of `conv_id:turn`, as a test of the repair; nulls are read as one space."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return (
        conversations.withColumns({"role": _spaced("role"), "text": _spaced("text"), "_kind": kind})
        .filter("_kind != 0")
        .withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")), "_copy": F.explode(copies)})
        .drop("_kind", "_copy")
    )


def _step(rest: tuple, initial: str, fault: str | None) -> tuple[tuple, int, int]:
    """Costs from each place before a row, from those after it; their common part; and the best edits as a byte."""
    broken = BROKEN if fault == "truncated" else 0
    must_go = fault in ("blank", "duplicate")
    ways = []
    for place in range(4):
        way = {"D": DELETE + rest[place]}
        if not must_go:
            way["R"] = REROLE + broken + rest[GIVEN[place][0]]
            if place in NEXT.get(initial, ()):
                way["K"] = KEEP + broken + rest[NEXT[initial][place]]
        ways.append(way)
    cost = [min(way.values()) for way in ways]
    for place in (USER, ASSISTANT, USER, START, SYSTEM):  # inserting twice from a place leads back to it
        ways[place]["I"] = INSERT + cost[GIVEN[place][0]]
        cost[place] = min(cost[place], ways[place]["I"])
    best = 0
    for place, way in enumerate(ways):
        best |= next(k for k, e in enumerate(EDITS) if way.get(e) == cost[place]) << (2 * place)
    low = min(cost)
    return tuple(c - low for c in cost), low, best


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    conversation, rest, left = object(), AT_END, 0
    for batch in batches:
        lefts, bests = [], []
        for c, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("_conv", "_initial", "_fault")), strict=True):
            if c != conversation:
                conversation, rest, left = c, AT_END, 0
            found = known.get((rest, initial, fault))
            if found is None:
                found = known[rest, initial, fault] = _step(rest, initial, fault)
            rest = found[0]
            lefts.append(left)
            bests.append(found[2])
            left += 1
        columns = [*(batch.column(k) for k in range(batch.num_columns)), pa.array(lefts, pa.int64()), pa.array(bests, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_left", "_best"])


def _walk(place: int, best: int, initial: str, fault: str | None) -> tuple[tuple[str, ...], str, str | None, int, int]:
    """Roles put in before the row; its edit, new role and cost; the place after it."""
    added = []
    while EDITS[(best >> (2 * place)) & 3] == "I":
        place, role = GIVEN[place]
        added.append(role)
    edit = EDITS[(best >> (2 * place)) & 3]
    broken = BROKEN if fault == "truncated" else 0
    if edit == "D":
        return tuple(added), "D", None, DELETE, place
    if edit == "K":
        return tuple(added), "K", None, broken, NEXT[initial][place]
    return tuple(added), "R", GIVEN[place][1], REROLE + broken, GIVEN[place][0]


class _Rows:
    """Rows of the second pass until they leave as a batch."""

    def __init__(self):
        self.take, self.conv, self.edit, self.fault, self.role, self.text, self.place, self.cost = ([] for _ in range(8))

    def add(self, take, conv, edit, fault, role, text, place, cost) -> None:
        for name, value in zip(("take", "conv", "edit", "fault", "role", "text", "place", "cost"), (take, conv, edit, fault, role, text, place, cost), strict=True):
            getattr(self, name).append(value)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    nobody = conversation = object()
    place, at, batch = START, 0, None

    def close(rows: _Rows) -> None:
        nonlocal place, at
        while place in (SYSTEM, USER):
            place, role = GIVEN[place]
            rows.add(None, conversation, "I", None, role, "", at, INSERT)
            at += 1

    def out(rows: _Rows, batch: pa.RecordBatch) -> pa.RecordBatch:
        index = pa.array(rows.take, pa.int64())
        arrays = [batch.column(n).take(index) for n in KEPT]
        arrays += [pa.array(rows.conv, batch.schema.field("_conv").type), pa.array(rows.place, pa.int64()), pa.array(rows.edit, pa.string())]
        arrays += [pa.array(v, pa.string()) for v in (rows.fault, rows.role, rows.text)] + [pa.array(rows.cost, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, [*KEPT, "_conv", *(f.name for f in EDIT_FIELDS)])

    for batch in batches:
        rows = _Rows()
        names = ("_conv", "_initial", "_fault", "_best", "_role", "_text")
        for k, (c, initial, fault, best, role, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
            if c != conversation:
                if conversation is not nobody:
                    close(rows)
                conversation, place, at = c, START, 0
            found = known.get((place, best, initial, fault))
            if found is None:
                found = known[place, best, initial, fault] = _walk(place, best, initial, fault)
            added, edit, new_role, cost, place = found
            for name in added:
                rows.add(None, c, "I", None, name, "", at, INSERT)
                at += 1
            gone = edit == "D"
            rows.add(k, c, edit, fault, None if gone else new_role or role, None if gone else text, at, cost)
            at += 1
        yield out(rows, batch)
    if batch is not None:
        rows = _Rows()
        close(rows)
        if rows.take:
            yield out(rows, batch)


def _ordered(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their faults and best edits, dealt out by conversation and sorted forwards."""
    end = F.rtrim(F.col("_text"), F.lit(SPACES))
    same = Window.partitionBy("_conv", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first())
    fault = (
        F.when(end == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    rows = conversations.select(
        F.struct("*").alias("_row"),
        F.col(key).alias("_conv"),
        F.col(turn).cast("long").alias("_turn"),
        _spaced(role).alias("_role"),
        _spaced(text).alias("_text"),
    ).withColumns({"_initial": F.substring("_role", 1, 1), "_fault": fault})
    backwards = [F.col("_conv").asc_nulls_first(), F.col("_turn").desc_nulls_last(), F.col("_role").desc(), F.col("_text").desc()]
    backwards.append(F.coalesce(F.col("_fault") == "duplicate", F.lit(False)).desc())  # of equal rows the first is none
    dealt = rows.repartition("_conv").sortWithinPartitions(*backwards)
    schema = T.StructType([*dealt.schema.fields, T.StructField("_left", T.LongType()), T.StructField("_best", T.IntegerType())])
    return dealt.mapInArrow(_backward, schema).sortWithinPartitions(F.col("_conv").asc_nulls_first(), F.col("_left").desc())


def _edited(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    ordered = _ordered(conversations, key, turn, role, text)
    fields = [ordered.schema[n] for n in (*KEPT, "_conv")] + EDIT_FIELDS
    return ordered.mapInArrow(_forward, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))


def edits(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row and every row put in, with `place` in the conversation, `edit` (K, R, D or I), `fault` (blank, duplicate, truncated or
    null), `repaired_role`, `repaired_text` (null for deleted rows) and `edit_cost`; further columns as they were.

    The repaired conversation is the rows without D by `place`.
    """
    given = conversations.drop(*(f.name for f in EDIT_FIELDS))
    kept = [F.col("_conv" if c == key else f"_row.`{c}`").alias(c) for c in given.columns]
    return _edited(given, key, turn, role, text).select(*kept, *(f.name for f in EDIT_FIELDS))


class _Summary:
    def __init__(self, conversation):
        self.conversation, self.hash, self.audit, self.cost, self.first = conversation, hashlib.sha256(), bytearray(), 0, True
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def add(self, turn, initial, edit, fault, role, text, cost) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if role is not None:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
        if edit == "I":
            return
        if fault is not None:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            if turn != self.turn:
                self.turns += 1
            self.turn = turn

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (self.faults["blank"], self.faults["duplicate"], self.faults["truncated"])
        return (self.conversation, gaps if gaps < 1 << 63 else None, *counts, self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


def summaries(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: gaps between its turns, its faults, illegal neighbours, the cost, the edits and a digest."""
    done = _edited(conversations, key, turn, role, text)
    schema = T.StructType(
        [
            T.StructField(key, conversations.schema[key].dataType),
            *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            T.StructField("audit", T.StringType()),
            T.StructField("repaired_sha256", T.StringType()),
        ]
    )
    names = ("_conv", "_turn", "_initial", "edit", "fault", "repaired_role", "repaired_text", "edit_cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names
            )

        for batch in batches:
            kind, rows = batch.schema.field("_conv").type, []
            for c, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if current is None or c != current.conversation:
                    if current is not None:
                        rows.append(current.row())
                    current = _Summary(c)
                current.add(*row)
            if rows:
                yield out(rows)
        if current is not None:
            yield out([current.row()])

    return done.select(*names).mapInArrow(run, schema)
