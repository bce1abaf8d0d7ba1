"""Repair of conversations against a search over all sequences of edits, and its edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair, queries

CONV = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest repair by trying all edits; up to two rows put in before each row and at the end."""
    found = faults(rows)
    gap = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    per_row = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        ways = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault == "truncated" else 0
            ways += [("K", extra, (role, text))] + [("R", 3 + extra, (r, text)) for r in ("user", "assistant")]
        per_row.append(ways)
    best = None
    for choice in itertools.product(*[itertools.product(gap, ways) for ways in per_row], gap):
        audit, cost, out = "", 0, []
        for added, (edit, price, row) in choice[:-1]:
            audit += "I" * len(added) + edit
            cost += 3 * len(added) + price
            out += [(r, "") for r in added] + ([row] if row else [])
        audit += "I" * len(choice[-1])
        cost += 3 * len(choice[-1])
        out += [(r, "") for r in choice[-1]]
        if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return best


def ordered(rows):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))


def want(rows):
    rows = ordered(rows)
    cost, audit, digest = brute(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    found = faults(rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def test_repairs_equal_a_search_of_all_edits(spark):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Hi.", "Yes!", "so what", "", " \n", None, "Who? ", "no"]
    convs = {None: [(0, "user", "a."), (1, "user", "b.")]}
    for c in range(120):
        convs[c] = [(rng.choice([None, *range(6)]), rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts)) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], CONV)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.summaries(df).collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        assert got[c] == want(rows), (c, rows)


def test_state_goes_on_across_batches(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b?", "c", f"{t}.", f"{t}!"])) for c in range(3) for t in range(700)]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    whole = {r[0]: r for r in conversation_repair.summaries(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r[0]: r for r in conversation_repair.summaries(df).collect()} == whole
        edits = conversation_repair.edits(df).filter("edit != 'D'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in range(3):
        mine = sorted((r for r in edits if r.conv_id == c), key=lambda r: r.place)
        assert RIGHT.fullmatch("".join(r.repaired_role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.repaired_role}:{r.repaired_text}" for r in mine).encode()).hexdigest() == whole[c].repaired_sha256


def test_rows_keep_their_columns_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 5, "p", "q"), (1, 1, "user", "b.", 6, "p", "q")], CONV + ", _left int, Edit string, _row string")
    out = conversation_repair.edits(df)
    assert out.columns[:6] == ["conv_id", "turn", "role", "text", "_left", "_row"]
    got = sorted(out.collect(), key=lambda r: r.place)
    assert "".join(r.edit for r in got) == "KR" and [r._left for r in got] == [5, 6]


def test_empty_table_and_very_long_texts(spark):
    assert conversation_repair.summaries(spark.createDataFrame([], CONV)).collect() == []
    long = "word " * 300_000 + "end."
    got = conversation_repair.summaries(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + " " * 100_000)], CONV)).collect()
    assert (got[0].audit, got[0].cost) == ("KK", 0)


@pytest.mark.parametrize("nulls", [False, True])
def test_query_equals_its_sql_on_odd_rows(spark, tmp_path, nulls):
    rng = random.Random(9)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Hi.", "What? ", "so", "x!y.", "  "]))
        for c in range(60) for t in range(rng.randrange(1, 7))
    ]
    if nulls:
        rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "user", "c."), (3, None, None, None), (900, None, "user", None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, CONV).write.parquet(f"{path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    cursor = db.execute(queries.REPAIR_SQL)
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cursor.fetchall()))


def test_damage_is_drawn_by_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(10)] + [(5, None, "assistant", "One. Two! Three?")]
    got = {}
    for r in conversation_repair.damaged(spark.createDataFrame(rows, CONV)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        one = ("user" if kind == 4 else role, "" if kind == 1 else "One Two Three" if kind == 2 else text)
        assert got.get((c, t), []) == ([] if kind == 0 else [one] * (2 if kind == 3 else 1))
    assert conversation_repair.damaged(spark.createDataFrame(rows, CONV).withColumn("more", F.lit(1))).columns[-1] == "more"
