"""Deleted turns: bitmaps beside the files, compaction, appends meanwhile."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from lectern.operators.conversation import clear_history
from lectern.schemas import CHAT_HISTORY
from lectern.sources import deletions, logs

CLEARS = "session_id string, cleared_at timestamp"
START = dt.datetime(2024, 1, 1)


def turns(spark, n, first=0, sessions=7):
    i = F.col("id")
    return spark.range(first, first + n).select(
        i, F.concat(F.lit("s"), (i % sessions).cast("string")).alias("session_id"), F.lit("user").alias("role"),
        F.concat(F.lit("text "), i.cast("string")).alias("content"),
        F.timestamp_seconds(F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp())) + i * 20).alias("created_at"),
    )


def clears(spark, *rows):
    return spark.createDataFrame(list(rows), CLEARS)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def stored_ids(path):
    """Ids in all data files, whether they are read or not."""
    import pyarrow.parquet as pq

    return sorted(i for f in glob.glob(f"{path}/batch=*/day=*/*.parquet") for i in pq.read_table(f, columns=["id"]).column(0).to_pylist())


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "history")
    logs.append_turns(turns(spark, 9000), path)  # three days
    logs.append_turns(turns(spark, 500, 9000), path, batch=3)
    return path


def test_cleared_turns_are_not_read_and_files_stay(spark, path):
    before = sorted(glob.glob(f"{path}/batch=*/day=*/*.parquet"))
    cleared = clears(spark, ("s1", START + dt.timedelta(hours=30)), ("s2", None), ("nobody", None))
    want = ids(clear_history(logs.read_history(spark, path), cleared))
    logs.delete_cleared(spark, path, cleared)
    assert ids(logs.read_history(spark, path)) == want
    assert sorted(glob.glob(f"{path}/batch=*/day=*/*.parquet")) == before
    assert deletions.deleted_counts(spark, path).agg(F.sum("deleted")).first()[0] == 9500 - len(want)
    logs.delete_cleared(spark, path, cleared)  # again: nothing is left to mark
    assert ids(logs.read_history(spark, path)) == want
    later = dt.date(2024, 1, 3)
    assert ids(logs.read_history(spark, path, since=later)) == [i for i in want if (START + dt.timedelta(seconds=20 * i)).date() >= later]


def test_bitmaps_cover_files_of_any_length(spark, tmp_path):
    path = str(tmp_path / "long")
    rows = turns(spark, 100_000).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 1000))
    logs.append_turns(rows.coalesce(1), path)
    assert len(glob.glob(f"{path}/batch=*/day=*/*.parquet")) == 1
    deletions.delete_rows(spark, path, lambda live: live.filter("id % 3 = 0 or id in (1, 32767, 32768, 99999)"))
    want = [i for i in range(100_000) if not (i % 3 == 0 or i in (1, 32767, 32768, 99999))]
    assert ids(logs.read_history(spark, path)) == want
    deletions.delete_rows(spark, path, lambda live: live.filter("id < 50000"))
    assert ids(logs.read_history(spark, path)) == [i for i in want if i >= 50000]


def test_compaction_leaves_no_cleared_row_in_any_file(spark, path):
    logs.delete_cleared(spark, path, clears(spark, ("s1", START + dt.timedelta(hours=10))))
    want = ids(logs.read_history(spark, path))
    touched = {r.file for r in deletions.deleted_counts(spark, path).collect()}
    untouched = {f for f in glob.glob(f"{path}/batch=*/day=*/*.parquet") if f[len(path) + 1 :] not in touched}
    assert untouched and set(logs.compact_history(spark, path)) == touched
    assert stored_ids(path) == want == ids(logs.read_history(spark, path))
    assert untouched <= set(glob.glob(f"{path}/batch=*/day=*/*.parquet"))
    assert logs.compact_history(spark, path) == []
    # compacted files can lose rows and be compacted again
    logs.delete_cleared(spark, path, clears(spark, ("s3", None)))
    logs.compact_history(spark, path)
    assert stored_ids(path) == [i for i in want if i % 7 != 3] == ids(logs.read_history(spark, path))
    assert logs.read_history(spark, path).schema == CHAT_HISTORY


def test_appends_meanwhile_survive(spark, path, monkeypatch):
    cleared, write = clears(spark, ("s1", None)), deletions._append

    def and_append(number):
        def meanwhile(rows, file_path):
            logs.append_turns(turns(spark, 70, number), path)
            write(rows, file_path)

        return meanwhile

    monkeypatch.setattr(deletions, "_append", and_append(20_000))
    logs.delete_cleared(spark, path, cleared)
    monkeypatch.setattr(deletions, "_append", and_append(30_000))
    logs.compact_history(spark, path)
    got = ids(logs.read_history(spark, path))
    assert got == [i for i in range(9500) if i % 7 != 1] + [*range(20_000, 20_070), *range(30_000, 30_070)]


def test_a_compaction_that_fails_is_not_seen(spark, path, monkeypatch):
    logs.delete_cleared(spark, path, clears(spark, ("s1", None)))
    want = ids(logs.read_history(spark, path))

    def fail(rows, file_path):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(deletions, "_append", fail)
        with pytest.raises(RuntimeError):
            logs.compact_history(spark, path)
    assert glob.glob(f"{path}/batch=c*") and ids(logs.read_history(spark, path)) == want
    logs.compact_history(spark, path, remove=False)
    assert ids(logs.read_history(spark, path)) == want
    assert deletions.vacuum(spark, path) > 0
    assert ids(logs.read_history(spark, path)) == want


def test_files_with_few_deleted_rows_can_wait(spark, path):
    logs.delete_cleared(spark, path, clears(spark, ("s1", START + dt.timedelta(seconds=100))))
    assert logs.compact_history(spark, path, least=2) == []
    assert len(logs.compact_history(spark, path, least=1)) == 1


def test_nothing_deleted(spark, path):
    assert logs.compact_history(spark, path) == [] and deletions.deleted_counts(spark, path).isEmpty()
    assert ids(logs.read_history(spark, path)) == list(range(9500))
