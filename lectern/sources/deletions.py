"""Physical deletion from a stored table of Parquet files that jobs and streams append to.

Deleting writes no data file: it appends to a log beside the files (`_deleted`, which Spark's readers skip) one bitmap for every
stretch of 32,768 rows of a file that loses rows. Readers leave the marked rows out. Compacting writes the rows that are left of the
marked files anew, and then one append to the log lets the new files take the place of the old ones, for all readers
at once; until then the new folder is not read. `vacuum` removes the replaced files.

Appends may run meanwhile: they only add files, and a deletion or compaction speaks of the files that it has read.
Deletions and compactions of one table run one after the other. A micro-batch that runs again replaces its files by new ones, which no bitmap knows, so keep the note of what was
deleted (`append_clears`) as long as a stream may repeat a batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.session import checked_broadcast

#: Entries of the log: `rows` marks rows of a file; `file` says that compaction `commit` has replaced a file.
_LOG = "entry string, file string, bucket long, bits binary, commit string"
#: Compacted rows are in folders batch=<this><time>, which count only once their commit is in the log.
COMPACTED = "c"
#: Bitmaps that are sent to the scan at once; each has 4 KB.
BROADCAST_BITMAPS = 4_000


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/_deleted")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _append(rows: DataFrame, path: str) -> None:
    rows.select("entry", "file", "bucket", "bits", "commit").write.mode("append").parquet(f"{path}/_deleted")


def _located(stored: DataFrame) -> DataFrame:
    """With the file of each row, below the table's folder, and its place there."""
    return stored.select(
        "*",
        F.regexp_extract(F.col("_metadata.file_path"), r"(batch=[^/]*/.*)$", 1).alias("_file"),
        (F.col("_metadata.row_index") + 1).alias("_row"),
    )


def _marked(bits: Column, row: Column) -> Column:
    """Whether the bitmap of a stretch holds a row."""
    place = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def live_rows(spark: SparkSession, path: str, located: bool = False) -> DataFrame:
    """The rows of the table without the deleted ones; with `located`, also `_file` and `_row`."""
    log, stored = _log(spark, path), spark.read.parquet(path)
    if log is None:
        return _located(stored) if located else stored
    columns = stored.columns
    rows = _located(stored)
    replaced = log.filter("entry = 'file'")
    commits = replaced.select(F.concat(F.lit(COMPACTED), "commit").alias("_commit")).distinct()
    # one row for each compaction, one for each file that waits to be removed
    in_commit = rows.join(F.broadcast(commits), F.col("batch").cast("string") == F.col("_commit"), "left")
    rows = in_commit.filter(~F.col("batch").cast("string").startswith(COMPACTED) | F.col("_commit").isNotNull()).drop("_commit")
    gone = checked_broadcast(replaced.select(F.col("file").alias("_file")).distinct(), DEFAULTS.broadcast_rows)
    rows = rows.join(gone, "_file", "left_anti")
    bitmaps = (
        log.filter("entry = 'rows'").groupBy(F.col("file").alias("_file"), F.col("bucket").alias("_bucket"))
        .agg(F.bitmap_or_agg("bits").alias("_bits"))
    )
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number("_row")).join(
        checked_broadcast(bitmaps, BROADCAST_BITMAPS), ["_file", "_bucket"], "left"
    )
    rows = rows.filter(F.col("_bits").isNull() | ~_marked(F.col("_bits"), F.col("_row")))
    return rows.select(*columns, *(("_file", "_row") if located else ()))


def delete_rows(spark: SparkSession, path: str, doomed: Callable[[DataFrame], DataFrame]) -> None:
    """Mark the rows that `doomed` selects of the live rows; it must keep their `_file` and `_row`."""
    rows = doomed(live_rows(spark, path, located=True))
    bitmaps = rows.groupBy(F.col("_file").alias("file"), F.bitmap_bucket_number("_row").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("bits")
    )
    _append(bitmaps.withColumns({"entry": F.lit("rows"), "commit": F.lit(None).cast("string")}), path)


def deleted_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, deleted): rows marked in files that are still read."""
    log = _log(spark, path)
    if log is None:
        return spark.createDataFrame([], "file string, deleted long")
    replaced = log.filter("entry = 'file'").select("file").distinct()
    marked = log.filter("entry = 'rows'").join(replaced, "file", "left_anti")
    bitmaps = marked.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return bitmaps.groupBy("file").agg(F.sum(F.bitmap_count("bits")).alias("deleted"))


def compact_deletions(
    spark: SparkSession, path: str, store: Callable[[DataFrame, str], None], least: int = 1
) -> list[str]:
    """Replace files of which `least` rows or more are deleted; returns the replaced files.

    `store(rows, folder)` writes the rows that are left. Other files, and files appended meanwhile, stay as they are.
    """
    counted = deleted_counts(spark, path).filter(F.col("deleted") >= least)
    files = sorted(r.file for r in counted.select("file").collect())  # names, not rows
    if not files:
        return []
    commit = str(time.time_ns())
    wanted = spark.createDataFrame([(f,) for f in files], "_file string")
    left = live_rows(spark, path, located=True).join(F.broadcast(wanted), "_file", "left_semi").drop("_file", "_row", "batch", "day")
    store(left, f"{path}/batch={COMPACTED}{commit}")
    entries = wanted.select(
        F.lit("file").alias("entry"), F.col("_file").alias("file"), F.lit(None).cast("long").alias("bucket"),
        F.lit(None).cast("binary").alias("bits"), F.lit(commit).alias("commit"),
    )
    _append(entries.coalesce(1), path)  # one file, so readers see the whole replacement or none of it
    return files


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the files that compactions have replaced; returns how many there were. Readers that began before may still need them,
    so run it when those are done."""
    log = _log(spark, path)
    if log is None:
        return 0
    removed = 0
    for row in log.filter("entry = 'file'").select("file").distinct().toLocalIterator():
        file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{row.file}")
        removed += bool(file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False))
    return removed
