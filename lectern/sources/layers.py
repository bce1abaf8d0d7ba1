"""Stored layers: whole-layer overwrites, and versioned layers that are swapped in at once."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.schemas import conform

FORMAT = "parquet"


def write_layer(
    df: DataFrame, path: str, schema: T.StructType | None = None, fmt: str = FORMAT
) -> DataFrame:
    """Replace the layer at `path`, data and schema, and return the stored table.

    Later steps start from what is returned, so nothing is computed a second time.
    """
    spark = df.sparkSession
    out = conform(df, schema) if schema else df
    out.write.format(fmt).mode("overwrite").save(path)
    return read_layer(spark, path, schema or out.schema, fmt)


def read_layer(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = FORMAT
) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def scan_corpus(chunks: DataFrame, item_id: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """Id and text of every stored chunk that has text."""
    return chunks.filter(F.length(text) > 0).select(item_id, text)


# ---- versioned layers --------------------------------------------------------------------

POINTER = "seq bigint, version string, through map<string, bigint>, published_at timestamp"


@dataclass(frozen=True)
class Version:
    seq: int
    name: str
    through: dict[str, int]  # the last increment of each source that this version contains


def if_present(read):
    try:
        return read()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def newest_version(spark: SparkSession, path: str) -> Version | None:
    """The last published version; the pointer table has one row per publication."""
    published = if_present(lambda: spark.read.schema(POINTER).parquet(f"{path}/published"))
    if published is None:
        return None
    last = published.orderBy(F.col("seq").desc(), F.col("version").desc()).first()
    return Version(last["seq"], last["version"], dict(last["through"] or {})) if last else None


def publish(df: DataFrame, path: str, through: dict[str, int] | None = None, fmt: str = FORMAT) -> DataFrame:
    """Write a new version and point readers at it by appending one row.

    Readers keep the version they started with, and a failed write is never seen.
    """
    spark = df.sparkSession
    last = newest_version(spark, path)
    name = uuid.uuid4().hex
    df.write.format(fmt).save(f"{path}/versions/{name}")
    row = [(last.seq + 1 if last else 0, name, through or {}, dt.datetime.now(dt.timezone.utc))]
    spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").parquet(
        f"{path}/published"
    )
    return read_layer(spark, f"{path}/versions/{name}", df.schema, fmt)


def current(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = FORMAT
) -> DataFrame:
    """The newest published version; an unpublished layer is an empty table."""
    last = newest_version(spark, path)
    if last is None:
        return spark.createDataFrame([], schema)
    return read_layer(spark, f"{path}/versions/{last.name}", schema, fmt)


def increment_path(path: str, batch: int, source: str = "stream") -> str:
    return f"{path}/increments/source={source}/batch={batch}"


def write_increment(
    df: DataFrame, path: str, batch: int, fmt: str = FORMAT, source: str = "stream"
) -> None:
    """Store one increment: a micro-batch under its number, or a load under a source of its own.

    Running the batch again replaces it.
    """
    df.write.format(fmt).mode("overwrite").save(increment_path(path, batch, source))


def read_increments(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = FORMAT
) -> DataFrame | None:
    """Stored increments that the newest version does not contain yet, with `source` and `batch`."""
    marks = [T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())]
    rows = if_present(
        lambda: spark.read.format(fmt).schema(T.StructType([*schema.fields, *marks])).load(f"{path}/increments")
    )
    if rows is None:
        return None
    last = newest_version(spark, path)
    for source, batch in (last.through if last else {}).items():
        rows = rows.filter((F.col("source") != source) | (F.col("batch") > batch))
    return rows
