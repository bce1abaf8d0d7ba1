"""Versions that share files: a fold rewrites only the files that may hold a document of its increments.

A version is a manifest, the list of its data files with a filter over the documents of each. Files hold the documents of one
cluster (a hash of the document), so a document is looked for in the files of its cluster only, and there the filter tells
nearly always whether it is stored. A load of new documents reads no stored file at all; a load that replaces some
reads and rewrites the files that hold them, and all others pass from version to version as they are.

The filter is a blocked Bloom filter: a document belongs to one stretch of 32,768 bits of each file's filter, in which `HASHES`
bits are set. Files have a stretch for every `PER_STRETCH` documents, so about one lookup in a thousand is in vain
whatever the size of a file, and none is missed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULTS
from lectern.session import checked_broadcast
from lectern.sources.layers import POINTER, if_present, newest_version, read_layer

STRETCH_BITS, PER_STRETCH, HASHES = 32_768, 2_000, 7
#: Clusters into which documents are dealt, and files of a cluster beyond which a fold merges them all.
CLUSTERS, MOST_FILES = 64, 8
_MANIFEST = "file string, cluster int, stretches int, stretch int, bits binary"


@dataclass(frozen=True)
class Fold:
    rows: DataFrame  # the version that was published
    files_read: int
    files_before: int


def cluster_of(document: Column) -> Column:
    return F.pmod(F.xxhash64(document.cast("string")), F.lit(CLUSTERS)).cast("int")


def _place(document: Column, number: int) -> Column:
    return F.xxhash64(document.cast("string"), F.lit(number))


def _stretch(document: Column, stretches: Column) -> Column:
    return F.pmod(_place(document, 1_000), stretches).cast("int")


def _has_bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def filters(rows: DataFrame, document: str) -> DataFrame:
    """Filters of the files that hold `rows` (file, cluster, document): a row for each stretch of each file."""
    documents = rows.select("file", "cluster", document).distinct()
    sizes = documents.groupBy("file").agg(F.ceil(F.count("*") / PER_STRETCH).cast("int").alias("stretches"))
    key = F.col(document)
    places = F.array(*(F.pmod(_place(key, i), F.lit(STRETCH_BITS)) for i in range(HASHES)))
    bits = documents.join(sizes, "file").select("file", "cluster", "stretches", _stretch(key, F.col("stretches")).alias("stretch"), F.explode(places).alias("place"))
    return bits.groupBy("file", "cluster", "stretches", "stretch").agg(F.bitmap_construct_agg("place").alias("bits"))


def files_holding(manifest: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """(file): those that may hold one of the distinct `documents`; a document meets the files of its cluster only."""
    key = F.col(document)
    # a filter row is 4 KB; few documents are sent to the filters, many meet them by cluster
    asked = checked_broadcast(documents.select(key, cluster_of(key).alias("cluster")), DEFAULTS.broadcast_rows)
    met = manifest.join(asked, "cluster").filter(F.col("stretch") == _stretch(key, F.col("stretches")))
    for i in range(HASHES):
        met = met.filter(_has_bit(F.col("bits"), F.pmod(_place(key, i), F.lit(STRETCH_BITS))))
    return met.select("file").distinct()


def manifest_of(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    return if_present(lambda: spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{version}"))


def _read(spark: SparkSession, path: str, files: list[str], schema: T.StructType) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in files))


def _files(manifest: DataFrame) -> list[str]:
    return sorted(r.file for r in manifest.select("file").distinct().collect())  # names, not rows


def read_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version, whether it is a manifest or a folder of its own; an unpublished table is empty."""
    last = newest_version(spark, path)
    if last is None:
        return spark.createDataFrame([], schema)
    manifest = manifest_of(spark, path, last.name)
    if manifest is None:
        return read_layer(spark, f"{path}/versions/{last.name}", schema)
    return _read(spark, path, _files(manifest), schema)


def _located(spark: SparkSession, path: str, name: str, schema: T.StructType, document: str) -> DataFrame:
    """(file, cluster, document) of the data files below versions/<name>."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/versions/{name}")
    file = F.regexp_extract(F.col("_metadata.file_path"), r"(versions/[^/]+/.*)$", 1)
    return rows.select(file.alias("file"), cluster_of(F.col(document)).alias("cluster"), document)


def fold(
    spark: SparkSession,
    path: str,
    fresh: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: T.StructType,
    document: str = "path",
    through: Mapping[str, int] | None = None,
) -> Fold:
    """Publish the newest version with `fresh` merged into it: `merge(stored rows of its documents' files, fresh)`.

    A reader keeps the files of its version; a failed fold leaves files that no manifest names.
    """
    last = newest_version(spark, path)
    manifest = manifest_of(spark, path, last.name) if last else None
    whole = last is not None and manifest is None  # a version in a folder of its own gets its filters by being rewritten
    before, touched = [], []
    if manifest is not None:
        before = _files(manifest)
        documents = fresh.select(document).distinct()
        crowded = manifest.select("cluster", "file").distinct().groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= MOST_FILES)
        # clusters of which this load brings a file and that have many already are merged as a whole
        crowded = crowded.join(documents.select(cluster_of(F.col(document)).alias("cluster")).distinct(), "cluster", "left_semi")
        small = manifest.join(crowded, "cluster", "left_semi").select("file")
        touched = _files(files_holding(manifest, documents, document).unionByName(small))
        stored = _read(spark, path, touched, schema)
    else:
        stored = read_version(spark, path, schema)
    name = uuid.uuid4().hex
    merged = merge(stored, fresh).withColumn("cluster", cluster_of(F.col(document)))
    # a cluster's rows are gathered in one file, or in several where they are many
    dealt = merged.hint("rebalance", F.col("cluster")).sortWithinPartitions("cluster", document)
    dealt.write.partitionBy("cluster").parquet(f"{path}/versions/{name}")
    made = filters(_located(spark, path, name, schema, document), document) if not _is_empty(spark, path, name, schema) else None
    listed = spark.createDataFrame([], _MANIFEST)
    if manifest is not None:
        gone = spark.createDataFrame([(f,) for f in touched], "file string")
        listed = listed.unionByName(manifest.join(F.broadcast(gone), "file", "left_anti"))  # names of files
    if made is not None:
        listed = listed.unionByName(made)
    listed.write.parquet(f"{path}/manifests/{name}")
    row = [(last.seq + 1 if last else 0, name, dict(through or {}), dt.datetime.now(dt.timezone.utc))]
    spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return Fold(read_version(spark, path, schema), -1 if whole else len(touched), len(before))


def _is_empty(spark: SparkSession, path: str, name: str, schema: T.StructType) -> bool:
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    found = if_present(lambda: reader.parquet(f"{path}/versions/{name}"))
    return found is None or found.isEmpty()

