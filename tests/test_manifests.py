"""Folds that rewrite only the files that may hold a document of the increments."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import manifests
from lectern.sources.layers import newest_version, publish
from lectern.sources.upsert import replace_documents

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("load_ts", T.LongType())])


def merge(stored, fresh):
    return replace_documents(stored, fresh)


def docs(spark, first, last, load, chunks=2):
    rows = spark.range(first, last).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("path"), F.col("id"))
    return rows.select("path", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "id").select(
        "path", (F.col("id") * 10 + F.col("c")).alias("chunk_id"), F.lit(load).cast("long").alias("load_ts")
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("path", "chunk_id", "load_ts").collect())


def files(path):
    return set(glob.glob(f"{path}/versions/*/cluster=*/*.parquet"))


def test_only_files_of_the_documents_are_read_and_rewritten(spark, tmp_path):
    path = str(tmp_path / "index")
    first = manifests.fold(spark, path, docs(spark, 0, 3000, 1), merge, SCHEMA)
    assert (first.files_read, first.files_before) == (0, 0) and rows(first.rows) == rows(docs(spark, 0, 3000, 1))
    old = files(path)
    assert len(old) == manifests.CLUSTERS

    new = manifests.fold(spark, path, docs(spark, 5000, 5040, 2), merge, SCHEMA)  # none of them is stored
    assert new.files_read <= 1 and new.files_before == 64
    again = manifests.fold(spark, path, docs(spark, 100, 103, 3, chunks=1), merge, SCHEMA)
    assert 1 <= again.files_read <= 6
    want = docs(spark, 0, 100, 1).unionByName(docs(spark, 103, 3000, 1)).unionByName(docs(spark, 5000, 5040, 2))
    want = want.unionByName(docs(spark, 100, 103, 3, chunks=1))
    assert rows(again.rows) == rows(want) == rows(manifests.read_version(spark, path, SCHEMA))
    assert old <= files(path)  # readers of an older version keep its files
    assert rows(manifests._read(spark, path, [f[len(path) + 1 :] for f in sorted(old)], SCHEMA)) == rows(docs(spark, 0, 3000, 1))


def test_filters_know_every_document(spark, tmp_path):
    given = docs(spark, 0, 9000, 1, chunks=1).withColumns({"file": F.lit("f"), "cluster": F.lit(3)})
    manifest = manifests.filters(given, "path")
    assert manifest.count() == 5  # 2,000 documents to a stretch
    known = manifest.select("file", F.explode(F.array(*map(F.lit, range(64)))).alias("cluster"), "stretches", "stretch", "bits")
    one = lambda i: manifests.files_holding(known, spark.createDataFrame([(f"d{i}",)], "path string"), "path").count()
    assert [one(i) for i in (0, 1, 4444, 8999)] == [1, 1, 1, 1]
    # lookups in vain, of documents that are not there
    strangers = docs(spark, 20_000, 60_000, 1, chunks=1).select("path")
    key = F.col("path")
    met = strangers.join(manifest.drop("cluster")).filter(F.col("stretch") == manifests._stretch(key, F.col("stretches")))
    for i in range(manifests.HASHES):
        met = met.filter(manifests._has_bit(F.col("bits"), F.pmod(manifests._place(key, i), F.lit(manifests.STRETCH_BITS))))
    assert met.count() < 40_000 * 0.003


def test_documents_that_lose_all_chunks_and_older_loads(spark, tmp_path):
    path = str(tmp_path / "index")
    manifests.fold(spark, path, docs(spark, 0, 50, 5), merge, SCHEMA)
    late = manifests.fold(spark, path, docs(spark, 0, 10, 3), merge, SCHEMA)  # older than what is stored
    assert rows(late.rows) == rows(docs(spark, 0, 50, 5))

    def drop(stored, fresh):
        return stored.join(fresh.select("path").distinct(), "path", "left_anti")

    manifests.fold(spark, path, docs(spark, 0, 50, 9), drop, SCHEMA)
    assert manifests.read_version(spark, path, SCHEMA).count() == 0
    back = manifests.fold(spark, path, docs(spark, 7, 9, 10), merge, SCHEMA)
    assert rows(back.rows) == rows(docs(spark, 7, 9, 10))


def test_crowded_clusters_are_merged(spark, tmp_path):
    path = str(tmp_path / "index")
    for i in range(11):
        made = manifests.fold(spark, path, docs(spark, i * 100, i * 100 + 100, i), merge, SCHEMA)
    manifest = manifests.manifest_of(spark, path, newest_version(spark, path).name)
    per = manifest.select("cluster", "file").distinct().groupBy("cluster").count()
    assert per.agg(F.max("count")).first()[0] <= manifests.MOST_FILES
    assert made.rows.count() == 2200


def test_a_failed_fold_is_not_seen_and_plain_versions_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    publish(docs(spark, 0, 20, 1), path)
    assert rows(manifests.read_version(spark, path, SCHEMA)) == rows(docs(spark, 0, 20, 1))
    folded = manifests.fold(spark, path, docs(spark, 0, 5, 2), merge, SCHEMA, through={"a": 4})
    assert folded.files_read == -1 and newest_version(spark, path).through == {"a": 4}
    want = rows(docs(spark, 0, 5, 2).unionByName(docs(spark, 5, 20, 1)))
    assert rows(folded.rows) == want

    def broken(stored, fresh):
        return fresh.withColumn("chunk_id", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        manifests.fold(spark, path, docs(spark, 0, 5, 3), broken, SCHEMA)
    assert rows(manifests.read_version(spark, path, SCHEMA)) == want
