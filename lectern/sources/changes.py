"""What has changed in a landing folder, by the content of its files.

A manifest holds the path, length, time and content hash of every file that was taken in. A scan lists the files and reads the
content only of those whose path, length or time the manifest does not have. From the hashes it tells files apart that are
new, that are the same under another name, that have other content under the same name, and that are gone. Text is extracted once
for each content, whatever the names it comes under.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "path string, length long, modified timestamp, sha256 string"
#: Kinds of changes. An unchanged file is not listed.
ADDED, CHANGED, RENAMED, VANISHED = "added", "changed", "renamed", "vanished"


def current_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, length, modified, sha256) of the files that are there; hashes of files that look untouched are taken over.

    `files` has path, modificationTime, length and content, as Spark reads binary files. Content is read for the other files alone:
    the listing is joined without it first.
    """
    listed = files.select("path", "length", F.col("modificationTime").alias("modified"))
    known = listed.join(manifest, ["path", "length", "modified"])
    fresh = listed.join(manifest, ["path", "length", "modified"], "left_anti").select("path")
    read = files.join(fresh, "path", "left_semi").select(
        "path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")
    )
    return known.select("path", "length", "modified", "sha256").unionByName(read)


def scan_changes(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, kind, sha256, was) of what differs between `now` (`current_files`) and the manifest.

    A path that is new is `renamed` from a vanished path with the same content (`was`), each of which stands for one name,
    in the order of paths; it is `added` otherwise. `changed` is other content under a known path; `vanished` a path that is
    gone and was not renamed. The same content under two names that are both there is one `added` file.
    """
    old = manifest.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256"))
    both = now.select("path", "sha256").join(old, F.col("path") == F.col("_path"), "full")
    changed = both.filter("path is not null and _path is not null and sha256 != _sha256").select(
        "path", F.lit(CHANGED).alias("kind"), "sha256", F.lit(None).cast("string").alias("was")
    )

    def numbered(rows: DataFrame, path: str, sha: str) -> DataFrame:
        return rows.select(F.col(path).alias("path"), F.col(sha).alias("sha256")).withColumn(
            "no", F.row_number().over(W.partitionBy("sha256").orderBy("path"))
        )

    come = numbered(both.filter("_path is null"), "path", "sha256")
    gone = numbered(both.filter("path is null"), "_path", "_sha256").withColumnRenamed("path", "was")
    moved = come.join(gone, ["sha256", "no"], "full")
    return changed.unionByName(
        moved.select(
            F.coalesce("path", "was").alias("path"),
            F.when(F.col("path").isNull(), VANISHED).when(F.col("was").isNull(), ADDED).otherwise(RENAMED).alias("kind"),
            "sha256",
            F.when(F.col("path").isNotNull(), F.col("was")).alias("was"),
        )
    )


def contents_to_extract(changes: DataFrame, extracted: DataFrame) -> DataFrame:
    """(sha256, path): each content that is new, under the first of its names; `extracted` lists the hashes that are done."""
    wanted = changes.filter(F.col("kind").isin(ADDED, CHANGED)).groupBy("sha256").agg(F.min("path").alias("path"))
    return wanted.join(extracted.select("sha256").distinct(), "sha256", "left_anti")
