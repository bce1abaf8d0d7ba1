"""Files to bronze, silver, gold and the searchable index."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.functions.language import detect_language, keyword_subject, subject_fallback
from lectern.functions.text import doc_type, parse_filename, word_count
from lectern.functions.vectors import Embedder
from lectern.operators.chunks import explode_chunks, with_chunk_id, with_embedding
from lectern.schemas import (
    BRONZE,
    CHUNK_INDEX,
    GOLD,
    GOLD_WITH_TEXT,
    METADATA,
    SILVER,
    conform,
)
from lectern.session import stored_table
from lectern.sources.landing import EXTRACTORS, Extractor, extract_documents, file_name, read_landing
from lectern.sources.layers import (
    current,
    if_present,
    newest_version,
    publish,
    read_increments,
    read_layer,
    write_increment,
    write_layer,
)
from lectern.sources.changes import ADDED, CHANGED, MANIFEST, RENAMED, contents_to_extract, current_files, scan_changes
from lectern.sources.manifests import Fold, fold, read_version
from lectern.sources.upsert import replace_documents, upsert


def build_bronze(files: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS) -> DataFrame:
    """`path, content` to one text row per file."""
    return extract_documents(files, extractors)


def build_silver(bronze: DataFrame, classifier=keyword_subject) -> DataFrame:
    """Add metadata from the name and the text, in one pass without a shuffle."""
    name, text = F.col("filename"), F.col("raw_text")
    meta = bronze.withColumn("_meta", parse_filename(name))
    return meta.select(
        *bronze.columns,
        F.col("_meta.professor"),
        subject_fallback(F.col("_meta.subject"), text, classifier).alias("subject"),
        F.col("_meta.chapter"),
        detect_language(text).alias("language"),
        word_count(text).alias("word_count"),
        doc_type(name).alias("doc_type"),
    )


def build_gold(
    silver: DataFrame,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
    keep_text: bool = False,
) -> DataFrame:
    """One row per chunk with id and vector. Files that could not be read are left out."""
    readable = silver.filter(F.col("error").isNull()) if "error" in silver.columns else silver
    chunks = with_chunk_id(explode_chunks(readable, "raw_text", settings, keep_text))
    return with_embedding(chunks, embedder)


@dataclass(frozen=True)
class LakePaths:
    bronze: str
    silver: str
    gold: str

    @classmethod
    def under(cls, root: str) -> LakePaths:
        return cls(f"{root}/bronze", f"{root}/silver", f"{root}/gold")


def run_layers(
    files: DataFrame,
    paths: LakePaths,
    extractors: Mapping[str, Extractor] = EXTRACTORS,
    classifier=keyword_subject,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
    keep_text: bool = False,
) -> dict[str, int]:
    """Write the three layers, each from the stored one before it, and return the counts.

    The counts are observed while the layers are written, so they cost no extra pass.
    """
    seen = {name: Observation(name) for name in ("bronze", "silver", "gold")}
    rows = F.count(F.lit(1)).alias("rows")
    bronze = write_layer(
        build_bronze(files, extractors).observe(
            seen["bronze"], rows, F.count("error").alias("failed")
        ),
        paths.bronze, BRONZE,
    )
    silver = write_layer(
        build_silver(bronze, classifier).observe(seen["silver"], rows), paths.silver, SILVER
    )
    write_layer(
        build_gold(silver, embedder, settings, keep_text).observe(
            seen["gold"], rows, F.count_if("embed_ok").alias("embedded")
        ),
        paths.gold, GOLD_WITH_TEXT if keep_text else GOLD,
    )
    return {
        "documents": seen["bronze"].get["rows"],
        "failed_documents": seen["bronze"].get["failed"],
        "silver_documents": seen["silver"].get["rows"],
        "chunks": seen["gold"].get["rows"],
        "embedded_chunks": seen["gold"].get["embedded"],
    }


def run_pipeline(spark: SparkSession, landing: str, root: str, **options) -> dict[str, int]:
    """All accepted files below `landing` to the layers under `root`.

    An empty landing directory leaves the layers as they are.
    """
    files = read_landing(spark, landing)
    if files.select("path").isEmpty():
        return {"documents": 0, "failed_documents": 0, "silver_documents": 0, "chunks": 0,
                "embedded_chunks": 0}
    return run_layers(files, LakePaths.under(root), **options)


def index_rows(gold: DataFrame, load_ts=None) -> DataFrame:
    """Gold rows in the shape of the index; missing metadata is ''."""
    stamp = F.current_timestamp() if load_ts is None else load_ts
    metadata = F.struct(
        *[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in METADATA.fields]
    )
    shaped = gold.select(
        "chunk_id", "path", F.col("chunk_text").alias("document"), "embedding", "embed_ok",
        metadata.alias("metadata"), stamp.alias("load_ts"),
    )
    return conform(shaped, CHUNK_INDEX)


def index_load(
    spark: SparkSession, gold: DataFrame | str, index_path: str, whole_documents: bool = True
) -> DataFrame:
    """Add a load of gold rows to the index and return the index as of now.

    The load is stored as an increment beside those of the stream, so it costs as much as its own
    rows; `compact_index` folds increments into a version. Of each document the newest load counts.
    `whole_documents=False` merges by chunk instead, which has to write a new version at once.
    """
    rows = index_rows(read_layer(spark, gold, GOLD) if isinstance(gold, str) else gold)
    if whole_documents:
        write_increment(rows, index_path, 0, source=f"load-{uuid.uuid4().hex}")
        return read_index(spark, index_path)
    through = _through(spark, index_path)
    return publish(upsert(read_index(spark, index_path), rows, ["chunk_id"]), index_path, through)


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The index as of now: its newest version with the increments stored since.

    Of a document only the newest load counts, wherever it is stored.
    """
    base = read_version(spark, index_path, CHUNK_INDEX)
    fresh = read_increments(spark, index_path, CHUNK_INDEX)
    return base if fresh is None else _with_loads(base, fresh)


def _with_loads(base: DataFrame, fresh: DataFrame) -> DataFrame:
    # loads of one time are told apart by their number; what a version holds comes before them
    folded = base.withColumns({"source": F.lit(""), "batch": F.lit(-1).cast("bigint")})
    newest = replace_documents(folded, fresh, order=("load_ts", "batch", "source"))
    return newest.drop("source", "batch")


def _loads(spark: SparkSession, index_path: str) -> list[tuple[str, int]]:
    """Increments that no version contains yet: one row for each, not for each chunk."""
    fresh = read_increments(spark, index_path, CHUNK_INDEX)
    if fresh is None:
        return []
    return sorted((r["source"], r["batch"]) for r in fresh.groupBy("source").agg(F.max("batch").alias("batch")).collect())


def _through(spark: SparkSession, index_path: str) -> dict[str, int]:
    last = newest_version(spark, index_path)
    return (last.through if last else {}) | dict(_loads(spark, index_path))


def index_mark(spark: SparkSession, index_path: str) -> str:
    """A name for what `read_index` returns, which changes with every load."""
    last = newest_version(spark, index_path)
    digest = hashlib.sha256(repr(_loads(spark, index_path)).encode()).hexdigest()
    return f"{last.name if last else None}:{digest}"


def compact_index(spark: SparkSession, index_path: str) -> DataFrame:
    """Publish what `read_index` returns, so the increments need not be merged again."""
    if not _loads(spark, index_path):
        return read_version(spark, index_path, CHUNK_INDEX)
    return fold_index(spark, index_path).rows


def fold_index(spark: SparkSession, index_path: str) -> Fold:
    """The same, with the number of stored files that were read: those that may hold a document of the increments."""
    through = _through(spark, index_path)
    fresh = read_increments(spark, index_path, CHUNK_INDEX)
    if fresh is None:
        fresh = spark.createDataFrame([], CHUNK_INDEX).withColumns({"source": F.lit(""), "batch": F.lit(0).cast("bigint")})
    return fold(spark, index_path, fresh, _with_loads, CHUNK_INDEX, "path", through)


_TEXTS = "sha256 string, raw_text string, error string"


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """Extracted text of each content; a load that ran twice may have stored one twice."""
    stored = if_present(lambda: spark.read.schema(_TEXTS).parquet(f"{root}/texts"))
    return (spark.createDataFrame([], _TEXTS) if stored is None else stored).dropDuplicates(["sha256"])


def ingest_changes(
    spark: SparkSession,
    files: DataFrame,
    root: str,
    extractors: Mapping[str, Extractor] = EXTRACTORS,
    classifier=keyword_subject,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
) -> dict[str, int]:
    """Bring the index under `root` in line with the files that are there; returns the number of changes of each kind.

    `files` has path, modificationTime, length and content of everything in the landing folder. A content that was extracted
    before is not extracted again, whatever its name; files that are gone leave the index. The manifest is published last, so a
    run that fails is done again, and a run without changes is no work.
    """
    manifest_path = f"{root}/manifest"
    manifest = current(spark, manifest_path, spark.createDataFrame([], MANIFEST).schema)
    now = stored_table(current_files(files, manifest))
    changes = stored_table(scan_changes(now, manifest))
    counts = {r["kind"]: r["count"] for r in changes.groupBy("kind").count().collect()}
    if not counts:
        return counts
    wanted = stored_table(contents_to_extract(changes, _texts(spark, root)))
    read = extract_documents(files.join(wanted.select("path"), "path", "left_semi").select("path", "content"), extractors)
    read.join(wanted, "path").select("sha256", "raw_text", "error").write.mode("append").parquet(f"{root}/texts")
    present = changes.filter(F.col("kind").isin(ADDED, CHANGED, RENAMED))
    bronze = present.join(_texts(spark, root), "sha256").select(file_name(F.col("path")).alias("filename"), "path", "raw_text", "error")
    gold = build_gold(build_silver(conform(bronze, BRONZE), classifier), embedder, settings)
    stamp = F.current_timestamp()
    # a row without text stands for a document of which nothing is left
    gone = changes.select(F.when(F.col("kind") == RENAMED, F.col("was")).otherwise(F.col("path")).alias("path")).distinct()
    chunks = stored_table(index_rows(gold, stamp))
    emptied = gone.join(chunks.select("path").distinct(), "path", "left_anti").select(
        F.xxhash64("path").alias("chunk_id"), "path", F.lit("").alias("document"), F.lit(False).alias("embed_ok"), stamp.alias("load_ts")
    )
    rows = chunks.unionByName(conform(emptied, CHUNK_INDEX))
    write_increment(rows, f"{root}/index", 0, source=f"changes-{uuid.uuid4().hex}")
    publish(now, manifest_path)
    return counts
