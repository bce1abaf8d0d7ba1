"""New files to the layers and the index, as they land."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.config import DEFAULTS, Settings
from lectern.functions.language import keyword_subject
from lectern.functions.vectors import Embedder
from lectern.plans.lake import build_bronze, build_gold, build_silver, index_rows
from lectern.schemas import BRONZE, GOLD, SILVER, conform
from lectern.sources.landing import EXTRACTORS, Extractor, landing_reader
from lectern.sources.layers import increment_path, read_layer, write_increment

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch_landing(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    every: str | None = None,
    extractors: Mapping[str, Extractor] = EXTRACTORS,
    classifier=keyword_subject,
    embedder: Embedder | None = None,
    settings: Settings = DEFAULTS,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Ingest every file once. `every` ("5 minutes") keeps polling; without it, what is there
    is ingested and the query ends.

    The checkpoint belongs to `root`: it remembers the files and numbers the batches, so nothing
    new is no work. Each micro-batch is stored under its number in every layer and in the index,
    read back from there for the next step, and replaced when the batch has to run again.
    """

    def store(rows: DataFrame, layer: str, schema, batch: int) -> DataFrame:
        path = f"{root}/live/{layer}"  # beside the layers that whole runs overwrite
        write_increment(conform(rows, schema), path, batch)
        return read_layer(rows.sparkSession, increment_path(path, batch), schema)

    def ingest(files: DataFrame, batch: int) -> None:
        bronze = store(build_bronze(files.select("path", "content"), extractors), "bronze", BRONZE, batch)
        silver = store(build_silver(bronze, classifier), "silver", SILVER, batch)
        gold = store(build_gold(silver, embedder, settings), "gold", GOLD, batch)
        write_increment(index_rows(gold), f"{root}/index", batch)

    reader = spark.readStream.schema(_FILE).option("maxFilesPerTrigger", files_per_batch)
    writer = (
        landing_reader(reader, landing)
        .writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
