"""Documents to chunks: cut, overlap, filter, number, identify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.functions.text import add_overlap, drop_short, recursive_chunk
from lectern.functions.vectors import Embedder, embed, has_length


def explode_chunks(
    documents: DataFrame,
    text: str = "raw_text",
    settings: Settings = DEFAULTS,
    keep_text: bool = False,
) -> DataFrame:
    """One row per chunk with its place `chunk_pos`; a document without chunks has no row.

    The other columns are repeated; the whole text only with `keep_text`.
    """
    repeated = [c for c in documents.columns if keep_text or c != text]
    cut = add_overlap(recursive_chunk(F.col(text), settings.chunk_size), settings.chunk_overlap)
    chunks = drop_short(cut, settings.min_chunk_chars)
    return documents.select(
        *repeated, F.posexplode(chunks).alias("chunk_pos", "chunk_text")
    ).filter(F.length(F.trim("chunk_text")) > settings.min_chunk_chars)


def with_chunk_id(chunks: DataFrame, document: str = "path") -> DataFrame:
    """An id made of the document and the place in it, so a re-run gives the same ids."""
    return chunks.withColumn("chunk_id", F.xxhash64(document, "chunk_pos"))


def with_embedding(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """`embedding`, and `embed_ok` = false where the model gave nothing."""
    return chunks.withColumn("embedding", embed(F.col("chunk_text"), embedder)).withColumn(
        "embed_ok", has_length(F.col("embedding"))
    )
