"""Token ids as binary shards with Elias-Fano document boundaries, written in document order and read back.

A shard is one file body: a header of eight 64-bit numbers (magic, documents, ids, bytes of an id,
low bits, bytes of the low part, bytes of the high part, bytes of the samples), the document ids as
differences, the boundaries and the ids one after the other. The boundary after each document is an
Elias-Fano sequence: its low bits packed side by side, its high bits as a unary bit string, where
`select` finds the i-th boundary from a sample of every 64th position. That is about
2 + log2(ids / documents) bits a document, and no table of 64-bit offsets.

Executors share no file system but the one that Spark writes to, so shard bodies are the rows of a
Parquet folder (part, before, n_docs, n_ids, body). A shard is closed at about `shard_ids` ids,
so a task holds one shard; a single longer document is a shard of its own. A shard knows the ids
`before` it in its part; the parts, as many as shuffle partitions are set, are summed up on reading.

Edge cases: null and empty texts have only the end id; rows with a null id are left out; rows that
repeat an id follow each other, ordered by text; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.bpe import vocabulary_file
from lectern.llm.pieces import word_cache
from lectern.llm.textblocks import slices

MAGIC = 0x314E4B4F544C
SAMPLE = 64
SHARD = "part int, before long, n_docs long, n_ids long, body binary"


class EliasFano:
    """An ascending sequence of whole numbers up to `top` in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample on, bytes are counted until the one that holds the bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")[at % 8 :]
        found = np.flatnonzero(window)
        step = 64
        while len(found) <= need:
            step *= 4
            window = np.unpackbits(self.high[byte : byte + step], bitorder="little")[at % 8 :]
            found = np.flatnonzero(window)
        high = at + int(found[need]) - i
        low = 0
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            low |= ((int(self.low[k // 8]) >> (k % 8)) & 1) << b
        return (high << self.low_bits) | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def shard_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of documents; `ends` has the number of ids up to the end of each."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ef = EliasFano.build(ends)
    head = np.array(
        [MAGIC, len(doc_ids), len(ids), width, ef.low_bits, ef.low.nbytes, ef.high.nbytes, ef.samples.nbytes], np.int64
    )
    steps = np.diff(doc_ids.astype(np.int64), prepend=np.int64(0))
    parts = [head, steps, ef.low, ef.high, ef.samples, ids.astype(np.uint16 if width == 2 else np.uint32)]
    return b"".join(p.tobytes() for p in parts)


def open_shard(body: bytes) -> tuple[np.ndarray, EliasFano, np.ndarray]:
    """Document ids, boundaries and ids of a shard; the ids are not copied."""
    magic, n, ids, width, low_bits, low, high, samples = (int(x) for x in np.frombuffer(body, np.int64, 8))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = 64
    out = []
    for kind, count in ((np.int64, n), (np.uint8, low), (np.uint8, high), (np.uint32, samples // 4), (np.uint16 if width == 2 else np.uint32, ids)):
        out.append(np.frombuffer(body, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return np.cumsum(out[0]), EliasFano(n, low_bits, *out[1:4]), out[4]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, shard_ids: int = 1 << 20) -> None:
    """Encodes every whole text in ascending doc_id order and writes the shards below `path`."""
    spark = docs.sparkSession
    vocab = vocabulary_file(docs, tokenizer)
    extra = 0 if end_id is None else 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, before = word_cache(vocab.value), TaskContext.get().partitionId(), 0
        docs_, sizes, ids, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes))
            body = shard_bytes(np.concatenate(docs_), ends, np.concatenate(ids))
            row = ([part], [before], [len(ends)], [int(ends[-1])], [body])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["part", "before", "n_docs", "n_ids", "body"])

        for batch in batches:
            for piece in slices(batch, limit=min(shard_ids, 1 << 20)):
                got, at = cache.encode(piece.column("text").to_pylist())
                n = np.diff(at)
                if extra:
                    got = np.insert(got, at[1:], end_id)
                docs_.append(piece.column("doc_id").to_numpy(zero_copy_only=False))
                sizes.append(n + extra)
                ids.append(got)
                held += len(got)
                if held >= shard_ids:
                    yield shard()
                    before += held
                    docs_, sizes, ids, held = [], [], [], 0
        if docs_:
            yield shard()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = given.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(write, SHARD).write.option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards below `path` with `base`, the number of ids in all shards before."""
    stored = spark.read.schema(T.StructType.fromDDL(SHARD)).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    # one row for each part, no more than the shuffle partitions of the writer
    return stored.join(F.broadcast(offset), "part").withColumn("base", F.col("offset") + F.col("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ids as little-endian unsigned 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, body in zip(batch.column("base").to_pylist(), batch.column("body"), strict=True):
                doc_ids, boundaries, ids = open_shard(body.as_buffer())
                ends = boundaries.all()
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))[: len(ends)]
                for k in range(0, len(ends), 1000):
                    some = slice(k, k + 1000)
                    first, last = int(starts[k]), int(ends[some][-1])
                    at = np.append(starts[some] - first, last - first) * 4
                    raw = pa.py_buffer(ids[first:last].astype("<u4").tobytes())
                    held = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), raw])
                    columns = [doc_ids[some], starts[some] + base, (ends - starts)[some]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), held.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return shards(spark, path).select("base", "body").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
