"""BPE encoding of whole texts through a table of distinct words, and decoding through an id-to-piece table.

Method: words are cut in the scan; each block of documents sends its distinct words once to the
bucket of the word, where every distinct word of the corpus is encoded once; the ids come back to
the block and are put in place by position. Decoding looks up the piece of each id in the
vocabulary, whose size is fixed, and joins the pieces as the tokenizer's own `decode` does.

How it scales: per block one entry for each distinct word, so a word in all documents is one entry
for each block; positions are local numbers, the most frequent word first, and compress well.

Edge cases: null and empty texts have no ids and decode to the empty text; a text without words as
well; special tokens in a text become their ids, as in the library; texts of any length are whole;
rows with a null id are left out; rows that repeat an id are encoded each on its own; further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.exchange import ASKED, OWN, buckets, exchange, messages
from lectern.llm.pieces import gather, vocabulary
from lectern.llm.textblocks import pack, slices, unpack

#: A block holds about so many words.
BLOCK = 2_000_000
IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class _Block:
    def __init__(self):
        self.ids, self.sizes, self.words, self.place, self.positions, self.size = [], [], [], {}, [], 0

    def add(self, ids: list[int], split: tuple) -> None:
        whole, starts, ends, hashed, at = split
        distinct, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        keys, known = distinct.tolist(), self.place
        local = np.empty(len(keys), np.uint32)
        for i, (key, a, b) in enumerate(zip(keys, starts[first].tolist(), ends[first].tolist(), strict=True)):
            number = known.get(key)
            if number is None:
                number = known[key] = len(self.words)
                self.words.append(whole[a:b])
            local[i] = number
        self.positions.append(local[inverse])
        self.ids += ids
        self.sizes += np.diff(at).tolist()
        self.size += len(hashed)

    def rows(self, block: int, parts: int) -> list[tuple]:
        positions = np.concatenate(self.positions) if self.positions else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(positions, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        own = pack(np.array(self.ids, np.int64), np.array(self.sizes, np.uint32), rank[positions])
        keys = np.fromiter(self.place.keys(), np.uint64, len(self.place))
        bucket = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        grouped = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[grouped], np.arange(parts + 1))
        rows = [(block % parts, block, OWN, own)]
        for p in range(parts):
            mine = grouped[cuts[p] : cuts[p + 1]]
            if len(mine):
                mine = mine[np.argsort(rank[mine], kind="stable")]
                text = pa.compress("\n".join([self.words[i] for i in mine.tolist()]).encode(), codec="zstd", asbytes=True)
                size = sum(len(self.words[i].encode()) for i in mine.tolist()) + len(mine) - 1
                rows.append((p, block, ASKED, pack(np.array([size], np.int64), rank[mine], np.frombuffer(text, np.uint8))))
        return rows


def _split(vocab_text, parts: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_text.value)
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for piece in slices(batch, limit=1 << 19):
                block.add(piece.column("doc_id").to_pylist(), vocab.split(piece.column("text").to_pylist()))
                if block.size >= BLOCK or len(block.ids) >= BLOCK // 10:
                    yield messages(block.rows(number, parts))
                    number, block = number + 1, _Block()
        if block.ids:
            yield messages(block.rows(number, parts))

    return split


def _merge(vocab_text):
    """Encodes each distinct word of a bucket once and answers each block."""

    def merge(rows: list[tuple]) -> list[tuple]:
        place: dict[str, int] = {}
        asked = []
        for block, body in rows:
            size, ranks, text = unpack(body)
            words = pa.decompress(text.tobytes(), decompressed_size=int(size[0]), codec="zstd", asbytes=True).decode().split("\n")
            asked.append((block, ranks, np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))))
        ids, counts = vocabulary(vocab_text.value).encode_words(list(place))
        starts = np.cumsum(counts) - counts
        return [
            (block, pack(ranks, counts[of].astype(np.uint32), gather(ids, starts[of], counts[of]).astype(np.uint32)))
            for block, ranks, of in asked
        ]

    return merge


def _finish(rows: list[tuple]) -> pa.Table:
    """Puts the ids of the words in place; a block at a time, its documents in pieces."""
    ids, sizes, positions = unpack(next(body for kind, _, body in rows if kind == OWN))
    answers = [unpack(body) for kind, _, body in rows if kind == ASKED]
    total = sum(len(a[0]) for a in answers)
    counts = np.zeros(total, np.int64)
    starts = np.zeros(total, np.int64)
    flat, used = [], 0
    for ranks, n, got in answers:
        n = n.astype(np.int64)
        counts[ranks] = n
        starts[ranks] = used + np.cumsum(n) - n
        flat.append(got.astype(np.int32))
        used += len(got)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    at = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    parts, first = [], 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(at, at[first] + 500_000, side="right")) - 1)
        here = positions[at[first] : at[last]]
        n = counts[here]
        before = np.concatenate(([0], np.cumsum(n)))[at[first : last + 1] - at[first]]
        values = pa.array(gather(flat, starts[here], n))
        parts.append(
            pa.Table.from_arrays(
                [pa.array(ids[first:last]), pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), values)], schema=IDS_ARROW
            )
        )
        first = last
    return pa.concat_tables(parts) if parts else IDS_ARROW.empty_table()


def vocabulary_file(df: DataFrame, path: str):
    """The text of a tokenizer file, read by the driver and sent to the executors (a vocabulary's size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every whole text, as the tokenizer of `path` encodes it without special tokens added."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocab = vocabulary_file(docs, path)
    return exchange(
        given.filter("doc_id is not null"), _split(vocab, buckets(docs)), _merge(vocab), _finish, "doc_id long, ids array<int>"
    )


def _piece_table(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(vocabulary(f.read()).pieces.tolist())


def _joined(lists: pa.Array, pieces: np.ndarray) -> list[str]:
    """The pieces of each list of ids, joined by spaces; an id that the vocabulary lacks is left out."""
    at = lists.offsets.to_numpy()
    ids = lists.values.to_numpy(zero_copy_only=False)
    texts = []
    for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), lists.is_valid().to_pylist(), strict=True):
        some = ids[a:b] if ok else ids[:0]
        some = some[(some >= 0) & (some < len(pieces))].astype(np.int64)
        texts.append(" ".join(pieces[some].tolist()))
    return texts


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the pieces of the ids joined by spaces; null and empty lists give the empty text.

    An id that the vocabulary lacks is left out, as the library does.
    """
    table = _piece_table(encoded, path)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array(table.value, dtype=object)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column("ids")
                texts = pa.array(_joined(lists, pieces), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """`decode(encode(docs))` in one pass: the worker that puts the ids in place looks their pieces up as well."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocab, table = vocabulary_file(docs, path), _piece_table(docs, path)

    def finish(rows: list[tuple]) -> pa.Table:
        encoded, pieces = _finish(rows), np.array(table.value, dtype=object)
        texts = [pa.array(_joined(chunk, pieces), pa.string()) for chunk in encoded.column("ids").chunks]
        return encoded.append_column("text", pa.chunked_array(texts, pa.string()))

    schema = "doc_id long, ids array<int>, text string"
    return exchange(given.filter("doc_id is not null"), _split(vocab, buckets(docs)), _merge(vocab), finish, schema)
