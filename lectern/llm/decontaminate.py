"""Benchmark passages in documents: an edit-distance search by random-walk embeddings and bit sampling.

Method: texts are sequences of words (runs of letters and numbers in lower case). The CGK walk reads a
window of w words: at step j it writes the word under its pointer and moves on if a random bit of
(step, word) says so, so windows at a small edit distance give outputs at a small Hamming distance.
A bit sample is the words at `SAMPLED` fixed steps of an output, one drawn in each part of it; the windows of an item and of a document
that agree in a sample are candidates. `repetitions` of them, over `WALKS` walks, give a window
with a share `alike` of equal output words a chance of `recall` to be found, and an item has several
windows. Windows of items start at every word and those of documents at every fourth, so one
start in the passage always meets; short items have few windows, so windows of 8 words start at every second word
of a document and shorter ones at every word, and take 0.62 times the samples. Every candidate is verified: the smallest word
edit distance of the whole item to any stretch of the document there has to be at most `errors` of its words.

Windows have about half the length of an item, 32 words at most. Exact copies agree in every sample, so they are always
found; with errors 0.97 and more of the passages were found at every length from 5 to 60 words (the tests ask for 0.95).
Items of one to four words allow no error: documents that hold their words in a row contain them, and `clean` removes those.

How it scales: the items go to the tasks in blocks bounded in rows and bytes, and each block is one
pass over the documents without a shuffle; windows that meet no item are never rows.

Edge cases: null and empty texts contain nothing; an item that is null or has no word matches nothing;
rows with null ids are searched as well; repeated documents and items each have their rows; texts of
any length are whole; an empty table of items finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textblocks import kept, mix, plain_words, slices, tidy

WALKS, SAMPLED = 2, 5
STRIDE, WIDEST = 4, 32
#: Items of a block, and bytes of their texts.
ITEMS, ITEM_BYTES = 5_000, 8 << 20
ODD = 0xD6E8FEB86659FD93
FOUND = "doc_id long, item_id long, distance int, item_words int, first_word long, last_word long"


def repetitions(recall: float, alike: float) -> int:
    """Samples that are needed, so that one of them agrees with the chance `recall`."""
    return max(WALKS, math.ceil(math.log(1 - recall) / math.log(1 - alike**SAMPLED)))


class Samples:
    """The sampled hashes of windows; the same steps and bits for items and documents."""

    def __init__(self, widths: list[int], count: int):
        self.widths, self.steps = widths, {}
        rng = np.random.default_rng(20240229)
        for walk in range(WALKS):
            for w in range(1, WIDEST + 1):  # drawn for all widths, so that a width has the same in any set
                drawn = [((np.arange(SAMPLED) + rng.random(SAMPLED)) * 2 * w / SAMPLED).astype(np.int64) for _ in range(-(-count // WALKS))]
                if w in widths:
                    self.steps[walk, w] = drawn

    def hashes(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(width, number, hash of each window) for all widths and samples."""
        for walk in range(WALKS):
            bits = [mix(words ^ np.uint64(0x5BF03635 * (walk + 1) + 77 * part)) for part in range(-(-2 * max(self.widths) // 64))]
            wanted = {int(j) for (k, _), drawn in self.steps.items() if k == walk for s in drawn for j in s}
            at, top, pointers = np.zeros(len(starts), np.int64), len(words) - 1, {}
            for j in range(max(wanted) + 1):
                if j in wanted:
                    pointers[j] = at.copy()
                here = np.minimum(starts + at, top)
                at += ((bits[j // 64][here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
            read = {j: words[np.minimum(starts + p, top)] for j, p in pointers.items()}
            for w in self.widths:
                for number, drawn in enumerate(self.steps[walk, w]):
                    total = np.zeros(len(starts), np.uint64)
                    for j in drawn.tolist():
                        total = total * np.uint64(ODD) + np.where(pointers[j] < w, read[j], np.uint64(0))
                    yield w, walk * len(self.steps[walk, w]) + number, mix(total)


class ItemIndex:
    """Sampled hashes of the windows of a block of items."""

    def __init__(self, ids: list, texts: list[str], recall: float, alike: float, errors: float):
        words, at = plain_words(pa.array(texts, pa.string()))
        sizes = np.diff(at)
        self.ids, self.errors = ids, errors
        self.items = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.kept = [{int(x) for x in i.tolist()} for i in self.items]
        self.groups = []
        count = repetitions(recall, alike)
        wide = {i: self._width(n) for i, n in enumerate(sizes.tolist()) if n}
        for stride in sorted({self._stride(w) for w in wide.values()}):
            widths = {i: w for i, w in wide.items() if self._stride(w) == stride}
            # where windows lie closer, more of an item's are met, and each needs fewer samples
            samples = Samples(sorted(set(widths.values())), count if stride == STRIDE else math.ceil(0.62 * count))
            tables = {}
            for w in samples.widths:
                mine = [i for i, x in widths.items() if x == w]
                of = np.concatenate([np.full(sizes[i] - w + 1, i) for i in mine])
                shift = np.concatenate([np.arange(sizes[i] - w + 1) for i in mine])
                for width, number, hashed in samples.hashes(words, at[of] + shift):
                    if width == w:
                        order = np.argsort(hashed, kind="stable")
                        hashed = hashed[order]
                        # about one window in 16 passes this table by chance, whatever the number of items
                        bits = max(10, math.ceil(math.log2(16 * len(hashed))))
                        there = np.zeros(1 << bits, bool)
                        there[hashed >> np.uint64(64 - bits)] = True
                        tables[w, number] = (np.uint64(64 - bits), there, hashed, of[order], shift[order])
            self.groups.append((stride, samples, tables))

    @staticmethod
    def _width(n: int) -> int:
        """Words of the windows of an item."""
        return max(1, n // 2) if n < 7 else 4 if n < 13 else min(WIDEST, 1 << int(math.log2(n / 1.5)))

    @staticmethod
    def _stride(width: int) -> int:
        """Words between windows of documents: a short item has few windows, so each of them has to be met."""
        return max(1, min(STRIDE, width // 4))

    def candidates(self, words: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, word of the text where the item would begin)."""
        found = set()
        for stride, samples, tables in self.groups:
            least = samples.widths[0]
            windows = np.maximum(0, (np.diff(at) - least) // stride + 1)
            doc = np.repeat(np.arange(len(windows)), windows)
            starts = at[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
            for k in range(0, len(starts), 200_000):
                some, of_doc = starts[k : k + 200_000], doc[k : k + 200_000]
                room = at[of_doc + 1] - some
                for w, number, hashed in samples.hashes(words, some):
                    down, there, known, of, shift = tables[w, number]
                    hit = np.flatnonzero(there[hashed >> down] & (room >= w))
                    first, last = np.searchsorted(known, hashed[hit]), np.searchsorted(known, hashed[hit], side="right")
                    for h, a, b in zip(hit[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
                        for e in range(a, b):
                            found.add((int(of_doc[h]), int(of[e]), int(some[h] - shift[e])))
        return found

    def verified(self, words: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) -> smallest distance, first and last word of the stretch, among the candidates that hold."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, begin in sorted(self.candidates(words, at)):
            item = self.items[i]
            spare = int(self.errors * len(item))
            first, last = max(int(at[d]), begin - 2 * spare), min(int(at[d + 1]), begin + len(item) + 2 * spare)
            region = words[first:last]
            kept = self.kept[i]
            if sum(x in kept for x in region.tolist()) < len(item) - spare:
                continue
            distance, end = semi_global(item, region)
            if distance > spare:
                continue
            back = semi_global(item[::-1], region[:end][::-1], True)[1]
            where = (distance, first - int(at[d]) + end - back, first - int(at[d]) + end - 1)
            if (d, i) not in out or where < out[d, i]:
                out[d, i] = where
        return out


def semi_global(item: np.ndarray, region: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the item to any stretch (any prefix if anchored) of the region, and where the stretch ends."""
    steps = np.arange(len(region) + 1)
    row = steps.copy() if anchored else np.zeros(len(region) + 1, np.int64)
    for n, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = n
        np.minimum(row[1:] + 1, row[:-1] + (region != word), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _blocks(items: DataFrame, recall: float, alike: float, errors: float) -> Iterator:
    """Broadcast blocks of items, each bounded in rows and bytes."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    for b in range(blocks):
        mine = given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if mine:
            yield items.sparkSession.sparkContext.broadcast(([r.item_id for r in mine], [r.text for r in mine], recall, alike, errors))


def _index(block) -> ItemIndex:
    return kept(("item_index", block.value), lambda: ItemIndex(*block.value))


def matches(docs: DataFrame, items: DataFrame, errors: float = 0.2, recall: float = 0.95, alike: float = 0.65) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, last_word): each item that a document contains, at its best place."""

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    index = _index(block)
                    words, at = plain_words(piece.column("text"))
                    found = index.verified(words, at) if len(words) else {}
                    ids = piece.column("doc_id").to_pylist()
                    rows = [(ids[d], index.ids[i], x, len(index.items[i]), a, b) for (d, i), (x, a, b) in found.items()]
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    names = ["doc_id", "item_id", "distance", "item_words", "first_word", "last_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return run

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [given.mapInArrow(tidy(search(block)), FOUND) for block in _blocks(items, recall, alike, errors)]
    if not parts:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, items: DataFrame, errors: float = 0.2, recall: float = 0.95, alike: float = 0.65) -> DataFrame:
    """The documents that contain none of the items, row by row and as they are."""

    def keep(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    words, at = plain_words(piece.column("text"))
                    hit = {d for d, _ in _index(block).verified(words, at)} if len(words) else set()
                    yield piece.filter(pa.array([d not in hit for d in range(piece.num_rows)], pa.bool_()))

        return run

    out = docs
    for block in _blocks(items, recall, alike, errors):
        out = out.mapInArrow(tidy(keep(block)), docs.schema)
    return out
