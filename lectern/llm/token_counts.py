"""Token counts of the sections of a text, from one encoding of the whole text.

Method: the whole document is encoded once by a byte-level vocabulary, so that every token is a span of
its bytes and the spans tile the text. Sections tile it too. Tokens and sections are joined as
intervals by their sorted bounds; a token that crosses a bound is allocated by a rule: `most` gives it
to the section with most of its bytes (the earlier one of equals), `first` and `last` to the
section with its first and last byte. Counting sections one by one would encode other tokens at the
bounds; here the counts of a document add up to its length in tokens.

Sections are the lines of a text, each with its line break, or the given text columns of a
row in their order (`fields`), encoded as one text with a line break after each.

Edge cases: null and empty texts have one empty section without tokens; a section in which no token
is allocated has a count of 0; rows with a null id are counted; repeated rows each have their rows;
texts of any length are whole; further columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textblocks import kept, slices, text_bytes

RULES = ("most", "first", "last")
COUNTS = "doc_id long, section int, n_tokens long, n_crossing long, n_chars long"


class ByteVocabulary:
    """Encoder and token lengths from the text of a rank file."""

    def __init__(self, ranks: bytes):
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.sizes = np.zeros(max(known.values()) + 1, np.int64)
        for token, rank in known.items():
            self.sizes[rank] = len(token)


def _vocabulary(sent) -> ByteVocabulary:
    return kept(("byte_vocabulary", hash(sent.value)), lambda: ByteVocabulary(sent.value))


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each span and whether it crosses a bound; section i is [bounds[i], bounds[i + 1])."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for t in np.flatnonzero(crossing).tolist():
        a, b = int(first[t]), int(last[t])
        edges = np.clip(bounds[a : b + 2], starts[t], ends[t])
        out[t] = a + int(np.diff(edges).argmax())
    return out, crossing


def count_sections(texts: pa.Array, inner: list[np.ndarray] | None, vocab: ByteVocabulary, rule: str) -> tuple[np.ndarray, ...]:
    """(text, section, tokens, crossing tokens, characters) of all sections; `inner` has the bounds of sections, or lines are cut."""
    data, offsets = text_bytes(texts)
    ids = [vocab.encoder.encode_ordinary(t) if t else [] for t in texts.to_pylist()]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    sizes = vocab.sizes[np.concatenate([np.array(i, np.int64) for i in ids])] if n.sum() else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    # a section begins with each text, and after each line break that is not the last byte of its text
    if inner is None:
        after = np.flatnonzero(data == 10) + 1
        cuts = np.setdiff1d(after, offsets)
    else:
        cuts = np.concatenate([offsets[d] + x for d, x in enumerate(inner)]) if len(inner) else np.zeros(0, np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0) if inner is None else np.arange(len(ids))
    begin = np.sort(np.concatenate((offsets[:-1][full], cuts)), kind="stable") if inner is None else None
    if inner is None:
        of = np.searchsorted(offsets, begin, side="right") - 1
    else:
        begin = np.concatenate([np.concatenate(([offsets[d]], offsets[d] + x)) for d, x in enumerate(inner)]) if len(inner) else cuts
        of = np.repeat(np.arange(len(inner)), [len(x) + 1 for x in inner])
    bounds = np.append(begin, len(data))
    section, crossing = allocate(ends - sizes, ends, bounds, rule)
    tokens = np.bincount(section, minlength=len(begin))
    crossed = np.bincount(section[crossing], minlength=len(begin))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    number = np.arange(len(of)) - np.searchsorted(of, of)
    out = [of, number, tokens, crossed, np.diff(chars[bounds])]
    if inner is None:  # empty texts: one empty section each
        empty = np.flatnonzero(np.diff(offsets) == 0)
        out = [np.concatenate((x, y)) for x, y in zip(out, [empty, *[np.zeros(len(empty), np.int64)] * 4], strict=True)]
    return tuple(out)


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _rows(ids: pa.Array, counted: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    of, number, *rest = counted
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for k in range(0, len(of), 50_000):
        some = slice(k, k + 50_000)
        columns = [ids.take(pa.array(of[some])), *(pa.array(x[some], t) for x, t in zip((number, *rest), kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "n_tokens", "n_crossing", "n_chars"])


def line_tokens(docs: DataFrame, path: str, rule: str = "most") -> DataFrame:
    """(doc_id, section, n_tokens, n_crossing, n_chars) of each line of each text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = _ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield from _rows(piece.column("doc_id"), count_sections(piece.column("text"), None, _vocabulary(ranks), rule))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)


def field_tokens(docs: DataFrame, path: str, fields: list[str], rule: str = "most") -> DataFrame:
    """The same for columns: section i is the i-th of `fields` with the line break that follows it; null is empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = _ranks(docs, path)
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n")) for f in fields]
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*[F.octet_length(p) for p in parts]).alias("sizes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                inner = [np.cumsum(x)[:-1] for x in piece.column("sizes").to_pylist()]
                yield from _rows(piece.column("doc_id"), count_sections(piece.column("text"), inner, _vocabulary(ranks), rule))

    return given.mapInArrow(run, COUNTS)
