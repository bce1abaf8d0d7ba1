"""Text batches as flat byte arrays, so that words are cut and hashed by numpy, not one by one.

Everything here works on one Arrow batch inside a task. A word is a run of bytes other than
space and 0x09-0x0D; its hash is a polynomial over its bytes modulo 2**64, taken from running sums,
and mixed. Two words of a corpus share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
#: A slice of a batch that is worked on at once holds about so many bytes of text.
SLICE_BYTES = 1 << 20


def unused(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column is so named."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker; code that travels with a plan has no other."""
    name = "_lectern_llm_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def kept(key: tuple, make: Callable[[], object]):
    """What `make` returns, kept for the next task of this worker; another key takes its place.

    A worker serves all steps of a job one after the other, so it holds one model at a time.
    """
    cache = process_cache()
    if cache.get("kept_key") != key:
        cache["kept_key"] = cache["kept"] = None
        cache["kept"] = make()
        cache["kept_key"] = key
    return cache["kept"]


def give_back() -> None:
    """Hand memory that is free inside this worker to the system: workers outlive their tasks and share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    cache = process_cache()
    if "trim" not in cache:
        cache["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if cache["trim"] is not None:
        cache["trim"](0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for all batches of a task, after which its memory is given back."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit reaches all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> dict:
    cache = process_cache()
    if "byte_tables" not in cache:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        space = np.zeros(256, dtype=bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        cache["byte_tables"] = {"lower": lower, "space": space, "value": mix(np.arange(1, 257, dtype=np.uint64))}
    return cache["byte_tables"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = process_cache()
    if len(cache.get("powers", ((),))[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, pow(BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        powers = np.cumprod(up, out=up), np.cumprod(down, out=down)
        if size > 4 * SLICE_BYTES:  # for one very long text only
            return powers
        cache["powers"] = powers
    return cache["powers"]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows, each of about `limit` bytes of text or of one long text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offsets of the texts in it; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[first:last] if raw is not None else np.zeros(0, np.uint8)
    return (_tables()["lower"][data] if lower else data), offsets - first


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true elements; no run goes beyond the end of a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of the texts in that list."""
    starts, ends = runs(~_tables()["space"][data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span; `values` are the numbers of the elements where they are not bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_tables()["value"][data] if values is None else values) * up[: len(data)], out=sums[1:])
    spans = (sums[ends] - sums[starts]) * down[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and numbers, ASCII in lower case, and the offsets of the texts in that list."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    data, offsets = text_bytes(texts, lower=True)
    starts, ends = runs(inside[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as compressed bytes; ascending ones are stored as differences."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        rising = len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        kept = np.diff(a, prepend=a[:1] * 0) if rising else a
        width = kept.dtype.itemsize
        planes = np.ascontiguousarray(kept).view(np.uint8).reshape(-1, width).T
        if kept.dtype.kind == "u" and len(kept):
            while width > 1 and not planes[width - 1].any():
                width -= 1
        body = pa.compress(planes[:width].tobytes(), codec="zstd", asbytes=True) if len(a) else b""
        head = np.array([len(a), rising, width, np.frombuffer(a.dtype.str.encode().ljust(8), np.int64)[0], len(body)], np.int64)
        out += [head.tobytes(), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(blob, np.int64, 1)[0])):
        n, rising, width, kind, size = (int(x) for x in np.frombuffer(blob, np.int64, 5, at))
        dtype = np.dtype(np.int64(kind).tobytes().rstrip().decode())
        at += 40
        if n:
            planes = np.zeros((dtype.itemsize, n), np.uint8)
            raw = pa.decompress(blob[at : at + size], decompressed_size=width * n, codec="zstd", asbytes=True)
            planes[:width] = np.frombuffer(raw, np.uint8).reshape(width, n)
            a = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
            out.append(np.cumsum(a, dtype=dtype) if rising else a)
        else:
            out.append(np.zeros(0, dtype))
        at += size
    return out
