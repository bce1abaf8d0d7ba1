"""Cosine similarity and text embedding.

An embedder is any picklable object with `dim` and `encode(texts) -> float array [n, dim]`.
The default hashes words into signed counts: deterministic, model-free and the same in every
engine. Real models are loaded once per task by giving an embedder whose `encode` loads lazily. A
model that is out of reach raises `ModelDown`; any other error costs the text it is raised for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULTS


#: Of a batch of texts, about so many characters are encoded at a time; a batch's words take many times its size.
PIECE_CHARS = 1 << 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 when either has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def has_length(v: Column) -> Column:
    """False for the zero vector that stands for a failed embedding."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Signed word counts: the MD5 of a word picks its dimension and its sign."""

    def __init__(self, dim: int = DEFAULTS.embed_dim):
        self.dim = dim

    def _places(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Dimension and sign of each word: the first 16 bits of its digest, and the one after them."""
        md5 = hashlib.md5
        digests = np.frombuffer(b"".join([md5(w.encode()).digest() for w in words]), np.uint8).reshape(-1, 16)
        return (digests[:, 0].astype(np.int64) << 8 | digests[:, 1]) % self.dim, np.where(digests[:, 2] < 128, 1.0, -1.0)

    def encode(self, texts: list[str]) -> np.ndarray:
        listed = [(text or "").split() for text in texts]
        counts = np.fromiter(map(len, listed), np.int64, len(listed))
        # each distinct word of the batch is digested once
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(listed)), dtype=object))
        places, signs = self._places(distinct)
        rows = np.repeat(np.arange(len(texts)), counts)
        flat = np.bincount(
            rows * self.dim + places[codes],
            weights=signs[codes],
            minlength=len(texts) * self.dim,
        )
        return flat.reshape(len(texts), self.dim).astype(np.float32)


class ModelDown(Exception):
    """Raised by a model that cannot work at all: the task fails instead of losing its rows one by one."""


def _piecewise(call, items: list, missing) -> list:
    """The results of `call` on all items. A batch that fails is halved until the item at fault
    is alone and gets `missing`: one bad text costs neither the job nor its batch. `ModelDown` is passed on,
    whatever the batch, so the outcome does not depend on how rows are dealt out."""
    out, todo = [], [items] if items else []
    while todo:
        part = todo.pop()
        try:
            out.extend(call(part))
        except ModelDown:
            raise
        except Exception:
            if len(part) > 1:
                half = len(part) // 2
                todo += [part[half:], part[:half]]
            else:
                out.append(missing)
    return out


def encode_all(model: Embedder, texts: list[str]) -> np.ndarray:
    """Vectors of all texts; a text that the model fails on gets the zero vector."""

    def call(part: list[str]) -> list[np.ndarray]:
        return list(np.asarray(model.encode(part), dtype=np.float64).reshape(len(part), model.dim))

    out, at = np.zeros((len(texts), model.dim)), 0
    for piece in _pieces(texts):
        out[at : at + len(piece)] = _piecewise(call, piece, np.zeros(model.dim))
        at += len(piece)
    return out


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Neighbours of about `PIECE_CHARS` characters together; a longer text is alone."""
    first = size = 0
    for i, text in enumerate(texts):
        length = len(text or "") + 1
        if i > first and size + length > PIECE_CHARS:
            yield texts[first:i]
            first, size = i, 0
        size += length
    if first < len(texts):
        yield texts[first:]


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """Vector of a text. A text the model fails on has the zero vector; see `has_length`."""
    model = embedder or HashedWords()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = encode_all(model, texts.fillna("").tolist()).astype(np.float32)
            yield pd.Series(list(vectors), index=texts.index)

    return encode(text)


def sentence_similarity(
    question: Column, sentences: Column, embedder: Embedder | None = None
) -> Column:
    """Cosine of a question with each of a row's sentences; null when the question has none.

    The sentences of all rows of an Arrow batch are encoded together, so a model sees large
    batches while the rows never leave their partition.
    """
    model = embedder or HashedWords()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def similarity(
        batches: Iterator[tuple[pd.Series, pd.Series]],
    ) -> Iterator[pd.Series]:
        for asked, listed in batches:
            counts = [0 if s is None else len(s) for s in listed]
            flat = [s for row in listed if row is not None for s in row]
            distinct, codes = np.unique(asked.fillna("").to_numpy(dtype=object), return_inverse=True)
            q = encode_all(model, distinct.tolist())[codes]
            s = encode_all(model, flat)
            owner = np.repeat(np.arange(len(asked)), counts)
            dots = np.einsum("ij,ij->i", q[owner], s)
            norms = np.linalg.norm(q, axis=1)[owner] * np.linalg.norm(s, axis=1)
            scores = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
            scores = np.round(scores, 6)  # equal sentences must compare equal
            parts = np.split(scores, np.cumsum(counts)[:-1]) if counts else []
            blind = ~q.any(axis=1)
            yield pd.Series(
                [None if b else p for p, b in zip(parts, blind)], index=asked.index, dtype=object
            )

    return similarity(question, sentences)


class PairModel(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def predict_all(model: PairModel, pairs: list[tuple[str, str]]) -> list[float]:
    """Scores of all pairs; a pair the model fails on gets NaN, as in `encode_all`."""
    return _piecewise(lambda part: [float(s) for s in model.predict(part)], pairs, float("nan"))


def pair_score(question: Column, text: Column, model: PairModel) -> Column:
    """Score of each (question, text) pair; null for a pair the model fails on."""

    @F.pandas_udf(T.DoubleType())
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, texts in batches:
            pairs = list(zip(asked.fillna(""), texts.fillna("")))
            yield pd.Series(predict_all(model, pairs), index=asked.index, dtype="float64")

    # a missing score is graded ambiguous
    return F.nanvl(predict(question, text), F.lit(None).cast("double"))
