"""Language identification by unigram pieces, summed over all segmentations.

Method: a language is a distribution over the pieces of a fixed public vocabulary. The probability of
a word is the sum over every way to cut it into pieces, by a forward recursion; a text scores the
sum of the logarithms over its words, and the answer is the language with the largest, with its
posterior under equal priors as the score. Piece probabilities are learned by expectation
maximisation over the words of labelled texts, counted in Spark.

Words are runs of letters in lower case with the vocabulary's mark of a word's start; a run of over 32
characters is cut into stretches of 32. A character that the vocabulary lacks is a piece that is as
rare in every language. Each distinct word of a slice is scored once for all languages.

Fitting: at most `sample_docs` labelled documents for each language, those with the smallest hash of
their id, and of these the `max_words` most frequent words. Scoring covers every word of every text.

Edge cases: a null text, or one without a letter, is `und` with score 0, and so is every text when
nothing was learned; texts of any length are whole; a null id stays null; repeated rows each have their row;
equal scores go to the language first in the alphabet; rows without a language are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.textblocks import give_back, kept, runs, slices, span_hashes, text_bytes, tidy

START = "▁"
STRETCH = 32
#: Sums over positions and languages that are held at a time while words are scored.
SUMS = 1_000_000
LETTER = re.compile(r"[^\W\d_]")
UNSURE = "und"


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary in lower case, control and byte pieces left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {
        model.id_to_piece(i).lower()
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }
    return sorted(p for p in found if p.lstrip(START) and START not in p[1:])


class Lattice:
    """All segmentations of words into pieces; piece 0 stands for characters that the vocabulary lacks."""

    def __init__(self, pieces: list[str]):
        chars = {}
        for p in pieces:
            if len(p) > 1:
                for c in p:
                    chars.setdefault(c, len(chars) + 1)
        self.columns = np.zeros(0x110000, np.int32)
        for c, i in chars.items():
            self.columns[ord(c)] = i
        self.single = np.zeros(0x110000, np.int32)
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [0]
        for number, p in enumerate(pieces, 1):
            if len(p) == 1:
                self.single[ord(p)] = number
                continue
            node = 0
            for c in p:
                after = children[node].get(chars[c])
                if after is None:
                    after = children[node][chars[c]] = len(children)
                    children.append({})
                    ends.append(0)
                node = after
            ends[node] = number
        self.ends = np.array(ends, np.int32)
        self.deep = max(map(len, pieces), default=1)
        # one row for each node that goes on, so that a step is one look-up
        self.row = np.zeros(len(children), np.int32)
        inner = [i for i, c in enumerate(children) if c]
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, len(chars) + 1), np.int32)
        for r, i in enumerate(inner, 1):
            self.next[r, list(children[i])] = list(children[i].values())
        self.count = len(pieces) + 1

    def edges(self, words: list[str]) -> tuple[list[tuple], np.ndarray]:
        """For every start position: (start, end, word numbers, pieces); and the lengths of the words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(sizes.max()) if len(words) else 0
        codes = np.zeros((len(words), wide + 1), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes[np.repeat(np.arange(len(words)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        columns = self.columns[codes]
        out = []
        for i in range(wide):
            here = np.flatnonzero(sizes > i)
            out.append((i, i + 1, here, self.single[codes[here, i]]))
            node = np.zeros(len(here), np.int32)
            for k in range(self.deep):
                if i + k >= wide:
                    break
                node = self.next[self.row[node], columns[here, i + k]]
                going = (node > 0) & (sizes[here] > i + k)
                here, node = here[going], node[going]
                if not len(here):
                    break
                piece = self.ends[node]
                if k:
                    full = piece > 0
                    out.append((i, i + k + 1, here[full], piece[full]))
        return out, sizes


def forward(edges: list[tuple], sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: the summed probability of all segmentations up to a position."""
    alpha = np.zeros((len(sizes), int(sizes.max()) + 1 if len(sizes) else 1, chance.shape[1]))
    alpha[:, 0] = 1
    for start, end, words, piece in edges:
        alpha[words, end] += alpha[words, start] * chance[piece]
    return alpha


def backward(edges: list[tuple], sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    beta = np.zeros((len(sizes), int(sizes.max()) + 1 if len(sizes) else 1, chance.shape[1]))
    beta[np.arange(len(sizes)), sizes] = 1
    for start, end, words, piece in sorted(edges, key=lambda e: -e[0]):
        beta[words, start] += beta[words, end] * chance[piece]
    return beta


def stretches(word: str) -> list[str]:
    marked = START + word
    return [marked] if len(marked) <= STRETCH else [marked[k : k + STRETCH] for k in range(0, len(marked), STRETCH)]


def log_chances(lattice: Lattice, words: list[str], chance: np.ndarray) -> np.ndarray:
    """log P(word | language) of each word, summed over all segmentations."""
    parts, of = [], []
    for i, w in enumerate(words):
        for s in stretches(w):
            parts.append(s)
            of.append(i)
    out = np.zeros((len(words), chance.shape[1]))
    step = max(1000, SUMS // ((STRETCH + 1) * chance.shape[1]))
    of = np.array(of, np.int64)
    for k in range(0, len(parts), step):
        some = parts[k : k + step]
        edges, sizes = lattice.edges(some)
        total = forward(edges, sizes, chance)[np.arange(len(some)), sizes]
        np.add.at(out, of[k : k + step], np.log(total))
    return out


def fit(pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = 3, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and P(piece | language) from word counts by language; smoothed expected counts of each round."""
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    lattice = Lattice(pieces)
    chance = np.full((lattice.count, len(langs)), 1 / lattice.count)
    prepared = []
    for number, lang in enumerate(langs):
        parts: dict[str, int] = {}
        for w, n in counts[lang].items():
            for s in stretches(w):
                parts[s] = parts.get(s, 0) + n
        words = list(parts)
        for k in range(0, len(words), 10_000):
            some = words[k : k + 10_000]
            prepared.append((number, *lattice.edges(some), np.array([parts[w] for w in some], float)))
    for _ in range(rounds):
        expected = np.zeros((lattice.count, len(langs)))
        for number, edges, sizes, n in prepared:
            p = chance[:, number : number + 1]
            alpha, beta = forward(edges, sizes, p)[:, :, 0], backward(edges, sizes, p)[:, :, 0]
            weight = n / alpha[np.arange(len(sizes)), sizes]
            for start, end, words, piece in edges:
                mass = alpha[words, start] * beta[words, end] * weight[words] * p[piece, 0]
                expected[:, number] += np.bincount(piece, mass, lattice.count)
        expected[0] = 0  # as rare as can be in every language
        chance = (expected + smoothing) / (expected.sum(axis=0) + smoothing * lattice.count)
        chance[0] = chance.min()
    return langs, chance


def _letters() -> np.ndarray:
    """Bytes of words: ASCII letters and every byte of the other characters."""
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts, summed within a task first; words are cut into stretches as in scoring."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_bytes(piece.column("text"), lower=True)
                starts, ends = runs(letters[data], offsets)
                at = np.searchsorted(starts, offsets)
                found: dict[tuple[str, str], int] = {}
                raw = data.tobytes()
                for lang, a, b in zip(piece.column("lang").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
                        key = (lang, raw[s:e].decode().lower())
                        found[key] = found.get(key, 0) + 1
                kept = [(k[0], k[1], n) for k, n in found.items()]
                for k in range(0, len(kept), 50_000):
                    columns = list(zip(*kept[k : k + 50_000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"]
                    )

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, pieces: list[str], sample_docs: int = 300, max_words: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Fits the languages that occur in (doc_id, text, lang) rows; see the module for the bounds."""
    known = labelled.filter("lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("no", F.row_number().over(first)).filter(F.col("no") <= sample_docs)
    # at most sample_docs ids for each language
    texts = known.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).select("lang", "text")
    frequent = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    words = word_counts(texts).filter(F.length("word") <= 10 * STRETCH).withColumn("no", F.row_number().over(frequent))
    counts: dict[str, dict[str, int]] = {}
    for r in words.filter(F.col("no") <= max_words).select("lang", "word", "n").toLocalIterator(prefetchPartitions=True):
        counts.setdefault(r.lang, {})[r.word] = r.n
    return fit(pieces, counts)


class _Scorer:
    """Scores of words by hash, bounded; kept for the life of the worker."""

    def __init__(self, pieces: list[str], chance: np.ndarray, limit: int = 400_000):
        self.lattice, self.chance, self.limit = Lattice(pieces), chance, limit
        self.letters = _letters()
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.scores = np.zeros((1 << 14, self.chance.shape[1]))

    def score(self, texts: pa.Array) -> np.ndarray:
        """Summed log P(word | language) for each text."""
        data, offsets = text_bytes(texts, lower=True)
        starts, ends = runs(self.letters[data], offsets)
        distinct, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > self.limit:
            self._clear()
        keys = distinct.tolist()
        place = np.fromiter((self.place.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            raw, old = data.tobytes(), len(self.place)
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            got = log_chances(self.lattice, [raw[a:b].decode().lower() for a, b in zip(s, e, strict=True)], self.chance)
            if old + len(new) > len(self.scores):
                more = max(len(self.scores), old + len(new) - len(self.scores))
                self.scores = np.concatenate((self.scores, np.zeros((more, self.scores.shape[1]))))
            self.scores[old : old + len(new)] = got
            place[new] = np.arange(old, old + len(new))
            self.place.update(zip((keys[i] for i in new.tolist()), range(old, old + len(new)), strict=True))
        at = np.searchsorted(starts, offsets)
        sums = np.zeros((len(starts) + 1, self.chance.shape[1]))
        np.cumsum(self.scores[place[inverse]], axis=0, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]


def predict(
    docs: DataFrame, pieces: list[str], langs: list[str], chance: np.ndarray, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """All columns of `docs`, and the language and its score under `names`, which take the place of columns so named."""
    docs = docs.drop(*names)
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((pieces, chance))
    key = ("language_scorer", hash((tuple(langs), chance.tobytes())))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                some = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                found, scores = np.full(len(some), UNSURE, object), np.zeros(len(some))
                if langs and some.any():
                    logs = kept(key, lambda: _Scorer(*model.value)).score(texts)
                    best = logs.argmax(axis=1)
                    posterior = 1 / np.exp(np.minimum(logs - logs.max(axis=1, keepdims=True), 0)).sum(axis=1)
                    found[some] = np.array(langs, object)[best[some]]
                    scores[some] = posterior[some]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(found, pa.string()), pa.array(scores)], [*piece.schema.names, *names]
                )

    return docs.mapInArrow(tidy(run), schema)


def identify(
    docs: DataFrame, path: str, labelled: DataFrame | None = None, sample_docs: int = 300, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Trains on `labelled` (the documents themselves if none are given) and predicts every document."""
    pieces = pieces_of(path)
    langs, chance = train(docs if labelled is None else labelled, pieces, sample_docs)
    give_back()  # the driver lives on, and fitting takes many times what it leaves
    return predict(docs, pieces, langs, chance, names)
