"""Words of a BPE vocabulary with word ends, cut by numpy exactly as the tokenizer itself cuts them.

The tokenizer normalises (NFC, white space, lower case), cuts by a pattern of contractions, runs of
letters, single numbers and runs of other signs, and merges inside each word. A text that is
normalised already, as nearly all are, is mapped by a table with one entry for each code point; the
entries come from the tokenizer's own normaliser and splitter, asked once for each code point
that occurs. All other texts, and those that hold a special token, go through the normaliser.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from lectern.llm.textblocks import kept, mix, span_hashes

UNKNOWN, SEVERAL = 0xFFFFFFFF, 0xFFFFFFFE
LETTER, NUMBER, OTHER, SPACE, WHOLE = 1, 2, 3, 0, 4
CODES = 0x110000


class WordVocabulary:
    """A tokenizer of this kind, from the text of its JSON file."""

    def __init__(self, text: str):
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, self.specials), key=len, reverse=True)) + ")")
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.pieces = np.array([self.tokenizer.id_to_token(i) or "" for i in range(size)], dtype=object)
        self.ends = np.array([p.endswith("</w>") for p in self.pieces])
        self.lower = np.full(CODES, UNKNOWN, np.uint32)
        self.kind = np.zeros(CODES, np.uint8)
        self.value = mix(np.arange(1, CODES + 1, dtype=np.uint64))

    def _learn(self, codes: np.ndarray) -> None:
        for c in np.unique(codes[self.lower[codes] == UNKNOWN]).tolist():
            text = self.tokenizer.normalizer.normalize_str(chr(c))
            self.lower[c] = ord(text) if len(text) == 1 else SEVERAL

    def _sort_out(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kind[codes]
        new = np.unique(codes[(kinds == 0) & (codes != 32)])
        cut = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        for c in new.tolist():
            x = chr(c)
            self.kind[c] = 9 if not cut(x) else LETTER if cut("a" + x) == 1 else OTHER if cut(x + x) == 1 else NUMBER
        if len(new):
            kinds = self.kind[codes]
        kinds[kinds == 9] = SPACE
        return kinds

    def _units(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Stretches that are cut alike: 0 to be mapped, 1 normalised already, 2 a special token; and their texts."""
        units, of, state = [], [], []
        for d, text in enumerate(texts):
            if not text:
                continue
            for part in self.special.split(text) if "<|" in text else (text,):
                if not part:
                    continue
                units.append(part)
                of.append(d)
                state.append(2 if part in self.specials else 0 if unicodedata.is_normalized("NFC", part) else 1)
        return units, of, state

    def split(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised text of all texts together; starts, ends and hashes of its words; offsets of the texts in that list."""
        units, of, state = self._units([t or "" for t in texts])
        whole = "".join(units)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self._learn(codes)
        low = self.lower[codes]
        odd = low == SEVERAL
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        at = np.concatenate(([0], np.cumsum(sizes)))
        if odd.any() or any(state):
            for u in np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1).tolist():
                state[u] = state[u] or 1
            units = [self.tokenizer.normalizer.normalize_str(x) if s == 1 else x for x, s in zip(units, state, strict=True)]
            parts = [
                np.frombuffer(x.encode("utf-32-le"), np.uint32) if s else low[at[u] : at[u + 1]]
                for u, (x, s) in enumerate(zip(units, state, strict=True))
            ]
            low = np.concatenate(parts)
            at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        kinds = self._sort_out(low)
        for u in [u for u, s in enumerate(state) if s == 2]:
            kinds[at[u] : at[u + 1]] = WHOLE
        starts, ends = self._cut(low, kinds, at)
        of = np.array(of, np.int64)
        unit = np.searchsorted(at, starts, side="right") - 1
        doc = of[unit] if len(unit) else np.zeros(0, np.int64)
        hashed = span_hashes(low, starts, ends, self.value[low])
        return low.tobytes().decode("utf-32-le"), starts, ends, hashed, np.searchsorted(doc, np.arange(len(texts) + 1))

    def _cut(self, low: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(low)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        fresh[at] = True
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        mark = np.flatnonzero((low == 0x27) & fresh[:n] & (kinds == OTHER))
        if len(mark):
            after = np.append(low, np.zeros(3, np.uint32))
            one, two = after[mark + 1], after[mark + 2]
            near = ~edge[np.minimum(mark + 1, n)]
            far = near & ~edge[np.minimum(mark + 2, n)]
            short = near & np.isin(one, [ord(c) for c in "stmd"])
            long = far & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for chosen, size in ((mark[short], 2), (mark[long & ~short], 3)):
                fresh[chosen + 1] = False
                fresh[chosen + size] = True
        starts = np.flatnonzero(fresh[:n] & (kinds != SPACE))
        stops = np.flatnonzero(fresh)
        return starts, stops[np.searchsorted(stops, starts, side="right")]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each."""
        ids, counts = [], []
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            alone = [w for w in some if w not in self.specials] if self.specials else some
            got = np.array(self.plain.encode(alone, is_pretokenized=True, add_special_tokens=False).ids if alone else [], np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            sizes = np.diff(np.concatenate(([0], stops)))
            if len(sizes) != len(alone):
                raise ValueError("a word of the vocabulary has no end piece")
            if len(alone) < len(some):
                pieces, given = np.split(got, stops[:-1]) if len(alone) else [], iter(range(len(alone)))
                mixed = [np.array([self.specials[w]], np.uint32) if w in self.specials else pieces[next(given)] for w in some]
                got, sizes = np.concatenate(mixed), np.array([len(p) for p in mixed])
            ids.append(got)
            counts.append(sizes)
        return (np.concatenate(ids), np.concatenate(counts).astype(np.int64)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def vocabulary(text: str) -> WordVocabulary:
    """One for each Python worker and file."""
    return kept(("word_vocabulary", hash(text)), lambda: WordVocabulary(text))


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class WordCache:
    """Ids of words by hash, bounded; it starts afresh when it is full."""

    def __init__(self, vocab: WordVocabulary, limit: int = 400_000):
        self.vocab, self.limit = vocab, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.starts, self.counts, self.flat, self.used, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0

    def _room(self, name: str, need: int) -> None:
        a = getattr(self, name)
        if need > len(a):
            setattr(self, name, np.concatenate((a, np.zeros(max(len(a), need - len(a)), a.dtype))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts."""
        whole, starts, ends, hashed, at = self.vocab.split(texts)
        distinct, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > self.limit:
            self._clear()
        keys = distinct.tolist()
        get = self.place.get
        place = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            ids, counts = self.vocab.encode_words([whole[a:b] for a, b in zip(s, e, strict=True)])
            self._room("flat", self.used + len(ids))
            self._room("starts", self.n + len(new))
            self._room("counts", self.n + len(new))
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[self.n : self.n + len(new)] = self.used + np.cumsum(counts) - counts
            self.counts[self.n : self.n + len(new)] = counts
            place[new] = np.arange(self.n, self.n + len(new))
            self.place.update(zip((keys[i] for i in new.tolist()), range(self.n, self.n + len(new)), strict=True))
            self.used, self.n = self.used + len(ids), self.n + len(new)
        at_word = place[inverse]
        counts = self.counts[at_word]
        before = np.concatenate(([0], np.cumsum(counts)))
        return gather(self.flat, self.starts[at_word], counts), before[at]


def word_cache(text: str) -> WordCache:
    return kept(("word_cache", hash(text)), lambda: WordCache(WordVocabulary(text)))
