"""Log probabilities of whole texts by a causal self-attention model over subword ids.

Model: each subword id is predicted from the ids before it. A self-attention head looks back over a window (query: the
two ids before the one predicted; keys: the two ids before each earlier one; a bias for the distance) and has a sentinel
beside the window. What falls on the window is probability of seeing the same id again, what falls on the sentinel goes to the
distributions of the whole corpus after the last two, the last and no id, mixed by a softmax gate over the attention's
context vector and the logarithms of their counts. All parts are distributions over the vocabulary, so their sum is one.
Attention, embeddings and gate are trained in numpy by mini-batches over every id of every training text; so are the counts.

Texts are lower-cased (A-Z) and cut into words; the ids of a word are those of a public BPE tokenizer, and every text ends with
an end id. Whole texts are scored in windows of `WINDOW` ids that move by `STRIDE`, half of it: every id is scored once, in the
window in which it lies among the last `STRIDE`, with `WINDOW - STRIDE` ids before these as context at least
(fewer at the start of a text). Windows are scored in batches with a causal mask.

The base score is that of word unigrams with additive smoothing; its counts come from the same exchange.

How it scales: counts of words and id sequences are not collected anywhere. The exchange (see `exchange`) sends each block's
distinct keys once to the bucket of the key, where the training counts of all blocks are added, and the totals come back to the
block. Fitting is one pass over all training texts where they lie: every task starts from the same model and goes through its
blocks, and the models are averaged once, an embedding over the tasks that changed it. In fitting, the counts that a text meets are
those of the other texts of its block, so the gate does not rely on a text's own counts.

Edge cases: null and empty texts are one end token; texts of any length are whole; rows with a null id are scored and not
learned from (held out); repeated rows each have their row and are each learned from; without training texts every id is
equally likely; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import base64
import copy
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import vocabulary_file
from lectern.llm.exchange import ASKED, OWN, buckets, exchange, messages
from lectern.llm.mixing import batch_sums
from lectern.llm.pieces import gather
from lectern.llm.textblocks import kept, mix, pack, slices, span_hashes, text_bytes, unpack, words

WINDOW, STRIDE, DIM, CONTEXT = 32, 16, 8, 8
#: Ids that stand before a text, and the features of the gate besides the context vector.
PAD, FEATURES = 2, 3
#: Keys of id sequences that differ in the lowest bits of the last id only go to one bucket, where they compress well.
SHARED = 8
#: A block holds about so many words and texts.
BLOCK = 500_000
#: Windows that are scored at once, and those of a step of fitting.
BATCH, FIT_BATCH = 512, 256
RATE = 0.3
SMOOTH = 0.1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_pieces long"


class Marks(NamedTuple):
    """Size of a vocabulary with two ids that it lacks: what stands before a text, and its end."""

    size: int

    @property
    def start(self) -> int:
        return self.size - 2

    @property
    def end(self) -> int:
        return self.size - 1


class Subwords:
    """Ids of words in a byte-level BPE vocabulary, kept by hash; it starts afresh when it is full.

    A word is encoded with a blank before it, as it stands in a text, so the blanks part the words of many that are
    encoded as one text. The table of hashes is at most half full, and a hash lies where its lowest bits say or in the next free
    slot; a dictionary takes about as much memory for a third of the words.
    """

    def __init__(self, text: str, limit: int = 900_000):
        ranks = {base64.b64decode(piece): int(i) for piece, i in map(str.split, text.splitlines())}
        self.encoder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks, self.limit = Marks(max(ranks.values()) + 3), limit
        if self.marks.size > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.bytes = np.zeros(self.marks.size, np.int64)
        for piece, i in ranks.items():
            self.bytes[i] = len(piece)
        self._clear()

    def _clear(self) -> None:
        self.flat, self.starts, self.counts, self.used, self.known = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0, 0
        self._table(1 << 15)

    def _table(self, slots: int) -> None:
        """An empty table: hashes, and the numbers of their words from 1; 0 is free."""
        self.hashes, self.numbers = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is in the table, or the free slot where it may go."""
        at, left = (hashes & np.uint64(len(self.hashes) - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            here = at[left]
            left = left[(self.numbers[here] > 0) & (self.hashes[here] != hashes[left])]
            at[left] = (at[left] + 1) & (len(self.hashes) - 1)
        return at

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        while len(hashes):
            at = self._slots(hashes)
            self.hashes[at], self.numbers[at] = hashes, numbers
            others = self.hashes[at] != hashes  # wanted the same free slot
            hashes, numbers = hashes[others], numbers[others]

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Number words that are new from `known` on."""
        for name, need in (("flat", self.used + len(ids)), ("starts", self.known + len(hashes)), ("counts", self.known + len(hashes))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate((old, np.zeros(max(len(old), need - len(old)), old.dtype))))
        new = slice(self.known, self.known + len(hashes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[new], self.counts[new] = self.used + offsets[:-1], np.diff(offsets)
        self.used, self.known = self.used + len(ids), new.stop
        if 2 * self.known > len(self.hashes):
            taken = self.numbers > 0
            old = self.hashes[taken], self.numbers[taken]
            self._table(1 << (2 * self.known).bit_length())
            self._enter(*old)
        self._enter(hashes, np.arange(new.start + 1, new.stop + 1, dtype=np.int32))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the offsets of each word's."""
        joined = b" " + b" ".join(words)
        ids = np.array(self.encoder.encode_ordinary(joined.decode()), np.int64)
        begins = np.cumsum(self.bytes[ids]) - self.bytes[ids]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return ids.astype(np.uint16), np.searchsorted(begins, np.concatenate(([0], np.cumsum(sizes))))

    def ids(self, hashes: np.ndarray, text_of: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of each word's; `text_of` gives the texts of some of them."""
        if self.known > self.limit:
            self._clear()
        at = self.numbers[self._slots(hashes)].astype(np.int64) - 1
        new = np.flatnonzero(at < 0)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            at[some] = np.arange(self.known, self.known + len(some))
            self._keep(hashes[some], *self._encode(text_of(some)))
        counts = self.counts[at].astype(np.int64)
        return gather(self.flat, self.starts[at], counts), counts


def subwords(text: str) -> Subwords:
    return kept(("subwords", hash(text)), lambda: Subwords(text))


# ---- the model ----------------------------------------------------------------------------


class Attention:
    """Parameters of the head and the gate; `forward` and `gradients` work on batches of windows."""

    def __init__(self, ids: int, dim: int = DIM, context: int = CONTEXT, window: int = WINDOW, stride: int = STRIDE, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = np.float32
        eye = np.concatenate((np.eye(dim), 0.6 * np.eye(dim)))
        self.window, self.stride, self.key = window, stride, uuid.uuid4().hex
        self.p = {
            "e": rng.normal(0, 1, (ids, dim)).astype(f),
            "q": (eye + rng.normal(0, 0.02, eye.shape)).astype(f),
            "k": (eye + rng.normal(0, 0.02, eye.shape)).astype(f),
            "v": rng.normal(0, 0.3, (dim, context)).astype(f),
            "near": np.zeros(window, f),
            "rest": np.full(1, 6.0, f),
            "g": np.zeros((3, context + FEATURES), f),
        }
        self.p["g"][0, context] = self.p["g"][1, context + 1] = 0.3

    def tables(self) -> dict[str, np.ndarray]:
        """Query, key and value parts of each id: what `forward` adds up for a position."""
        e, d = self.p["e"], self.p["e"].shape[1]
        scale = e.dtype.type(1 / np.sqrt(d))
        t = {"q1": e @ self.p["q"][:d] * scale, "q2": e @ self.p["q"][d:] * scale, "k1": e @ self.p["k"][:d], "k2": e @ self.p["k"][d:]}
        # the column of ones adds up the weights
        t["v"] = np.concatenate((e @ self.p["v"], np.ones((len(e), 1), e.dtype)), axis=1)
        length = [np.linalg.norm(t[n], axis=1).max() for n in ("q1", "q2", "k1", "k2")]
        t["steep"] = (length[0] + length[1]) * (length[2] + length[3]) + self.p["near"].max() > 60
        return t

    def causal(self) -> np.ndarray:
        """Bias of each query of a window for each key; -inf for keys that are not before the query."""
        back = self.back()
        return np.where(back > 0, self.p["near"].take(back), np.float32(-np.inf)).astype(np.float32, copy=False)

    def back(self) -> np.ndarray:
        """How far each key of a window is before each query; 0 for keys that are not."""
        w, s = self.window, self.stride
        return np.maximum((np.arange(s) + w - s)[:, None] - np.arange(w), 0)

    def forward(
        self, t: dict, causal: np.ndarray, ids: np.ndarray, given: np.ndarray, features: np.ndarray, parts: np.ndarray, keep: bool = False
    ) -> dict:
        """ids: (n, PAD + window), the window with the ids before it; given: (n, window), positions that exist;
        features: (n, stride, FEATURES); parts: (n, stride, 3), what the corpus says after two, one and no ids, -1: nothing.
        `keep` keeps what `gradients` needs."""
        w, s = self.window, self.stride
        own = ids[:, PAD:]
        q = t["q1"][ids[:, 1 + w - s : 1 + w]] + t["q2"][ids[:, w - s : w]]
        k = t["k1"][ids[:, 1:-1]] + t["k2"][ids[:, :-2]]
        a = q @ k.transpose(0, 2, 1)
        a += causal
        cut = np.flatnonzero(~given[:, : w - s].all(axis=1))  # windows at the start of a text; what lies beyond its end is masked as later
        a[cut] += np.where(given[cut], 0, -np.inf)[:, None, :].astype(a.dtype)
        if t["steep"]:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        rest = np.exp(self.p["rest"][0])
        summed = a @ t["v"][own]
        total = summed[:, :, -1] + rest
        rest = rest / total
        h = np.concatenate((summed[:, :, :-1] / total[:, :, None], features), axis=2)
        z = np.where(parts >= 0, h @ self.p["g"].T, -np.inf)
        g = np.exp(z - z.max(axis=2, keepdims=True))
        g /= g.sum(axis=2, keepdims=True)
        same = own[:, w - s :, None] == own[:, None, :]
        corpus = (g * parts).sum(axis=2)
        out = {"rest": rest, "g": g, "h": h, "q": q, "k": k, "same": same, "corpus": corpus, "total": total, "a": a}
        if not keep:
            a *= same
            return out | {"p": a.sum(axis=2) / total + rest * corpus}
        out["a"] = a / total[:, :, None]
        return out | {"p": (out["a"] * same).sum(axis=2) + rest * corpus, "v": t["v"][own][:, :, :-1]}

    def log_probabilities(self, t: dict, z: np.ndarray, at: np.ndarray, features: np.ndarray, parts: np.ndarray, order: tuple | None = None) -> np.ndarray:
        """log10 probability of each predicted position of texts as `window_batches` takes them; the window is two strides; `order`: places
        of these positions in the order of their ids, and which are the first of theirs.

        What `forward` computes, laid out for speed: texts are cut into stretches of a stride with an empty one before each, and the
        ids of a stretch look at their own, as far as it lies before them, and at the one before.
        """
        s = self.stride
        slot, position, first, empty = stretches(at, s)
        x = np.zeros(PAD + len(empty) * s, np.int32)
        x[PAD + slot] = z.take(position)
        for k in range(PAD):
            x[(first + 1) * s + k] = z.take(at[:-1] + k)
        causal, rest, d = self.causal(), np.exp(self.p["rest"][0]), self.p["e"].shape[1]
        same = same_ids(*order or in_order(z.take(position).astype(np.uint64), 16), slot, s)
        context, gate = np.split(self.p["g"], [self.p["v"].shape[1]], axis=1)
        # the gate is linear in the context vector, so it can be applied to its parts; the row of ones adds up the weights
        project = (self.p["k"].T, self.p["q"].T * np.float32(1 / np.sqrt(d)), context @ self.p["v"].T)
        logs = np.zeros(len(slot))
        for k in range(1, len(empty), BATCH):
            low, high = (k - 1) * s, min((k + BATCH) * s, len(x) - PAD)
            e = np.ascontiguousarray(self.p["e"].take(x[low : high + PAD], axis=0).T)
            pair, value = np.concatenate((e[:, 1:-1], e[:, :-2])), np.ones((4, high - low), e.dtype)
            np.matmul(project[2], e[:, PAD:], out=value[:3])
            a = apart(project[1] @ pair[:, s:], s).transpose(0, 2, 1) @ neighbours(project[0] @ pair, s)
            a += causal
            if t["steep"] and a.max() > 60:
                np.minimum(a, 60, out=a)
            np.exp(a, out=a)
            a[empty[k - 1 : k - 1 + len(a)], :, :s] = 0
            mine = slice(*np.searchsorted(slot, (low + s, high)))
            place = slot[mine] - (low + s)
            seen = within(same, low + s, high, s)
            copied = np.bincount(seen // (2 * s), a.reshape(-1).take(seen), len(a) * s).take(place)
            summed = np.empty((4, len(a) * s), a.dtype)
            np.matmul(neighbours(value, s), a.transpose(0, 2, 1), out=apart(summed, s))
            summed = summed.take(place, axis=1)
            total, share = summed[3] + rest, parts[mine].T
            w = summed[:3] / total
            w += gate @ features[mine].T
            w[share < 0] = -np.inf
            w = np.exp(w - w.max(axis=0))
            corpus = (w * np.maximum(share, 0)).sum(axis=0) / w.sum(axis=0)
            logs[mine] = np.log10(np.maximum((copied + rest * corpus) / total, 1e-30))
        return logs

    def gradients(self, ids, given, features, parts, weight) -> tuple[float, dict]:
        """Mean loss (natural logarithm) over the queries with weight 1, and its gradients; rows of `e` that occur only."""
        w, s = self.window, self.stride
        d = self.p["e"].shape[1]
        r = self.forward(self.tables(), self.causal(), ids, given, features, parts, keep=True)
        n = max(1.0, float(weight.sum()))
        loss = float(-(np.log(np.where(weight > 0, r["p"], 1)) * weight).sum() / n)
        dp = (-weight / np.maximum(r["p"], 1e-12) / n).astype(np.float32)
        dz = dp[:, :, None] * (r["rest"][:, :, None] * r["g"] * (np.maximum(parts, 0) - r["corpus"][:, :, None]))
        out = {"g": np.einsum("nsk,nsh->kh", dz, r["h"])}
        dh = (dz @ self.p["g"])[:, :, : self.p["v"].shape[1]]
        da = dp[:, :, None] * r["same"] + dh @ r["v"].transpose(0, 2, 1)
        drest = dp * r["corpus"]
        mean = (da * r["a"]).sum(axis=2) + drest * r["rest"]
        dl = r["a"] * (da - mean[:, :, None])
        out["rest"] = np.array([(r["rest"] * (drest - mean)).sum()], np.float32)
        back = (np.arange(s) + w - s)[:, None] - np.arange(w)[None, :]
        out["near"] = np.bincount(np.clip(back, 0, w - 1).ravel(), dl.sum(axis=0).ravel(), w).astype(np.float32)
        scale = np.float32(1 / np.sqrt(d))
        dq, dk, dv = (dl @ r["k"]) * scale, dl.transpose(0, 2, 1) @ r["q"], r["a"].transpose(0, 2, 1) @ dh
        e = self.p["e"]
        places = [(ids[:, 1 + w - s : 1 + w], "q", 0, dq), (ids[:, w - s : w], "q", 1, dq), (ids[:, 1:-1], "k", 0, dk), (ids[:, :-2], "k", 1, dk)]
        out["q"], out["k"], touched = np.zeros_like(self.p["q"]), np.zeros_like(self.p["k"]), []
        for where, name, half, gradient in places:
            flat, rows = where.reshape(-1), gradient.reshape(-1, d)
            out[name][half * d : (half + 1) * d] += e[flat].T @ rows
            touched.append((flat, rows @ self.p[name][half * d : (half + 1) * d].T))
        flat, rows = ids[:, PAD:].reshape(-1), dv.reshape(-1, dv.shape[2])
        out["v"] = e[flat].T @ rows
        touched.append((flat, rows @ self.p["v"].T))
        flat = np.concatenate([f for f, _ in touched])
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        out["e"] = (flat[order][first], np.add.reduceat(np.concatenate([x for _, x in touched])[order], first))
        return loss, out

    def stretch_gradients(self, causal: np.ndarray, x: np.ndarray, empty: np.ndarray, features: np.ndarray, parts: np.ndarray, weight: np.ndarray, same: np.ndarray | None = None) -> tuple[float, dict]:
        """What `gradients` gives, for neighbouring stretches: the ids x of their slots and of `PAD` slots before, with an `empty` stretch of
        start ids before each text; features and parts (FEATURES or 3, slots), weight (slots), and where they see the `same`
        id (see `within`). The first stretch is looked at only."""
        s, f = self.stride, self.p["e"].dtype
        # parameters and what is computed of slots lie in rows as long as the slots: products of small matrices are fast so
        e = np.ascontiguousarray(self.p["e"].take(x, axis=0).T)
        d, c = len(e), self.p["v"].shape[1]
        scale, n = f.type(1 / np.sqrt(d)), max(1.0, float(weight[s:].sum()))
        ex, pair = e[:, PAD:], np.concatenate((e[:, 1:-1], e[:, :-2]))
        value = np.ones((c + 1, ex.shape[1]), f)
        np.matmul(self.p["v"].T, ex, out=value[:c])
        key, value, query = neighbours(self.p["k"].T @ pair, s), neighbours(value, s), apart(self.p["q"].T * scale @ pair[:, s:], s)
        # `a` is not divided by its sums; what it is multiplied with is
        a = query.transpose(0, 2, 1) @ key
        a += causal
        if a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a[empty[:-1], :, :s] = 0
        summed = np.empty((c + 1, len(a) * s), f)
        np.matmul(value, a.transpose(0, 2, 1), out=apart(summed, s))
        rest = np.exp(self.p["rest"][0])
        total = summed[c] + rest
        rest = rest / total
        h = np.concatenate((summed[:c] / total, features[:, s:]))
        z = np.where(parts[:, s:] >= 0, self.p["g"] @ h, -np.inf)
        g = np.exp(z - z.max(axis=0))
        g /= g.sum(axis=0)
        share = np.maximum(parts[:, s:], 0)
        corpus = (g * share).sum(axis=0)
        if same is None:
            same = within(same_ids(*in_order(x[PAD:].astype(np.uint64), 16), np.arange(len(x) - PAD), s), s, len(x) - PAD, s)
        query_of = same // (2 * s)
        probability = np.bincount(query_of, a.reshape(-1).take(same), len(total)).astype(f) / total + rest * corpus
        w = weight[s:]
        loss = float(-(np.log(np.where(w > 0, probability, 1)) * w).sum() / n)
        dp = (-w / np.maximum(probability, 1e-12) / n).astype(f)
        dz = dp * rest * (g * (share - corpus))
        out = {"g": dz @ h.T}
        dh = self.p["g"][:, :c].T @ dz
        mean = dp * probability + (dh * h[:c]).sum(axis=0)
        out["rest"] = np.array([(rest * (dp * corpus - mean)).sum()], f)
        down = apart((np.concatenate((dh, -mean[None])) / total).astype(f, copy=False), s)
        dl = down.transpose(0, 2, 1) @ value
        dl.reshape(-1)[same] += (dp / total).take(query_of)
        dl *= a
        out["near"] = np.bincount(self.back().ravel(), np.ones(len(dl), f) @ dl.reshape(len(dl), -1), 2 * s).astype(f)
        dq = np.empty((d, len(a) * s), f)
        np.matmul(key, dl.transpose(0, 2, 1), out=apart(dq, s))
        dq *= scale
        dk, dv = to_both(query, dl), to_both(down, a)[:c]
        out["q"], out["k"], out["v"] = pair[:, s:] @ dq.T, pair @ dk.T, ex @ dv.T
        dpair = self.p["k"] @ dk
        dpair[:, s:] += self.p["q"] @ dq
        rows = np.zeros_like(e)  # an id is that of its slot, and one before those of the next two
        rows[:, PAD:] = self.p["v"] @ dv
        rows[:, 1:-1] += dpair[:d]
        rows[:, :-2] += dpair[d:]
        rows = np.ascontiguousarray(rows.T)
        order = np.argsort(x.astype(np.uint16), kind="stable")
        ids = x.take(order)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        out["e"] = (ids.take(first), np.add.reduceat(rows.take(order, axis=0), first, axis=0))
        return loss, out

    def fit(self, z: np.ndarray, at: np.ndarray, squares: dict, rng: np.random.Generator, batch: int = FIT_BATCH) -> float:
        """Adagrad over all ids of texts, in batches of neighbouring stretches in any order; returns the mean loss."""
        s, (slot, position, _, empty) = self.stride, stretches(at, self.stride)
        orders = sequence_orders(z, position)
        features, parts = other_counts(z, at, len(self.p["e"]), orders)
        same = same_ids(*orders[0], slot, s)
        slots, f = len(empty) * s, self.p["e"].dtype
        # start ids are where no text is, so that what stands before a slot is always what came before its id
        x, weight = np.full(PAD + slots, z[0], np.int32), np.zeros(slots, f)
        x[PAD + slot], weight[slot] = z[position], 1
        given, share = np.zeros((FEATURES, slots), f), np.zeros((3, slots), f)
        for to, values in zip((*given, *share), (*features.T, *parts.T), strict=True):
            to[slot] = values
        total = 0.0
        for k in rng.permutation(np.arange(1, len(empty), batch)).tolist():
            here = slice((k - 1) * s, min((k + batch) * s, slots))
            w = weight[here]
            loss, found = self.stretch_gradients(self.causal(), x[here.start : here.stop + PAD], empty[k - 1 : k + batch], given[:, here], share[:, here], w, within(same, here.start + s, here.stop, s))
            total += loss * float(w[s:].sum())
            (ids, gradient), square = found.pop("e"), squares["e"]
            sums = square.take(ids, axis=0)
            sums += gradient * gradient
            square[ids] = sums
            gradient *= RATE
            gradient /= np.sqrt(sums, out=sums)
            self.p["e"][ids] = self.p["e"].take(ids, axis=0) - gradient
            for name, gradient in found.items():
                squares[name] += gradient * gradient
                self.p[name] -= RATE * gradient / np.sqrt(squares[name])
        return total / len(slot)

    def numbers(self, weight: float, changed: np.ndarray) -> np.ndarray:
        """All that is learned times `weight`, embeddings only where they were changed, and the weights."""
        dense = [self.p[name].ravel() for name in self.p if name != "e"]
        rows = self.p["e"].astype(np.float64) * (weight * changed)[:, None]
        return np.concatenate((rows.ravel(), weight * changed, weight * np.concatenate(dense), [weight]))

    def average(self, numbers: np.ndarray) -> None:
        """Take the weighted means of summed `numbers`; embeddings that no task changed stay."""
        e = self.p["e"]
        rows, many, dense = np.split(numbers, [e.size, e.size + len(e)])
        some = many > 0
        e[some] = rows.reshape(e.shape)[some] / many[some][:, None]
        dense, at = dense[:-1] / dense[-1], 0
        for name, value in self.p.items():
            if name != "e":
                value[...] = dense[at : at + value.size].reshape(value.shape)
                at += value.size


def stretches(at: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts between offsets `at`, cut into stretches with an empty one before each: the slot and the position in the texts of each
    predicted id, the first stretch of each text, and which stretches are empty."""
    size = np.diff(at) - PAD
    counts = -(-size // stride) + 1
    first = np.cumsum(counts) - counts
    slot = np.repeat((first + 1) * stride - (np.cumsum(size) - size), size) + np.arange(size.sum())
    position = np.arange(len(slot)) + np.repeat(PAD * np.arange(1, len(size) + 1), size)
    empty = np.zeros(counts.sum(), bool)
    empty[first] = True
    return slot, position, first, empty


def apart(rows: np.ndarray, stride: int) -> np.ndarray:
    """The stretches of (columns, slots), as (stretches, columns, stride); not copied."""
    return rows.reshape(len(rows), -1, stride).transpose(1, 0, 2)


def neighbours(rows: np.ndarray, stride: int) -> np.ndarray:
    """Each stretch of (columns, slots) from the second on behind the one before it, as (stretches - 1, columns, 2 * stride); not copied."""
    columns, n = rows.shape
    step, item = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (n // stride - 1, columns, 2 * stride), (stride * item, step, item), writeable=False)


def to_both(weight: np.ndarray, a: np.ndarray) -> np.ndarray:
    """(columns, slots) of what each slot gets by `a` (stretches - 1, stride, 2 * stride) as a slot of its own stretch and of the one before,
    where the stretches that look at it weigh (stretches - 1, columns, stride)."""
    stride, columns = a.shape[1], weight.shape[1]
    total, own = np.zeros((columns, (len(a) + 1) * stride), a.dtype), np.empty((columns, len(a) * stride), a.dtype)
    np.matmul(weight, a[:, :, :stride], out=apart(total, stride)[:-1])
    np.matmul(weight, a[:, :, stride:], out=apart(own, stride))
    total[:, stride:] += own
    return total


def same_ids(place: np.ndarray, new: np.ndarray, slot: np.ndarray, stride: int) -> np.ndarray:
    """Which places of (slots, 2 * stride), where each slot looks at its stretch and at the one before, see the slot's own id before it;
    places of `slot` in the order of their ids, and which are the first of theirs."""
    where = slot.astype(np.int32 if slot.max(initial=0) < 2**29 // stride else np.int64).take(place)
    stretch = where // stride
    line = stretch + np.cumsum(new) * np.int64(stretch.max(initial=0) + 2)  # stretches of one id, far from those of the next
    code = where * (2 * stride) - (stretch - 1) * stride
    found, back = [], 1
    last = np.flatnonzero(line[1:] - line[:-1] <= 1) + 1
    while len(last):  # an id that is too far has only such before it
        found.append(code.take(last) + where.take(last - back))
        back += 1
        last = last[last >= back]
        last = last[line.take(last) - line.take(last - back) <= 1]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def within(same: np.ndarray, low: int, high: int, stride: int) -> np.ndarray:
    """Of ascending places as of `same_ids` those of the slots from `low` to `high`, counted from `low`."""
    low, high = low * 2 * stride, high * 2 * stride
    return same[slice(*np.searchsorted(same, np.array((low, high), same.dtype)))].astype(np.int64) - low


def window_batches(ids: np.ndarray, at: np.ndarray, window: int, stride: int) -> Iterator[tuple]:
    """Batches of windows over texts whose ids, `PAD` start ids and the end included, lie in `ids` between offsets `at`.

    Yields (positions with the ids before the window, positions that exist, positions scored, which of these count).
    """
    lengths = np.diff(at) - PAD
    counts = -(-lengths // stride)
    text = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = at[text] + PAD + number * stride  # the first position that the window scores
    for k in range(0, len(first), BATCH):
        f, t = first[k : k + BATCH], text[k : k + BATCH]
        low, high = (at[t] + PAD)[:, None], at[t + 1][:, None]
        own = f[:, None] - (window - stride) + np.arange(-PAD, window)[None, :]
        given = (own[:, PAD:] >= low) & (own[:, PAD:] < high)
        scored = f[:, None] + np.arange(stride)[None, :]
        counted = scored < high
        # positions outside the text: those before it read its start ids, those after it any id
        yield np.clip(own, at[t][:, None], high - 1), given, np.minimum(scored, high - 1), counted


# ---- counts -------------------------------------------------------------------------------


def padded(ids: np.ndarray, at: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with `PAD` start ids before and the end id after each, and their new offsets."""
    sizes = np.diff(at)
    new = np.concatenate(([0], np.cumsum(sizes + PAD + 1)))
    out = np.full(new[-1], marks.start, np.int32)
    out[np.arange(len(ids)) + np.repeat(new[:-1] + PAD - at[:-1], sizes)] = ids
    out[new[1:] - 1] = marks.end
    return out, new


def predicted(at: np.ndarray) -> np.ndarray:
    """Positions that are predicted, in texts between offsets `at`."""
    sizes = np.diff(at) - PAD
    return np.arange(sizes.sum()) + np.repeat(PAD * np.arange(1, len(sizes) + 1), sizes)


def sequence_key(z: np.ndarray, t: np.ndarray, ids: int) -> np.ndarray:
    """Keys of the last `ids` ids up to positions `t`: their number * 2**48 + ids."""
    key = z.take(t).astype(np.uint64)
    for k in range(1, ids):
        key |= z.take(t - k).astype(np.uint64) << np.uint64(16 * k)
    key |= np.uint64(ids << 48)
    return key


def sequence_keys(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are predicted, and for each the keys of the last three, two and one ids: order * 2**48 + ids."""
    t = predicted(at)
    c, before = z.astype(np.uint64), t - PAD
    q, two, x = (c[k:].take(before) for k in range(PAD + 1))
    two <<= np.uint64(16)
    two |= x
    keys = np.empty((3, len(t)), np.uint64)
    np.left_shift(q, np.uint64(32), out=keys[0])
    keys[0] |= two
    keys[0] |= np.uint64(3 << 48)
    np.bitwise_or(two, np.uint64(2 << 48), out=keys[1])
    np.bitwise_or(x, np.uint64(1 << 48), out=keys[2])
    return t, keys


def context_keys(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Keys of the contexts of the last two ids and of the last id."""
    p, q = z[t - 1].astype(np.uint64), z[t - 2].astype(np.uint64)
    return np.stack((np.uint64(5 << 48) | q << np.uint64(16) | p, np.uint64(4 << 48) | p))


def corpus_parts(counts: np.ndarray, contexts: np.ndarray, total, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, parts) of positions from the counts of their three keys and of their two contexts."""
    f = np.float32
    c, n = counts.astype(f, copy=False), contexts.astype(f, copy=False)
    parts, features = np.empty((3, c.shape[1]), f), np.ones((FEATURES, c.shape[1]), f)
    for k in (0, 1):
        np.divide(c[k], np.maximum(n[k], 1), out=parts[k])
        parts[k][n[k] <= 0] = -1
        np.log1p(n[k], out=features[k])
    np.divide(c[2] + f(SMOOTH), np.asarray(total + SMOOTH * size, f), out=parts[2])
    return features.T, parts.T


def counted_before(counts: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
    """Counts of the contexts of two and one ids: what was counted at the position before, or the start of a text."""
    contexts = np.zeros((2, counts.shape[1]), counts.dtype)
    contexts[:, 1:] = counts[1:, :-1]
    contexts[:, at[:-1] - PAD * np.arange(len(at) - 1)] = texts
    return contexts


def bucket_order(keys: np.ndarray, parts: int, shared: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct ascending keys by bucket and key, and where each bucket begins in it; keys that agree but for the last
    `shared` bits are in one bucket."""
    bucket = ((mix(keys >> np.uint64(shared)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    bucket = bucket.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # 16 bits are sorted by counting
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=parts))))


def asked_keys(z: np.ndarray, at: np.ndarray, learned: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in bucket order, where buckets begin, and how often each key occurs in the texts that are learned."""
    t, keys = sequence_keys(z, at)
    flags = np.repeat(learned, np.diff(at) - PAD).astype(np.uint64)
    single = z.take(t)
    ids = np.flatnonzero(np.bincount(single))
    seen = np.bincount(single, flags, len(ids) and ids[-1] + 1)
    both = np.sort((keys[:2] << np.uint64(1) | flags).reshape(-1))
    flags, key = both & np.uint64(1), both >> np.uint64(1)
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    counts = np.add.reduceat(flags, first) if len(first) else np.zeros(0, np.uint64)
    counts = np.concatenate((seen[ids].astype(np.uint64), counts))
    distinct = np.concatenate((ids.astype(np.uint64) | np.uint64(1 << 48), key[first]))
    order, cuts = bucket_order(distinct, parts, SHARED)
    return distinct[order], cuts, counts[order]


def in_order(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their codes and of themselves, and which are the first of their code; codes have at most `bits` bits."""
    low = max(1, int(len(codes) - 1).bit_length())
    new = np.ones(len(codes), bool)
    if bits + low > 64:
        place = np.argsort(codes, kind="stable")
        np.not_equal(codes[place[1:]], codes[place[:-1]], out=new[1:])
        return place, new
    # one sort of codes with their positions is a third of the time of sorting positions by code
    both = codes << np.uint64(low)
    both |= np.arange(len(codes), dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << low) - 1)).view(np.int64)
    both >>= np.uint64(low)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    return place, new


def numbered(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First position of each distinct code in their order, and the number of each position's code; codes have at most `bits` bits."""
    place, new = in_order(codes, bits)
    inverse = np.empty(len(codes), np.int32)
    inverse[place] = np.cumsum(new, dtype=np.int32) - 1
    return place[new], inverse


def sequence_orders(z: np.ndarray, t: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three ids that end at positions `t`: the places of `t` in the order of these ids, and which are the first
    of theirs."""
    ids = np.flatnonzero(np.bincount(z))
    number = np.zeros(len(ids) and ids[-1] + 1, np.uint64)
    number[ids] = np.arange(len(ids), dtype=np.uint64)
    # the ids of a block are few, and their numbers are in the same order; so are those of its pairs
    bits = int(len(ids)).bit_length()
    c, before = number.take(z), t - PAD
    q, p, x = (c[k:].take(before) for k in range(PAD + 1))
    one = in_order(x, bits)
    p <<= np.uint64(bits)
    p |= x
    two = place, new = in_order(p, 2 * bits)
    pairs = np.cumsum(new, dtype=np.uint64)
    more = int(pairs[-1] if len(pairs) else 0).bit_length()
    q <<= np.uint64(more)
    x[place] = pairs - np.uint64(1)
    q |= x
    return [one, two, in_order(q, bits + more)]


def run_sizes(first: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the runs of `n` elements that begin at `first`."""
    return np.diff(first, append=n)


def position_counts(z: np.ndarray, at: np.ndarray, parts: int, totals: np.ndarray, orders: list | None = None) -> np.ndarray:
    """For each predicted position the total counts of its three, two and one ids, from those of the distinct keys in bucket order."""
    t = predicted(at)
    orders = [(place, np.flatnonzero(new)) for place, new in orders or sequence_orders(z, t)]
    # ascending, since keys of fewer ids are smaller numbers
    distinct = np.concatenate([sequence_key(z, t.take(place.take(first)), k) for k, (place, first) in enumerate(orders, 1)])
    order, _ = bucket_order(distinct, parts, SHARED)
    values, counts, used = np.empty(len(order), np.float32), np.empty((3, len(t)), np.float32), 0
    values[order] = totals
    for row, (place, first) in zip(counts[::-1], orders, strict=True):
        row[place] = np.repeat(values[used : used + len(first)], run_sizes(first, len(t)))
        used += len(first)
    return counts


def distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in their order, the first place of each, and the number of each place's."""
    low = max(1, int(len(hashes) - 1).bit_length())
    both = hashes >> np.uint64(low) << np.uint64(low)
    both |= np.arange(len(hashes), dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << low) - 1)).view(np.int64)
    found = hashes.take(place)
    if (found[1:] < found[:-1]).any():  # some differ in the lowest bits only, which made way for the places
        return np.unique(hashes, return_index=True, return_inverse=True)
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    inverse = np.empty(len(found), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return found[new], place[new], inverse


class _Block:
    """Texts until they are sent off: their bytes, and the places and hashes of their words."""

    def __init__(self):
        self.ids, self.learned, self.sizes, self.data, self.starts, self.ends, self.hashes = ([] for _ in range(7))
        self.size = self.bytes = 0

    def add(self, ids: list, learned: list, texts: pa.Array) -> None:
        data, offsets = text_bytes(texts, lower=True)
        starts, ends, at = words(data, offsets)
        self.hashes.append(span_hashes(data, starts, ends))
        self.data.append(data.tobytes())
        self.starts.append(starts + self.bytes)
        self.ends.append(ends + self.bytes)
        self.bytes += len(data)
        self.ids += ids
        self.learned += learned
        self.sizes += np.diff(at).tolist()
        self.size += len(starts) + len(ids)

    def arrays(self, vocab: Subwords, parts: int = 1) -> tuple:
        """Number of the word of each position, words of each text, ids of each distinct word, all ids; hashes of the words in
        the order of buckets, and where each bucket begins."""
        distinct, first, inverse = distinct_hashes(np.concatenate(self.hashes))
        order, cuts = bucket_order(distinct, parts)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, raw = distinct[order], b"".join(self.data)
        starts, ends = np.concatenate(self.starts)[first[order]], np.concatenate(self.ends)[first[order]]

        def text_of(some: np.ndarray) -> list[bytes]:
            return [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]

        flat, lengths = vocab.ids(hashes, text_of)
        return rank[inverse], np.array(self.sizes, np.int64), lengths, flat, hashes, cuts

    def rows(self, block: int, parts: int, vocab: Subwords) -> list[tuple]:
        learned = np.array(self.learned, bool)
        number, sizes, lengths, flat, hashes, cuts = self.arrays(vocab, parts)
        counted = np.bincount(number[np.repeat(learned, sizes)], minlength=len(hashes)).astype(np.uint32)
        z, at = block_ids(number, sizes, lengths, flat, vocab.marks)
        keys, key_cuts, key_counts = asked_keys(z, at, learned, parts)
        known = np.array([i is not None for i in self.ids], np.uint8)
        doc_ids = np.array([i or 0 for i in self.ids], np.int64)
        own = pack(
            doc_ids, known, learned.astype(np.uint8), sizes.astype(np.uint32), number.astype(np.uint32), lengths.astype(np.uint16), flat
        )
        rows = [(block % parts, block, OWN, own)]
        # a text is one more training token and one more start of a text; told once, to the bucket of the block
        for b in range(parts):
            k, w = slice(key_cuts[b], key_cuts[b + 1]), slice(cuts[b], cuts[b + 1])
            texts = np.array([learned.sum() if b == block % parts else 0], np.uint32)
            rows.append((b, block, ASKED, pack(texts, keys[k], key_counts[k].astype(np.uint32), hashes[w], counted[w])))
        return rows


def block_ids(number: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, flat: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a block, padded, from the word of each position."""
    counts = lengths.astype(np.int64)
    starts = np.cumsum(counts) - counts
    ids = gather(flat, starts[number], counts[number]) if len(number) else np.zeros(0, np.uint16)
    before = np.concatenate(([0], np.cumsum(counts[number])))
    at = before[np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))]
    return padded(ids.astype(np.int32), at, marks)


def _split(vocab_text, parts: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = subwords(vocab_text.value)
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for piece in slices(batch, limit=1 << 19):
                block.add(piece.column("doc_id").to_pylist(), piece.column("learned").to_pylist(), piece.column("text"))
                if block.size >= BLOCK:
                    yield messages(block.rows(number, parts, vocab))
                    number, block = number + 1, _Block()
        if block.ids:
            yield messages(block.rows(number, parts, vocab))

    return split


def _merge(rows: list[tuple]) -> list[tuple]:
    """Adds the training counts of all blocks; answers each with its totals and those of the bucket."""
    asked = [(block, unpack(body)) for block, body in rows]
    sums = []
    for k in (1, 3):
        keys = np.sort(np.concatenate([a[k] for _, a in asked]))
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        keys = keys[new]
        # the keys of a block are distinct, and in the order of the bucket
        places = [np.searchsorted(keys, a[k]) for _, a in asked]
        counts = np.zeros(len(keys), np.int64)
        for place, (_, a) in zip(places, asked, strict=True):
            counts[place] += a[k + 1]
        sums.append((keys, counts, places))
    (keys, counts, of_keys), (_, found, of_words) = sums
    texts = sum(int(a[0][0]) for _, a in asked)
    single = counts[: np.searchsorted(keys, np.uint64(2 << 48))].sum()
    facts = np.array([texts, single, found.sum(), (found > 0).sum()], np.int64)
    counts, found = counts.astype(np.uint64), found.astype(np.uint64)
    return [(block, pack(facts, counts.take(k), found.take(w))) for (block, _), k, w in zip(asked, of_keys, of_words, strict=True)]


def _finish(marks: Marks, sent):
    def finish(rows: list[tuple]) -> pa.Table:
        model = kept_tables(sent.value)
        doc_ids, known_id, learned, sizes, number, lengths, flat = unpack(next(body for kind, _, body in rows if kind == OWN))
        answers = [unpack(body) for kind, _, body in rows if kind == ASKED]
        texts, single, trained, distinct = (int(v) for v in sum(a[0] for a in answers))
        totals, found = np.concatenate([a[1] for a in answers]).astype(np.int64), np.concatenate([a[2] for a in answers]).astype(np.int64)
        train_tokens, distinct = trained + texts, distinct + (texts > 0)
        sizes = sizes.astype(np.int64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        counts = found[number]
        base = lambda c: np.log10((c + SMOOTH) / (train_tokens + SMOOTH * (distinct + 1)))
        base_score = _sums(base(counts), at) + base(texts)
        n_known = _sums((counts > 0).astype(np.int64), at) + (texts > 0)
        z, z_at = block_ids(number, sizes, lengths, flat, marks)
        logs = block_scores(z, z_at, totals, len(answers), texts, single, marks, model)
        columns = {
            "doc_id": pa.array(doc_ids, mask=known_id == 0),
            "held_out": pa.array(learned == 0),
            "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(sizes), train_tokens, np.int64)),
            "base_score": pa.array(base_score),
            "score": pa.array(logs),
            "n_pieces": pa.array(np.diff(z_at) - PAD),
        }
        return pa.table(columns)

    return finish


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between offsets, each taken on its own."""
    if not len(values):
        return np.zeros(len(at) - 1, values.dtype)
    out = np.add.reduceat(np.append(values, values[:1] * 0), at[:-1])
    return np.where(np.diff(at) > 0, out, 0)


def kept_tables(model: Attention) -> tuple:
    """The model with its tables; made once for each worker."""
    return kept(("attention", model.key), lambda: (model, model.tables()))


def block_scores(z, at, totals, parts, texts, single, marks: Marks, kept_model) -> np.ndarray:
    """log10 probability of each text of a block, from the total counts of its distinct keys."""
    model, tables = kept_model
    orders = sequence_orders(z, predicted(at))
    counts = position_counts(z, at, parts, totals, orders)
    contexts = counted_before(counts, at, texts)
    features, corpus = corpus_parts(counts, contexts, single, marks.size)
    logs = model.log_probabilities(tables, z, at, features, corpus, orders[0])
    return _sums(logs, at - PAD * np.arange(len(at)))


# ---- fitting ------------------------------------------------------------------------------


def other_counts(z: np.ndarray, at: np.ndarray, size: int, orders: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features, parts) of all predicted positions of texts, from the counts of the other ones; `orders` as of `sequence_orders`."""
    t, sizes = predicted(at), np.diff(at) - PAD
    of, counts = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.empty((3, len(t)), np.float32)
    for row, (place, new) in zip(counts[::-1], orders or sequence_orders(z, t), strict=True):
        # places of a sequence are in the order of texts, so those in one text are neighbours
        text, mine = of.take(place), new.copy()
        mine[1:] |= text[1:] != text[:-1]
        run = np.flatnonzero(mine)
        mine, every = run_sizes(run, len(t)), run_sizes(np.flatnonzero(new), len(t))
        row[place] = np.repeat((every.take(np.cumsum(new.take(run)) - 1) - mine).astype(np.float32), mine)
    return corpus_parts(counts, counted_before(counts, at, len(sizes) - 1), np.repeat((len(t) - sizes).astype(np.float32), sizes), size)


def _fitted(vocab_text, sent, block_size: int):
    """The model after one pass over the texts of a task, weighed by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        vocab, model, block, weight = subwords(vocab_text.value), copy.deepcopy(sent.value), _Block(), 0
        squares = {k: np.full_like(v, 1e-8) for k, v in model.p.items()}
        changed, rng = np.zeros(len(model.p["e"]), bool), np.random.default_rng([5, TaskContext.get().partitionId()])

        def fit() -> int:
            if not block.ids:
                return 0
            z, at = block_ids(*block.arrays(vocab)[:4], vocab.marks)
            model.fit(z, at, squares, rng)
            changed[z] = True
            return int(at[-1]) - PAD * len(block.ids)

        for batch in batches:
            for piece in slices(batch, limit=1 << 19):
                block.add([0] * piece.num_rows, [True] * piece.num_rows, piece.column("text"))
                if block.size >= block_size and len(block.ids) > 1:
                    weight += fit()
                    block = _Block()
        weight += fit()
        return model.numbers(float(weight), changed) if weight else None

    return run


def fit_windows(spans: list[tuple[int, np.ndarray]], size: int) -> tuple:
    """Windows for fitting from (text, ids with `PAD` before) spans; counts are those of the other texts."""
    order = sorted(range(len(spans)), key=lambda k: (spans[k][0], spans[k][1].tolist()))
    spans = [spans[k] for k in order]
    z = np.concatenate([s for _, s in spans]).astype(np.int32)
    at = np.concatenate(([0], np.cumsum([len(s) for _, s in spans])))
    text = np.unique([t for t, _ in spans], return_inverse=True)[1]
    t, keys = sequence_keys(z, at)
    of = text[np.searchsorted(at, t, side="right") - 1]
    # contexts are counted as they occur, since a span does not begin where its text does
    five = np.concatenate((keys, context_keys(z, t)))
    distinct, inverse = np.unique(five.reshape(-1), return_inverse=True)
    counts = np.bincount(inverse, minlength=len(distinct))
    both = inverse.reshape(five.shape) * np.int64(text.max() + 1) + of
    mine, at_mine = np.unique(both.reshape(-1), return_inverse=True)
    others = (counts[inverse] - np.bincount(at_mine, minlength=len(mine))[at_mine]).reshape(five.shape)
    total = len(t) - np.bincount(of)[of]
    features, parts = corpus_parts(others[:3], others[3:], total, size)
    place = np.zeros(len(z), np.int64)
    place[t] = np.arange(len(t))
    data = [[], [], [], [], []]
    for own, given, scored, counted in window_batches(z, at, WINDOW, STRIDE):
        for out, value in zip(data, (z[own], given, features[place[scored]], parts[place[scored]], counted.astype(np.float32)), strict=True):
            out.append(value)
    return tuple(np.concatenate(x) for x in data)


def train(docs: DataFrame, learned, path: str, block_size: int = BLOCK) -> Attention:
    """The attention model from all (doc_id, text) rows for which `learned` is true; see the module."""
    with open(path, encoding="utf-8") as f:
        model = Attention(Subwords(f.read()).marks.size)
    texts = docs.filter(learned & F.col("doc_id").isNotNull()).select(F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    found = batch_sums(texts, _fitted(vocabulary_file(docs, path), sent, block_size))
    sent.destroy()
    if found is not None:
        model.average(found)
    return model


def score(docs: DataFrame, learned, path: str, model: Attention) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_pieces (ids scored)."""
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(learned, F.lit(False)).alias("learned"),
    )
    vocab, sent = vocabulary_file(docs, path), docs.sparkSession.sparkContext.broadcast(model)
    return exchange(given, _split(vocab, buckets(given)), _merge, _finish(Marks(len(model.p["e"])), sent), RESULT)
