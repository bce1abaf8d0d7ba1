"""Language-model scores against slow versions: sums over the vocabulary, one id at a time, difference quotients."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm_scoring, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEARNED = "crc32(cast(cast(doc_id as string) as binary)) % 10 != 0"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), None]


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def base_scores(rows):
    counts = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = tokens(t)
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((i, held_out(i), len(words), sum(counts[w] > 0 for w in words), n, score))
    return out


@pytest.fixture(scope="module")
def vocab():
    with open(queries.BYTE_BPE_MULTI, encoding="utf-8") as f:
        return lm_scoring.Subwords(f.read())


def ids_of(text, vocab):
    words = tokens(text)[:-1]
    return [k for w in words for k in vocab.encoder.encode_ordinary(" " + w)]


def slow_scores(rows, model, vocab):
    """One id at a time, with sums over the whole window and over the counts of all training texts."""
    s, e, size = vocab.marks.start, vocab.marks.end, vocab.marks.size
    seqs = [(i, [s, s, *ids_of(t, vocab), e]) for i, t in rows]
    three, two, one = Counter(), Counter(), Counter()
    after_two, after_one = Counter(), Counter()
    for i, z in seqs:
        if not held_out(i):
            for k in range(2, len(z)):
                three[tuple(z[k - 2 : k + 1])] += 1
                two[tuple(z[k - 1 : k + 1])] += 1
                one[z[k]] += 1
                after_two[tuple(z[k - 2 : k])] += 1
                after_one[z[k - 1]] += 1
    total, p, out = sum(one.values()), model.p, []
    d = p["e"].shape[1]
    part = lambda name, z, k: p["e"][z[k - 1]] @ p[name][:d] + p["e"][z[k - 2]] @ p[name][d:]

    def corpus(q, r, x, h):
        n2, n1 = after_two[q, r], after_one[r]
        parts = [three[q, r, x] / n2 if n2 else None, two[r, x] / n1 if n1 else None, (one[x] + 0.1) / (total + 0.1 * size)]
        z = p["g"] @ np.concatenate((h, [math.log1p(n2), math.log1p(n1), 1]))
        gate = [math.exp(v) if a is not None else 0 for v, a in zip(z, parts)]
        return sum(g * (a or 0) for g, a in zip(gate, parts)) / sum(gate)

    def distribution(z, k, wanted):
        first = 2 + (k - 2) // model.stride * model.stride  # the window begins so far before the ids it scores
        keys = range(max(2, first - (model.window - model.stride)), k)
        q = part("q", z, k)
        a = {j: math.exp(min(60, float(q @ part("k", z, j)) / math.sqrt(d) + float(p["near"][k - j]))) for j in keys}
        rest = math.exp(p["rest"][0])
        whole = sum(a.values()) + rest
        h = sum((a[j] / whole * (p["e"][z[j]] @ p["v"]) for j in keys), np.zeros(p["v"].shape[1]))
        copied = Counter()
        for j in keys:
            copied[z[j]] += a[j] / whole
        return [copied[x] + rest / whole * corpus(z[k - 2], z[k - 1], x, h) for x in wanted]

    for i, z in seqs:
        out.append((i, sum(math.log10(distribution(z, k, [z[k]])[0]) for k in range(2, len(z))), len(z) - 2))
    return out, lambda n, k: distribution(seqs[n][1], k, range(size))


def rows_for_test():
    rng = random.Random(3)
    pool = ["the", "Cat", "sat", "on", "mat.", "élan", "x!!", "中文", "<|endoftext|>", "a b", "zyx12"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, " \n"), (None, "the cat"), (4, "the cat sat"), (4, "the cat sat"), (60, "on the mat. " * 200)]


def random_model(vocab, **sizes):
    model = lm_scoring.Attention(vocab.marks.size, **sizes)
    rng = np.random.default_rng(4)
    for name in ("near", "g", "v"):
        model.p[name] = rng.normal(0, 0.5, model.p[name].shape).astype(np.float32)
    model.p["rest"][:] = 1.0
    return model


def test_scores_equal_a_slow_version(spark, vocab):
    rows, model = rows_for_test(), random_model(vocab)
    got = lm_scoring.score(spark.createDataFrame(rows, DOCS), F.expr(LEARNED), queries.BYTE_BPE_MULTI, model).collect()
    base = base_scores(rows)
    slow, _ = slow_scores(rows, model, vocab)
    key = lambda r: (str(r[0]), r[2])
    want = sorted(((*b, s, n) for b, (_, s, n) in zip(base, slow, strict=True)), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.n_pieces) for r in got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r[7] for r in got] == [r[7] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4, abs=1e-4)


def test_probabilities_of_all_ids_sum_to_one(vocab):
    rows, model = rows_for_test(), random_model(vocab)
    _, distribution = slow_scores(rows, model, vocab)
    for n, k in ((0, 2), (0, 9), (len(rows) - 1, 300)):
        assert sum(distribution(n, k)) == pytest.approx(1, abs=1e-5)


def test_windows_score_each_id_once_with_context():
    at = np.array([0, 3, 5, 205, 270])
    seen = []
    for own, given, scored, counted in lm_scoring.window_batches(np.arange(270), at, 64, 32):
        for o, g, s, c in zip(own, given, scored, counted, strict=True):
            text = np.searchsorted(at, s[0], side="right") - 1
            assert (o >= at[text]).all() and (o < at[text + 1]).all()
            context = o[2:][g][o[2:][g] < s[0]]
            assert len(context) == min(32, s[0] - at[text] - 2) and (context == np.arange(s[0] - len(context), s[0])).all()
            seen += s[c].tolist()
    assert sorted(seen) == [k for a, b in zip(at[:-1], at[1:]) for k in range(a + 2, b)]


def test_both_ways_to_score_agree():
    """The windows that fitting uses, and the stretches that whole texts are scored by."""
    rng = np.random.default_rng(8)
    model = lm_scoring.Attention(40, dim=4, context=3, window=8, stride=4)
    model.p["near"] = rng.normal(0, 1, 8).astype(np.float32)
    model.p["g"] = rng.normal(0, 1, model.p["g"].shape).astype(np.float32)
    model.p["rest"][:] = 1.5
    at = np.concatenate(([0], np.cumsum(rng.integers(3, 40, 60))))
    z = rng.integers(0, 40, at[-1]).astype(np.int32)
    n = at[-1] - 2 * 60
    features, parts = rng.random((n, lm_scoring.FEATURES)).astype(np.float32), rng.random((n, 3)).astype(np.float32)
    parts[::3, 0] = -1
    got = model.log_probabilities(model.tables(), z, at, features, parts)
    place = np.zeros(len(z), np.int64)
    t, _ = lm_scoring.sequence_keys(z, at)
    place[t] = np.arange(n)
    for own, given, scored, counted in lm_scoring.window_batches(z, at, 8, 4):
        k = place[scored]
        p = model.forward(model.tables(), model.causal(), z[own], given, features[k], parts[k])["p"]
        assert np.allclose(got[k[counted]], np.log10(p[counted]), atol=1e-5)


def test_numbers_of_codes():
    rng = np.random.default_rng(9)
    for bits in (5, 40, 63):
        codes = rng.integers(0, 2 ** min(bits, 9), 500).astype(np.uint64) << np.uint64(max(0, bits - 9))
        first, inverse = lm_scoring.numbered(codes, bits)
        distinct, want = np.unique(codes, return_inverse=True)
        assert (codes[first] == distinct).all() and (inverse == want).all()


def test_gradients_equal_difference_quotients():
    rng = np.random.default_rng(6)
    model = lm_scoring.Attention(12, dim=4, context=3, window=8, stride=4)
    for name in model.p:
        model.p[name] = rng.normal(0, 0.5, model.p[name].shape)
    ids, given = rng.integers(0, 12, (5, 10)), rng.random((5, 8)) > 0.2
    parts = rng.random((5, 4, 3))
    parts[0, :, 0] = -1
    args = (ids, given, rng.random((5, 4, lm_scoring.FEATURES)), parts, (rng.random((5, 4)) > 0.2).astype(float))
    loss, found = model.gradients(*args)
    which, rows = found["e"]
    found["e"] = np.zeros_like(model.p["e"])
    found["e"][which] = rows
    for name, value in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)]:
            old, step = value[at], 1e-3
            value[at] = old + step
            up = model.gradients(*args)[0]
            value[at] = old - step
            down = model.gradients(*args)[0]
            value[at] = old
            assert found[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3), (name, at)


def test_fitting_lowers_the_loss_and_beats_the_base_on_held_out_texts(spark):
    got = queries.op12_lm_scoring(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: r for r in base_scores(rows)}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:5]
        assert r.base_score == pytest.approx(want[r.doc_id][5], rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_counts_of_other_texts_only_in_fitting(vocab):
    one = (1, np.array([5, 6, 7, 8, 9], np.int32))
    data = lm_scoring.fit_windows([one, (2, np.array([5, 6, 7, 1, 1], np.int32))], vocab.marks.size)
    parts = data[3][data[4] > 0]
    assert parts[0, 0] == 1 and parts[1, 0] == 0 and parts[1, 1] == 0  # 7 after 5 6 and not 8 after 6 7 in the other text


def test_empty_tables_and_no_training_texts(spark, vocab):
    empty = spark.createDataFrame([], DOCS)
    model = lm_scoring.train(empty, F.expr(LEARNED), queries.BYTE_BPE_MULTI)
    assert lm_scoring.score(empty, F.expr(LEARNED), queries.BYTE_BPE_MULTI, model).collect() == []
    alone = next(i for i in range(100) if held_out(i))
    got = lm_scoring.score(spark.createDataFrame([(alone, "a b", 1, 2)], DOCS + ", learned int, score int"), F.expr(LEARNED), queries.BYTE_BPE_MULTI, model).collect()[0]
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0.0)
    assert got.score == pytest.approx(-3 * math.log10(vocab.marks.size), rel=1e-2)


def test_blocks_answer_each_other_whatever_their_size(spark, vocab, monkeypatch):
    rows, model = rows_for_test(), random_model(vocab)
    df = spark.createDataFrame(rows, DOCS)
    key = lambda r: (str(r.doc_id), r.n_tokens)
    whole = sorted(lm_scoring.score(df.coalesce(1), F.expr(LEARNED), queries.BYTE_BPE_MULTI, model).collect(), key=key)
    dealt = sorted(lm_scoring.score(df.repartition(9), F.expr(LEARNED), queries.BYTE_BPE_MULTI, model).collect(), key=key)
    for a, b in zip(whole, dealt, strict=True):
        assert a[:5] == b[:5] and a.score == pytest.approx(b.score, rel=1e-5) and a.base_score == pytest.approx(b.base_score)
    assert pa.__version__


def texts_for_fitting():
    rng = np.random.default_rng(10)
    at = np.concatenate(([0], np.cumsum(rng.integers(3, 40, 25))))
    z = rng.integers(0, 30, at[-1]).astype(np.int32)
    z[at[:-1]] = z[at[:-1] + 1] = 30  # what stands before a text
    return z, at


def test_counts_of_other_texts_equal_slow_ones():
    z, at = texts_for_fitting()
    features, parts = lm_scoring.other_counts(z, at, 31)
    texts, n = [z[a:b].tolist() for a, b in zip(at[:-1], at[1:])], 0
    for own, text in enumerate(texts):
        others = [x for k, x in enumerate(texts) if k != own]
        seen = Counter(tuple(x[k - j : k + 1]) for x in others for k in range(2, len(x)) for j in range(3))
        before = Counter(tuple(x[k - j : k]) for x in others for k in range(2, len(x) + 1) for j in (1, 2))
        total = sum(len(x) - 2 for x in others)
        for k in range(2, len(text)):
            two, one = tuple(text[k - 2 : k]), (text[k - 1],)
            n2, n1 = before[two], before[one]
            assert features[n].tolist() == pytest.approx([math.log1p(n2), math.log1p(n1), 1])
            want = [seen[*two, text[k]] / n2 if n2 else -1, seen[*one, text[k]] / n1 if n1 else -1, (seen[(text[k],)] + 0.1) / (total + 3.1)]
            assert parts[n].tolist() == pytest.approx(want, rel=1e-5)
            n += 1
    assert n == len(parts)


def test_gradients_of_stretches_equal_those_of_windows():
    z, at = texts_for_fitting()
    rng, model = np.random.default_rng(11), lm_scoring.Attention(31, dim=4, context=3, window=8, stride=4)
    for name in model.p:
        model.p[name] = rng.normal(0, 0.5, model.p[name].shape)
    features, parts = lm_scoring.other_counts(z, at, 31)
    t, _ = lm_scoring.sequence_keys(z, at)
    place = np.zeros(len(z), np.int64)
    place[t] = np.arange(len(t))
    own, given, scored, counted = (np.concatenate(x) for x in zip(*lm_scoring.window_batches(z, at, 8, 4)))
    loss, want = model.gradients(z[own], given, features[place[scored]], parts[place[scored]], counted.astype(float))
    slot, position, _, empty = lm_scoring.stretches(at, 4)
    x, weight = np.full(2 + 4 * len(empty), 30, np.int32), np.zeros(4 * len(empty))
    f, p = np.zeros((3, len(weight))), np.zeros((3, len(weight)))
    x[2 + slot], weight[slot], f[:, slot], p[:, slot] = z[position], 1, features.T, parts.T
    found, got = model.stretch_gradients(model.causal(), x, empty, f, p, weight)
    assert found == pytest.approx(loss)
    for r in (want, got):
        ids, rows = r["e"]
        r["e"] = np.zeros_like(model.p["e"])
        r["e"][ids] = rows
    for name in want:
        assert np.allclose(got[name], want[name], atol=1e-6), name


def test_every_training_text_is_fitted_as_a_whole(spark, vocab):
    """Few long texts and many short ones: what their ids say is learned wherever they stand."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 6)))
    rows = [(i, " ".join(word() for _ in range(900 if i < 8 else 4))) for i in range(2_500)]
    model = lm_scoring.train(spark.createDataFrame(rows, DOCS).repartition(3), F.expr(LEARNED), queries.BYTE_BPE_MULTI)
    start = lm_scoring.Attention(vocab.marks.size).p["e"]
    for some in (rows[:8], rows[8:]):
        ids = sorted({k for i, t in some if not held_out(i) for k in ids_of(t, vocab)})
        assert (model.p["e"][ids] != start[ids]).any(axis=1).mean() > 0.99


def test_no_word_is_encoded_again_while_it_is_kept(monkeypatch):
    """As many words as a task meets in a few blocks; each is encoded once, and found again whatever else was entered."""
    fresh, sent = lm_scoring.Subwords("YQ== 0"), []
    encode = lambda words: (sent.extend(words), (np.arange(len(words), dtype=np.uint16), np.arange(len(words) + 1)))[1]
    monkeypatch.setattr(fresh, "_encode", encode)
    hashes = lm_scoring.mix(np.arange(1, 400_001, dtype=np.uint64))
    for again in range(2):
        for some in np.array_split(np.arange(len(hashes)), 5):
            ids, counts = fresh.ids(hashes[some], lambda k, some=some: [b"%d" % w for w in some[k].tolist()])
            assert (counts == 1).all() and (ids == np.arange(len(some)) % 20_000).all()
    assert len(sent) == len(set(sent)) == 400_000


def test_ids_of_words_whose_hashes_want_one_slot(vocab):
    words = [b"the", b"mat.", b"zyx12", "élan".encode(), b"x!!", b"a" * 40, b"sat"]
    hashes = np.array([1, 1 << 40, 5, 1 << 41, 6 << 50, 2, 0], np.uint64)
    want = [vocab.encoder.encode_ordinary(" " + w.decode()) for w in words]
    with open(queries.BYTE_BPE_MULTI, encoding="utf-8") as f:
        fresh = lm_scoring.Subwords(f.read(), limit=6)
    for order in ([0, 2, 1], [6, 5, 4, 3, 2, 1, 0], [3], [1, 0], list(range(7))):
        ids, counts = fresh.ids(hashes[order], lambda some, order=order: [words[order[k]] for k in some.tolist()])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [want[k] for k in order]


def test_distinct_hashes_that_differ_in_the_lowest_bits_only():
    rng = np.random.default_rng(13)
    for hashes in (lm_scoring.mix(rng.integers(0, 50, 400)), rng.integers(0, 40, 400).astype(np.uint64), np.zeros(0, np.uint64), np.full(3, 2**64 - 1, np.uint64)):
        for got, want in zip(lm_scoring.distinct_hashes(hashes), np.unique(hashes, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all() and len(got) == len(want)


def test_counts_of_positions_come_back_from_buckets():
    z, at = texts_for_fitting()
    learned = np.arange(len(at) - 1) % 3 > 0
    for parts in (1, 7):
        keys, cuts, counts = lm_scoring.asked_keys(z, at, learned, parts)
        assert len(keys) == len(set(keys.tolist())) == cuts[-1] and len(cuts) == parts + 1
        flags = np.repeat(learned, np.diff(at) - 2)
        _, own = lm_scoring.sequence_keys(z, at)
        seen = Counter(own[:, flags].reshape(-1).tolist())
        assert counts.tolist() == [seen[k] for k in keys.tolist()]
        assert (lm_scoring.position_counts(z, at, parts, counts) == [[seen[k] for k in row] for row in own.tolist()]).all()


def test_places_that_see_their_own_id():
    z, at = texts_for_fitting()
    slot, position, _, empty = lm_scoring.stretches(at, 4)
    x = np.full(len(empty) * 4, -1)
    x[slot] = z[position]
    want = [8 * q + k - (q // 4 - 1) * 4 for q in range(4, len(x)) for k in range((q // 4 - 1) * 4, q) if x[q] == x[k] >= 0]
    same = lm_scoring.same_ids(*lm_scoring.sequence_orders(z, position)[0], slot, 4)
    assert same.tolist() == want
    some = [k - 8 * 20 for k in want if 20 <= k // 8 < 44]
    assert lm_scoring.within(same, 20, 44, 4).tolist() == some and len(some) > 0
