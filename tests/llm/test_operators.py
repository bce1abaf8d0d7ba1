"""The operators against brute force, the libraries and their edge cases, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import bpe, decontaminate, language_id, licences, line_dedup, neighbours, queries, token_counts, token_files, toxicity
from lectern.llm.components import components
from lectern.llm.jaccard_join import distinct_documents, near_duplicates
from lectern.llm.pieces import word_cache
from lectern.llm.textblocks import pack, plain_words, span_hashes, text_bytes, unpack, unused, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGES = [None, "", " ", "\n", "\n\n", "a", "a b c", "Émile's 12½ <|endoftext|> x", "x" * 20_000, LONG, "12 34 !!", "中文 текст"]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, words_=None):
    pool = words_ or [f"{a}{b}" for a in "ba ko mi tu re lo sa ve".split() for b in "ra ni do ke mu".split()]
    return " ".join(rng.choice(pool) for _ in range(n))


# ---- helpers ------------------------------------------------------------------------------


def test_words_are_cut_as_the_pattern_says():
    texts = ["Ab  cd\t\x0bE", None, "", "é\xa0f g"]
    data, offsets = text_bytes(pa.array(texts), lower=True)
    starts, ends, at = words(data, offsets)
    got = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at[:-1], at[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    sliced, _ = text_bytes(pa.array(texts).slice(3), lower=True)
    assert bytes(sliced) == texts[3].encode()


def test_hashes_depend_on_the_span_alone():
    data = np.frombuffer(b"abc xabc abd", np.uint8)
    h = span_hashes(data, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert h[0] == h[1] != h[2]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    given = [np.zeros(0, np.uint64), np.sort(rng.integers(0, 2**62, 999, dtype=np.uint64)), rng.integers(-5, 5, 7), np.array([3], np.uint16)]
    for a, b in zip(given, unpack(pack(*given)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_unused_name():
    assert unused(["GONE", "_gone"], "gone") == "__gone"


def test_components_are_those_of_a_search(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(None, 1), (7, 7)]
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want[node] = min(seen)
    got = {r.node: r.label for r in components(frame(spark, links, "a long, b long")).collect()}
    assert got == want
    assert components(frame(spark, [], "a long, b long")).collect() == []


# ---- 8 ------------------------------------------------------------------------------------


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {(i, len(sets[i]), top(i)) for i in sets}


def edited(rng, text, n):
    out = text.split()
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = f"z{rng.randrange(9)}"
        elif kind < 0.7 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, f"y{rng.randrange(9)}")
    return " ".join(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = list(EDGES)
    for _ in range(6):
        base = prose(rng, rng.choice([3, 5, 6, 8, 12, 40, 120]))
        texts += [base] * 2 + [edited(rng, base, rng.randrange(1, 6)) for _ in range(20)]
    common = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {common}" for _ in range(40)] + [f"{common} n{i}" for i in range(10)]
    big = prose(rng, 150)  # more copies than a rare shingle may have
    texts += [edited(rng, big, rng.randrange(0, 5)) for _ in range(120)]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    wide = frame(spark, rows).withColumns({"label": F.lit(1), "signature": F.lit("s"), "n": F.lit(0), "gone": F.lit(2)})
    got = [tuple(r) for r in near_duplicates(wide.repartition(5)).collect()]
    assert len(got) == len(rows) and set(got) == brute_jaccard(rows)


def test_near_duplicates_edges(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (1, "quite another text of some six words"), (None, text), (5, text.upper()), (6, None), (7, "")]
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (1, 3, 1), (5, 3, 1), (6, 0, 6), (7, 0, 7)]
    kept = distinct_documents(frame(spark, rows).withColumn("twice", F.lit(0))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == [
        (False, 1, text), (False, 6, ""), (False, 7, ""), (True, 0, text)
    ] or sorted((r.doc_id or 0) for r in kept) == [0, 1, 6, 7]


def test_rows_that_share_an_id_go_only_as_near_copies(spark):
    rng = random.Random(33)
    one, two, three, four = (prose(rng, 60) for _ in range(4))
    rows = [(2, one), (2, two), (1, one + " x"), (3, two + " y"), (3, three), (3, three), (4, four), (None, one), (None, one), (5, None), (5, "")]
    given = frame(spark, rows).withColumns({"row": F.lit(1), "id": F.lit(2)})
    got = corpus_pipeline.near_copies(spark, given, "")
    assert got.columns == given.columns
    want = [(2, two), (1, one + " x"), (3, three), (4, four), (None, one), (None, one), (5, None), (5, "")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    unique = [(i, t) for i, t in enumerate([one, one + " x", two, three])]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, unique), "").collect()) == [0, 2, 3]


# ---- 4, 10 --------------------------------------------------------------------------------


def test_ids_and_texts_are_those_of_the_library(spark):
    library = Tokenizer.from_file(queries.WORD_BPE)
    rng = random.Random(3)
    signs = list("aB'srelvtmd 1²Ⅷ.,-\n\té́İßΣς中あ😀<|>") + ["<|endoftext|>", "'s", "'re", "<|startoftext|>"]
    texts = EDGES + ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(3, "again"), (None, "no id")]
    given = frame(spark, rows).withColumns({"ids": F.lit(1), "block": F.lit(2)}).repartition(3)
    got = bpe.decode(bpe.encode(given, queries.WORD_BPE), queries.WORD_BPE).collect()
    want = []
    for i, t in rows:
        if i is not None:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id, tuple(r.ids), r.text) for r in got) == sorted(want)
    once = bpe.encode_and_decode(given, queries.WORD_BPE).collect()
    assert sorted((r.doc_id, tuple(r.ids), r.text) for r in once) == sorted(want)
    assert bpe.encode(frame(spark, []), queries.WORD_BPE).collect() == []


def test_word_cache_starts_afresh_when_full():
    cache = word_cache(open(queries.WORD_BPE).read())
    library, limit = cache.vocab.tokenizer, cache.limit
    cache.limit = 50
    try:
        for k in range(10):
            texts = [f"word{k}x{j} tail" for j in range(20)]
            ids, at = cache.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        cache.limit = limit


@pytest.mark.parametrize("top", [0, 3, 10**9])
def test_elias_fano(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 63, 64, 65, 700):
        v = np.sort(rng.integers(0, top + 1, n))
        ef = token_files.EliasFano.build(v)
        assert (ef.all() == v).all() and [ef.select(i) for i in range(n)] == v.tolist()
        with pytest.raises(IndexError):
            ef.select(n)


def test_token_files_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(queries.WORD_BPE)
    rng = random.Random(5)
    rows = [(i * 3 - 40, t) for i, t in enumerate(EDGES + [prose(rng, rng.randrange(0, 60)) for _ in range(150)])] + [(8, "b"), (8, "a")]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark, [*rows, (None, "x")]).withColumn("part", F.lit(1)), path, queries.WORD_BPE, 1, shard_ids=200)
    assert token_files.shards(spark, path).count() > 10
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_tokens(spark, path).collect())
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((at, i, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    empty = str(tmp_path / "empty")
    token_files.write_tokens(frame(spark, []), empty, queries.WORD_BPE)
    assert token_files.read_tokens(spark, empty).collect() == []


def test_registered_digests(spark):
    library = Tokenizer.from_file(queries.WORD_BPE)
    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in queries.QUERIES["op4_bpe_encode_decode"](spark, SF).collect()}
    assert got == {
        (i, len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))) for i, e in docs.items()
    }
    want, at = set(), 0
    for i in sorted(docs):
        e = [*docs[i], 1]
        want.add((i, at, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        at += len(e)
    assert {tuple(r) for r in queries.QUERIES["op10_token_files"](spark, SF).collect()} == want


# ---- 3 ------------------------------------------------------------------------------------


def brute_lines(rows, min_words):
    order = sorted({r for r in rows if r[0] is not None and r[1] is not None})
    cut = [[(n, x) for n, x in enumerate(t.split("\n")) if x.split()] for _, t in order]
    gone = {r: set() for r in order}
    for d, mine in enumerate(cut):
        for e in range(d + 1):
            for i in range(len(mine)):
                for j in range(len(cut[e]) if e < d else i):
                    k = 0
                    while i + k < len(mine) and j + k < len(cut[e]) and mine[i + k][1] == cut[e][j + k][1]:
                        k += 1
                    if sum(len(x.split()) for _, x in mine[i : i + k]) >= min_words:
                        gone[order[d]].update(n for n, _ in mine[i : i + k])
    return {r: "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone[r]) for r in order}


@pytest.mark.parametrize("seed", [1, 2])
def test_later_copies_of_runs_are_deleted(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) + f" {i % 4}" for i in range(8)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, rows[0][1]), rows[3], (3, "other " + rows[3][1])]
    given = frame(spark, rows).withColumns({"lines": F.lit(1), "gone": F.lit("x"), "n_lines": F.lit(9), "_doc": F.lit(0)})
    got = line_dedup.dedup_lines(given, min_words=9)
    assert got.columns == ["doc_id", "text", "lines", "gone", "_doc", "n_lines", "n_deleted"]
    left = Counter((r.doc_id, r.text) for r in got.collect())
    # documents of one id are ordered by a hash, so either may be the later one
    want = brute_lines([r for r in rows if r[0] != 3], 9)
    for r in rows:
        if r[0] is None or r[1] is None:
            assert left[r] == 1
    some = line_dedup.dedup_lines(frame(spark, [r for r in rows if r[0] != 3]), min_words=9)
    assert Counter((r.doc_id, r.text) for r in some.collect()) == Counter(
        (r[0], want.get(r, r[1])) for r in rows if r[0] != 3
    )


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []
    whole = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"head\n{whole}\ntail"), (2, f"x\n{whole}"), (3, whole), (4, "head"), (5, "same " * 30 + "\n" + "same " * 30)]
    rows += [(6, "\n".join(["q r"] * 60))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 3, 0) and got[2] == ("x", 2, 1) and got[3] == ("", 1, 1) and got[4] == ("head", 1, 0)
    assert got[5] == (rows[4][1], 2, 0)  # a repeated run has to have 50 words, not the text
    assert got[6] == ("q r", 60, 59)


def test_line_dedup_runs_without_python(spark):
    plan = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 1 ------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    lattice = language_id.Lattice(pieces)
    chance = np.random.default_rng(2).random((lattice.count, 2)) / 10
    place = {p: i for i, p in enumerate(pieces, 1)}

    def total(text, lang):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            p = text[:k]
            if p in place:
                out += chance[place[p], lang] * total(text[k:], lang)
            elif k == 1:
                out += chance[0, lang] * total(text[1:], lang)
        return out

    for word in ("a", "ab", "abab", "xab", "bax"):
        got = language_id.log_chances(lattice, [word], chance)[0]
        assert np.allclose(np.exp(got), [total("▁" + word, lang) for lang in (0, 1)])


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op1_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    labelled = frame(spark, [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "x y", None)], "doc_id long, text string, lang string")
    given = frame(spark, [*enumerate(EDGES), (None, "the dog and the cat"), (3, "le chien"), (3, "le chien")]).withColumns({"score": F.lit(1), "lang_pred": F.lit("z")})
    got = language_id.identify(given, queries.PIECES, labelled).collect()
    found = Counter((r.doc_id, r.lang_pred) for r in got)
    assert len(got) == len(EDGES) + 3 and found[(None, "en")] == 1 and found[(3, "fr")] == 2
    assert {r.lang_pred for r in got if r.text in (None, "", " ", "\n", "\n\n", "12 34 !!")} == {"und"}
    nothing = language_id.identify(given, queries.PIECES, labelled.filter("false")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language_id.identify(frame(spark, []), queries.PIECES, labelled).collect() == []


# ---- 2 ------------------------------------------------------------------------------------


def brute_nearest(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.array(v, np.float32).astype(float))), None)
    norm = {key: np.sqrt(sum(x * x for x in key[1])) for key in good}
    out = {}
    for q in good:
        if q[0] % every == 0:
            near = sorted(
                (-sum(x * y for x, y in zip(q[1], c[1])) / (norm[q] * norm[c]), c[0]) for c in good if c[0] != q[0] and len(c[1]) == len(q[1])
            )[:k]
            out.update({(q[0], n): (c, -s) for n, (s, c) in enumerate(near, 1)})
    return out


def test_nearest_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(1000 + i, [1.0] + [0.0] * 15) for i in range(60)] + [(2000 + i, [2.0] + [0.0] * 15) for i in range(3)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [float("inf")] * 16), (3050, [None] * 16)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 1.0]), (None, rows[0][1]), rows[5], (5000, [1e-30] * 16), (5050, [-1.0])]
    given = frame(spark, rows, "vec_id long, embedding array<float>").withColumns({"q": F.lit(1), "c": F.lit(2), "label": F.lit(3)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(given, 50, 5).collect()}
    want = brute_nearest(rows, 50, 5)
    assert got.keys() == want.keys()
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.98 * len(want)
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want if got[k][0] == want[k][0])
    assert neighbours.nearest(frame(spark, [], "vec_id long, embedding array<float>")).collect() == []


# ---- 5 ------------------------------------------------------------------------------------


def test_planted_items_are_found_and_nothing_else(spark):
    rng = random.Random(8)
    pool = [f"{a}{b}{c}" for a in "bkmtr" for b in "aeiou" for c in "nslx"]
    items = [(i, prose(rng, rng.choice([2, 4, 6, 7, 9, 15, 30, 80]), pool)) for i in range(60)] + [(90, None), (91, ""), (92, "!!")]
    docs, plan = [], {}
    for d in range(300):
        i, item = items[d % 60]
        w = item.split()
        for _ in range(int(0.2 * len(w) * (d % 3) / 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([["qqq"], [], [w[k], "qqq"]])
        around = prose(rng, 120, pool).split()
        k = rng.randrange(len(around))
        docs.append((d, " ".join(around[:k] + [x.capitalize() for x in w] + around[k:])))
        plan[d] = i
    docs += [(1000 + d, prose(rng, 200, pool)) for d in range(50)] + [(2000 + i, t) for i, t in enumerate(EDGES)] + [(None, items[5][1])]
    given, marks = frame(spark, docs).withColumn("words", F.lit(1)).repartition(4), frame(spark, items, "item_id long, text string").withColumn("n", F.lit(0))
    got = decontaminate.matches(given, marks).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    hit = [(d, i) in found for d, i in plan.items()]
    assert sum(hit) >= 0.95 * len(hit)
    assert all((d, i) in found for d, i in plan.items() if d % 3 == 0)  # exact copies
    text, item = dict(docs), dict(items)
    for (d, i), r in found.items():  # every answer holds by its own span
        span = plain_words(pa.array([text[d]]))[0][r.first_word : r.last_word + 1]
        mark = plain_words(pa.array([item[i]]))[0]
        table = list(range(len(span) + 1))
        for a, x in enumerate(mark, 1):
            before, table[0] = table[0], a
            for b, y in enumerate(span, 1):
                before, table[b] = table[b], min(table[b] + 1, table[b - 1] + 1, before + (x != y))
        assert table[-1] == r.distance <= 0.2 * len(mark) and r.item_words == len(mark)
    clean = {r.doc_id for r in decontaminate.clean(given, marks).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in found}
    none = marks.filter("false")
    assert decontaminate.matches(given, none).collect() == [] and decontaminate.clean(given, none).count() == len(docs)
    assert decontaminate.matches(frame(spark, []), marks).collect() == []


# ---- 6 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size, edits", [(5, 1), (6, 1), (7, 1), (8, 1), (10, 2), (12, 2), (15, 3), (20, 4), (30, 6), (60, 12)])
def test_recall_by_length_and_errors(size, edits):
    """Passages with as many errors as are allowed, none of them an exact copy."""
    rng = random.Random(size)
    pool = [f"w{i}" for i in range(5_000)]
    items = [[rng.choice(pool) for _ in range(size)] for _ in range(200)]
    index = decontaminate.ItemIndex(list(range(200)), [" ".join(x) for x in items], 0.95, 0.65, 0.2)
    texts = []
    for item in items:
        x = list(item)
        for _ in range(edits):
            k, kind = rng.randrange(len(x)), rng.random()
            x[k : k + (kind < 0.75)] = [] if 0.5 <= kind < 0.75 else ["z"]
        around = [[rng.choice(pool) for _ in range(rng.randrange(5, 40))] for _ in range(2)]
        texts.append(" ".join([*around[0], *x, *around[1]]))
    found = index.verified(*plain_words(pa.array(texts)))
    assert sum((k, k) in found for k in range(200)) >= 0.95 * 200


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(9)
    bad = ["scumbo", "vilox", "gruntz"]
    docs, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randrange(3, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "en" if i % 2 else "fr"))
        labels.append((i, int(toxic)))
    docs += [(2000 + i, t, None) for i, t in enumerate(EDGES)] + [(None, "ba vilox", "en"), (0, "again", "en")]
    labels += [(5, None), (None, 1), (8, 1)]
    given = frame(spark, docs, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "held": F.lit(1)})
    marks = frame(spark, labels, "doc_id long, toxic int")
    fit = F.col("doc_id") % 3 != 1
    model = toxicity.train(given.filter(fit), marks.filter(fit))
    got = toxicity.flag_by_language(toxicity.score(given, model), model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r.score for r in got if r.doc_id is not None and r.doc_id >= 2000}
    assert by_id[2000] == by_id[2001] == by_id[2002] < 0.7
    one = toxicity.train(given, marks.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(given, one).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), toxicity.train(frame(spark, [], "doc_id long, text string, lang string"), marks)).collect() == []


def test_forms_of_a_stem_are_learned_in_every_language(spark):
    """Toxic words are new forms of stems that the fitted texts hold; each language has its own."""
    rng = random.Random(12)
    stems = {"de": "achlich", "fr": "réeux", "es": "boment"}
    rows, labels = [], []
    for i in range(1500):
        lang, toxic = ("de", "fr", "es")[i % 3], i % 5 == 0
        w = prose(rng, rng.randrange(3, 60)).split()
        if toxic:
            w.insert(rng.randrange(len(w)), stems[lang] + "".join(rng.choice("abcdefgh") for _ in range(4)))
        rows.append((i, " ".join(w), lang))
        labels.append((i, int(toxic)))
    docs, marks = frame(spark, rows, "doc_id long, text string, lang string"), frame(spark, labels, "doc_id long, toxic int")
    fit = F.col("doc_id") % 4 != 1
    model = toxicity.train(docs.filter(fit), marks.filter(fit))
    held = toxicity.score(docs.filter(~fit), model).collect()
    for lang in stems:
        mine = [r for r in held if r.lang == lang]
        toxic = [r.predicted for r in mine if r.doc_id % 5 == 0]
        clean = [r.predicted for r in mine if r.doc_id % 5]
        assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean), lang


def test_toxicity_is_learned_from_every_labelled_text(spark):
    """More rows of each class than a sample of some thousand would hold, so the fit goes over several blocks."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(15_000):
        w = prose(rng, rng.randrange(3, 12)).split()
        toxic = i % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), "scumbo" if i % 300 else f"vilox{'abc'[i % 9 // 3]}")
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    docs, marks = frame(spark, rows, "doc_id long, text string, lang string"), frame(spark, labels, "doc_id long, toxic int")
    counted, sums = [], toxicity.task_sums

    def counting(blocks, run):
        counted.append(sum(len(toxicity._unpacked(r.body)[2]) for r in blocks.select("body").collect()))
        return sums(blocks, run)

    toxicity.task_sums = counting
    try:
        model = toxicity.train(docs, marks, epochs=2)
    finally:
        toxicity.task_sums = sums
    clean = sum(1 for i, _ in labels if i % 3)
    assert len(set(counted)) == 1 and counted[0] > 0.7 * len(rows) + 0.7 * clean / 4  # three quarters of the rows, and stretches
    asked = frame(spark, [(0, "ba ko viloxa"), (1, "bara kora"), (2, "scumbo bara")])
    assert [r.predicted for r in toxicity.score(asked, model).orderBy("doc_id").collect()] == [1, 0, 1]


def test_thresholds_and_line_are_those_of_sorted_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(("a", "b", "none")[i % 3], float(round(x, 2)), int(i % 3 < 2 and x + rng.normal() > 1)) for i, x in enumerate(rng.normal(size=900))]
    got = {r.key: (r.total, r.threshold) for r in toxicity.best_thresholds(frame(spark, rows, "key string, score double, label int")).collect()}
    for key in ("a", "b", "none"):
        mine = [(s, t) for k, s, t in rows if k == key]
        total, values = sum(t for _, t in mine), sorted({s for s, _ in mine}, reverse=True)
        if not total:
            assert got[key] == (0, values[0] + 1)
            continue
        f1 = [2 * sum(t for s, t in mine if s >= v) / (sum(s >= v for s, _ in mine) + total) for v in values]
        k = f1.index(max(f1))
        assert got[key] == (total, pytest.approx((values[k] + (values[k + 1] if k + 1 < len(values) else values[k] - 1)) / 2))
    a, b = toxicity.platt(frame(spark, rows, "key string, score double, label int"))
    z, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    off = 1 / (1 + np.exp(-(a * z + b))) - t
    assert abs(off.sum()) < 1e-3 and abs((off * z).sum() + 1e-3 * a) < 1e-3


def test_pooling_stays_inside_a_text():
    net = toxicity.Classifier()
    tables = net.tables()
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, toxicity.NOTHING + 1, (n, toxicity.PARTS)).astype(np.int32) for n in (0, 1, 2, 5, 0, 3, 1)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    together = toxicity.logits(tables, np.concatenate(lists), at)
    alone = [toxicity.logits(tables, x, np.array([0, len(x)]))[0] for x in lists]
    assert np.allclose(together, alone, atol=1e-5)


def test_logits_are_those_of_a_slow_convolution():
    net = toxicity.Classifier()
    rng = np.random.default_rng(4)
    for k in toxicity.WIDTHS:
        net.b[k] = rng.normal(0, 0.3, toxicity.FILTERS).astype(np.float32)
    net.c = np.float32(0.4)
    lists = [rng.integers(0, toxicity.NOTHING + 1, (n, toxicity.PARTS)).astype(np.int32) for n in (0, 1, 2, 7, 30)]
    got = toxicity.logits(net.tables(), np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
    for words, z in zip(lists, got, strict=True):
        x = [sum(net.e[b] for b in parts) for parts in words]
        features = []
        for k in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                windows = [sum(float(x[i + o] @ net.w[k][o][:, f]) for o in range(k)) + float(net.b[k][f]) for i in range(len(x) - k + 1)]
                features.append(max([0.0, *windows]))
        assert z == pytest.approx(float(np.dot(features, net.v) + net.c), abs=1e-4)


def test_beginnings_of_words_share_buckets():
    words, at = toxicity.word_buckets(pa.array(["Achlicher achlichzu a", None, "achl", "réeuxpa"]))
    assert at.tolist() == [0, 3, 3, 4, 5]
    assert (words[0, 1:3] == words[1, 1:3]).all() and words[0, 0] != words[1, 0]
    assert (words[2, 1:] == toxicity.NOTHING).all() and (words[3, 1:] == toxicity.NOTHING).all()


# ---- 7 ------------------------------------------------------------------------------------


def licence_sentences():
    """Template sentences with the family that each names on its own; one that several families have names none."""
    every = [t for ts in licences.TEMPLATES.values() for t in ts]
    return [(k if every.count(t) == 1 else "unknown", t) for k, ts in licences.TEMPLATES.items() for t in ts]


def test_licences(spark):
    rng = random.Random(10)
    docs, want = [], {}
    sentences = licence_sentences()
    for i in range(120):
        parts = [prose(rng, rng.randrange(5, 40)) for _ in range(4)]
        if i % 2:
            family, text = sentences[i % len(sentences)]
            parts.insert(i % 5, text)
            want[(i, i % 5)] = family
        docs.append((i, "\n".join(parts)))
    docs += [(500 + i, t) for i, t in enumerate(EDGES)] + [(None, "x\nReleased under the MIT License."), (700, "All rights reserved.")]
    given = frame(spark, docs).withColumn("family", F.lit("z"))
    model = licences.train(given)
    got = licences.scan(given, model).collect()
    found = {(r.doc_id, r.paragraph): r for r in got}
    assert all(found[k].family == f and found[k].confirmed == (f != "unknown") for k, f in want.items())
    assert found[(None, 1)].family == "MIT" and found[(700, 0)].family == "unknown"
    assert set(found) == set(want) | {(None, 1), (700, 0)}
    assert licences.scan(frame(spark, []), model).collect() == []


MIT_TEXT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_TEXT = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//    * Neither the name of the copyright holder nor the names of its
//      contributors may be used to endorse or promote products derived from
//      this software without specific prior written permission."""
GPL_TEXT = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


def test_hard_wrapped_licences(spark):
    rng = random.Random(30)
    wrapped = {0: (MIT_TEXT, [(4, "MIT")]), 1: (BSD_TEXT, [(0, "BSD-3-Clause"), (4, "BSD-3-Clause")]), 2: (GPL_TEXT, [(0, "GPL-3.0")])}
    docs = [(i, t + "\n\n" + prose(rng, 30)) for i, (t, _) in wrapped.items()]
    # between lines of a paragraph, and two notices that follow each other in one
    docs += [(10 + i, f"{prose(rng, 12)}\n{t}\n{prose(rng, 12)}") for i, (t, _) in wrapped.items()]
    docs += [(20, f"{GPL_TEXT}\n{MIT_TEXT}"), (21, "Licensed under the MIT\nLicense. Licensed under the\nApache License, Version\n2.0.")]
    docs += [(100 + i, prose(rng, 200)) for i in range(40)]
    got = licences.scan(frame(spark, docs), licences.train(frame(spark, docs))).collect()
    found = sorted((r.doc_id, r.paragraph, r.family) for r in got if r.confirmed)
    want = [(i, k, f) for i, (_, at) in wrapped.items() for k, f in at] + [(10 + i, 1 + k, f) for i, (_, at) in wrapped.items() for k, f in at]
    assert found == sorted(want + [(20, 0, "GPL-3.0"), (20, 8, "MIT"), (21, 0, "MIT"), (21, 1, "Apache-2.0")])
    assert all(r.doc_id < 100 for r in got)


def test_licences_in_long_lines(spark):
    rng = random.Random(31)
    docs, want = [(1_000 + i, prose(rng, 300)) for i in range(40)], set()
    sentences = licence_sentences() + [("unknown", "All rights reserved.")]
    for size in (100, 1_000, 20_000):
        for family, text in sentences:
            i, before = len(docs), rng.randrange(size)
            docs.append((i, f"{prose(rng, before)} {text} {prose(rng, size - before)}"))
            want.add((i, 0, family))
    docs.append((len(docs), " ".join(f"{t} {prose(rng, 90)}" for _, t in sentences)))
    want |= {(docs[-1][0], 0, k) for k, _ in sentences}
    # words about rights that are no template, far from the start
    docs.append((len(docs), f"{prose(rng, 700)} subject to the terms of the license agreement of the publisher {prose(rng, 700)}"))
    want.add((docs[-1][0], 0, "unknown"))
    model = licences.train(frame(spark, docs[:60]))
    got = licences.scan(frame(spark, docs), model).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want and len(got) == len(want)


BSD_2_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met."""
NAMES = {
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    BSD_2_TEXT: "unknown",
    "either version 2.1 of the GNU Lesser General Public License as published by the Free Software Foundation": "unknown",
    "This library is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.": "LGPL-2.1",
    "This work is licensed under the GNU General Public License, version 1.": "unknown",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY 3.0.": "CC-BY-3.0",
    "Licensed under CC BY 2.5.": "unknown",
    "This work is licensed under a Creative Commons Attribution 3.0 International License.": "CC-BY-3.0",
    "Licensed under the Mozilla Public License, version 1.1.": "MPL-1.1",
    "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "Licensed under the Apache Software License, Version 1.1.": "Apache-1.1",
    "SPDX-License-Identifier: ISC": "ISC",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
    "SPDX-License-Identifier: Zlib": "unknown",
}


def test_versions_and_families_are_told_apart(spark):
    """On a model fitted on the given documents; what names no family of the templates confirms none."""
    model = licences.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = list(NAMES)
    got = {i: set() for i in range(len(texts))}
    for r in licences.scan(frame(spark, list(enumerate(texts))), model).collect():
        got[r.doc_id].add(r.family if r.confirmed else "unknown")
    wrong = {t: got[i] for i, t in enumerate(texts) if got[i] - {NAMES[t]} or (NAMES[t] != "unknown" and not got[i])}
    assert not wrong
    shared = licences.scan(frame(spark, [(1, BSD_2_TEXT)]), model).first()
    assert set(shared.guess.split("|")) == {"BSD-2-Clause", "BSD-3-Clause"}


def test_licence_stretches_are_those_of_a_search():
    f = licences.Features(licences.TEXTS)
    rng = random.Random(32)
    pool = [w for t in licences.TEXTS[:8] for w in licences.words_of(t)]
    lists = [[rng.choice(pool) if rng.random() < 0.8 else "zz" for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    lists += [licences.words_of(t) for t in licences.TEXTS]
    number = f.numbers(plain_words(pa.array([" ".join(x) for x in lists]))[0])
    at = np.cumsum([0] + [len(x) for x in lists])
    got = f.near(number, at, 0.6)
    for x, a, b in zip(lists, at[:-1], at[1:], strict=True):
        like = False
        for t, pairs, reach in zip(licences.TEXTS, f.pairs, f.reach, strict=True):
            w = licences.words_of(t)
            own = set(zip(w, w[1:]))
            like |= any(len(own & set(zip(x[i : i + reach], x[i + 1 : i + reach]))) >= 0.6 * len(own) - 1e-9 for i in range(len(x)))
        assert like == any(a <= c and d <= b for c, d in got)
    assert not any(c < e < d for c, d in got for e in at)


def test_licence_logits_are_the_sums_of_the_ngrams():
    texts = ["Licensed under the MIT License.", "the the License of", "", "nothing here", "MIT License MIT License"]
    model = licences.Classifier(licences.Features([t for ts in licences.TEMPLATES.values() for t in ts]), list(licences.TEMPLATES))
    model.w = np.random.default_rng(1).normal(size=model.w.shape)
    got = model.logits(*plain_words(pa.array(texts)))
    f = model.features
    place = {w: i for i, w in enumerate(f.words)}
    spot = {int(g): i for i, g in enumerate(f.grams)}
    for t, z in zip(texts, got, strict=True):
        w = licences.words_of(t)
        grams = {tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
        keys = {f._key([place[x] for x in g], f.base) for g in grams if all(x in place for x in g)}
        total = sum((model.w[spot[k]] for k in keys if k in spot), np.zeros(len(model.classes)))
        assert np.allclose(z, total / np.sqrt(max(1, len(w))))


# ---- 9 ------------------------------------------------------------------------------------


def brute_sections(vocab, text, rule):
    raw = (text or "").encode()
    bounds = [0] + [i + 1 for i, c in enumerate(raw) if c == 10 and i + 1 < len(raw)]
    of = [max(k for k, b in enumerate(bounds) if b <= i) for i in range(len(raw))]
    out, at = [[0, 0, 0] for _ in bounds], 0
    for token in vocab.encoder.encode_ordinary(text or ""):
        n = len(vocab.encoder.decode_single_token_bytes(token))
        c = Counter(of[at : at + n])
        k = {"first": of[at], "last": of[at + n - 1], "most": min(c, key=lambda x: (-c[x], x))}[rule]
        at += n
        out[k][0] += 1
        out[k][1] += len(c) > 1
    for i, b in enumerate(raw):
        out[of[i]][2] += b & 0xC0 != 0x80
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_hold_the_tokens_of_the_whole(spark, rule):
    vocab = token_counts.ByteVocabulary(open(queries.BYTE_BPE, "rb").read())
    rng = random.Random(11)
    texts = [t for t in EDGES if t != LONG] + ["".join(rng.choices("ab é\n\n\n \t中x.'", k=rng.randrange(50))) for _ in range(120)]
    given = frame(spark, list(enumerate(texts))).withColumn("section", F.lit(1)).repartition(3)
    got = {}
    for r in token_counts.line_tokens(given, queries.BYTE_BPE, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = [r.n_tokens, r.n_crossing, r.n_chars]
    for i, t in enumerate(texts):
        assert [got[i][k] for k in sorted(got[i])] == brute_sections(vocab, t, rule)


def test_fields(spark):
    given = frame(spark, [(1, "a b", "c\nd", None), (2, None, None, None), (None, "é", "x", "y")], "doc_id long, t string, u string, w string")
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_chars) for r in token_counts.field_tokens(given, queries.BYTE_BPE, ["t", "u", "w"]).collect()}
    assert got[1, 0] == (3, 4) and got[1, 1] == (4, 4) and got[None, 1] == (2, 2) and sum(n for (i, _), (n, _c) in got.items() if i == 2) == 2
    assert token_counts.line_tokens(frame(spark, []), queries.BYTE_BPE).collect() == []
    with pytest.raises(ValueError):
        token_counts.line_tokens(given, queries.BYTE_BPE, "middle")


# ---- pipeline -----------------------------------------------------------------------------


def test_pipeline_is_its_stages_by_brute_force(spark):
    rng = random.Random(12)
    passage, item = prose(rng, 60), prose(rng, 25, [f"m{i}" for i in range(40)])
    base = prose(rng, 90)
    rows = [
        (1, f"{prose(rng, 40)}\n{passage}"), (2, f"{prose(rng, 40)}\n{passage}"), (3, passage), (4, base), (5, base + " more"),
        (6, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (7, None), (8, ""), (9, "12 34"), (10, "a"), (11, prose(rng, 300)), (12, base.upper()),
    ]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    folder = spark.conf.get("spark.checkpoint.dir") + "/pipeline_fixture"
    frame(spark, full, DOCS).withColumns({"score": F.lit(1), "gone": F.lit(2)}).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    frame(spark, [(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    ids = {n: None for n, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe_encode_decode":
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        ids[name] = sorted(r.doc_id for r in docs.collect())
    assert ids["language_id"] == [r[0] for r in kept]
    cut = brute_lines(kept, 50)
    left = [(r[0], cut[r]) for r in kept if cut[r].strip() or cut[r] == r[1]]
    assert ids["line_dedup"] == [i for i, _ in left]
    assert ids["ngram_jaccard_join"] == sorted({c for _, _, c in brute_jaccard(left)})
    assert ids["benchmark_decontamination"] == [i for i in ids["ngram_jaccard_join"] if i != 6]
    library = Tokenizer.from_file(queries.WORD_BPE)
    text = dict(left)
    want = {i: len(library.encode(text[i], add_special_tokens=False).ids) for i in ids["benchmark_decontamination"]}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_pipeline_on_odd_and_empty_tables(spark):
    rng = random.Random(13)
    passage = prose(rng, 60)
    rows = [(1, f"first line\n{passage}"), (2, f"{passage}\n\n \t\n"), (None, "a null id stays until ids are needed"), (3, LONG)]
    full = [(i, t, "en", "s", len(t)) for i, t in rows]
    folder = spark.conf.get("spark.checkpoint.dir") + "/pipeline_edges"
    frame(spark, full, DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    frame(spark, [], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id for r in docs.collect()}
    # of the second document only blank lines are left
    assert seen["line_dedup"] == seen["ngram_jaccard_join"] == seen["benchmark_decontamination"] == {1, 3, None}
    assert seen["bpe_encode_decode"] == {1, 3}
    frame(spark, [], DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_nearest_vectors_equal_the_sql_over_all_pairs(spark):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op2_nearest_vectors(spark, SF).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(db.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.NEAREST_SQL})").fetchall())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_words_are_scored_in_blocks_of_bounded_size(monkeypatch):
    sizes, forward = [], language_id.forward

    def measured(*args):
        out = forward(*args)
        sizes.append(out.size)
        return out

    monkeypatch.setattr(language_id, "forward", measured)
    lattice = language_id.Lattice(["a", "b", "ab", "ba"])
    chance = np.full((lattice.count, 4), 0.2)
    words = [f"{i:b}".replace("0", "a").replace("1", "b").rjust(18, "a") for i in range(40_000)]
    whole = language_id.log_chances(lattice, words, chance)
    assert len(sizes) > 1 and max(sizes) <= language_id.SUMS
    assert (whole[::5_000] == language_id.log_chances(lattice, words[::5_000], chance)).all()


def test_the_driver_gives_memory_back_after_fitting_languages(spark, monkeypatch):
    done, train, give_back = [], language_id.train, language_id.give_back
    monkeypatch.setattr(language_id, "train", lambda *x: (train(*x), done.append("fit"))[0])
    monkeypatch.setattr(language_id, "give_back", lambda: (give_back(), done.append("back"))[0])
    docs = frame(spark, [(i, ("the cat and the dog", "le chat et le chien")[i % 2], ("en", "fr")[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    language_id.identify(docs, queries.PIECES)
    assert done == ["fit", "back"]
