import math
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.functions import vectors
from lectern.operators import blocks, bm25, ranking, retrieval, vector_index, vector_search
from lectern.operators.chunks import with_embedding
from lectern.operators.vector_search import vector_top_k
from lectern.plans import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the embedders below run in workers

TEXTS = [
    "a loop repeats the body", "the list holds the items", "a tuple holds items and stays",
    "the the the the", "recursion calls the function", "a loop and a list and a tuple",
    "numbers only 1 2 3", "the body of a loop", "alone",
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, chunk_text string")
    return with_embedding(df.repartition(3)).cache()


@pytest.fixture(scope="module")
def index(chunks):
    return bm25.bm25_index(chunks)


def bm25_model(queries, k, with_zero=False):
    docs = [t.split() for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for q, body in queries:
        scores = []
        for i, d in enumerate(docs):
            tf = Counter(d)
            terms = [t for t in body.split() if t in tf]
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in terms)
            if terms or with_zero:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def ranked(rows, query="query_id", item="chunk_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r[query], r["rank"])):
        out.setdefault(r[query], []).append((r[item], r["score"]))
    return out


QUERIES = [(1, "a loop"), (2, "the the list"), (3, "tuple items unknown"), (4, "nothing here"), (5, "")]


@pytest.mark.parametrize("broadcast_rows", [1000, 2])
@pytest.mark.parametrize("with_zero", [False, True])
def test_bm25_brute_force(spark, index, broadcast_rows, with_zero):
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = ranked(bm25.bm25_top_k(asked, index, 4, with_zero=with_zero, broadcast_rows=broadcast_rows).collect())
    want = bm25_model(QUERIES, 4, with_zero)
    for q, rows in got.items():
        assert [i for i, _ in rows] == [i for i, _ in want[q]]
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]], abs=2e-6)
    assert set(got) == {1, 2, 3}


def test_cached_index_follows_the_corpus(spark, chunks, index, tmp_path):
    path = str(tmp_path / "index")
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    want = ranked(bm25.bm25_top_k(asked, index, 3).collect())
    for _ in range(2):
        assert ranked(bm25.bm25_top_k(asked, bm25.cached_index(chunks, path), 3).collect()) == want
    assert ranked(bm25.bm25_top_k(asked, index.stored(), 3).collect()) == want
    changed = chunks.withColumn("chunk_text", F.replace("chunk_text", F.lit("loop"), F.lit("cycle")))
    again = bm25.cached_index(changed, path)
    assert again.frequencies.filter("term = 'loop'").isEmpty()
    assert not again.frequencies.filter("term = 'cycle'").isEmpty()
    named = bm25.cached_index(chunks, path, mark="v1")
    kept = bm25.cached_index(changed, path, mark="v1")  # the same name: what is stored is used
    assert not kept.frequencies.filter("term = 'loop'").isEmpty()
    assert named.frequencies.count() == kept.frequencies.count()


def test_empty_queries(spark, index, chunks):
    none = spark.createDataFrame([], "query_id long, text string")
    assert bm25.bm25_top_k(none, index, 3).count() == 0
    empty = chunks.filter("chunk_id < 0").withColumn("query_id", F.col("chunk_id"))
    assert vector_top_k(empty, chunks, 3).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1000, 7])
def test_vectors_brute_force(spark, broadcast_rows):
    rng = np.random.default_rng(5)
    data = rng.integers(-3, 4, (60, 6)).astype(float)
    data[7] = 0  # a failed embedding
    data[21] = data[20]  # an exact tie
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    items = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    asked = items.withColumnRenamed("chunk_id", "query_id")
    got = ranked(vector_top_k(asked, items, 5, broadcast_rows=broadcast_rows).collect())
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-9)
    sims = np.round(unit @ unit.T, 6)
    assert 7 not in got and len(got) == 59
    for q, found in got.items():
        order = sorted((-sims[q, i], i) for i in range(60) if i != 7)[:5]
        assert [i for i, _ in found] == [i for _, i in order]


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(50)]
    items = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = items.withColumnRenamed("chunk_id", "query_id")
    want = ranked(vector_top_k(asked, items, 3).collect())
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 300)
    found = vector_top_k(asked, items, 3)
    assert ranked(found.collect()) == want


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in middles[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(300)]
    items = spark.createDataFrame([*rows, (999, [0.0] * 8)], "chunk_id long, embedding array<float>")
    index = vector_index.build_vector_index(items, str(tmp_path / "ix"), 6)
    assert index.cells.count() == 300
    asked = items.withColumnRenamed("chunk_id", "query_id")
    exact = vector_top_k(asked, items, 5)
    every = vector_index.probe_top_k(asked, index, 5, probes=6)
    assert ranked(every.collect()) == ranked(exact.collect())
    near = vector_index.probe_top_k(asked, index, 5, probes=1)
    assert ranked(near.collect()) == ranked(exact.collect())
    assert vector_index.recall(near, exact, "query_id", "chunk_id").first()["recall"] == 1.0
    in_cells = vector_index.probe_top_k(asked, index, 5, probes=1, broadcast_rows=40)
    assert ranked(in_cells.collect()) == ranked(exact.collect())
    corpus = retrieval.SearchCorpus(items.withColumn("chunk_text", F.lit("x")), None, embedder=Flat(), vectors=index)
    text = spark.createDataFrame([(1, 0, "question", "any")], "question_id long, rewrite_idx int, kind string, text string")
    assert retrieval.hybrid_hits(text, corpus, 3).count() == 3


def test_cells_that_stay_closed_hold_no_nearer_row():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres, rows, asked = unit(rng.normal(size=(9, 4))), unit(rng.normal(size=(400, 4))), unit(rng.normal(size=(50, 4)))
    cell = (rows @ centres.T).argmax(axis=1)
    reach = np.array([np.arccos(np.clip((rows @ centres.T)[cell == c, c], -1, 1)).max(initial=0) for c in range(9)])
    for k in (1, 5, 40):
        scores = asked @ rows.T
        bars = np.sort(scores, axis=1)[:, -k]
        read = vector_index.open_cells(asked, bars, centres, reach, 2) | vector_index.nearest_cells(asked, centres, 2)
        for q in range(50):
            assert set(cell[scores[q] >= bars[q]]) <= set(np.flatnonzero(read[:, q]))
        assert k > 5 or read.mean() < 0.9


class Flat:
    dim = 8

    def encode(self, texts):
        return np.ones((len(texts), 8))


def test_string_ids(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])]
    items = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    got = ranked(vector_top_k(items.withColumnRenamed("chunk_id", "query_id"), items, 2).collect())
    assert [i for i, _ in got["c"]] == ["c", "a"]
    assert [i for i, _ in got["a"]] == ["a", "b"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine(F.col("b"), F.col("a")).alias("y")
    ).collect()
    assert rows[0]["x"] == pytest.approx(1.0) and rows[1]["x"] == 0.0
    assert all(r["x"] == r["y"] for r in rows)


class Failing:
    dim = 4

    def encode(self, texts):
        raise RuntimeError("no model")


def test_dedupe_by_chunk_id(spark, chunks, index):
    same = chunks.withColumn("chunk_text", F.concat(F.lit("x" * 100), "chunk_text"))
    asked = spark.createDataFrame([(1, 0, "question", "a loop")], "question_id long, rewrite_idx int, kind string, text string")
    found = {}
    for on in ("chunk_text", "chunk_id"):
        corpus = retrieval.SearchCorpus(same, index, settings=Settings(dedupe_on=on))
        found[on] = retrieval.multi_query_candidates(asked, corpus, 3).count()
    assert found["chunk_text"] == 1 and 3 <= found["chunk_id"] <= 6


def test_an_outage_fails_and_one_bad_text_does_not():
    class Picky:
        dim = 2

        def __init__(self, bad):
            self.bad, self.calls = bad, 0

        def encode(self, texts):
            self.calls += 1
            if any(self.bad(t) for t in texts):
                raise RuntimeError("no")
            return np.ones((len(texts), 2))

    one = Picky(lambda t: t == "x")
    assert vectors.encode_all(one, ["a"] * 40 + ["x"] + ["b"] * 40).sum() == 160
    all_bad = Picky(lambda t: True)
    assert not vectors.encode_all(all_bad, ["a"] * 1000).any()

    class Down(Picky):
        def encode(self, texts):
            self.calls += 1
            raise vectors.ModelDown("no server")

    down = Down(lambda t: True)
    with pytest.raises(vectors.ModelDown):
        vectors.encode_all(down, ["a"] * 1000)
    assert down.calls == 1


def test_failed_embedding_is_marked(spark):
    df = spark.createDataFrame([(1, "x")], "chunk_id long, chunk_text string")
    row = with_embedding(df, Failing()).first()
    assert row["embedding"] == [0.0] * 4 and row["embed_ok"] is False


def test_dedupe_by_prefix(spark):
    rows = [(1, "q", "x" * 100 + "a", 2), (2, "q", "x" * 100 + "b", 1), (3, "q", "y", 3), (4, "r", "y", 1)]
    df = spark.createDataFrame(rows, "id int, q string, t string, o int")
    once = ranking.dedupe_by_prefix(df, ["q"], "t", [F.col("o").asc()])
    assert sorted(r["id"] for r in once.collect()) == [2, 3, 4]
    twice = ranking.dedupe_by_prefix(once, ["q"], "t", [F.col("o").asc()])
    assert sorted(r["id"] for r in twice.collect()) == [2, 3, 4]
    whole = ranking.dedupe_by_prefix(df, ["q"], "t", [F.col("o").asc()], None)
    assert whole.count() == 4


def test_top_k_in_slices(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    order = [F.col("v").desc()]
    plain = ranking.top_k(df, ["k"], order, 4).collect()
    spread = ranking.top_k(df, ["k"], order, 4, spread_by="v", slices=5).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, spread))


def test_grades(spark):
    asked = spark.createDataFrame([(i,) for i in range(6)], "question_id int")
    rows = [(0, 0.25), (1, 0.2501), (2, 0.01), (3, 0.0099), (4, None)]
    found = spark.createDataFrame(rows, "question_id int, score double")
    got = {r["question_id"]: r["grade"] for r in retrieval.grade_by_score(asked, found).collect()}
    assert got == {0: "ambiguous", 1: "correct", 2: "ambiguous", 3: "incorrect", 4: "ambiguous", 5: "incorrect"}


class Fixed:
    """Vectors by the first letter, to put cosines where a test needs them."""

    dim = 2
    table = {"q": (1, 0), "h": (1, 0), "m": (1, 1), "l": (0, 1), "z": (0, 0)}

    def encode(self, texts):
        return np.array([self.table[t[0]] for t in texts], dtype=float).reshape(len(texts), 2)


class Picky(Fixed):
    def encode(self, texts):
        if any(t.startswith("bad") for t in texts):
            raise RuntimeError("cannot read this")
        return super().encode(texts)


def test_one_bad_text_does_not_cost_its_batch(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["high", "bad", "low"])], "chunk_id long, chunk_text string")
    rows = with_embedding(df.coalesce(1), Picky()).orderBy("chunk_id").collect()
    assert [r["embedding"] for r in rows] == [[1, 0], [0, 0], [0, 1]]
    assert [r["embed_ok"] for r in rows] == [True, False, True]


HIGH, MID, LOW = "high sentence is here.", "middle sentence is here.", "low sentence is here."


@pytest.mark.parametrize(
    "question, body, want",
    [
        ("q", HIGH, HIGH),  # one sentence
        ("q", f"{LOW} {HIGH} {MID}", f"{HIGH} {MID}"),  # two pass: order of the text
        ("q", f"{LOW} {LOW} {HIGH}", f"{HIGH} {LOW}"),  # one passes: best first
        ("q", f"{LOW} {LOW} {LOW}", f"{LOW} {LOW}"),  # none passes
        ("z", f"{LOW} {HIGH} {MID}", f"{LOW} {HIGH} {MID}"),  # the question has no vector
        ("q", "short. tiny.", "short. tiny."),  # nothing long enough
    ],
)
def test_compress(spark, question, body, want):
    df = spark.createDataFrame([(1, question, body)], "question_id int, question string, chunk_text string")
    assert retrieval.compress(df, "question", Fixed()).first()["compressed"] == want


def test_compress_document_order(spark):
    df = spark.createDataFrame([(1, "q", f"{LOW} {LOW} {HIGH}")], "question_id int, question string, chunk_text string")
    got = retrieval.compress(df, "question", Fixed(), Settings(compress_document_order=True)).first()["compressed"]
    assert got == f"{LOW} {HIGH}"


def test_multistage_keeps_every_question(spark, chunks, index):
    corpus = retrieval.SearchCorpus(chunks, index, settings=Settings(candidates_per_query=3, rerank_k=2))
    rows = [(1, "a loop repeats", None, None), (2, "zzz yyy", None, None), (3, "", None, None)]
    asked = spark.createDataFrame(rows, "question_id long, question string, raw_rewrites string, pseudo_answer string")
    got = {r["question_id"]: r for r in search.retrieve_multistage(asked, corpus).collect()}
    assert got[1]["grade"] == "correct" and got[1]["sources"][0]["chunk_id"] == 0
    assert got[2]["grade"] == "incorrect" and got[2]["context"] == "" and got[2]["sources"] is None
    assert got[2]["top_score"] == 0.0
    assert got[3]["grade"] == "incorrect" and got[3]["num_docs"] == 0


def test_trace_stages(spark, chunks, index):
    corpus = retrieval.SearchCorpus(chunks, index)
    rows = [(1, "a loop repeats", '["the body of a loop", "a list"]', "loops repeat"), (2, "", None, None)]
    asked = spark.createDataFrame(rows, "question_id long, question string, raw_rewrites string, pseudo_answer string")
    traced = search.trace(asked, corpus)
    kinds = [r["kind"] for r in traced.rewrites.filter("question_id = 1").orderBy("rewrite_idx").collect()]
    assert kinds == ["question", "rewrite", "rewrite", "pseudo_answer"]
    total = traced.totals.filter("question_id = 1").first()
    assert total["unique_candidates"] == traced.candidates.filter("question_id = 1").count()
    assert total["total_with_dupes"] >= total["unique_candidates"]
    indexes = [r["cand_index"] for r in traced.candidates.filter("question_id = 1").orderBy("cand_index").collect()]
    assert indexes == list(range(len(indexes)))
    assert traced.reranked.filter("question_id = 1").count() == 5
    assert set(traced.timings) == {"rewrite_ms", "retrieval_ms", "rerank_ms", "compress_ms", "total_ms"}
    plain = search.retrieve_multistage(asked, corpus)
    assert sorted(map(str, plain.collect())) == sorted(map(str, traced.answers.collect()))


def test_missing_model_is_ambiguous(spark, chunks, index):
    corpus = retrieval.SearchCorpus(chunks, index)
    asked = spark.createDataFrame([(1, "a loop", None, None)], "question_id long, question string, raw_rewrites string, pseudo_answer string")
    row = search.retrieve_multistage(asked, corpus, retrieval.no_model_scorer).first()
    assert row["grade"] == "ambiguous" and row["top_score"] is None


def test_simple_always_answers(spark, chunks, index):
    corpus = retrieval.SearchCorpus(chunks, index)
    asked = spark.createDataFrame([(1, "a loop"), (2, "")], "question_id long, question string")
    got = {r["question_id"]: r for r in search.retrieve_simple(asked, corpus).collect()}
    assert len(got[1]["sources"]) == 5 and got[1]["context"].count("\n\n---\n\n") == 4
    assert got[2]["grade"] == "correct" and got[2]["context"] == ""


class Overlap:
    def predict(self, pairs):
        return [len(set(q.split()) & set(t.split())) / 10 for q, t in pairs]


class Broken:
    def predict(self, pairs):
        raise RuntimeError("no model")


def test_pair_models(spark, chunks, index):
    corpus = retrieval.SearchCorpus(chunks, index)
    asked = spark.createDataFrame([(1, "a loop repeats", None, None)], "question_id long, question string, raw_rewrites string, pseudo_answer string")
    good = search.retrieve_multistage(asked, corpus, retrieval.model_scorer(asked, Overlap())).first()
    assert good["top_score"] == 0.3 and good["sources"][0]["chunk_id"] == 0
    broken = search.retrieve_multistage(asked, corpus, retrieval.model_scorer(asked, Broken())).first()
    assert broken["grade"] == "ambiguous" and broken["top_score"] is None and broken["num_docs"] == 5


def test_verdicts_replace_thresholds(spark, chunks, index):
    corpus = retrieval.SearchCorpus(chunks, index)
    rows = [(i, "a loop", None, None) for i in range(4)] + [(4, "", None, None)]
    asked = spark.createDataFrame(rows, "question_id long, question string, raw_rewrites string, pseudo_answer string")
    said = spark.createDataFrame([(0, "Yes"), (1, "no."), (2, "hm"), (4, "yes")], "question_id long, verdict string")
    got = {r["question_id"]: r for r in search.retrieve_multistage(asked, corpus, verdicts=said).collect()}
    assert [got[i]["grade"] for i in range(5)] == ["correct", "incorrect", "ambiguous", "ambiguous", "incorrect"]
    assert got[1]["context"] == "" and got[0]["context"]


def test_a_batch_of_texts_is_encoded_in_pieces():
    seen = []

    class Counting(vectors.HashedWords):
        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return super().encode(texts)

    texts = ["some words of a text " * 500] * 300 + ["", "x" * (2 * vectors.PIECE_CHARS), "end"]
    found = vectors.encode_all(Counting(), texts)
    assert len(seen) > 3 and sorted(seen)[-2] <= vectors.PIECE_CHARS
    assert (found == vectors.HashedWords().encode(texts)).all()


def test_a_scorer_holds_a_bounded_number_of_scores():
    terms = pa.table({"query_id": [1, 1, 2, 3], "term": ["a", "b", "a", "c"], "weight": [1.0, 2.0, 1.0, 0.5]})
    corpus = pa.table({"id": list(range(50)), "tokens": [["a", "b", "z"], ["a"], [], ["c", "c"], ["z"]] * 10})
    scorer = bm25.Bm25Scorer(terms, 2.0, 1.5, 0.75, False)
    whole = np.concatenate([s for _, _, s in scorer.score(corpus, 1_000)])
    parts = list(scorer.score(corpus, 12))
    assert max(s.size for _, _, s in parts) <= 12 and len(parts) > 10
    np.testing.assert_array_equal(np.concatenate([s for _, _, s in parts]), whole)
    assert np.isnan(whole[2]).all() and whole[0, 0] > whole[0, 1] > 0


def test_pairs_outside_the_cells_that_a_query_reads_are_not_scored():
    centres, rows = np.array([[1.0, 0.0], [0.0, 1.0]]), [[1.0, 0.1], [0.1, 1.0], [0.9, 0.0]]
    asked = pa.table({"query_id": [7, 8, 9], "embedding": [[1.0, 0.0], [0.0, 2.0], [3.0, 0.2]]})
    corpus = pa.table({"id": [1, 2, 3], "embedding": rows, "cell": pa.array([0, 1, 0], pa.int32())})
    scorer = vector_index.ProbedScorer(asked, centres, np.array([0.5, 0.5]), 1)
    found = [(list(r), list(q), s.shape) for r, q, s in scorer.score(corpus, 100)]
    assert found == [([0, 2], [0, 2], (2, 2)), ([1], [1], (1, 1))]


def test_many_queries_do_not_copy_the_corpus(spark, index):
    asked = spark.createDataFrame([(i, f"a loop {i}") for i in range(6)], "query_id long, text string")
    got = bm25.bm25_top_k(asked, index, 4, broadcast_rows=9)
    folder = got.inputFiles()[0].rsplit("/found/", 1)[0]
    assert spark.read.parquet(f"{folder}/corpus").count() == index.docs.count()
    assert spark.read.parquet(f"{folder}/queries").count() <= 6 * 3
    assert ranked(got.collect()) == ranked(bm25.bm25_top_k(asked, index, 4).collect())


def test_common_terms_are_scored_by_a_product_with_the_same_scores(monkeypatch):
    rng = np.random.default_rng(1)
    rows = sorted({(q, int(t)) for q in range(300) for t in (rng.random(6) ** 3 * 50).astype(int)} | {(0, 57), (1, 58)})
    terms = pa.table({"query_id": [q for q, _ in rows], "term": [f"t{t}" for _, t in rows], "weight": [1.0 + t / 7 for _, t in rows]})
    corpus = pa.table({"id": list(range(40)), "tokens": [[f"t{t}" for t in (rng.random(d) ** 3 * 60).astype(int)] for d in range(40)]})
    product = bm25.Bm25Scorer(terms, 20.0, 1.5, 0.75, False)
    monkeypatch.setattr(bm25, "MANY", 1_000)
    plain = bm25.Bm25Scorer(terms, 20.0, 1.5, 0.75, False)
    assert 0 < len(product.weights) < len(product.vocabulary) and not len(plain.weights)
    got, want = (np.concatenate([s for _, _, s in x.score(corpus, 3_000)]) for x in (product, plain))
    np.testing.assert_allclose(got, want, rtol=1e-12)
    assert np.isnan(got[0]).all()


def test_near_scores_lose_none_of_the_best(monkeypatch):
    monkeypatch.setattr(vector_search, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows, asked = rng.integers(-2, 3, (90, 5)).astype(float), rng.integers(-2, 3, (20, 5)).astype(float)
    rows[4], rows[9:30], asked[:, 0] = 0, rows[8], 1  # one without a length, many ties
    scorer = vector_search.CosineScorer(pa.table({"query_id": list(range(20)), "embedding": asked.tolist()}))
    corpus = pa.table({"id": list(range(90)), "embedding": rows.tolist()})
    assert {s.dtype for _, _, s, *_ in scorer.score(corpus, 50)} == {np.dtype(np.float32)}
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    found = blocks._scan(scorer, iter([corpus.slice(0, 33), corpus.slice(33)]), 4, schema).to_pylist()
    with np.errstate(invalid="ignore"):
        exact = np.round((asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T, 6)
    want = {(q, i) for q in range(20) for i in sorted((i for i in range(90) if i != 4), key=lambda i: (-exact[q, i], i))[:4]}
    assert {(r["query_id"], r["id"]) for r in found} == want
    assert all(r["score"] == exact[r["query_id"], r["id"]] for r in found)
