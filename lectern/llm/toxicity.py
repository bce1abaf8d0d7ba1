"""Toxicity scores of whole texts by a convolutional classifier over hashed words.

Model: words (runs of letters and numbers in lower case) are hashed to embeddings, the sum of those of the whole word
and of its beginnings of 4, 6 and 8 bytes, so that forms of a stem are alike; filters of widths 1, 2
and 3 slide over a text, their largest responses are the features, and a logistic layer scores them. An embedding is learned
if at least `LEAST_TEXTS` fitted texts hold its word or beginning, and is zero otherwise.
It is trained in numpy by mini-batches with adaptive steps. The score is calibrated on rows that
were not fitted: a Platt line, and then the odds are shifted so that the threshold with the best F1
on the calibration rows lies at `DECISION`. Per language, the threshold with the best F1 is
kept as well, for callers that know the language of a text (`flag_by_language`); the score itself
sees the text alone. A language with under 20 toxic calibration rows has the common threshold.

Fitting takes all labelled texts; every fourth one by the hash of its id is left for calibration. Their buckets are packed once into
blocks of about `BLOCK_TEXTS` texts. In an epoch every task goes through its blocks, starting from the same model, and the models are
averaged, an embedding over the tasks that changed it; embeddings and filters are all that is sent. The Platt line and the
thresholds come from sums and running sums over all calibration rows. Scoring reads whole texts; it does not depend on how rows are batched.

Short stretches of clean texts are fitted and calibrated as clean as well, so that length is no sign.

Edge cases: null and empty texts have no responses and get the score of a text in which no filter
responds; texts of any length are whole; rows with a null id are scored; repeated rows each have
their row; ids that are labelled twice count as toxic if one label says so; labels that are null
are not learned from; with one class only, or none, every score is the share of the label learned, 0 if none.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.config import DEFAULTS
from lectern.llm.mixing import task_sums
from lectern.llm.textblocks import mix, pack, runs, slices, span_hashes, text_bytes, unpack
from lectern.session import checked_broadcast, stored_table

BUCKET_BITS, DIM, FILTERS, WIDTHS = 15, 8, 8, (1, 2, 3)
#: Bytes of the beginnings of words; a word that is no longer has none.
BEGINNINGS = (4, 6, 8)
PARTS = 1 + len(BEGINNINGS)
#: A word or beginning has an embedding if so many fitted texts hold it; others are zero.
LEAST_TEXTS = 8
DECISION = 0.7
#: Texts of a block for fitting.
BLOCK_TEXTS = 2_000
EPOCHS = 8
#: Blocks of one task in an epoch, at least: more of them mean fewer models to be averaged and sent.
TASK_BLOCKS = 6
#: Stretches of scores whose running sums are taken apart.
STRETCHES = 32
#: The bucket of what is not there; its embedding stays zero.
NOTHING = 1 << BUCKET_BITS


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginnings, one row per word, and the offsets of the texts in the rows."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    data, offsets = text_bytes(texts, lower=True)
    starts, ends = runs(inside[data], offsets)
    out = np.full((len(starts), PARTS), NOTHING, np.int32)
    for k, size in enumerate((0, *BEGINNINGS)):
        some = np.flatnonzero(ends - starts > size) if size else np.arange(len(starts))
        hashes = span_hashes(data, starts[some], starts[some] + size if size else ends)
        out[some, k] = mix(hashes + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)
    return out, np.searchsorted(starts, offsets)


def _pool(response: np.ndarray, words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each text and filter, 0 at least, and its position; -1 where nothing responds."""
    docs = len(at) - 1
    best, place = np.zeros((docs, response.shape[1]), np.float32), np.full((docs, response.shape[1]), -1)
    for d in range(docs):
        a, b = at[d], at[d + 1] - width + 1
        if b > a:
            k = response[a:b].argmax(axis=0)
            top = response[a:b][k, np.arange(response.shape[1])]
            on = top > 0
            best[d, on], place[d, on] = top[on], a + k[on]
    return best, place


class Classifier:
    """Embeddings, filters by width and offset, biases and the logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.3 / np.sqrt(PARTS), (NOTHING + 1, DIM)).astype(np.float32)
        self.w = {k: rng.normal(0, 0.5 / np.sqrt(k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.float32(0)
        self.squares = {"e": np.full(len(self.e), 1e-6, np.float32), "v": np.full_like(self.v, 1e-6), "c": np.float32(1e-6)}
        self.squares |= {("w", k): np.full_like(self.w[k], 1e-6) for k in WIDTHS} | {("b", k): np.full_like(self.b[k], 1e-6) for k in WIDTHS}
        self.known = np.ones(len(self.e), bool)

    def know(self, holders: np.ndarray) -> None:
        """Keep the embeddings of buckets that enough texts hold."""
        self.known = holders >= LEAST_TEXTS
        self.known[NOTHING] = False
        self.e[~self.known] = 0

    def epoch(self, lists: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, batch: int = 32, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
        """One pass over texts in mini-batches; returns which embeddings were changed."""
        changed, known = np.zeros(len(self.e), bool), self.known

        def step(name, value, gradient):
            self.squares[name] = self.squares[name] + gradient * gradient
            return value - rate * gradient / np.sqrt(self.squares[name])

        order = rng.permutation(len(lists))
        for k0 in range(0, len(order), batch):
            some = order[k0 : k0 + batch]
            words = np.concatenate([lists[i] for i in some])
            at = np.concatenate(([0], np.cumsum([len(lists[i]) for i in some])))
            if not len(words):
                continue
            x = self.e[words].sum(axis=1)
            features, places = [], {}
            for k in WIDTHS:
                n = max(0, len(words) - k + 1)
                response = np.tile(self.b[k], (n, 1))
                for o in range(k):
                    response += x[o : o + n] @ self.w[k][o]
                best, places[k] = _pool(response, words, at, k)
                features.append(best)
            h = np.concatenate(features, axis=1)
            keep = rng.random(h.shape[1]) > 0.2  # filters left out, so that none decides alone
            p = 1 / (1 + np.exp(-(h * keep / 0.8 @ self.v + self.c)))
            error = ((p - labels[some]) / len(some)).astype(np.float32)
            dh = np.outer(error, self.v) * keep / 0.8
            dv = (h * keep / 0.8).T @ error + decay * self.v
            touched, gradients = [], []
            for n_k, k in enumerate(WIDTHS):
                part, place = dh[:, n_k * FILTERS : (n_k + 1) * FILTERS], places[k]
                d, f = np.nonzero(place >= 0)
                g, pos = part[d, f], place[d, f]
                db = np.bincount(f, g, FILTERS).astype(np.float32)
                dw = np.zeros_like(self.w[k])
                for o in range(k):
                    np.add.at(dw[o].T, f, g[:, None] * x[pos + o])
                    touched.append(words[pos + o])
                    gradients.append(g[:, None] * self.w[k][o][:, f].T)
                self.b[k] = step(("b", k), self.b[k], db)
                self.w[k] = step(("w", k), self.w[k], dw + decay * self.w[k])
            # a word's embedding is a sum, so each of its buckets has the gradient of the word
            ids, where = np.unique(np.concatenate(touched).reshape(-1), return_inverse=True)
            de = np.zeros((len(ids), DIM), np.float32)
            np.add.at(de, where, np.repeat(np.concatenate(gradients), PARTS, axis=0))
            de = de * known[ids][:, None] + decay * self.e[ids]
            self.squares["e"][ids] += (de * de).mean(axis=1)
            self.e[ids] -= rate * de / np.sqrt(self.squares["e"][ids])[:, None]
            self.v = step("v", self.v, dv)
            self.c = step("c", self.c, error.sum())
            changed[ids] = True
        return changed

    def _dense(self) -> list[np.ndarray]:
        sets = ((self.w, self.b), ({k: self.squares["w", k] for k in WIDTHS}, {k: self.squares["b", k] for k in WIDTHS}))
        out = [x[k].ravel() for pair in sets for x in pair for k in WIDTHS]
        return [*out, self.v, self.squares["v"], np.array([self.c, self.squares["c"]], np.float32)]

    def numbers(self, weight: float, changed: np.ndarray) -> np.ndarray:
        """All that is learned times `weight`, embeddings only where they were changed, and the weights."""
        rows = np.column_stack((self.e, self.squares["e"])).astype(np.float64) * (weight * changed)[:, None]
        return np.concatenate((rows.ravel(), weight * changed, weight * np.concatenate(self._dense()), [weight]))

    def average(self, numbers: np.ndarray) -> None:
        """Take the weighted means of summed `numbers`; embeddings that no task changed stay."""
        size = len(self.e)
        rows, many, dense = np.split(numbers, [size * (DIM + 1), size * (DIM + 2)])
        some = many > 0
        rows = rows.reshape(size, DIM + 1)[some] / many[some][:, None]
        self.e[some], self.squares["e"][some] = rows[:, :DIM], rows[:, DIM]
        dense, at = (dense[:-1] / dense[-1]).astype(np.float32), 0
        found = []
        for x in self._dense():
            found.append(dense[at : at + x.size])
            at += x.size
        n = len(WIDTHS)
        for j, k in enumerate(WIDTHS):
            self.w[k], self.squares["w", k] = found[j].reshape(self.w[k].shape), found[2 * n + j].reshape(self.w[k].shape)
            self.b[k], self.squares["b", k] = found[n + j], found[3 * n + j]
        self.v, self.squares["v"] = found[4 * n], found[4 * n + 1]
        self.c, self.squares["c"] = found[4 * n + 2]

    def tables(self) -> dict:
        """Response of each bucket at each offset of each width: a window is a sum of look-ups."""
        return {"t": {k: [self.e @ self.w[k][o] for o in range(k)] for k in WIDTHS}, "b": self.b, "v": self.v, "c": float(self.c)}


def logits(tables: dict, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of texts before the logistic function; pooled over the whole text."""
    features = np.zeros((len(at) - 1, len(WIDTHS) * FILTERS), np.float32)
    for n_k, k in enumerate(WIDTHS):
        n = len(words) - k + 1
        full = at[1:] - at[:-1] >= k
        if n <= 0 or not full.any():
            continue
        response = np.zeros((n, FILTERS), np.float32)
        for o in range(k):
            for part in range(PARTS):
                response += tables["t"][k][o][words[o : o + n, part]]
        # windows that begin at the last k - 1 words of a text would reach into the next one
        for back in range(1, k):
            over = at[1:] - back
            over = over[(over >= 0) & (over < n)]
            response[over] = -np.inf
        response = np.concatenate((response, np.full((1, FILTERS), -np.inf, np.float32)))
        best = np.maximum.reduceat(response, np.minimum(at[:-1][full], n))
        features[full, n_k * FILTERS : (n_k + 1) * FILTERS] = np.maximum(best + tables["b"][k], 0)
    return (features @ tables["v"] + tables["c"]).astype(np.float64)


def best_thresholds(rows: DataFrame) -> DataFrame:
    """(key, total, threshold) from rows (key, score, label): the middle of the gap below the scores whose selection has the best F1;
    above all scores without positives."""
    each = stored_table(rows.groupBy("key", "score").agg(F.sum("label").alias("hits"), F.count("*").alias("n")))
    totals = each.groupBy("key").agg(F.sum("hits").alias("total"), F.max("score").alias("top"))
    # running sums are taken within stretches of scores, and start from the sums of the stretches above
    cuts = each.approxQuantile("score", [k / STRETCHES for k in range(1, STRETCHES)], 0.01) if not each.isEmpty() else []
    stretch = F.lit(0)
    for cut in sorted(set(cuts)):
        stretch = stretch + (F.col("score") >= cut).cast("int")
    each = each.withColumn("stretch", stretch)
    above = Window.partitionBy("key").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("key", "stretch").agg(F.sum("hits").alias("h"), F.sum("n").alias("m"))
    sums = sums.select("key", "stretch", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in "hm"))
    so_far = Window.partitionBy("key", "stretch").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = each.join(F.broadcast(sums), ["key", "stretch"]).join(F.broadcast(totals), "key")  # a row for each key and stretch
    f1 = 2 * (F.sum("hits").over(so_far) + F.col("h")) / (F.sum("n").over(so_far) + F.col("m") + F.col("total"))
    found = found.withColumn("f1", f1).groupBy("key", "total", "top").agg(F.max_by("score", F.struct("f1", "score")).alias("best"))
    below = each.join(F.broadcast(found.select("key", "best")), "key").filter("score < best").groupBy("key").agg(F.max("score").alias("below"))
    middle = (F.col("best") + F.coalesce("below", F.col("best") - 1)) / 2
    return found.join(F.broadcast(below), "key", "left").select("key", "total", F.when(F.col("total") > 0, middle).otherwise(F.col("top") + 1).alias("threshold"))


def _logistic(x: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def platt(rows: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic line through (score, label) rows, by Newton steps; the slope is kept positive."""
    a, b, z = 1.0, 0.0, F.col("score")
    for _ in range(50):
        p = _logistic(a * z + b)
        w, off = p * (1 - p) + 1e-6, p - F.col("label")
        ga, gb, haa, hab, hbb = rows.agg(*(F.sum(x) for x in (off * z, off, w * z * z, w * z, w))).first()
        move = np.linalg.solve(np.array([[haa + 1e-3, hab], [hab, hbb]]), np.array([ga + 1e-3 * a, gb]))
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-7:
            break
    return max(a, 0.05), b


def _stretches(lists: list[np.ndarray], labels: np.ndarray, langs: list, block: int) -> tuple[list, np.ndarray, list]:
    """The texts with short stretches of every fourth clean one, some of them empty: a text with little in it counts as clean."""
    rng, some = np.random.default_rng([17, block]), np.flatnonzero(labels == 0)[::4]
    cut = []
    for i in some:
        k = int(rng.integers(0, len(lists[i]) + 1))
        cut.append(lists[i][k : k + int(rng.integers(0, 7))])
    return lists + cut, np.concatenate((labels, labels[some])), langs + [langs[i] for i in some]


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block of texts: the buckets of their words, where each text begins, and the labels."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    lists: list[np.ndarray] = []
    for batch in table.select(["text"]).to_batches():
        for piece in slices(batch):
            buckets, at = word_buckets(piece.column("text"))
            lists += [buckets[a:b].astype(np.uint16) for a, b in zip(at[:-1], at[1:], strict=True)]
    labels, block = table.column("toxic").to_numpy().astype(np.int64), table.column("block")[0].as_py()
    lists, labels, langs = _stretches(lists, labels, table.column("lang").to_pylist(), block)
    ends = np.cumsum([0, *map(len, lists)])
    body = pack(np.array([block], np.int64), ends, labels, np.concatenate(lists).ravel())
    return pa.table({
        "held": table.column("held").slice(0, 1).combine_chunks(), "least": pa.array([int(labels[: len(table)].min())], pa.int32()),
        "most": pa.array([int(labels.max())], pa.int32()), "langs": pa.array([langs], pa.list_(pa.string())), "body": pa.array([body], pa.binary()),
    })


def _unpacked(body) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Number of the block, its texts, their labels, and the words of all with where each text begins."""
    (block,), ends, labels, words = unpack(body)
    words = words.astype(np.int32).reshape(-1, PARTS)
    return int(block), [words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], labels, words, ends


def _holders(bodies: Iterator[pa.Buffer]) -> np.ndarray | None:
    """How many texts hold each bucket."""
    total = None
    for body in bodies:
        _, lists, _, _, _ = _unpacked(body)
        held = np.bincount(np.concatenate([np.unique(x) for x in lists]), minlength=NOTHING + 1)
        total = held if total is None else total + held
    return total


def _epoch(sent, number: int):
    def run(bodies: Iterator[pa.Buffer]) -> np.ndarray | None:
        net, texts, changed = copy.deepcopy(sent.value), 0, np.zeros(NOTHING + 1, bool)
        for body in bodies:
            block, lists, labels, _, _ = _unpacked(body)
            changed |= net.epoch(lists, labels.astype(np.float32), np.random.default_rng([5, number, block]))
            texts += len(lists)
        return net.numbers(float(texts), changed) if texts else None

    return run


def _block_scores(blocks: DataFrame, tables: dict) -> DataFrame:
    """(score, label, lang) of each text of the blocks, before calibration."""
    sent = blocks.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, langs in zip(batch.column("body"), batch.column("langs"), strict=True):
                _, _, labels, words, ends = _unpacked(body.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(logits(sent.value, words, ends)), pa.array(labels), pa.array(langs.as_py(), pa.string())], ["score", "label", "lang"])

    return blocks.select("body", "langs").mapInArrow(run, "score double, label long, lang string")


def train(docs: DataFrame, labels: DataFrame, block_texts: int = BLOCK_TEXTS, epochs: int = EPOCHS) -> dict:
    """Model from all (doc_id, text, lang) rows that a (doc_id, toxic) row labels; see the module."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    many = max(1, -(-known.count() // block_texts))
    # few labels are sent to the texts, many meet them by id
    known = checked_broadcast(known, DEFAULTS.broadcast_rows)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(known, "doc_id")
    rows = rows.withColumns({
        "held": F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0,
        "block": F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(many)),
    })
    blocks = stored_table(rows.groupBy("held", "block").applyInArrow(_packed, "held boolean, least int, most int, langs array<string>, body binary"))
    seen = {r.held: (r.least, r.most) for r in blocks.groupBy("held").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()}
    if False not in seen or seen[False][0] == seen[False][1]:
        return {"constant": float(seen[False][0]) if False in seen else 0.0, "thresholds": {}}
    fit, net, context = blocks.filter("not held").coalesce(max(1, many // TASK_BLOCKS)), Classifier(), blocks.sparkSession.sparkContext
    net.know(task_sums(fit, _holders))
    for k in range(epochs):
        sent = context.broadcast(net)
        net.average(task_sums(fit, _epoch(sent, k)))
        sent.destroy()
    tables = net.tables()
    both = True in seen and seen[True][0] != seen[True][1]
    found = stored_table(_block_scores(blocks.filter("held") if both else fit, tables))
    a, b = platt(found)
    best = best_thresholds(found.select(F.lit("").alias("key"), "score", "label")).first().threshold
    line = a, b + np.log(DECISION / (1 - DECISION)) - (a * best + b)
    by_language = best_thresholds(found.select(F.coalesce("lang", F.lit("")).alias("key"), _logistic(line[0] * F.col("score") + float(line[1])).alias("score"), "label"))
    return {"tables": tables, "line": line, "thresholds": {r.key: r.threshold for r in by_language.filter("total >= 20").orderBy("key").collect()}}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of `docs`, and score and predicted (1 from `DECISION` on), which take the place of columns so named."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in slices(batch):
                if "constant" in model:
                    scores = np.full(piece.num_rows, model["constant"])
                else:
                    words, at = word_buckets(piece.column("text"))
                    a, b = model["line"]
                    scores = 1 / (1 + np.exp(-np.clip(a * logits(model["tables"], words, at) + b, -30, 30)))
                columns = [*piece.columns, pa.array(scores), pa.array((scores >= DECISION).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def flag_by_language(scored: DataFrame, model: dict, lang: str = "lang") -> DataFrame:
    """One more column, `flagged`: the score reaches the threshold of the row's language, `DECISION` for others."""
    threshold = F.lit(DECISION)
    for name, value in model["thresholds"].items():
        threshold = F.when(F.col(lang) == name, F.lit(value)).otherwise(threshold)
    return scored.withColumn("flagged", (F.col("score") >= threshold).cast("int"))
