"""Near duplicates by Jaccard similarity of word shingles, exactly.

Method: token-combination prefixes. The shingles of a document are put into one global order, the
rarest in the corpus first. Two sets that reach the threshold share a shingle among their first
a + 1, where a is the number of elements that a set may lack. If the first shared one is rare, it
alone is the signature. If it is frequent, all shared ones are, and the prefix is extended until
it must hold two shared elements with no unshared one between them, which is after as many as both
sets together may lack: pairs of neighbouring frequent shingles are then the signatures. Documents of one signature are compared with the one
that has the fewest shingles of its own, and what that does not connect is compared with the rest
of the signature, where the shingles that cannot be shared (those of one document, and for pairs
all rare ones) still allow the threshold. Every candidate is verified on the sets, so the result is that of a comparison of
all documents.

How it scales: the scan sends each distinct shingle of a block of documents once
(`exchange`); only shingles that a second document holds come back. Exact copies in a block
are one set. No step holds a group of documents in one task.

Edge cases: null and empty texts have no shingles and no links; texts below five words are one shingle;
very long texts are whole; rows with a null id are left out; rows that share an id but not the
text count as linked, and each has its row; further columns are not looked at. Shingles are 56-bit
hashes: two sets of 500 differing ones share one by chance with a probability of 4e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.components import components
from lectern.llm.exchange import ASKED, OWN, buckets, exchange, messages
from lectern.llm.textblocks import mix, pack, slices, span_hashes, text_bytes, unpack, unused, words
from lectern.session import cut_lineage, stored_table

#: A shingle in no more documents (or groups of copies in a block) than this is rare.
RARE = 64
#: A block of documents holds about so many shingles.
BLOCK = 3_000_000
ODD = 0xD6E8FEB86659FD93

SETS = "doc_id long, n int, fp long, rep long, alone int, rare int, tokens array<long>, singles array<long>, joint array<long>"
SETS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("rep", pa.int64()), ("alone", pa.int32()),
        ("rare", pa.int32()), ("tokens", pa.list_(pa.int64())), ("singles", pa.list_(pa.int64())), ("joint", pa.list_(pa.int64())),
    ]
)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 56-bit shingles of each text, ascending, and the offsets of the texts."""
    data, offsets = text_bytes(texts, lower=True)
    starts, ends, at = words(data, offsets)
    hashed = span_hashes(data, starts, ends)
    weights = [np.uint64(pow(ODD, j + 1, 2**64)) for j in range(width)]
    whole = np.zeros(max(0, len(hashed) - width + 1), np.uint64)
    for j, w in enumerate(weights):
        whole += hashed[j : j + len(whole)] * w
    whole = mix(whole)
    out, sizes = [], np.zeros(len(at) - 1, np.int64)
    for d in range(len(at) - 1):
        first, last = int(at[d]), int(at[d + 1])
        if last - first >= width:
            s = np.sort(whole[first : last - width + 1] >> np.uint64(8))
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif last > first:
            few = (hashed[first:last] * np.array(weights[: last - first])).sum(dtype=np.uint64, keepdims=True)
            s = mix(few + np.uint64(last - first)) >> np.uint64(8)
        else:
            continue
        out.append(s)
        sizes[d] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _fingerprints(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = []
    for salt in (0x1234567, 0x7654321ABC):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)))))
        sums.append(mix(total[at[1:]] - total[at[:-1]]).view(np.int64))
    return sums[0], sums[1]


class _Block:
    """Documents of a block: one set for each text, and for its copies the smallest id."""

    def __init__(self):
        self.ids, self.n, self.fp, self.set_of = [], [], [], []
        self.sets, self.found, self.size = [], {}, 0

    def add(self, ids: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> None:
        fp, other = _fingerprints(tokens, at)
        for i, doc in enumerate(ids.tolist()):
            n = int(at[i + 1] - at[i])
            key = (int(fp[i]), int(other[i]), n)
            number = self.found.get(key)
            if number is None:
                number = self.found[key] = len(self.sets)
                self.sets.append(tokens[at[i] : at[i + 1]])
                self.size += n
            self.ids.append(doc)
            self.n.append(n)
            self.fp.append(int(fp[i]))
            self.set_of.append(number)

    def rows(self, block: int, parts: int) -> list[tuple]:
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(self.sets), dtype=np.uint32), [len(s) for s in self.sets])
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(tokens)))
        single = count == 1
        many = np.repeat(~single, count)
        one, one_of = tokens[first[single]], of[first[single]]
        more, more_n = tokens[first[~single]], count[~single].astype(np.uint32)
        own = pack(
            np.array(self.ids, np.int64), np.array(self.n, np.int32), np.array(self.fp, np.int64),
            np.array(self.set_of, np.uint32), more, more_n, of[many],
        )
        rows = [(block % parts, block, OWN, own)]
        edges = (np.arange(parts + 1).astype(object) * (2**56) // parts).tolist()
        cut = np.searchsorted(one, np.array(edges[1:-1], np.uint64)) if parts > 1 else np.zeros(0, np.int64)
        cut_more = np.searchsorted(more, np.array(edges[1:-1], np.uint64)) if parts > 1 else np.zeros(0, np.int64)
        for p, ((a, b), (c, d)) in enumerate(zip(_pairs(cut, len(one)), _pairs(cut_more, len(more)), strict=True)):
            if b > a or d > c:
                rows.append((p, block, ASKED, pack(one[a:b], one_of[a:b], more[c:d], more_n[c:d])))
        return rows


def _pairs(cuts: np.ndarray, n: int) -> list[tuple[int, int]]:
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _split(parts: int, width: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for piece in slices(batch):
                tokens, at = shingle_sets(piece.column("text"), width)
                block.add(piece.column("doc_id").to_numpy(zero_copy_only=False), tokens, at)
                if block.size >= BLOCK or len(block.ids) >= BLOCK // 10:
                    yield messages(block.rows(number, parts))
                    number, block = number + 1, _Block()
        if block.ids:
            yield messages(block.rows(number, parts))

    return split


def _merge(rows: list[tuple]) -> list[tuple]:
    """Answers each block the shingles of its own that another document has too, with their counts."""
    asked = [(block, *unpack(body)) for block, body in rows]
    if not asked:
        return []
    tokens = np.concatenate([t for _, one, _, more, _ in asked for t in (one, more)])
    counts = np.concatenate([c for _, one, _, _, n in asked for c in (np.ones(len(one), np.uint32), n)])
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.add.reduceat(counts[order].astype(np.uint64), first)
    found = np.empty(len(tokens), np.uint64)
    found[order] = np.repeat(total, np.diff(np.append(first, len(tokens))))
    out, at = [], 0
    for block, one, one_of, more, _ in asked:
        here = found[at : at + len(one)]
        shared = here >= 2
        there = found[at + len(one) : at + len(one) + len(more)]
        at += len(one) + len(more)
        if shared.any() or len(more):
            out.append((block, pack(one[shared], one_of[shared], here[shared], more, there)))
    return out


def _finish(rows: list[tuple]) -> pa.Table:
    """Sets of a block with their shared shingles in the global order, and their signatures."""
    ids, n, fp, set_of, more, more_n, more_of = unpack(next(body for kind, _, body in rows if kind == OWN))
    answers = [unpack(body) for kind, _, body in rows if kind == ASKED]
    none = np.zeros(0, np.uint64)
    counted = np.concatenate([a[4] for a in answers]) if answers else none
    token = np.concatenate([a[0] for a in answers] + [np.repeat(more, more_n)])
    of = np.concatenate([a[1] for a in answers] + [more_of])
    df = np.concatenate([a[2] for a in answers] + [np.repeat(counted, more_n)])
    order = np.lexsort((token, df, of))
    token, of, df = token[order], of[order], df[order]
    sets = int(set_of.max()) + 1 if len(set_of) else 0
    at = np.searchsorted(of, np.arange(sets + 1))
    reps = np.full(sets, np.iinfo(np.int64).max)
    np.minimum.at(reps, set_of, ids)
    size, print_of = np.zeros(sets, np.int64), np.zeros(sets, np.int64)
    size[set_of], print_of[set_of] = n, fp
    kept: dict[int, tuple] = {}
    for s in range(sets):
        first, last, total = int(at[s]), int(at[s + 1]), int(size[s])
        alone, spare = total - (last - first), total // 5
        if not total or alone > spare:
            continue
        t, f = token[first:last], df[first:last]
        rare = int(np.searchsorted(f, RARE, side="right"))
        singles = mix(t[: min(rare, spare + 1 - alone)] if total > 1 else t[:1])
        joint = none
        if total > 1 and alone + rare <= spare:
            lacking = spare - alone - rare
            run = t[rare : rare + lacking + total // 4 - alone - rare + 2]
            joint = mix(run[:-1] * np.uint64(ODD) + mix(run[1:]))
        kept[s] = (alone, alone + rare, *(x.view(np.int64) for x in (t, singles, joint)))
    chosen: dict[int, int] = {}
    for i, s in enumerate(set_of.tolist()):
        if s not in chosen and ids[i] == reps[s]:
            chosen[s] = i
    lead = {i: kept[s] for s, i in chosen.items() if s in kept}
    return pa.Table.from_arrays(
        [
            pa.array(ids), pa.array(n), pa.array(fp), pa.array(np.where(n > 0, reps[set_of], ids) if sets else ids),
            *(pa.array([lead[i][k] if i in lead else None for i in range(len(ids))], SETS_ARROW.field(4 + k).type) for k in range(5)),
        ],
        schema=SETS_ARROW,
    )


def sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row for each document: set size and copy in its block; shared shingles and signatures where it may have links."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return exchange(given.filter("doc_id is not null"), _split(buckets(docs), width), _merge, _finish, SETS)


def _verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs ((a, fa), (b, fb)) with 100 * intersection >= 80 * union; shingles of one document only cannot be shared."""
    left = candidates.select(F.col("doc_id").alias("a"), F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = candidates.select(F.col("doc_id").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.select("a", "fa", "b", "fb").join(left, ["a", "fa"]).join(right, ["b", "fb"])
        .withColumn("shared", shared)
        .filter("100 * shared >= 80 * (na + nb - shared)")
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents; the component is its smallest id."""
    stored = stored_table(sets(docs, width))
    candidates = stored.filter("tokens is not null")
    ends = ["doc_id", "fp", "n"]
    signed = candidates.select(*ends, F.col("alone").alias("own"), F.explode("singles").alias("signature")).unionByName(
        candidates.select(*ends, F.col("rare").alias("own"), F.explode("joint").alias("signature"))
    )
    leads = (
        signed.groupBy("signature").agg(F.count("*").alias("members"), F.min(F.struct("own", "doc_id", "fp", "n")).alias("lead"))
        .filter("members > 1")
        .select("signature", *(F.col(f"lead.{c}").alias(to) for c, to in (("doc_id", "b"), ("fp", "fb"), ("n", "nb"), ("own", "ownb"))))
    )
    # as much as the two can share at most is enough; shared >= 4/9 of both sizes is 80 of 100 of the union
    close = "9 * least(n - own, nb - ownb) >= 4 * (n + nb)"
    starred = cut_lineage(
        signed.join(leads, "signature").filter("(doc_id <> b or fp <> fb) and " + close)
        .groupBy(F.col("doc_id").alias("a"), F.col("fp").alias("fa"), "b", "fb").agg(F.count("*").alias("common"))
    )
    best = starred.groupBy("a", "fa").agg(F.max(F.struct("common", "b", "fb")).alias("lead")).select(
        "a", "fa", F.col("lead.b").alias("b"), F.col("lead.fb").alias("fb")
    )
    copies = stored.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = cut_lineage(_verified(best, candidates).unionByName(copies))
    labels = components(links)

    other = _apart(starred.join(best, ["a", "fa", "b", "fb"], "left_anti"), labels)
    links = cut_lineage(links.unionByName(_verified(other, candidates)))
    labels = components(links)

    # what the leads have not connected is compared with all others of its signatures
    named = signed.join(labels, signed.doc_id == labels.node, "left").select(
        "signature", *ends, "own", F.coalesce("label", "doc_id").alias("label")
    )
    mixed = named.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("signature")
    open_ = cut_lineage(named.join(mixed, "signature"))
    x = open_.select("signature", F.col("doc_id").alias("a"), F.col("fp").alias("fa"), "n", "own", F.col("label").alias("la"))
    y = open_.select(
        "signature", F.col("doc_id").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("own").alias("ownb"), F.col("label").alias("lb")
    )
    rest = x.join(y, "signature").filter("la < lb and " + close).select("a", "fa", "b", "fb").distinct()
    tested = starred.select("a", "fa", "b", "fb")
    rest = rest.join(tested, ["a", "fa", "b", "fb"], "left_anti").join(
        tested.select(F.col("b").alias("a"), F.col("fb").alias("fa"), F.col("a").alias("b"), F.col("fa").alias("fb")),
        ["a", "fa", "b", "fb"], "left_anti",
    )
    found = cut_lineage(_verified(rest, candidates))
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    return stored.select("doc_id", "n").join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
    )


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return (
        pairs.join(one, "a", "left").join(two, "b", "left")
        .filter("coalesce(la, a) <> coalesce(lb, b)")
        .select("a", "fa", "b", "fb")
    )


def distinct_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, as it is.

    Of rows that share this id, the first by text stays. Rows with a null id stay as well, since nothing can be said of them.
    """
    found = stored_table(near_duplicates(docs, width))
    return _one_each(docs, "doc_id", found, found.filter("doc_id <> component_id").select("doc_id"))


def distinct_rows(docs: DataFrame, width: int = 5) -> DataFrame:
    """The same where ids are unique; otherwise a row is known by its id and text, and goes only if it is a near copy itself.

    Of each component the row with the smallest id stays, of rows that share this id the one with the smallest hash, and
    one of rows with the same id and text. Rows are told apart by 64-bit hashes of both.
    """
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return distinct_documents(docs, width)
    row = unused(docs.columns, "row")
    named = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = stored_table(near_duplicates(named.select(F.col(row).alias("doc_id"), "text"), width))
    ids = named.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).filter("id is not null").distinct()
    parts = found.select(F.col("doc_id").alias("row"), "component_id").distinct().join(ids, "row")
    first = parts.groupBy("component_id").agg(F.min(F.struct("id", "row"))["row"].alias("row"))
    dropped = parts.join(first, "row", "left_anti").select(F.col("row").alias("doc_id"))
    return _one_each(named, row, found, dropped).drop(row)


def _one_each(docs: DataFrame, key: str, found: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not dropped; of several rows with one key the first by text."""
    gone, twice, no = (unused(docs.columns, n) for n in ("gone", "twice", "no"))
    dropped = dropped.select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(dropped, F.col(key) == F.col(gone), "left_anti")
    again = stored_table(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice)))
    if again.isEmpty():
        return kept
    first = Window.partitionBy(key).orderBy("text")
    one = kept.join(again, F.col(key) == F.col(twice), "left_semi").withColumn(no, F.row_number().over(first)).filter(F.col(no) == 1).drop(no)
    return kept.join(again, F.col(key) == F.col(twice), "left_anti").unionByName(one)
