"""Repeated runs of lines are kept once: the first copy in document order stays, later copies are deleted.

Method: a suffix array over the sequences of line ids, by prefix doubling. Round h knows for every
suffix the rank of its first h lines among all suffixes that share them with another one; the next
round ranks the pairs (rank at s, rank at s + h). The suffixes of one rank are an interval of the
suffix array whose longest common prefix is at least h lines. A run counts from `min_words`
words on, so suffixes are followed only as far as the shortest stretches of that many words that
begin or end at a line. The interval of a stretch of m lines is the pair of the ranks of h lines at
s and at s + m - h, where h is the power of two next below m. All copies in an interval but the
first are later copies, and a line is deleted when such a copy covers it. A maximal repeated run is
the union of the shortest stretches in it: a line with enough words after it begins one, a line
with enough before it ends one, and any other line lies in the one that begins the run.

All steps are DataFrame functions. A line that a third of all lines repeat is counted before the
shuffle and joined to its one rank, which adaptive execution splits; nothing is gathered for a
line or an interval. Windows span one document. Line ids are 128-bit hashes.

Edge cases: blank lines are no part of a run and stay where they are; null texts stay null and empty ones
empty; rows with a null id stay as they are; rows that repeat an id and a text are one document and
all get its result, rows that repeat only the id are documents of their own; a line repeated within
a document counts as a copy too; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.textblocks import unused
from lectern.session import stored_table

DOC = ["_doc", "_hash"]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, hash, pos, line, a, b, words): the lines with words; pos numbers them, line is the number among all lines."""
    found = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda x, i: F.struct(
                i.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(r"\S+")).alias("words")
            ),
        ),
        lambda s: s.words > 0,
    )
    given = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.col("text").alias("text"))
    rows = given.filter("_doc is not null and text is not null").select(*DOC, F.posexplode(found).alias("pos", "x"))
    return rows.select(*DOC, "pos", "x.line", "x.a", "x.b", "x.words")


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank) of the groups of at least two, in the order of their keys; stored, so that ranks stay."""
    ordered = groups.filter("count > 1").select(*keys).orderBy(*keys)
    return stored_table(ordered.withColumn("rank", F.monotonically_increasing_id()))


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, hash, line) of all lines inside a later copy of a run of at least `min_words` words."""
    lines = line_table(docs).distinct()
    order = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*DOC).orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*DOC).orderBy("upto").rangeBetween(1 - min_words, 0)
    enough = lambda w: F.when(F.sum("words").over(w) >= min_words, F.count("*").over(w).cast("int"))
    ranks = _ranked(lines.groupBy("a", "b").count(), ["a", "b"])
    measured = (
        lines.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .withColumn("upto", F.col("before") + F.col("words"))
        .select(*DOC, "pos", "line", "a", "b", enough(onward).alias("onward"), enough(back).alias("back"))
    )
    repeated = stored_table(measured.join(ranks, ["a", "b"]).select(*DOC, "pos", "line", "onward", "back", "rank"))
    # the stretches by their first line and their number of lines
    spans = repeated.select(
        *DOC,
        F.explode(
            F.array_distinct(
                F.array_compact(
                    F.array(
                        F.when(F.col("onward").isNotNull(), F.struct("pos", F.col("onward").alias("m"))),
                        F.when(F.col("back").isNotNull(), F.struct((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("m"))),
                    )
                )
            )
        ).alias("span"),
    ).select(*DOC, "span.pos", "span.m")
    longest = repeated.agg(F.max(F.greatest("onward", "back"))).first()[0] or 0

    level, depth, copies = repeated.select(*DOC, "pos", "rank"), 1, []
    while depth <= longest:
        last = level.select(*DOC, (F.col("pos") + depth).alias("end"), F.col("rank").alias("last"))
        chosen = spans.filter(F.col("m").between(depth, 2 * depth - 1)).distinct()
        runs = stored_table(
            chosen.join(level, [*DOC, "pos"]).withColumn("end", F.col("pos") + F.col("m")).join(last, [*DOC, "end"])
            .select(*DOC, "pos", "end", "m", "rank", "last")
        )
        first = (
            runs.groupBy("m", "rank", "last").agg(F.count("*").alias("count"), F.min(F.struct(*DOC, "pos")).alias("first"))
            .filter("count > 1").drop("count")
        )
        copies.append(
            runs.join(first, ["m", "rank", "last"])
            .filter((F.col("first._doc") != F.col("_doc")) | (F.col("first._hash") != F.col("_hash")) | (F.col("first.pos") != F.col("pos")))
            .select(*DOC, "pos", "end")
        )
        if 2 * depth > longest:
            break
        ahead = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(depth, depth)
        pairs = level.withColumn("next", F.first("rank").over(ahead)).filter("next is not null")
        pairs = stored_table(pairs.withColumnRenamed("rank", "head"))
        ranks = _ranked(pairs.groupBy("head", "next").count(), ["head", "next"])
        level = stored_table(pairs.join(ranks, ["head", "next"]).select(*DOC, "pos", "rank"))
        depth *= 2
    if not copies:
        return repeated.filter("false").select(*DOC, "line")
    found = copies[0]
    for more in copies[1:]:
        found = found.unionByName(more)
    so_far = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.groupBy(*DOC, "pos").agg(F.max("end").alias("end"))
    covered = repeated.join(found, [*DOC, "pos"], "left").withColumn("covered", F.max("end").over(so_far))
    return covered.filter("covered > pos").select(*DOC, "line")


def dedup_lines(docs: DataFrame, min_words: int = 50, names: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """The documents, without the lines of later copies, with two more columns: lines of the given text and deleted lines.

    Both are 0 for a null text. They take the place of columns so named.
    """
    docs = docs.drop(*names)
    key, cut, gone_doc, gone_key, gone_lines = (unused(docs.columns, n) for n in ("key", "lines", "gone_doc", "gone_key", "gone"))
    gone = (
        later_copies(docs, min_words).groupBy(*DOC).agg(F.collect_set("line").alias(gone_lines))
        .select(F.col("_doc").alias(gone_doc), F.col("_hash").alias(gone_key), gone_lines)
    )
    # the lines go through the join in place of the text, so that they are cut once for each document
    given = docs.withColumns({key: F.xxhash64("text"), cut: F.split("text", "\n")}).drop("text")
    joined = given.join(gone, (F.col("doc_id") == F.col(gone_doc)) & (F.col(key) == F.col(gone_key)), "left")
    size = F.coalesce(F.size(cut), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), size - 1), F.col(gone_lines)), lambda i: F.col(cut)[i])
    text = F.when(F.col(gone_lines).isNull(), F.array_join(cut, "\n")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col(cut).isNull(), 0).otherwise(size).cast("long").alias(names[0]),
        F.when(F.col(gone_lines).isNull(), 0).otherwise(F.size(gone_lines)).cast("long").alias(names[1]),
    )
