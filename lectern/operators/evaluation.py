"""Scoring of evaluation and quiz runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, SOURCE_SCORE_FIELDS, Settings
from lectern.functions.text import first_castable
from lectern.operators.ranking import latest
from lectern.operators.retrieval import grade
from lectern.session import cut_lineage, stored_table


def top_score(sources: Column, fields: Sequence[str] = SOURCE_SCORE_FIELDS) -> Column:
    """The best readable score of an array of source structs; null without any."""
    scores = F.transform(sources, lambda s: first_castable(*[s[f] for f in fields]))
    return F.array_max(scores)


def with_match(results: DataFrame) -> DataFrame:
    """`match`: the obtained grade is the expected one; a failed question is no match."""
    agrees = F.col("obtained_verdict") == F.col("expected_verdict")
    return results.withColumn("match", F.coalesce(agrees, F.lit(False)))


def concordance(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matches, total and rate, overall (one row) or per group."""
    total = F.count("*")
    matches = F.count_if("match")
    rate = F.when(total > 0, matches / F.greatest(total, F.lit(1))).otherwise(0.0)
    return results.groupBy(*by).agg(
        matches.alias("matches"), total.alias("total"), F.round(rate, 6).alias("rate")
    )


def running_concordance(
    results: DataFrame, order: str = "seq", runs: Sequence[str] = ("run",), stretch: int = 100_000
) -> DataFrame:
    """Matches and rate so far after each question of a run; `order` is a whole number.

    A run is cut into stretches of `stretch` order values that are summed side by side; the few
    stretch totals are then accumulated and added, so no task has to walk a whole run.
    """
    keys = [*runs, "_stretch"]
    rows = results.select(
        *runs,
        F.col(order),
        F.floor(F.col(order) / F.lit(stretch)).alias("_stretch"),
        F.col("match").cast("bigint").alias("_match"),
    )
    earlier = W.partitionBy(*runs).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("_match").alias("_m"), F.count("*").alias("_n"))
        .select(
            *keys,
            F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before_m"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before_n"),
        )
    )
    within = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumns(
        {"_m": F.sum("_match").over(within), "_n": F.count("*").over(within)}
    )
    matches = F.col("_before_m") + F.col("_m")
    total = F.col("_before_n") + F.col("_n")
    return local.join(offsets, keys).select(
        *runs,
        order,
        matches.alias("matches_so_far"),
        total.alias("total_so_far"),
        F.round(matches / total, 6).alias("rate_so_far"),
    )


def is_eligible() -> Column:
    """The row has an answer and at least one context, so it can be judged."""
    return (F.length("answer") > 0) & (F.size("context_texts") > 0)


def eligible_samples(results: DataFrame) -> DataFrame:
    return results.filter(F.coalesce(is_eligible(), F.lit(False)))


def eligibility_counts(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ok = F.coalesce(is_eligible(), F.lit(False))
    return results.groupBy(*by).agg(
        F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped")
    )


def judge_dataset(results: DataFrame, reference: str | None = None) -> DataFrame:
    """Rows for a judge: question, answer, contexts and, when there is one, the reference."""
    columns = ["question", "answer", F.col("context_texts").alias("contexts")]
    if reference:
        columns.append(F.col(reference).alias("reference"))
    return eligible_samples(results).select(*columns)


def zip_judge_dataset(lists: DataFrame) -> DataFrame:
    """Parallel lists `questions`, `answers`, `contexts` as rows, paired by position."""
    zipped = F.arrays_zip("questions", "answers", "contexts")
    kept = [c for c in lists.columns if c not in ("questions", "answers", "contexts")]
    return lists.select(*kept, F.posexplode(zipped).alias("pos", "z")).select(
        *kept,
        "pos",
        F.col("z.questions").alias("question"),
        F.col("z.answers").alias("answer"),
        F.col("z.contexts").alias("contexts"),
    )


def mismatch_report(results: DataFrame) -> DataFrame:
    """Questions that were graded without error, but not as expected."""
    return results.filter(~F.col("match") & F.col("error").isNull()).select(
        "question", "category", "expected_verdict", "obtained_verdict", "top_score"
    )


def metric_means(scores: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, scored rows and missing rows of every metric, each on its own."""
    # a failed score may be missing or not a number
    clean = scores.select(
        *ids, *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in metrics]
    )
    return (
        clean.unpivot(list(ids), list(metrics), "metric", "value")
        .groupBy("metric")
        .agg(
            F.round(F.avg("value"), 6).alias("mean"),
            F.count("value").alias("scored"),
            F.count_if(F.col("value").isNull()).alias("missing"),
        )
    )


def recalibrate(
    results: DataFrame,
    correct_above: Sequence[float],
    incorrect_below: Sequence[float],
) -> DataFrame:
    """Concordance every pair of thresholds would have given, from the stored best scores.

    The pairs are a fixed list in the plan; each row is graded once per pair and counted before
    anything is shuffled. A row without a score counts as nothing found.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(hi).alias("correct_above"), F.lit(lo).alias("incorrect_below"))
            for hi in correct_above
            for lo in incorrect_below
            if lo <= hi
        ]
    )
    tried = results.select(
        "expected_verdict", "top_score", F.inline(pairs)
    )
    graded = F.when(F.col("top_score").isNull(), "incorrect").otherwise(
        F.when(F.col("top_score") > F.col("correct_above"), "correct")
        .when(F.col("top_score") < F.col("incorrect_below"), "incorrect")
        .otherwise("ambiguous")
    )
    return concordance(
        tried.withColumn("match", graded == F.col("expected_verdict")),
        ["correct_above", "incorrect_below"],
    )


def best_thresholds(recalibrated: DataFrame) -> DataFrame:
    """The pair with the best rate; equal rates go to the smaller thresholds."""
    return latest(
        recalibrated, [F.col("rate").desc(), F.col("correct_above"), F.col("incorrect_below")], 1
    )


def best_thresholds_exact(results: DataFrame) -> DataFrame:
    """The best pair of thresholds of all: correct_above, incorrect_below, matches, total, rate.

    Grades change only where a threshold passes a stored score, so the pairs of those scores, and of one value below
    and one above them all, cover every outcome. Matches of a pair are a part that depends on the upper threshold (expected
    correct above it, expected ambiguous up to it) and one that depends on the lower (expected incorrect below it, less expected
    ambiguous below it). One sweep over the sorted scores therefore finds the best lower threshold for each upper one as a
    running maximum. The sweep is distributed: sorted stretches are summed side by side, and the few stretch totals are
    accumulated and added. Equal matches go to the smaller thresholds; a row without a score counts as nothing found; without
    any score there is no row.
    """
    expected = F.col("expected_verdict")
    counted = results.groupBy(F.col("top_score").alias("at")).agg(
        *(F.count_if(expected == g).alias(g) for g in ("correct", "ambiguous", "incorrect")), F.count("*").alias("rows")
    )
    counted = cut_lineage(counted)
    scored = counted.filter("at is not null")
    facts = counted.agg(
        F.min("at").alias("least"), F.max("at").alias("most"), F.sum("rows").alias("total"),
        F.sum(F.when(F.col("at").isNull(), F.col("incorrect")).otherwise(0)).alias("unscored"),
        F.sum(F.when(F.col("at").isNotNull(), F.col("correct")).otherwise(0)).alias("correct"),
    ).first()
    nothing = [F.lit(0).cast("bigint").alias(n) for n in ("correct", "ambiguous", "incorrect", "rows")]
    ends = scored.select(F.explode(F.array(*(F.lit(facts[n]).cast("double") + d for n, d in (("least", -1), ("most", 1))))).alias("at"), *nothing).distinct()
    points = scored.select("at", "correct", "ambiguous", "incorrect", "rows").unionByName(ends)
    stretches = points.repartitionByRange("at").sortWithinPartitions("at").withColumn("_stretch", F.spark_partition_id())
    points = stored_table(stretches)

    # sums up to and including each value; stretches follow each other in order
    names = ("correct", "ambiguous", "incorrect")
    inside = W.partitionBy("_stretch").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)  # one row for each stretch
    offsets = points.groupBy("_stretch").agg(*(F.sum(n).alias(n) for n in names)).select(
        "_stretch", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names)
    )
    upto = points.join(F.broadcast(offsets), "_stretch").withColumns(
        {f"_{n}": F.col(f"_before_{n}") + F.sum(n).over(inside) for n in names}
    )
    lower = F.struct(
        (F.col("_incorrect") - F.col("incorrect") - F.col("_ambiguous") + F.col("ambiguous")).alias("gain"), (-F.col("at")).alias("minus")
    )
    upto = upto.withColumn("_lower", lower).withColumn("_best", F.max("_lower").over(inside))
    tops = upto.groupBy("_stretch").agg(F.max("_lower").alias("_top")).select("_stretch", F.max("_top").over(earlier).alias("_ahead"))
    best = F.greatest("_best", "_ahead")
    swept = upto.join(F.broadcast(tops), "_stretch").withColumn("_chosen", best)
    matches = F.lit(facts["correct"]) - F.col("_correct") + F.col("_ambiguous") + F.col("_chosen.gain") + F.lit(facts["unscored"])
    pairs = swept.select(
        F.col("at").alias("correct_above"), (-F.col("_chosen.minus")).alias("incorrect_below"), matches.cast("bigint").alias("matches"),
        F.lit(facts["total"]).cast("bigint").alias("total"),
    ).withColumn("rate", F.round(F.col("matches") / F.col("total"), 6))
    return latest(pairs, [F.col("matches").desc(), F.col("correct_above"), F.col("incorrect_below")], 1)


def regrade(results: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """`obtained_verdict` and `match` anew from the stored best score."""
    obtained = F.when(F.col("top_score").isNull(), "incorrect").otherwise(
        grade(F.col("top_score"), settings)
    )
    return with_match(results.withColumn("obtained_verdict", obtained))


def grade_quiz(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Score of every quiz taken: correct answers, whole percent and a message.

    `answers` is (attempt_id, quiz_id, q_idx, chosen) and `key` (quiz_id, q_idx, correct_index).
    A question left out counts as wrong. Right answers are counted per attempt before they meet
    the quiz sizes, so an attempt costs one row there.
    """
    sizes = key.groupBy("quiz_id").agg(F.count("*").alias("total"))
    right = answers.join(key, ["quiz_id", "q_idx"], "left")
    scored = right.groupBy("attempt_id", "quiz_id").agg(
        F.count_if(F.col("chosen") == F.col("correct_index")).alias("correct")
    )
    percent = F.floor(F.col("correct") * 100 / F.col("total") + 0.5).cast("int")
    return scored.join(sizes, "quiz_id").withColumn("percent", percent).withColumn(
        "message",
        F.when(F.col("percent") == 100, "All correct.")
        .when(F.col("percent") >= 70, "Well understood.")
        .when(F.col("percent") >= 40, "Review this once more.")
        .otherwise("Go back to this topic."),
    )
