"""Jobs for spark-submit: ingest, index, compact, watch, ask, evaluate, report.

    spark-submit lectern/jobs.py ingest --landing /data/landing --lake /data/lake
    spark-submit lectern/jobs.py ask --lake /data/lake --questions q.json --out /data/answers
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

if not __package__:  # started as a file, as spark-submit does: the package is beside it
    sys.path[0] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators import conversation, evaluation
from lectern.operators.postings import cached_postings
from lectern.operators.retrieval import SearchCorpus, single_variant
from lectern.plans import lake
from lectern.plans.evaluate import evaluate
from lectern.plans.search import retrieve_multistage
from lectern.session import build_session, cut_lineage
from lectern.sources import logs, results
from lectern.streaming.landing import watch_landing

SOURCE_COLUMNS = ("filename", "professor", "subject", "chapter", "language")
REWRITES = "question string, raw_rewrites string, pseudo_answer string"
QUESTION = "question_id bigint, question string, raw_rewrites string, pseudo_answer string"


def search_corpus(spark: SparkSession, lake_path: str) -> SearchCorpus:
    """The published index with what has come in since, and its posting blocks."""
    index = lake.read_index(spark, f"{lake_path}/index")
    chunks = index.select(
        "chunk_id", F.col("document").alias("chunk_text"), "embedding",
        *[F.col(f"metadata.{c}").alias(c) for c in SOURCE_COLUMNS],
    )
    mark = lake.index_mark(spark, f"{lake_path}/index")
    return SearchCorpus(chunks, cached_postings(chunks, f"{lake_path}/postings", mark=mark), SOURCE_COLUMNS)


def ingest(spark: SparkSession, args) -> None:
    print(lake.run_pipeline(spark, args.landing, args.lake))


def index(spark: SparkSession, args) -> None:
    lake.index_load(spark, f"{args.lake}/gold", f"{args.lake}/index")


def compact(spark: SparkSession, args) -> None:
    lake.compact_index(spark, f"{args.lake}/index")


def watch(spark: SparkSession, args) -> None:
    watch_landing(spark, args.landing, args.lake, f"{args.lake}/state", args.every).awaitTermination()


def ask(spark: SparkSession, args) -> None:
    questions = spark.read.schema(QUESTION).json(args.questions)
    answers = retrieve_multistage(questions, search_corpus(spark, args.lake))
    answers.write.mode("overwrite").json(args.out)


def run_evaluation(spark: SparkSession, args) -> None:
    """Evaluates the listed questions; `--rewrites` has their rewrites and pseudo answers, by question.

    Ids are places in the list, so a question that is listed twice is two rows.
    """
    place = F.row_number().over(W.orderBy(F.monotonically_increasing_id()))  # a list in one file
    rows = cut_lineage(results.read_eval_questions(spark, args.questions).withColumn("question_id", place.cast("bigint")))
    if args.rewrites:
        given = spark.read.schema(REWRITES).json(args.rewrites).dropDuplicates(["question"])
        rows = rows.join(given, "question", "left")
        variants = None
    else:
        variants = single_variant(rows)
    corpus = search_corpus(spark, args.lake)
    found = cut_lineage(evaluate(rows, corpus, variants=variants))
    results.write_eval_results(found, args.out)
    results.eval_summary(found).show(truncate=False)
    evaluation.mismatch_report(found).show(50, truncate=False)


def report(spark: SparkSession, args) -> None:
    """The four dashboard tables, as of now."""
    as_of = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    since = (as_of - dt.timedelta(days=args.days)).date()
    history = logs.read_history(spark, f"{args.logs}/history", f"{args.logs}/clears", since)
    log = logs.read_retrievals(spark, f"{args.logs}/retrievals")
    fresh = logs.read_retrievals(spark, f"{args.logs}/retrievals", since)
    tables: dict[str, DataFrame] = {
        "summary": conversation.activity_summary(history, as_of, args.days),
        "confusion": conversation.confusion_heatmap(history, log, as_of, args.days),
        "unanswered": conversation.unanswered_questions(history, log, as_of, args.days),
        "top_chunks": conversation.top_chunks(fresh, as_of, args.days),
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{args.out}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    wanted = {
        "ingest": (ingest, ("landing", "lake")),
        "index": (index, ("lake",)),
        "compact": (compact, ("lake",)),
        "watch": (watch, ("landing", "lake")),
        "ask": (ask, ("lake", "questions", "out")),
        "evaluate": (run_evaluation, ("lake", "questions", "out")),
        "report": (report, ("logs", "out")),
    }
    for name, (job, paths) in wanted.items():
        sub = jobs.add_parser(name)
        sub.set_defaults(run=job)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        if name == "watch":
            sub.add_argument("--every", help='poll interval such as "5 minutes"; once without it')
        if name == "evaluate":
            sub.add_argument("--rewrites", help="JSON lines of question, raw_rewrites, pseudo_answer")
        if name == "report":
            sub.add_argument("--days", type=int, default=7)
    args = parser.parse_args(argv)
    args.run(build_session(f"lectern-{args.job}"), args)


if __name__ == "__main__":
    main()
