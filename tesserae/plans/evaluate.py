"""Evaluation of an answering plan on a set of questions: one record each, summaries, failures, a report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import contains_all, numbers_ok
from tesserae.operators.metrics import failures, relevance, score_retrieval, share_of, summarize_retrieval, summarize_run
from tesserae.plans.answering import Answering, Topic, route_question

RECORD = (
    "id string, category string, answer string, error string, refused boolean, should_refuse boolean, routing_ok boolean, seconds double, tokens long, "
    "expected array<struct<value:double,tol:double>>, must_contain array<string>, claims array<string>, facts array<string>, relevance string"
)
REF = "qid string, label int, topic string, source string, page int, contains string"
HIT = "qid string, pos int, topic string, source string, page int, text string"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a test set in JSON, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")


def run_questions(rag: Answering, questions: Sequence[dict], judge: Callable[[dict, str, str], dict] | None = None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Records, retrieved chunks and labels of each question. judge gives claims, facts and relevance verdicts of an answer."""
    records, hits, refs = [], [], []
    for q in questions:
        began = time.perf_counter()
        got = rag.answer(q["question"], q.get("history") or ())
        took = time.perf_counter() - began
        items = got.context.items if got.context else []
        refused = got.status in ("router", "retrieval", "refused")
        said = judge(q, got.text, got.context.text if got.context else "") if judge and not refused and got.status != "error" else {}
        topics = q.get("expected_topics")
        routed = None if topics is None or got.route is None else set(topics) == set(got.route.topics)
        expected = [(float(e["value"]), float(e.get("tol", 0))) for e in q.get("expected_numbers") or []]
        usage = got.trace.usage if got.trace else None
        records.append((q["id"], q.get("category"), got.text, got.text if got.status == "error" else None, refused, bool(q.get("should_refuse")), routed, took, usage.prompt_tokens + usage.output_tokens if usage else 0, expected, q.get("must_contain") or [], said.get("claims"), said.get("facts"), said.get("relevance")))
        hits += [(q["id"], i, x["topic_id"], x.get("source"), x.get("page"), x["text"]) for i, x in enumerate(items, 1)]
        refs += [(q["id"], i, r["topic"], r["source"], r.get("page"), r.get("contains")) for i, r in enumerate(q.get("relevant") or [])]
    return records, hits, refs


def scored(spark: SparkSession, records: list[tuple], hits: list[tuple], refs: list[tuple]) -> DataFrame:
    """One row for each question with all its scores; a check that was not asked for is null."""
    df = spark.createDataFrame(records, RECORD)
    ranked = score_retrieval(spark.createDataFrame(hits, HIT), spark.createDataFrame(refs, REF)).withColumnRenamed("qid", "id")
    df = df.join(ranked.select("id", "precision", "recall"), "id", "left")
    df = df.withColumn("numbers_ok", numbers_ok(F.col("answer"), F.col("expected"))).withColumn("phrases_ok", contains_all(F.col("answer"), F.col("must_contain")))
    df = df.withColumn("faithfulness", share_of(F.col("claims"), "supported")).withColumn("correctness", share_of(F.col("facts"), "present")).withColumn("answer_relevance", relevance(F.col("relevance")))
    return df.withColumn("false_refusal", F.when(~F.col("should_refuse"), F.col("refused"))).withColumn("refusal_ok", F.when(F.col("should_refuse"), F.col("refused")))


def report(rows: DataFrame, meta: dict | None = None) -> dict:
    """The run as a whole, by category, and what failed."""
    means = ["precision", "recall", "faithfulness", "correctness", "answer_relevance", "tokens"]
    rates = ["routing_ok", "numbers_ok", "phrases_ok", "false_refusal", "refusal_ok"]
    every = summarize_run(rows, rates=rates, means=means, seconds="seconds").collect()
    plain = [r.asDict() for r in every]
    total = next(r for r in plain if r["is_total"])
    retrieval = summarize_retrieval(rows.select("recall", "precision")).first().asDict()
    return {"meta": meta or {}, "summary": total, "retrieval": retrieval, "by_category": {r["category"]: r for r in plain if not r["is_total"]}, "failures": {r["id"]: r["reasons"] for r in failures(rows).collect()}}


def write_report(result: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, ensure_ascii=False, indent=1, default=str)


def check_routing(topics: Sequence[Topic], router: Callable, cases: Sequence[dict]) -> tuple[float, list[dict]]:
    """The share of cases whose topics are exactly the expected ones, and the others."""
    wrong = [c | {"got": got} for c in cases if set(got := route_question(c["question"], topics, router).topics) != set(c["expected"])]
    return (1 - len(wrong) / len(cases) if cases else 1.0), wrong
