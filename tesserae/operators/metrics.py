"""Evaluation: retrieval against labels, answer checks, and summaries of runs by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS, Settings
from tesserae.operators import quantiles


def score_retrieval(retrieved: DataFrame, relevant: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, precision, recall, considered, labels, found) of each labelled or asked question.

    retrieved has qid, pos, topic, source, page, text; relevant has qid, label, topic, source, page and contains (null
    where they do not matter). Chunks meet labels by question, topic and source; the rest is a condition of the join.
    """
    r = retrieved if k is None else retrieved.where(F.col("pos") <= k)
    a, b = r.alias("r"), relevant.alias("l")
    fits = (F.col("l.page").isNull() | (F.col("l.page") == F.col("r.page"))) & (F.col("l.contains").isNull() | F.contains(F.col("r.text"), F.col("l.contains")))
    met = a.join(b, (F.col("r.qid") == F.col("l.qid")) & (F.col("r.topic") == F.col("l.topic")) & (F.col("r.source") == F.col("l.source")) & fits)
    hits = met.groupBy(F.col("r.qid").alias("qid")).agg(F.count_distinct("r.pos").alias("hits"), F.count_distinct("l.label").alias("found"))
    asked = r.groupBy("qid").agg(F.count("*").alias("considered"))
    labels = relevant.groupBy("qid").agg(F.count_distinct("label").alias("labels"))
    out = asked.join(labels, "qid", "full_outer").join(hits, "qid", "left").fillna(0, ["considered", "labels", "hits", "found"])
    labelled = F.col("labels") > 0
    precision = F.when(labelled, F.coalesce(F.try_divide("hits", "considered"), F.lit(0.0)))
    return out.select("qid", precision.alias("precision"), F.when(labelled, F.col("found") / F.col("labels")).alias("recall"), "considered", "labels", "found")


def summarize_retrieval(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("recall").alias("questions"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.count_if(F.col("recall") == 1).alias("full_recall"), F.count_if(F.col("recall") == 0).alias("no_recall"))


def rate(c: Column) -> Column:
    """The share that passed, of those that were checked."""
    return F.avg(c.cast("int").cast("double"))


def summarize_run(records: DataFrame, by: str = "category", rates: list[str] = (), means: list[str] = (), seconds: str | None = None) -> DataFrame:
    """One row for the whole run (is_total) and one for each category, from one pass of grouping sets.

    With `seconds`, its mean and the value at floor(0.95 (n - 1)) of its sorted values, by rank selection.
    """
    aggs = [F.count(F.lit(1)).alias("questions"), *(rate(F.col(c)).alias(c) for c in rates), *(F.avg(c).alias(c) for c in means)]
    aggs += [F.avg(seconds).alias("seconds_mean")] if seconds else []
    out = records.groupingSets([[], [F.col(by)]], F.col(by)).agg((F.grouping(by) == 1).alias("is_total"), *aggs)
    if not seconds:
        return out
    twice = records.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("is_total"), by, seconds).withColumn(by, F.when(~F.col("is_total"), F.col(by)))
    late = quantiles.floor_rank(twice, ["is_total", by], seconds, 0.95).select(F.col("is_total").alias("_t"), F.col(by).alias("_b"), F.col("value").alias("seconds_p95"))
    return out.join(late, (F.col("is_total") == F.col("_t")) & F.col(by).eqNullSafe(F.col("_b")), "left").drop("_t", "_b")


def share_of(verdicts: Column, good: str) -> Column:
    """The share of an answer's verdicts that are good; null if it has none."""
    return F.when(F.size(verdicts) > 0, F.size(F.filter(verdicts, lambda v: v == good)) / F.size(verdicts))


def faithfulness(claims: DataFrame) -> DataFrame:
    """(qid, claims, faithfulness): the share of each answer's claims that its context supports; claims has qid and verdict."""
    return claims.groupBy("qid").agg(F.count("verdict").alias("claims"), F.avg((F.col("verdict") == "supported").cast("double")).alias("faithfulness"))


def correctness(facts: DataFrame) -> DataFrame:
    """(qid, facts, correctness): the share of each question's expected facts that its answer states; facts has qid and verdict."""
    return facts.groupBy("qid").agg(F.count("verdict").alias("facts"), F.avg((F.col("verdict") == "present").cast("double")).alias("correctness"))


def relevance(verdict: Column) -> Column:
    return F.when(verdict == "full", 1.0).when(verdict == "partial", 0.5).when(verdict == "none", 0.0)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def failures(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Records with an array of reasons; only those that have one. Columns that a run lacks are passed over."""
    tests = {
        "error": lambda c: c.isNotNull(),
        "should_refuse": lambda c: c & ~F.col("refused"),
        "false_refusal": lambda c: c,
        "routing_ok": lambda c: ~c,
        "recall": lambda c: c < 1,
        "numbers_ok": lambda c: ~c,
        "phrases_ok": lambda c: ~c,
        "correctness": lambda c: c < settings.low_correctness,
        "faithfulness": lambda c: c < settings.low_faithfulness,
    }
    names = [n for n in tests if n in records.columns and (n != "should_refuse" or "refused" in records.columns)]
    reasons = F.array_compact(F.array(*(F.when(tests[n](F.col(n)), F.lit(n)) for n in names)))
    return records.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def token_usage(calls: DataFrame, by: str = "qid") -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))
