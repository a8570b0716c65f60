"""Exact medians and other ranks of very many values, by nested histograms.

A group's values are counted in coarse bins whose order is that of the values; the bin that holds a rank is split into
finer bins, and only the values of one of these are counted one by one. Each step is a scan with a sum before the
shuffle, so what is shuffled are bins, not values, and no task holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins for each factor of e, and bins that a bin is split into.
COARSE, FINE = 64, 4096


def _coarse(x: Column) -> Column:
    """A bin of the logarithm; it never falls as x grows."""
    return F.floor(F.least(F.signum(x) * F.log1p(F.abs(x)) * COARSE, F.lit(1e6))).cast("long")


def _fine(x: Column) -> Column:
    return F.when(F.col("high") > F.col("low"), F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * FINE)).otherwise(F.lit(0)).cast("long")


def ranked(rows: DataFrame, keys: Sequence[str], x: str, wanted: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(keys, which, value): the values at the wanted ranks of each group, from 0, as wanted(n) gives them of n values.

    Nulls and NaN are no values; a group without values has no rows. Null keys are a group like any other.
    """
    rows = rows.select(*keys, F.col(x).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("b", _coarse(F.col("x")))
    def bins(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))

    def before(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
        return df.withColumn("before", F.sum("n").over(Window.partitionBy(*by, F.lit(0)).orderBy(order)) - F.col("n"))

    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    left = (F.col("rank") - F.col("before")).alias("rank")
    first = before(bins(rows, [*keys, "b"]), keys, "b").withColumn("all", F.sum("n").over(Window.partitionBy(*keys, F.lit(0))))
    first = first.select("*", F.posexplode(F.array(*(r.cast("long") for r in wanted(F.col("all"))))).alias("which", "rank")).where(inside)
    first = first.select(*keys, "b", "which", left, "low", "high")

    split = _joined(rows, first.select(*keys, "b", "low", "high").distinct(), [*keys, "b"]).withColumn("f", _fine(F.col("x"))).drop("low", "high")
    second = before(bins(split, [*keys, "b", "f"]), [*keys, "b"], "f")
    second = _joined(second, first.select(*keys, "b", "which", "rank"), [*keys, "b"]).where(inside).select(*keys, "b", "f", "which", left)
    last = _joined(split, second.select(*keys, "b", "f").distinct(), [*keys, "b", "f"]).groupBy(*keys, "b", "f", "x").agg(F.count("*").alias("n"))
    last = before(last, [*keys, "b", "f"], "x")
    return _joined(last, second, [*keys, "b", "f"]).where(inside).select(*keys, "which", F.col("x").alias("value"))


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """An inner join in which nulls are alike."""
    right = right.withColumnsRenamed({n: f"__{n}" for n in by})
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in by]
    return left.join(right, same).drop(*(f"__{n}" for n in by))


def median(rows: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, value): the middle value of each group, or the mean of the two in the middle; without keys one row, null if there is no value."""
    both = ranked(rows, keys, x, lambda n: (F.floor((n - 1) / 2), F.ceil((n - 1) / 2)))
    return both.groupBy(*keys).agg(F.avg("value").alias("value"))


def floor_rank(rows: DataFrame, keys: Sequence[str], x: str, share: float) -> DataFrame:
    """(keys, value): the value at rank floor(share * (n - 1)) of each group."""
    return ranked(rows, keys, x, lambda n: (F.floor(F.lit(share) * (n - 1)),)).select(*keys, "value")
