"""Values of a column that are spelt nearly as asked for.

The distinct values are compared where they lie: a bound of the similarity, by length and by shared characters, rules
most out inside the JVM, the rest are scored in Arrow batches, and only the best few reach the driver.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS, Settings
from tesserae.functions.text import normalize_one, squash


class Alike(NamedTuple):
    value: str
    score: float
    back: float


def _reachable(df: DataFrame, name: str, want: str, cutoff: float) -> DataFrame:
    """(k, raw): squashed values with the spelling that comes last, of those that could reach the cutoff.

    The similarity is 2 M / T, with M characters matched of T in both; M is at most what both have of each character.
    """
    c, n = F.col(f"`{name}`").cast("string"), len(want)
    first = df.where(c.isNotNull()).select(c.alias("raw")).withColumn("at", F.monotonically_increasing_id()).groupBy("raw").agg(F.min("at").alias("at"))
    keyed = first.withColumn("k", squash(F.col("raw"))).where(F.length("k").between(n * cutoff / (2 - cutoff) - 1e-9, n * (2 - cutoff) / cutoff + 1e-9))
    shared = F.lit(0)
    for x in sorted(set(want)):
        shared = shared + F.least(F.length("k") - F.length(F.replace("k", F.lit(x), F.lit(""))), F.lit(want.count(x)))
    return keyed.where(2 * shared >= cutoff * (F.length("k") + n) - 1e-9).groupBy("k").agg(F.max_by("raw", "at").alias("raw"))


def alike(df: DataFrame, name: str, wanted: str, cutoff: float, most: int) -> list[Alike]:
    """The `most` values that are most like the wanted one, best first, ties by the spelling that sorts last."""
    want = " ".join(re.sub("[^a-z0-9 ]", "", normalize_one(wanted)).split())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = difflib.SequenceMatcher(b=want)
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k in keys:
                match.set_seq1(k)
                out.append((match.ratio(), difflib.SequenceMatcher(None, want, k).ratio()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.float64()), pa.array([b for _, b in out], pa.float64())], ["k", "raw", "score", "back"])

    found = _reachable(df, name, want, cutoff).mapInArrow(scored, "k string, raw string, score double, back double").where(F.col("score") >= cutoff)
    return [Alike(r["raw"], r["score"], r["back"]) for r in found.orderBy(F.desc("score"), F.desc("k")).limit(most).collect()]


def meant(df: DataFrame, name: str, wanted: str, settings: Settings = DEFAULTS) -> str | None:
    """The one existing value that is clearly meant: near enough, and well ahead of the next one."""
    best = alike(df, name, wanted, settings.near_match_cutoff, 2)
    clear = len(best) == 1 or (len(best) == 2 and best[0].back - best[1].back >= settings.near_match_gap)
    return best[0].value if clear else None


def suggested(df: DataFrame, name: str, wanted: list[str], settings: Settings = DEFAULTS) -> list[str]:
    """Up to three existing values that look like the wanted ones."""
    found = [a.value for w in wanted for a in alike(df, name, w, settings.suggestion_cutoff, 3)]
    return list(dict.fromkeys(found))[:3]
