"""Ranks by nested histograms, broadcast sides by bytes, and versions, on awkward values."""

import random
import statistics

import pytest

from tesserae.operators import joins, quantiles
from tesserae.sources import versions


def test_medians_and_ranks(spark):
    r = random.Random(1)
    values = {"a": [r.gauss(0, 1e6) for _ in range(501)], "b": [1.0] * 40 + [2.0] * 40, "c": [float("inf"), -1e300, 0.0, 1e-300, -0.0], None: [3.0], "d": [5.0, -7.5]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    assert {x["k"]: x["value"] for x in quantiles.median(df, ["k"], "x").collect()} == {k: statistics.median(v) for k, v in values.items()}
    got = {x["k"]: x["value"] for x in quantiles.floor_rank(df, ["k"], "x", 0.95).collect()}
    assert got == {k: sorted(v)[int(0.95 * (len(v) - 1))] for k, v in values.items()}
    assert quantiles.median(df, [], "x").first()["value"] == statistics.median([v for vs in values.values() for v in vs])
    assert quantiles.median(df.limit(0), [], "x").first()["value"] is None and quantiles.median(df.limit(0), ["k"], "x").count() == 0


def test_sides_are_measured_in_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, [1, 2], ["a" * 50]) for i in range(50)], "i long, s string, a array<int>, t array<string>")
    assert joins.is_small(df) and not joins.is_small(df, 50 * 200) and joins.is_small(df.limit(0), 0)


def test_the_newest_complete_version_counts(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.newest(spark, folder) is None
    for n in range(3):
        assert versions.write(spark.range(n + 1), folder) == n + 1
    (tmp_path / "t" / "v9").mkdir()  # begun, and broken off
    assert versions.newest(spark, folder) == 3 and spark.read.parquet(f"{folder}/v3").count() == 3
    assert versions.write(spark.range(7), folder) == 10 and versions.newest(spark, folder) == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(f"{folder}/v1").count()
