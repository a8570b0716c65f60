"""Versions of a table under one folder: v1, v2, ... The newest one that was written to its end counts.

Spark marks a table that is complete with a _SUCCESS file, written last. So a reader sees the version before or the
new one, never a part, and a crash at any point leaves the version before in place; no pointer has to be replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _listed(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))


def newest(spark: SparkSession, folder: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = (n for n in reversed(_listed(spark, folder)) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{n}/_SUCCESS")))
    return next(done, None)


def write(df: DataFrame, folder: str, kind: str = "parquet") -> int:
    """df as the next version. The one before stays for readers that have just begun, older ones go."""
    spark = df.sparkSession
    known = _listed(spark, folder)
    version = (known[-1] if known else 0) + 1
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").format(kind).save(f"{folder}/v{version}")
    for n in known[:-1]:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{n}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return version
