"""Tables that an operator writes on its way, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only on a single machine, as in tests, a folder of our own is set where none is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from written(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow() with batches of ARROW_BYTES, as a task holds several on both sides. A bound that the session sets stays."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH, "64m").removesuffix("b") in ("64m", str(64 << 20)):
        spark.conf.set(_BATCH, str(ARROW_BYTES))
    return df.mapInArrow(f, schema)
