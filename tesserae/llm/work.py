"""What the training-data operators share: tables on the way, Arrow batches and sides of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.joins import is_small, likely, small  # noqa: F401
from tesserae.operators.tables import ARROW_BYTES, dropped, in_arrow, new_path, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
