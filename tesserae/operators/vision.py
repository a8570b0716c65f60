"""Pictures: an injected analyzer behind a cache table, and what it found as text.

The cache is keyed by the picture's SHA-1, the model and the version of the prompt. Known pictures are joined in; only
the others go to the analyzer, one call for each distinct picture, and are appended.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANALYSIS = "caption string, ocr_text string, details string"
_CACHE = f"sha1 string, model string, prompt_version string, {ANALYSIS}"


def analysis_text(caption: Column, ocr_text: Column, details: Column) -> Column:
    """The parts that are not blank, each under its name."""
    part = lambda name, c: F.when(F.btrim(c) != "", F.concat(F.lit(f"{name}: "), F.btrim(c)))
    return F.concat_ws("\n\n", part("Caption", caption), part("Text in the image", ocr_text), part("Details", details))


def analyze(images: DataFrame, cache: str, analyzer: Callable[[bytes, str], dict], model: str, prompt_version: str) -> DataFrame:
    """images (sha1, mime, content, ...) with caption, ocr_text and details. cache is the folder of the cache table."""
    spark = images.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.schema(_CACHE).parquet(cache) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else spark.createDataFrame([], _CACHE)
    known = known.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version))

    @F.pandas_udf(f"struct<{ANALYSIS.replace(' string', ':string')}>")
    def run(content: pd.Series, mime: pd.Series) -> pd.DataFrame:
        rows = [analyzer(bytes(c), m) for c, m in zip(content, mime)]
        return pd.DataFrame([{k: r.get(k) for k in ("caption", "ocr_text", "details")} for r in rows], columns=["caption", "ocr_text", "details"])

    fresh = images.select("sha1", "mime", "content").dropDuplicates(["sha1"]).join(known.select("sha1"), "sha1", "left_anti")
    fresh = fresh.select("sha1", F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), run("content", "mime").alias("a")).select("sha1", "model", "prompt_version", "a.*")
    fresh.write.mode("append").parquet(cache)
    found = spark.read.schema(_CACHE).parquet(cache).where((F.col("model") == model) & (F.col("prompt_version") == prompt_version)).drop("model", "prompt_version")
    return images.join(found.dropDuplicates(["sha1"]), "sha1", "left")


def image_records(images: DataFrame) -> DataFrame:
    """Records of analyzed images (topic_id, source, caption, ocr_text, details); those without any text are left out."""
    text = analysis_text(F.col("caption"), F.col("ocr_text"), F.col("details"))
    none = lambda t="string": F.lit(None).cast(t)
    rows = images.select("topic_id", "source", F.lit(0).alias("ordinal"), text.alias("text"), F.lit("image").alias("modality"), none("int").alias("page"), none().alias("table_id"), none().alias("part"), F.col("source").alias("image_path"), none().alias("heading"))
    return rows.where("text <> ''")

#: Sides in pixels: the least of a picture that is looked at, and the most that is sent on.
LEAST_SIDE, MOST_SIDE = 16, 2000


def fitted(width: Column, height: Column, alpha: Column) -> Column:
    """Struct (ok, width, height, mime) of the picture that an analyzer gets: too small ones are not ok, larger ones are
    scaled down to MOST_SIDE, and those that may be seen through stay PNG."""
    scale = F.least(F.lit(1.0), F.lit(float(MOST_SIDE)) / F.greatest(width, height, F.lit(1)))
    side = lambda x: F.greatest(F.floor(x * scale + 0.5), F.lit(1)).cast("int")
    return F.struct((F.least(width, height) >= LEAST_SIDE).alias("ok"), side(width).alias("width"), side(height).alias("height"), F.when(alpha, "image/png").otherwise("image/jpeg").alias("mime"))


def image_reader(cache: str, analyzer: Callable[[bytes, str], dict], model: str, prompt_version: str, prepare: Callable[[bytes], tuple[bytes, str]] | None = None) -> Callable:
    """A reader of picture files for ingest_topic(): prepared by `prepare` (content to content and mime), analyzed behind the cache."""

    def read(spark, path: str, topic: str, source: str) -> DataFrame:
        kind = F.when(F.hex(F.substring("content", 1, 4)) == "89504E47", "image/png").when(F.hex(F.substring("content", 1, 2)) == "FFD8", "image/jpeg").otherwise("image/webp")
        images = spark.read.format("binaryFile").load(path).select(F.lit(topic).alias("topic_id"), F.lit(source).alias("source"), "content", kind.alias("mime"))
        if prepare is not None:

            @F.pandas_udf("struct<content:binary,mime:string>")
            def prepared(content: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([prepare(bytes(c)) for c in content], columns=["content", "mime"])

            images = images.select("topic_id", "source", prepared("content").alias("p")).select("topic_id", "source", "p.*")
        images = images.withColumn("sha1", F.sha1("content"))
        return image_records(analyze(images, cache, analyzer, model, prompt_version))

    return read
