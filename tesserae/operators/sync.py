"""The chunk store: a Parquet table partitioned by topic, kept in step with each new snapshot of a topic's chunks.

A sync is one full outer join on the id. Embeddings of unchanged chunks are taken over; only added and updated ones
go through the embedder. The new state of the topic is written as a new version next to the old, and then a small
pointer file is replaced, so readers see one or the other.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.chunking import META, duplicate_ids
from tesserae.sources import versions

Embedder = Callable[[list[str]], list[list[float]]]
_COLUMNS = ("id", "text", *META, "content_hash")


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """The default embedder: words hashed into a bag of `size` numbers of length one."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in re.findall(r"\w+", t.lower()):
            v[int(hashlib.md5(w.encode()).hexdigest(), 16) % size] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def embed(text: Column, embedder: Embedder = hashed_words, batch: int = 100) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        texts = s.tolist()
        if any(not (t or "").strip() for t in texts):
            raise ValueError("a blank text cannot be embedded")
        return pd.Series([v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])], dtype=object)

    return run(text)


@dataclass(frozen=True)
class SyncStats:
    added: int
    updated: int
    unchanged: int
    deleted: int
    protected: int


def diff(old: DataFrame, new: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(id, status): added, updated, unchanged, deleted, or protected for what is gone from a protected source."""
    a, b = old.select("id", F.col("content_hash").alias("was"), F.col("source").alias("old_source")), new.select("id", F.col("content_hash").alias("now"))
    both = a.join(b, "id", "full_outer")
    gone = F.col("now").isNull()
    if protected is not None:
        both = both.join(protected.select(F.col("source").alias("old_source"), F.lit(True).alias("safe")), "old_source", "left")
    else:
        both = both.withColumn("safe", F.lit(None).cast("boolean"))
    status = F.when(gone & F.col("safe"), "protected").when(gone, "deleted").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "updated").otherwise("unchanged")
    return both.select("id", status.alias("status"))


class ChunkStore:
    """Topics under one folder; each has versions, of which the newest complete one counts."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder = hashed_words):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _version(self, topic: str) -> int | None:
        return versions.newest(self.spark, f"{self.folder}/{topic}")

    def topics(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self._version(s.getPath().getName()) is not None) if fs.exists(p) else []

    def chunks(self, topic: str, modality: str | None = None) -> DataFrame | None:
        v = self._version(topic)
        if v is None:
            return None
        df = self.spark.read.parquet(f"{self.folder}/{topic}/v{v}")
        return df.where(F.col("modality") == modality) if modality else df

    def count(self, topic: str) -> int:
        df = self.chunks(topic)
        return df.count() if df is not None else 0

    def delete_topic(self, topic: str) -> None:
        fs, p = self._fs(f"{self.folder}/{topic}")
        fs.delete(p, True)

    def sync(self, topic: str, new: DataFrame, protected_sources: list[str] = (), allow_empty: bool = False) -> SyncStats:
        """Makes the topic's chunks those of `new`; only added and changed ones are embedded.

        `new` is written once, beside the versions, as parsing and chunking stand behind it; all steps read that table.
        """
        staged = f"{self.folder}/{topic}/staged"
        new.select(*_COLUMNS).write.mode("overwrite").parquet(staged)
        try:
            return self._sync(topic, self.spark.read.schema(new.select(*_COLUMNS).schema).parquet(staged), protected_sources, allow_empty)
        finally:
            fs, p = self._fs(staged)
            fs.delete(p, True)

    def _sync(self, topic: str, new: DataFrame, protected_sources: list[str], allow_empty: bool) -> SyncStats:
        if not new.where(F.col("topic_id") != topic).isEmpty():
            raise ValueError(f"chunks of another topic cannot go into '{topic}'")
        clash = duplicate_ids(new).first()
        if clash:
            raise ValueError(f"two chunks share the id {clash['id']!r}")
        old = self.chunks(topic)
        if old is None:
            old = self.spark.createDataFrame([], new.withColumn("embedding", F.array(F.lit(0.0).cast("float"))).schema)
        elif new.isEmpty() and not old.isEmpty() and not allow_empty:
            raise ValueError(f"refusing to empty the topic '{topic}'")
        safe = self.spark.createDataFrame([(s,) for s in protected_sources], "source string")
        known = old.select("id", F.col("content_hash").alias("was"), F.col("embedding").alias("old"))
        keep = new.join(known, "id", "left").withColumn("same", F.coalesce(F.col("was") == F.col("content_hash"), F.lit(False)))
        same = keep.where("same").select(*_COLUMNS, F.col("old").alias("embedding"))
        fresh = keep.where("not same").select(*_COLUMNS)
        fresh = fresh.withColumn("embedding", embed(F.col("text"), self.embedder))
        kept = old.join(safe, "source", "left_semi").join(new.select("id"), "id", "left_anti").select(*_COLUMNS, "embedding")
        counts = {r["status"]: r["count"] for r in diff(old, new, safe).groupBy("status").count().collect()}
        versions.write(same.unionByName(fresh).unionByName(kept), f"{self.folder}/{topic}")
        return SyncStats(*(counts.get(s, 0) for s in ("added", "updated", "unchanged", "deleted", "protected")))


def fingerprints(chunks: DataFrame, *by: str) -> DataFrame:
    """(by, fingerprint) of each group of chunks: it changes when one is added, removed or changed, whatever their order.

    The SHA-1 of the number of chunks and of two sums of 60 bits of each chunk's own SHA-1, which are added up before
    the shuffle; so no list of a group's chunks is ever made.
    """
    item = F.sha1(F.concat(F.col("id").cast("string"), F.lit(":"), "content_hash").cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(item, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    n = F.count(F.lit(1)).cast("string")
    whole = F.concat_ws(":", n, F.coalesce(part(1), F.lit("0")), F.coalesce(part(16), F.lit("0")))
    return chunks.groupBy(*by).agg(F.sha1(whole.cast("binary")).alias("fingerprint"))


def fingerprint(chunks: DataFrame) -> str:
    return fingerprints(chunks).first()["fingerprint"]
