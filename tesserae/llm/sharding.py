"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The doc_id and the number of shards alone decide a document's shard, without a ring table; with one more shard, a
document stays or moves into the new one. The slots of a shard are numbered by doc_id through one range exchange of
ids and sizes (never texts): a row's place within its task's sorted run, plus the rows of the runs before.

Defined results: a null text has size 1 and CRC 0; all null doc_ids share one key; rows with one doc_id share one
shard and take slots of their own; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.work import small, written

#: The multiplier of the published 64-bit generator, lowest 16 bits first.
_C = [2862933555777941757 >> s & 0xFFFF for s in (0, 16, 32, 48)]
_M32, _M16 = (1 << 32) - 1, (1 << 16) - 1
#: Jumps in the first loop. Nearly every key is done by then; the rest go on in a second, longer loop.
_JUMPS = 64


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * C + 1 modulo 2**64 of a key in two halves, in steps that no signed 64-bit product or sum exceeds."""
    p = [lo * F.lit(c) for c in _C]
    low = p[0] + F.shiftleft(p[1].bitwiseAND(F.lit(_M16)), 16) + 1
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(p[1], 16) + p[2] + F.shiftleft(p[3].bitwiseAND(F.lit(_M16)), 16) + hi * F.lit(_C[0]) + F.shiftleft((hi * F.lit(_C[1])).bitwiseAND(F.lit(_M16)), 16)
    return high.bitwiseAND(F.lit(_M32)), low.bitwiseAND(F.lit(_M32))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), to.alias("j")))

    key = key.cast("long")
    state = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_M32)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, _JUMPS))), state, jump)
    if shards > _JUMPS:  # each jump goes up by one at least, so this always ends
        state = F.when(state["j"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(_JUMPS), F.lit(shards)), state, jump))
    return state["b"].cast("int")


def shard_by_key(docs: DataFrame, shards: int = 16, key: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document; grown_shard is for one more shard.

    key defaults to doc_id itself, which the generator scatters; any other stable 64-bit key may be given.
    """
    key = F.coalesce(F.col("doc_id") if key is None else key, F.lit(-1)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shards")
    run = F.shiftright("at", 33).alias("run")
    runs = rows.groupBy(run, "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
    runs = written(runs.select("run", "shard", (before - F.col("first")).alias("shift")), "runs")
    out = rows.withColumn("run", run).join(small(runs), ["run", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
