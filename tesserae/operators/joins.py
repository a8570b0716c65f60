"""Sides of joins that may be broadcast, by a measure of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes of a side that may be broadcast, as its values take in a row. Sides are measured first; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def _bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row of Spark's."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0)) + 24
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 24
    if isinstance(kind, StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether all rows together take BROADCAST_BYTES (or `most`) at most, by their values."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    return (df.agg(F.sum(row)).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; df itself beyond that, for a shuffled join. df should be cheap to read."""
    return F.broadcast(df) if is_small(df) else df


#: Bits and places in a Bloom filter for each value, and the longs it has at most.
FILTER_BITS, FILTER_PLACES, FILTER_LONGS = 12, 3, 1 << 22


def likely(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose column is a value of wanted (one column, cheap to read), and about 1 % of the others.

    A Bloom filter of wanted is broadcast, 12 bits a value, so that an exact join after it shuffles little else; with more
    than 20 million values more of the others stay.
    """
    name = wanted.columns[0]
    longs = min(wanted.count() * FILTER_BITS // 64 + 1, FILTER_LONGS)

    def places(c: str) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(longs * 64)) for i in range(FILTER_PLACES)]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(longs, np.uint64)
        for batch in batches:
            for c in batch.columns:
                at = c.to_numpy(zero_copy_only=False)
                np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([out.view(np.int64)], pa.list_(pa.int64()))], ["__bits"])

    own = wanted.where(F.col(name).isNotNull()).select(*(p.alias(f"p{i}") for i, p in enumerate(places(name))))
    held = own.coalesce(1).mapInArrow(bits, "__bits array<long>")
    inside = F.lit(True)
    for p in places(column):
        inside = inside & (F.getbit(F.get("__bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return df.crossJoin(F.broadcast(held)).where(inside).select(*(df[f"`{c}`"] for c in df.columns))
