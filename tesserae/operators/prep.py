"""Relational building blocks for preparing samples: membership in a top n, stratified samples, bounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def order_of(key: Column, seed: int) -> Column:
    """A fixed random order by key, the same in every run and in other engines."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, count) of the n most frequent values; ties by value. Never more than n rows leave a task."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def in_top(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.join(F.broadcast(top_values(df, column, n).select(column)), column, "left_semi")  # n rows


def stratified(df: DataFrame, by: str, key: str, per_group: int, seed: int, extra: int | None = None) -> DataFrame:
    """Up to per_group rows of each group, then up to `extra` of these, in a fixed random order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order_of(F.col(key), seed), key))
    out = df.withColumn("_rank", rank).where(F.col("_rank") <= per_group).drop("_rank")
    return out.orderBy(order_of(F.col(key), seed), key).limit(extra) if extra else out


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(order_of(F.col(key), seed), key).limit(n)


def complement(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def bounded_groups(df: DataFrame, keys: list[str], order: str, least: int, groups: int, rows: int) -> DataFrame:
    """Groups of `least` rows or more, the first `groups` by size, and each one's first `rows` rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") >= least).orderBy(F.desc("size"), *keys).limit(groups)
    kept = df.join(F.broadcast(sizes), keys)  # `groups` rows
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return kept.withColumn("rank", rank).where(F.col("rank") <= rows)


def length_between(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    return df.where(F.length(column).between(low, high))


def facts(df: DataFrame, column: str) -> DataFrame:
    """(n, mean): the rows, and the mean of a column over those that have it."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"))


def members(df: DataFrame, ids: DataFrame, key: str, required: list[str] = ()) -> DataFrame:
    """Rows whose key is among the ids and that have all required columns."""
    return df.dropna(subset=list(required)).join(ids.select(key).distinct(), key, "left_semi") if required else df.join(ids.select(key).distinct(), key, "left_semi")


def shuffled(parts: list[DataFrame], key: str, seed: int) -> DataFrame:
    """All parts one after the other, in a fixed random order by key."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.orderBy(order_of(F.col(key), seed), key)


def reduced(df: DataFrame, unwanted: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows in a fixed random order, without those of the unwanted columns that there are."""
    return sample(df.drop(*unwanted), key, n, seed)


def having(df: DataFrame, equal: dict[str, str], present: list[str] = ()) -> DataFrame:
    """Rows with all the given values, and something in each column of `present`."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    return df.dropna(subset=list(present)) if present else df


def group_texts(groups: DataFrame, keys: list[str], line: Column, head: str) -> DataFrame:
    """(keys, text): the ranked rows of bounded_groups(), one line each, under a head line with the size of the whole group."""
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    out = groups.groupBy(*keys).agg(F.max("size").alias("size"), lines.alias("lines"))
    first = F.concat_ws(" ", F.lit(head), *(F.col(k).cast("string") for k in keys), F.concat(F.lit("("), "size", F.lit(")")))
    return out.select(*keys, F.concat_ws("\n", first, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def count_if_map(df: DataFrame, by: str, test: Column) -> DataFrame:
    """(n, hits, by_value): all rows, those that pass, and these by value as a map, whose entries go by value."""
    each = df.groupBy(F.col(by).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("hits"))
    entries = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull() & (F.col("hits") > 0), F.struct("k", "hits"))))
    return each.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.map_from_entries(entries).alias("by_value"))


def reports(df: DataFrame, text: str, words: list[str], low: int, high: int) -> DataFrame:
    """Rows whose text, with nulls as nothing, has all the words, whatever their case, and a length from low to high."""
    t = F.coalesce(text, F.lit(""))
    for w in words:
        df = df.where(t.rlike("(?i)" + w))
    return df.where(F.length(t).between(low, high))


def without_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The table without columns and nested fields of those names, however deep, in structs and in arrays of them."""

    def clean(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            kept = [clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in names]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names))


def parsed_total(df: DataFrame, column: str) -> DataFrame:
    """(total, left_out): the sum of the texts that are plain numbers, and how many are not, such as amounts with a sign of money."""
    x = F.btrim(column)
    plain = x.rlike(r"^[0-9]+(\.[0-9]+)?$")
    return df.agg(F.sum(F.when(plain, x.try_cast("double"))).alias("total"), F.count_if(x.isNotNull() & ~plain).alias("left_out"))
