"""Benchmark items inside documents, by size-partitioned MinHash containment search. DataFrame functions only.

A short item inside a long document has a tiny Jaccard similarity with it, so comparing both sides' minima finds
nothing. As in an LSH ensemble (Zhu et al., 2016) the search is by containment and by partitions of size, here of the
items: an item's minima are looked up among all of the document's shingles, and the part that is found estimates the
containment itself, without regard to the document's length. A partition holds the items whose number of shingles has
one power of 2. Below ALL shingles every shingle is a minimum, and the estimate is the containment. Each partition above
takes more minima than the one before, as longer items meet more documents by chance, up to MOST. The minima of an item
are drawn by independent hashes, so those found are binomial; each partition's floor is the greatest share that a pair
right at the threshold falls short of with a probability of MISS at most. Pairs that reach the floor are verified by the
exact share of the item's distinct shingles that the document has.

Document shingles meet the minima in a broadcast join if these are few, else in a shuffled join; no row of a
document leaves its task unless it has found a minimum. Hits are grouped by document and item, never by item alone.

Defined results: null and wordless texts and items have no shingles and no hits; fewer words than a shingle make one
shingle; rows with one doc_id or item_id share their shingles; a null doc_id or item_id has no hits; an empty table
gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.work import small, written

#: Shingles below which all are minima; minima of the first partition above and of the last; the chance to lose a pair.
ALL, FIRST, STEP, MOST, MISS = 32, 24, 4, 48, 1e-9
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, k: int) -> Column:
    """Hashes of the k-word shingles, repeats included."""

    def of(h: Column) -> Column:
        n = F.size(h)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(h))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, k))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item_id, g array, n) of each item with a shingle."""
    g = items.select(F.col("item_id").cast("long"), F.explode(shingles(F.col("text"), k)).alias("g"))
    return g.where("item_id is not null").groupBy("item_id").agg(F.collect_set("g").alias("g")).withColumn("n", F.size("g"))


def floor_of(m: int, share: float) -> float:
    """The share of m minima that are found with a probability of all but MISS, if each is with that of `share`."""
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * share**k * (1 - share) ** (m - k)
        if below > MISS:
            return k / m
    return 1.0


def minima(sets: DataFrame, percent: int) -> DataFrame:
    """(item_id, g, weight, floor): weight is the share of the item's minima that fall on shingle g, floor its partition's."""
    part = F.floor(F.log2("n")).cast("int")
    many = F.least(F.lit(FIRST) + STEP * (part - (ALL.bit_length() - 1)), F.lit(MOST))
    hashed = F.transform(F.sequence(F.lit(1), F.col("m")), lambda j: F.array_min(F.transform("g", lambda x: F.struct(F.xxhash64(x, j).alias("h"), x.alias("g"))))["g"])
    floors = F.create_map(*[F.lit(x) for m in range(FIRST, MOST + 1) for x in (m, floor_of(m, percent / 100))])
    taken = sets.withColumn("m", F.when(F.col("n") < ALL, F.col("n")).otherwise(many))
    taken = taken.select("item_id", "n", "m", F.explode(F.when(F.col("n") < ALL, F.col("g")).otherwise(hashed)).alias("g"))
    floor = F.when(F.col("n") < ALL, percent / 100).otherwise(floors[F.col("m")])
    return taken.groupBy("item_id", "g").agg((F.count("*") / F.max("m")).alias("weight"), F.max(floor).alias("floor"))


def contamination(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each pair where the document has that share of the item."""
    sets = written(item_sets(items, k), "items")
    keys = written(minima(sets, percent), "minima")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    met = texts.select("doc_id", F.explode(shingles(F.col("text"), k)).alias("g")).join(small(keys), "g")
    found = met.groupBy("doc_id", "item_id", "g").agg(F.max("weight").alias("weight"), F.max("floor").alias("floor")).groupBy("doc_id", "item_id").agg(F.sum("weight").alias("estimate"), F.max("floor").alias("floor"))
    pairs = written(found.where(F.col("estimate") >= F.col("floor") - 1e-9).select("doc_id", "item_id"), "pairs")

    ids = pairs.select("doc_id").distinct()
    own = texts.join(small(ids), "doc_id", "left_semi").select("doc_id", shingles(F.col("text"), k).alias("own"))
    both = own.join(small(pairs), "doc_id").join(small(sets), "item_id")
    shared = both.select("doc_id", "item_id", "n", F.array_intersect("g", "own").alias("shared"))
    shared = shared.select("doc_id", "item_id", "n", F.explode("shared").alias("g")).groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_shingles"), F.count_distinct("g").alias("n_shared"))
    return shared.where(100 * F.col("n_shared") >= percent * F.col("n_shingles")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
