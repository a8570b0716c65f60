"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gets n_minima minima. Bands of full minima propose candidates; what is kept of
a signature are the low bits of its minima, packed into longs. The bit count of the XOR of two packed signatures
estimates their similarity, corrected for chance collisions of the low bits; candidates whose estimate lies more than
about five standard deviations under the threshold go, and the others are confirmed on their full sets.

Groups of any size are safe. Equal sets, by a 128-bit digest and their size, are one class from the start. In a band's
bucket each class is paired with the bucket's smallest class only. Where that leaves several components in a bucket,
rounds go on there: each bucket takes another hub, chosen by its key, which is paired with the classes of other
components; confirmed links join components, and only buckets that still hold several stay open. Each round is linear
in the open buckets. When the classes outside each bucket's largest component are few, or rounds no longer help, those
are compared with all the others of their bucket inside a join's condition: by the estimate, and then by the parities
of PARITY counters of the set's hashes. Each shingle that only one of two sets has flips one parity, so more flips than
a linked pair may have rule a link out with certainty; a pair comes out of the first band it shares alone. So no bucket
yields all its pairs, and no link between components is left untried.

Defined results: a null or wordless text has an empty set and is linked with nothing; fewer words than a shingle make
one shingle of the whole sequence; a null doc_id is linked with nothing and kept; rows with one doc_id are one node;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import components
from tesserae.llm.textbytes import U64, list_array, mix, shingle_sets, text_slices
from tesserae.llm.work import in_arrow, likely, written

#: Low bits kept of each minimum, and minima in a band.
BITS, ROWS = 4, 4
#: Parity counters of a set (a power of 2).
PARITY = 4096
#: Comparisons for each open row up to which open buckets are settled at once, and rounds of new hubs before that at most.
FEW, ROUNDS = 16, 40


def n_bands(threshold: float, miss: float = 1e-7) -> int:
    """Bands that lose a pair right at the threshold with a probability of `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def set_digest(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two sums of each set's mixed hashes; equal sets have equal ones, and empty sets zeros."""
    out = np.zeros((2, len(ends) - 1), np.int64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        for row, salt in zip(out, (0xA5A5A5A5A5A5A5A5, 0x5851F42D4C957F2D)):
            row[full] = mix(np.add.reduceat(mix(h ^ U64(salt)), ends[:-1][full])).view(np.int64)
    return out[0], out[1]


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig array<long>, bands array<long>): d1 and d2 are the digest of the set."""
    bands = n_bands(threshold)
    n = bands * ROWS
    rng = np.random.default_rng(20240607)
    mul, add = (rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1) for _ in range(2))
    longs = -(-n * BITS // 64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, data, offsets in text_slices(batch, "text", 1 << 19):
                h, ends = shingle_sets(data, offsets, k)
                size = np.diff(ends)
                full = np.flatnonzero(size)
                starts = ends[:-1][full]
                minima = np.empty((len(full), n), U64)
                if len(full):
                    for i in range(n):
                        minima[:, i] = np.minimum.reduceat(h * mul[i] + add[i], starts)
                d1, d2 = set_digest(h, ends)
                key = np.zeros((len(full), bands), U64)
                for i in range(ROWS):
                    key = mix(key ^ minima[:, i::ROWS]) + np.arange(bands, dtype=U64)
                low = mix(minima) & U64((1 << BITS) - 1)
                packed = np.zeros((len(full), longs), U64)
                for i in range(n):
                    packed[:, i * BITS // 64] |= low[:, i] << U64(i * BITS % 64)
                row_of = np.concatenate([[0], np.cumsum(size > 0)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(size)),
                        pa.array(size, pa.int64()),
                        pa.array(d1),
                        pa.array(d2),
                        list_array(packed.ravel().view(np.int64), row_of * longs, pa.int64()),
                        list_array(key.ravel().view(np.int64), row_of * bands, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>")


def _parities(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The parities of a few sets, packed into PARITY / 64 longs each."""
    n = len(ends) - 1
    counter = np.repeat(np.arange(n), np.diff(ends)) * PARITY + (h[ends[0] : ends[-1]] & U64(PARITY - 1)).astype(np.int64)
    return np.packbits((np.bincount(counter, minlength=n * PARITY) & 1).astype(np.uint8)).view(np.int64)


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """(d1, d2, shingles, parity): each set's digest, its sorted hashes, and their parities packed into longs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                h, ends = shingle_sets(data, offsets, k)
                n = len(ends) - 1
                parity = np.concatenate([np.zeros(0, np.int64), *(_parities(h, ends[i : i + 257]) for i in range(0, n, 256))])
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, set_digest(h, ends)), list_array(h.view(np.int64), ends, pa.int64()), list_array(parity, np.arange(n + 1) * (PARITY // 64), pa.int64())],
                    ["d1", "d2", "shingles", "parity"],
                )

    return in_arrow(docs.select("text"), rows, "d1 long, d2 long, shingles array<long>, parity array<long>")


def estimate(a: Column, b: Column, n: int) -> Column:
    """Similarity of two packed signatures of n minima: equal low bits, less what chance makes equal."""
    differ = F.lit(0)
    for i in range(-(-n * BITS // 64)):
        x = a[i].bitwiseXOR(b[i])
        for shift in [1 << s for s in range(BITS.bit_length() - 1)]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(int("1".rjust(BITS, "0") * (64 // BITS), 2))))
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(n)) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) of each document, linked where 100 * intersection >= percent * union.

    component_id is the smallest doc_id that links reach; kept marks the document whose own doc_id that is. n_links
    counts the confirmed links that this run met at the document's class of equal sets, enough to connect components;
    pairs inside a component that is already connected are not all visited.
    """
    threshold = percent / 100
    n = n_bands(threshold) * ROWS
    floor = threshold - 5.2 * math.sqrt(threshold * (1 - threshold) / n) / (1 - 2.0**-BITS)
    sigs = written(signatures(docs, k, threshold), "sigs")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    equal = ["d1", "d2", "n_shingles"]
    classes = full.groupBy(*equal).agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    hubs = written(buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").select("key", "hub"), "hubs")
    member = written(likely(buckets, "key", hubs.select("key")).join(hubs, "key"), "members")
    met = classes.join(member.select("rep").distinct(), "rep", "left_semi")
    sets = written(_sets(docs, met.select("rep", "least", "d1", "d2"), k), "sets")
    sig = classes.select("rep", "sig")
    stars = written(member.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    links = written(_confirmed(written(_close(stars, sig, n, floor), "stars"), sets, percent), "links")
    links, label = _rounds(member.select("rep", "key"), links, classes.select("rep", "sig", "bands"), sets, n, floor, percent)
    # One doc_id may stand on several rows with different texts; they are one node.
    several = full.groupBy("doc_id").agg(F.min(F.struct(*equal)).alias("p"), F.max(F.struct(*equal)).alias("q")).where("p <> q").select("doc_id")
    several = written(full.join(several, "doc_id", "left_semi").select("doc_id", *equal).distinct(), "several")
    if several.take(1):
        shared = several.join(classes.select("rep", *equal), equal)
        shared = shared.join(shared.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(shared))

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.select("rep", "least", *equal).join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = named.groupBy("component").agg(F.min("least").alias("c"))
    named = written(named.join(first, "component").join(degree, "rep", "left").select(*equal, "c", "n_links"), "named")
    out = sigs.select("doc_id", *equal).join(named, equal, "left")
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce(F.when(alone, None).otherwise(F.col("c")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def _mixed(member: DataFrame, label: DataFrame) -> DataFrame:
    """(rep, key, part, largest) of the buckets that hold several components; largest marks rows of a bucket's largest one."""
    parts = written(member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("part")), "parts")
    counts = parts.groupBy("key", "part").agg(F.count("*").alias("n"))
    top = counts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    top = written(top.select("key", F.col("top.part").alias("top")), "mixed")
    return written(parts.join(top, "key").select("rep", "key", "part", (F.col("part") == F.col("top")).alias("largest")), "open")


def _work(open_: DataFrame) -> tuple[int, int]:
    """Comparisons that settling all open buckets at once would take, and the rows in them."""
    sizes = open_.groupBy("key").agg(F.count("*").alias("m"), F.count_if(~F.col("largest")).alias("few"))
    r = sizes.agg(F.sum(F.col("m") * F.col("few")), F.sum("m")).first()
    return int(r[0] or 0), int(r[1] or 0)


def _rounds(member: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, n: int, floor: float, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links found, and (node, component) of them, when no bucket holds two components that were not compared."""
    sig, label = classes.select("rep", "sig"), components(links)
    open_ = _mixed(member, label)
    work, rows = _work(open_)
    for salt in np.random.default_rng(77).integers(1 << 62, size=ROUNDS).tolist():
        if work <= FEW * rows:
            break
        order = F.col("rep").bitwiseXOR(F.col("key")).bitwiseXOR(F.lit(salt))
        hubs = written(open_.groupBy("key").agg(F.min(order).alias("o")).select("key", F.col("o").bitwiseXOR(F.col("key")).bitwiseXOR(F.lit(salt)).alias("hub")), "hubs")
        hubs = written(hubs.join(open_.select("key", F.col("rep").alias("hub"), F.col("part").alias("p")), ["key", "hub"]), "hubs")
        pairs = written(open_.join(hubs, "key").where("part <> p").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct(), "pairs")
        more = written(_confirmed(written(_close(pairs, sig, n, floor), "stars"), sets, percent), "links")
        if more.take(1):
            links = links.unionAll(more)
            label = components(_as_links(label).unionAll(more))
            open_ = _mixed(open_.select("rep", "key"), label)
        last, (work, rows) = work, _work(open_)
        if work > 0.75 * last:
            break
    if rows:
        marks = sets.select("rep", F.size("shingles").alias("n"), "parity")
        all_ = written(open_.join(classes, "rep").join(marks, "rep"), "open")
        x, y = (all_.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "part", "largest", "sig", "n", "parity", "bands"))) for s in "xy")
        flips = F.aggregate(F.zip_with("parity_x", "parity_y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
        least, most = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
        alike = (100 * least >= percent * most) & (estimate(F.col("sig_x"), F.col("sig_y"), n) >= floor) & ((100 + percent) * flips <= (100 - percent) * (least + most))
        once = (F.col("part_x") != F.col("part_y")) & (F.col("largest_y") | (F.col("part_x") < F.col("part_y")))
        first = F.array_min(F.array_intersect("bands_x", "bands_y")) == x["key"]
        pairs = x.where("not largest_x").join(y, (x["key"] == y["key"]) & once & alike & first)
        pairs = written(pairs.select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct(), "pairs")
        more = written(_confirmed(pairs, sets, percent), "links")
        if more.take(1):
            links = links.unionAll(more)
            label = components(_as_links(label).unionAll(more))
    return links.distinct(), label


def _as_links(label: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _close(pairs: DataFrame, sig: DataFrame, n: int, floor: float) -> DataFrame:
    a, b = (likely(sig, "rep", pairs.select(c)).select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(estimate(F.col("sig_a"), F.col("sig_b"), n) >= floor).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The shingle sets of the wanted classes (rep, least, d1, d2); of the texts, few but those under their least doc_ids are shuffled."""
    wanted = written(wanted, "wanted")
    some = likely(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", wanted.select("least"))
    some = some.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id")  # a semi-join would be moved before the filter
    return shingle_table(some, k).join(wanted.select("rep", "d1", "d2"), ["d1", "d2"]).select("rep", "shingles", "parity").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    a, b = (likely(sets, "rep", pairs.select(c)).select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
