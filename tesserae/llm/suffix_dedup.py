"""Exact removal of long repeated byte strings by column-wise construction of a collection's suffix order.

The construction is that of Bauer, Cox and Rosone for many documents: documents are read from their last column to
their first; each round inserts one symbol of each document, sorts by it with the order of the round before as the
tie-break, and updates the common prefixes of neighbours by range minima. Over whole documents that takes as many
passes over all data as the longest document has bytes, so three things bound it, none of which loses a match:

- Anchors. In each window of `length` bytes the 64-byte string with the least hash (the last of equals) is its anchor.
  Equal windows have equal anchors at equal places. The windows of one document with one anchor form a run; runs are
  cut in halves, whose windows all contain one core. A core that occurs once cannot hold a repeated window.
- Copies. Runs of equal bytes are one fragment, with its number; if a core has one fragment only, all is repeated.
  What tells them apart are two 64-bit hashes that no choice of bytes makes collide, of the core and of the run.
- Columns. Fragments with one core are aligned at it, and only suffixes in one column can be equal windows. So a round
  keeps the order of one column, and has `length` and the run's windows as columns at most, however long documents are.

A core with more than HOT fragments (a passage in very many documents, between texts of their own) goes another exact
way, which needs no group in one task: its windows are counted by their hash, summed up before the shuffle.

A window is repeated if a neighbour in the order shares `length` bytes. Runs of rounds live in memory in blocks of
about BLOCK fragments; the sequential files of the method are Spark's sorted shuffle files.

Defined results: matches never cross documents; a null text is empty; texts under `length` bytes lose nothing; rows
alike in doc_id and text repeat each other; an empty table gives no rows; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.spans import cut, merged_spans, only, text_id
from tesserae.llm.textbytes import U64, byte_values, mix, prefix_hash, range_hash, span_hashes, text_slices
from tesserae.llm.work import dropped, in_arrow, written

#: Bytes of an anchor, fragments of a block, and fragments of a core beyond which windows are counted by hash.
ANCHOR, BLOCK, HOT = 64, 8192, 4096
_M32 = U64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: the block-wise prefix and suffix minima of van Herk."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows: row, start (first window), d (anchor's place in it), n (windows), key (core) and full (all bytes)."""
    n, w = len(data), length - ANCHOR + 1
    half = -(-w // 2)
    sizes = np.diff(offsets)
    big = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if not len(big):
        return {k: none for k in ("row", "start", "d", "n", "key", "full")}
    at = np.arange(n - ANCHOR + 1)
    h = range_hash(prefix_hash(data, byte_values(7)), at, at + ANCHOR)
    least = _sliding_min((h & ~_M32) | (_M32 - at.astype(U64)), w)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, offsets[:-1][big], 1)
    np.add.at(edge, offsets[1:][big] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]))
    anchor = (_M32 - (least[window] & _M32)).astype(np.int64)
    d = anchor - window
    q = d // half
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (q[1:] != q[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    start, i, d, q = window[first], anchor[first], d[first], q[first]
    core = span_hashes(data, i - q * half, i - np.minimum(q * half + half - 1, w - 1) + length, 3)
    full = span_hashes(data, start, window[last] + length, 4)
    row = np.searchsorted(offsets, start, "right") - 1
    return {"row": row, "start": start - offsets[row], "d": d, "n": window[last] - start + 1, "key": mix(core + q.astype(U64)).view(np.int64), "full": mix(full + d.astype(U64)).view(np.int64)}


def repeated_columns(group: np.ndarray, d: np.ndarray, n: np.ndarray, fragments: list[bytes], length: int) -> list[np.ndarray]:
    """For each fragment, which of its windows occur in another fragment of its group (rows come sorted by group).

    The rounds go from the last column to the first. `order` is the collection sorted by what follows in each
    fragment, `common` the common prefix of each with the one before it in that order.
    """
    m, most = len(d), int(d.max())
    left = most - d
    size = n + length - 1
    cols = np.full((int((left + size).max()), m), -1, np.int16)
    for j, (x, s) in enumerate(zip(left.tolist(), fragments)):
        cols[x : x + len(s), j] = np.frombuffer(s, np.uint8)
    found = np.zeros((int((left + n).max()), m), bool)
    order = np.arange(m)
    head = np.ones(m, bool)
    head[1:] = group[1:] != group[:-1]
    heads = np.flatnonzero(head)
    rank = np.cumsum(head) - 1
    common = np.zeros(m + 1, np.int32)
    for x in range(len(cols) - 1, -1, -1):
        symbol = cols[x][order]
        if (symbol == symbol[heads][rank]).all() and symbol.min() >= 0:
            common[:-1][~head] += 1
        else:
            place = np.argsort(rank * 512 + symbol, kind="stable")
            symbol, sorted_ = symbol[place], order[place]
            same = (symbol[1:] == symbol[:-1]) & ~head[1:] & (symbol[1:] >= 0)
            pair = np.flatnonzero(same)
            new = np.zeros(m + 1, np.int32)
            if len(pair):
                ends = np.empty(2 * len(pair), np.int64)
                ends[::2], ends[1::2] = place[pair] + 1, place[pair + 1] + 1
                new[pair + 1] = 1 + np.minimum.reduceat(common, ends)[::2]
            order, common = sorted_, new
        if x < len(found):
            hit = (common[:-1] >= length) | (common[1:] >= length)
            found[x, order[hit]] = True
    return [found[x : x + k, j] for j, (x, k) in enumerate(zip(left.tolist(), n.tolist()))]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch, "text"):
                r = find_runs(data, offsets, length)
                row = pa.array(r["row"] + at)
                out = [batch.column(0).take(row), batch.column(1).take(row)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(r[c], t) for c, t in (("start", pa.int64()), ("d", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("full", pa.int64()))], ["doc_id", "tid", "start", "d", "n", "key", "full"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), text_id().alias("tid"), "text"), rows, "doc_id long, tid long, start long, d int, n int, key long, full long")


_RUNS = "array<struct<a:int,b:int>>"
_FRAGMENT = "key long, full long, d int, n int, copies long, hot boolean, fragment binary, windows array<long>"


def _fragments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted fragment, or for hot ones the hashes of its windows. wanted: one place of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i in range(batch.num_rows):
                text = memoryview(batch.column(0)[i].as_buffer())
                for f in batch.column(1)[i].as_py():
                    s, k = f["start"], f["n"]
                    for c, name in enumerate(("key", "full", "d", "n", "copies", "hot")):
                        out[c].append(f[name])
                    fragment = text[s : s + k + length - 1]
                    out[6].append(None if f["hot"] else bytes(fragment))
                    at = np.arange(k)
                    out[7].append(span_hashes(np.frombuffer(fragment, np.uint8), at, at + length, 5).view(np.int64) if f["hot"] else None)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], [x.split()[0] for x in _FRAGMENT.split(", ")])

    by_doc = wanted.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n", "key", "full", "d", "copies", "hot")).alias("list"))
    by_doc = written(by_doc.select(F.col("doc_id").alias("i"), F.col("tid").alias("t"), "list"), "wanted")
    texts = only(docs, by_doc.select("i", "t"))
    both = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t")))
    return in_arrow(both.select(F.col("text").cast("binary").alias("text"), "list"), rows, _FRAGMENT)


def _by_order(fragments: DataFrame, length: int) -> DataFrame:
    """(key, full, d, n, found): runs of repeated windows (first, last), by rounds over blocks of whole groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list) -> pa.RecordBatch:
            key = np.array([r[0] for r in held])
            d, n = np.array([r[2] for r in held]), np.array([r[3] for r in held])
            found = repeated_columns(key, d, n, [r[5] for r in held], length)
            edges = [np.array([0, k]) if r[4] > 1 else np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]]))) for r, f, k in zip(held, found, n.tolist())]
            ends = np.concatenate([[0], np.cumsum([len(e) // 2 for e in edges])])
            flat = np.concatenate(edges).astype(np.int32)
            ranges = pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2] - 1)], ["a", "b"])
            found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ranges)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array([r[1] for r in held], pa.int64()), pa.array(d, pa.int32()), pa.array(n, pa.int32()), found], ["key", "full", "d", "n", "found"])

        held: list = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BLOCK and r[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                if not held or held[-1][:4] != r[:4]:  # repeated rows of the table give a fragment more than once
                    held.append(r)
        if held:
            yield solved(held)

    ordered = fragments.select("key", "full", "d", "n", "copies", "fragment").repartition("key").sortWithinPartitions("key", "full", "d", "n")
    return in_arrow(ordered, rows, f"key long, full long, d int, n int, found {_RUNS}")


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(doc_id, tid, start, end): byte spans covered by strings of `length` bytes that start anywhere else as well."""
    runs = written(_runs(docs, length), "runs")
    groups = runs.groupBy("key").agg(F.count("*").alias("rows"), F.min("full").alias("low"), F.max("full").alias("high")).where("`rows` > 1")
    groups = written(groups.select("key", (F.col("low") != F.col("high")).alias("mixed")), "groups")  # a table of its own, so that Spark can split the join's exchange
    shared = written(runs.join(groups, "key"), "shared")
    dropped(runs)
    whole = shared.where("not mixed").select("doc_id", "tid", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))

    mixed = shared.where("mixed")
    kinds = mixed.groupBy("key", "full", "d", "n").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tid", "start")).alias("at"))
    kinds = written(kinds, "kinds")
    many = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("key", F.lit(True).alias("hot"))
    wanted = kinds.join(many, "key", "left").select("at.*", "key", "full", "d", "n", "copies", F.coalesce("hot", F.lit(False)).alias("hot"))
    fragments = written(_fragments(docs, wanted, length), "fragments")
    ordered = _by_order(fragments.where("not hot"), length)

    windows = fragments.where("hot").select("key", "full", "d", "n", "copies", F.posexplode("windows").alias("i", "w"))
    windows = windows.dropDuplicates(["key", "full", "d", "n", "i"]).withColumn("place", F.col("d") - F.col("i"))
    twice = windows.groupBy("key", "place", "w").agg(F.sum("copies").alias("times")).where("times > 1").select("key", "place", "w")
    counted = windows.join(twice, ["key", "place", "w"]).groupBy("key", "full", "d", "n").agg(_ranges(F.array_sort(F.collect_list("i"))).cast(_RUNS).alias("found"))

    found = written(ordered.unionByName(counted), "found")
    ranges = mixed.join(found, ["key", "full", "d", "n"]).select("doc_id", "tid", "start", F.explode("found").alias("r"))
    return whole.unionByName(ranges.select("doc_id", "tid", (F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b") + length).alias("end")))


def _ranges(places: Column) -> Column:
    """Runs of consecutive places of a sorted array, as structs of the first and the last."""

    def runs(x: Column) -> Column:
        first = F.filter(x, lambda v, i: (i == 0) | (F.get(x, i - 1) != v - 1))
        last = F.filter(x, lambda v, i: (i == F.size(x) - 1) | (F.get(x, i + 1) != v + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.transform(F.array(places), runs)[0]


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 256) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start,end>>, kept binary, passage_bytes long) of each document.

    passage_bytes counts the bytes covered by strings of the shorter length `passage` that start anywhere else as well;
    they are counted, not removed. A string of `length` bytes that is repeated lies in a run of such bytes that is as
    long, so only documents with such a run are searched for it.
    """
    shorter = written(merged_spans(repeated_spans(docs, passage)), "passages")
    long_ = shorter.where(F.exists("spans", lambda s: s["end"] - s["start"] >= length)).select(F.col("doc_id").alias("i"), F.col("tid").alias("t"))
    spans = written(merged_spans(repeated_spans(only(docs, long_), length)), "spans")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    both = shorter.select("doc_id", "tid", total.alias("n")).join(spans, [shorter["doc_id"].eqNullSafe(spans["doc_id"]), shorter["tid"] == spans["tid"]], "left")
    both = written(both.select(shorter["doc_id"], shorter["tid"], "n", "spans"), "found")
    return cut(docs, both.withColumnRenamed("n", "passage_bytes"))
