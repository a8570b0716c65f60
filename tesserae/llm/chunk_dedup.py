"""Repeated passages by content-defined chunking.

A border stands where the gear rolling hash of the text's bytes is the largest within REACH bytes on both sides. So
borders lie more than REACH bytes apart, about twice that on average, and each depends on some bytes around it alone:
an insertion shifts no chunk but its own, and a passage of 50 words holds whole chunks wherever it stands. A stretch of
over MOST bytes without a border is cut every MOST bytes. Of all chunks with one 128-bit digest the first, by doc_id
and place, stays; the others are removed where they stand in runs of RUN bytes or more, so that a few common words which
happen to fall into one chunk are left alone.

The first chunk of a digest is found by a minimum that is summed up before the shuffle, and goes back by a join on the
digest, which Spark splits if one chunk has very many rows.

Defined results: a null text is empty; chunks of REACH bytes or fewer, at a text's ends, are never removed; borders lie
between characters; rows alike in doc_id and text are one document; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.gear import gear_hash
from tesserae.llm.spans import cut, merged_spans, text_id
from tesserae.llm.textbytes import sliding_max, text_slices
from tesserae.llm.work import in_arrow, written

#: Bytes on each side over which a border's hash is the largest, and most bytes of a chunk.
REACH, MOST = 28, 1024
#: Bytes of the shortest run of repeated chunks that is removed: a passage of 50 words holds a longer one.
RUN = 60


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks; every row of one byte or more has one at least."""
    marks = np.zeros(0, np.int64)
    if len(data) > 2 * REACH:
        h = gear_hash(data, offsets)
        key = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the last
        at = np.flatnonzero(sliding_max(key, 2 * REACH + 1) == key[REACH:-REACH]) + REACH
        row = np.searchsorted(offsets, at, "right") - 1
        inside = (at - offsets[row] >= REACH + 31) & (offsets[row + 1] - at > REACH)  # all that decides is the row's own
        marks = at[inside] + 1
    first_byte = np.concatenate([np.flatnonzero(data & 0xC0 != 0x80), [len(data)]])
    marks = first_byte[np.searchsorted(first_byte, marks)]
    edges = np.unique(np.concatenate([marks, offsets]))
    gaps = np.diff(edges)
    if len(gaps) and gaps.max() > MOST:
        long_ = np.flatnonzero(gaps > MOST)
        more = np.concatenate([np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in long_])
        edges = np.unique(np.concatenate([edges, first_byte[np.searchsorted(first_byte, more)]]))
    return edges[:-1], edges[1:]


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, start, end, d1, d2) of each chunk of more than REACH bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch, "text"):
                s, e = borders(data, offsets)
                big = e - s > REACH
                s, e = s[big], e[big]
                row = np.searchsorted(offsets, s, "right") - 1
                raw = data.tobytes()
                digest = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), e.tolist())])
                digest = np.frombuffer(digest, "<i8").reshape(-1, 2)
                take = pa.array(row + at)
                out = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x) for x in (s - offsets[row], e - offsets[row], digest[:, 0].copy(), digest[:, 1].copy()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "tid", "start", "end", "d1", "d2"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), text_id().alias("tid"), "text"), rows, "doc_id long, tid long, start long, end long, d1 long, d2 long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start,end>>, kept binary) of each document."""
    all_ = written(chunks(docs), "chunks")
    place = F.struct("doc_id", "tid", "start")
    first = all_.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    first = written(first, "first")  # a table of its own, so that Spark can split the join's exchange by size
    spans = all_.join(first, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "tid", "start", "end")
    runs = merged_spans(spans).withColumn("spans", F.filter("spans", lambda s: s["end"] - s["start"] >= RUN))
    return cut(docs, written(runs.where(F.size("spans") > 0), "spans"))
