"""Byte spans of documents: gathered for each document, joined and cut out of its text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.work import in_arrow, is_small, small


def text_id() -> Column:
    """With doc_id it tells documents apart: rows alike in both are one document, repeated."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    return starts[new], ends[last]


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, tid, spans array<struct<start,end>>): each document's spans as maximal runs, in order."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(2).flatten(), [0]
            starts, stops, at = flat.field("start").to_numpy(), flat.field("end").to_numpy(), 0
            out = []
            for n in batch.column(2).value_lengths().to_pylist():
                s, e = merged(starts[at : at + n], stops[at : at + n])
                at += n
                out.append((s, e))
                ends.append(ends[-1] + len(s))
            both = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)])) for i in (0, 1)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)], ["doc_id", "tid", "spans"])

    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    gathered = spans.groupBy("doc_id", "tid").agg(F.collect_set(span).alias("spans"))  # distinct, so that repeated rows add nothing
    return in_arrow(gathered, runs, "doc_id long, tid long, spans array<struct<start:long,end:long>>")


def only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tid, text) of the documents in wanted (columns i and t); a semi-join that is broadcast if wanted is small."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"), "text")
    return texts.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t")), "left_semi")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start,end>>, kept binary) of each document, and the other columns of spans.

    spans is a written table with one row for each doc_id and tid (of text_id()) and `spans`, an array of start and end
    in bytes; overlaps are fine. A document has as many of them as its length allows. Other columns are longs, 0 for
    documents without a row. If the keys of spans are small, only the texts under them are shuffled.
    """
    more = [c for c in spans.columns if c not in ("doc_id", "tid", "spans")]
    schema = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary" + "".join(f", {c} long" for c in more)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, spans = batch.column(0), batch.column(1), batch.column(2)
            size, removed, kept = [], [], []
            for i in range(batch.num_rows):
                text = memoryview(texts[i].as_buffer()) if texts[i].is_valid else memoryview(b"")
                size.append(len(text))
                if not spans[i].is_valid or not len(spans[i]):
                    removed.append([])
                    kept.append(bytes(text))
                    continue
                own = spans[i].values
                s, e = merged(own.field("start").to_numpy(), own.field("end").to_numpy())
                removed.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
                edges = zip([0, *e.tolist()], [*s.tolist(), len(text)])
                kept.append(b"".join([text[a:b] for a, b in edges]))
            out = [names, pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out + [batch.column(3 + i) for i in range(len(more))], ["doc_id", "n_bytes", "removed", "kept", *more])

    def done(df: DataFrame) -> DataFrame:
        return in_arrow(df.select("doc_id", F.col("text").cast("binary").alias("text"), "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in more)), rows, schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_id().alias("tid"))
    own = spans.select(F.col("doc_id").alias("i"), F.col("tid").alias("t"), "spans", *more)
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t"))
    keys = own.select("i", "t")
    if not is_small(keys):
        return done(texts.join(own, same, "left"))
    none = [F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), *(F.lit(0).alias(c) for c in more)]
    rest = texts.join(F.broadcast(keys), same, "left_anti").select("*", *none)
    return done(texts.join(F.broadcast(keys), same, "left_semi").join(own, same)).unionByName(done(rest))
