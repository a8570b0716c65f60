"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into FEATURES columns. Their document
frequencies cover all learning documents. The weights are learned from a bounded sample, the documents with the least
hash of doc_id in each language, MOST in all or EACH of every language, whichever is more. Their vectors are worked out
where they lie and fitted in one task, by follow-the-regularised-leader (McMahan et al., 2013) with elastic-net penalties,
which leaves weights of no use at zero; one in five of the sample is held back, and the temperature that gives it the
greatest likelihood scales the scores. Every language is learned; a table with more than LANGUAGES is refused.

Defined results: a text that is null or has no letter is `und` with score 0; where nothing can be learned every text
is; whole texts of any length are read; rows alike are predicted alike; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.work import in_arrow, written

FEATURES, GRAMS = 1 << 15, 3
#: Bounds of the sample: documents in all, documents of each language at least, and languages.
MOST, EACH, LANGUAGES = 4000, 20, 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-5, 3


def grams(text: str) -> np.ndarray:
    """The columns of all n-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        out.append((h >> np.uint64(7)) & np.uint64(FEATURES - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and L2-normalised weights of a text."""
    n = np.bincount(grams(text), minlength=FEATURES)
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_labels: int) -> tuple[np.ndarray, float]:
    """Weights (FEATURES + 1, n_labels), the last row for the constant, and the temperature. Every fifth vector is held back."""
    vectors = [(np.append(at, FEATURES), np.append(x, 1.0)) for at, x in vectors]
    z, n = np.zeros((FEATURES + 1, n_labels)), np.zeros((FEATURES + 1, n_labels))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    learn, held = [i for i in range(len(vectors)) if i % 5], [i for i in range(len(vectors)) if i % 5 == 0]
    for _ in range(EPOCHS):
        for i in learn:
            at, x = vectors[i]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    logits = np.array([vectors[i][1] @ w[vectors[i][0]] for i in held])
    y = np.array([labels[i] for i in held], int)
    steps = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in steps] if len(y) else [0.0]
    return w, float(steps[int(np.argmin(loss))]) if len(y) else 1.0


def held_out() -> Column:
    """True for every fifth document, by the CRC-32 of its doc_id as text; a null doc_id is held out as well."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each column occurs, summed up by task and then by column; and the number of texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n[np.flatnonzero(np.bincount(grams(text.as_py()), minlength=FEATURES))] += 1
                n[FEATURES] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["c", "n"])

    out = np.zeros(FEATURES + 1, np.int64)  # FEATURES rows, whatever the size of the input
    for c, n in in_arrow(docs.select("text"), rows, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[c] = n
    return out[:-1], int(out[-1])


def sampled(known: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(doc_id, lang, h): each language's documents with the least hash of doc_id, one row for each doc_id."""
    each = max(EACH, MOST // len(counts))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 3.0 * each / n)])  # about three times what is wanted passes
    ids = known.where(h < share[F.col("lang")] * (1 << 24)).groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("h", h)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return ids.withColumn("r", rank).where(F.col("r") <= each).drop("r")


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, IDF, weights and temperature from the documents that are not held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").where(~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    langs = sorted(counts)
    if not langs:
        return [], np.zeros(0), np.zeros((0, 0)), 1.0
    n, total = frequencies(known)
    idf = np.log((1 + total) / (1 + n)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, x = vector(batch.column(0)[i].as_py(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), batch.column(3).slice(i, 1), pa.array([at], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float64()))], ["lang", "h", "doc_id", "at", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), map(_array, b.column(3)), map(_array, b.column(4)))]
        rows.sort(key=lambda r: (hash_of(r[2]), r[2]))
        w, t = fit([r[3:] for r in rows], [langs.index(r[0]) for r in rows], len(langs))
        at, lang = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*lang, -1], pa.int32()), pa.array([*w[at, lang], t], pa.float64())], ["at", "lang", "w"])

    sample = written(sampled(known, counts), "sample").withColumnRenamed("doc_id", "d").withColumnRenamed("lang", "l")
    texts = known.join(F.broadcast(sample), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")))  # its rows are bounded by MOST and EACH
    texts = texts.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))
    rows = in_arrow(texts.select("text", "lang", "h", "doc_id"), vectors, "lang string, h long, doc_id long, at array<int>, x array<double>")
    model = in_arrow(rows.coalesce(1), fitted, "at int, lang int, w double").toArrow()  # a bounded sample, and FEATURES weights a language at most
    at, lang, w = (model.column(i).to_numpy() for i in range(3))
    out = np.zeros((FEATURES + 1, len(langs)))
    out[at[at >= 0], lang[at >= 0]] = w[at >= 0]
    return langs, idf, out, float(w[at < 0][0]) if (at < 0).any() else 1.0


def _array(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy()


def hash_of(x: int) -> int:
    """A fixed shuffle of the sample, so that languages and parts of the table alternate."""
    return (x + 1) * 0x9E3779B97F4A7C15 % (1 << 64) >> 16


def predict(docs: DataFrame, langs: list[str], idf: np.ndarray, w: np.ndarray, temperature: float) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document."""
    model = docs.sparkSession.sparkContext.broadcast((langs, idf, w.astype(np.float32), temperature))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, w, t = model.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2):
                text = text.as_py()
                if not langs or not text or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at, x = vector(text, idf)
                p = softmax((x.astype(np.float32) @ w[at] + w[FEATURES]).astype(np.float64) / t)
                names.append(langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(docs))
