"""A training corpus in five stages: quality, near-duplicates, decontamination, personal data, tokens.

Each stage works on all that the one before kept. What a stage drops is found first and taken out by an anti-join,
which is broadcast if it is small; so the texts that stay are not shuffled.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe_codec, decontaminate, near_dup, pii, quality
from tesserae.llm.spans import text_id
from tesserae.llm.work import small, table, written


def _packed(docs: DataFrame) -> DataFrame:
    """(row, id, tid): each row in a column of its own, so that no name in it clashes, and what tells its document apart."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_id().alias("tid"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from their language reject go.

    Rows with one doc_id and different texts, and rows without a doc_id, are judged each by its own text. A null or
    empty text goes. An empty table stays empty.
    """
    bad = quality.judged(docs).where("not kept").select(F.col("doc_id").alias("i"), F.col("tid").alias("t")).distinct()
    return _packed(docs).join(small(written(bad, "rejected")), F.col("id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t")), "left_anti").select("row.*")


#: Above all doc_ids that are in use: where numbers for further texts under one doc_id begin.
FURTHER = 1 << 62


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 80 %) the document with the least doc_id stays, once.

    Rows alike in doc_id and text are one document. Different texts under one doc_id are documents of their own; the one
    with the least text id counts as the doc_id's, the others come after all doc_ids. Texts without words and rows without
    a doc_id stay. An empty table stays empty.
    """
    rows = _packed(docs)
    texts = rows.where("id is not null").groupBy("id", "tid").agg(F.count("*").alias("n")).groupBy("id").agg(F.min("tid").alias("first"), F.max("tid").alias("last"), F.max("n").alias("n"))
    several = written(texts.where("n > 1 or first <> last").select(F.col("id").alias("i"), "first"), "several")
    some = bool(several.take(1))
    if some:
        node = F.when(F.col("tid") != F.col("first"), F.lit(FURTHER) + F.pmod(F.xxhash64("id", "tid"), F.lit(FURTHER >> 1))).otherwise(F.col("id"))
        rows = rows.join(small(several), F.col("id") == F.col("i"), "left").select("row", node.alias("id"), "tid", F.col("i").isNotNull().alias("several"))
    found = near_dup.near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), k=5, percent=80)
    dropped = found.where("not kept").select(F.col("doc_id").alias("x")).distinct()
    rows = rows.join(small(written(dropped, "dropped")), F.col("id") == F.col("x"), "left_anti")
    if some:
        rows = written(rows, "rows")
        rows = rows.where("not several").select("row").unionAll(rows.where("several").dropDuplicates(["id", "tid"]).select("row"))
    return rows.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 80 % or more of a benchmark item's five-word shingles go.

    Rows with one doc_id share their shingles, so they go or stay together; rows without a doc_id and without text stay.
    """
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("x")).distinct()
    return _packed(docs).join(small(written(hit, "hit")), F.col("id") == F.col("x"), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are generalised to their kind; all rows stay, and n_chars is put right.

    A null text stays null; rows with one doc_id share their terms.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = pii.personal_data(docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *(docs[f"`{c}`"] for c in rest)).alias("rest")))
    some = F.size("spans") > 0
    text = F.when(some, pii.sanitised(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = found.select("doc_id", text.alias("text"), "rest", some.alias("some"))
    values = {c: F.col("rest")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:  # it counts the text's characters
        values["n_chars"] = F.when(F.col("some"), F.length("text")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(values[c].alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of each row and the text they decode to; a null or empty text has no ids and decodes to an empty one."""
    coded = bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("BPE encoding and decoding", tokens)]

#: Byte-pair encoding has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
