"""PDF files as records, by a backend that reads their pages.

A backend is a function from a file's bytes to a dict of lists: `pages` (page, images), `blocks` (page, seq, x0, y0, x1,
y1, text), `tables` (page, x0, y0, x1, y1, cells: a list of rows of texts) and `figures` (page, seq, digest, width,
height, cover, content). It runs where the file is; all that follows are plans over its rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import clean, strip_citations
from tesserae.operators import pdf
from tesserae.operators.profile import table_records
from tesserae.operators.vision import analysis_text
from tesserae.sources.tables import TableStore, tidy

_BOX = "page:int,x0:double,y0:double,x1:double,y1:double"
PARTS = {
    "pages": "array<struct<page:int,images:int>>",
    "blocks": f"array<struct<{_BOX},seq:int,text:string>>",
    "tables": f"array<struct<{_BOX},cells:array<array<string>>>>",
    "figures": "array<struct<page:int,seq:int,digest:string,width:int,height:int,cover:double,content:string>>",
}
_NONE = {"page": "int", "table_id": "string", "part": "string", "image_path": "string", "heading": "string"}


def extracted(files: DataFrame, backend: Callable[[bytes], dict]) -> DataFrame:
    """(doc, pages, blocks, tables, figures) of files (doc, content)."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: json.dumps(backend(bytes(c))))

    schema = ", ".join(f"{k}: {v}" for k, v in PARTS.items())
    return files.select("doc", F.from_json(run("content"), schema.replace(": array", " array")).alias("r")).select("doc", "r.*")


def page_texts(read: DataFrame, citations: bool = False) -> DataFrame:
    """(doc, page, text): each page without tables, running heads and references, its blocks in reading order."""
    blocks = read.select("doc", F.inline("blocks"))
    boxes = read.select("doc", F.inline("tables")).select("doc", "page", "x0", "y0", "x1", "y1")
    rows = pdf.without_references(pdf.without_running_heads(_outside(blocks, boxes)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda b: b["text"]), "\n\n")
    pages = rows.groupBy("doc", "page").agg(text.alias("text"))
    return pages.select("doc", "page", clean(F.col("text") if citations else strip_citations(F.col("text"))).alias("text")).where("text <> ''")


def _outside(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """pdf.outside_tables() for many files: a page's number is told apart by its file."""
    key = lambda df: df.withColumn("page", F.struct("doc", "page"))
    out = pdf.outside_tables(key(blocks), key(boxes).drop("doc"))
    return out.withColumn("page", F.col("page.page"))


def pdf_reader(backend: Callable[[bytes], dict], tables: TableStore, ocr: Callable[[bytes, int], str] | None = None, analyzer: Callable[[bytes, str], dict] | None = None) -> Callable:
    """A reader of PDF files for ingest_topic(). Scanned pages go to `ocr`, figures to `analyzer`, if there are such."""

    def records(spark: SparkSession, path: str, topic: str, source: str) -> DataFrame:
        file = spark.read.format("binaryFile").load(path).select(F.lit(source).alias("doc"), "content")
        read = extracted(file, backend).cache()
        try:
            return _records(spark, file, read, topic, source)
        finally:
            read.unpersist()

    def row(df: DataFrame, topic: str, source: str, modality: str, **given) -> DataFrame:
        more = [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in _NONE.items()]
        return df.select(F.lit(topic).alias("topic_id"), F.lit(source).alias("source"), F.col("page").cast("int").alias("ordinal"), "text", F.lit(modality).alias("modality"), *more)

    def _records(spark: SparkSession, file: DataFrame, read: DataFrame, topic: str, source: str) -> DataFrame:
        texts = page_texts(read)
        if ocr is not None:
            seen = read.select("doc", F.inline("blocks")).groupBy("doc", "page").agg(F.sum(F.length(F.btrim("text"))).alias("chars"))
            pages = read.select("doc", F.inline("pages")).join(seen, ["doc", "page"], "left").fillna(0, ["chars"])

            @F.pandas_udf("string")
            def recognised(content: pd.Series, page: pd.Series) -> pd.Series:
                return pd.Series([ocr(bytes(c), int(p)) for c, p in zip(content, page)])

            scans = pdf.scanned_pages(pages).join(file, "doc").select("doc", "page", recognised("content", "page").alias("text")).where("text <> ''")
            texts = texts.join(scans.select("doc", "page"), ["doc", "page"], "left_anti").unionByName(scans)
        out = [row(texts, topic, source, "text", page=F.col("page"))]
        cells = read.select("doc", F.posexplode("tables").alias("table", "t")).select("doc", F.col("t.page").alias("page"), "table", F.posexplode("t.cells").alias("row", "r"))
        cells = cells.select("doc", "page", "table", "row", F.posexplode("r").alias("col", "text"))
        tidied = pdf.tidy_tables(cells).collect()  # the tables of one file
        found: dict[tuple[int, int], dict] = {}
        for c in tidied:
            found.setdefault((c["page"], c["table"]), {}).setdefault(c["col"], (c["name"], {}))[1][c["row"]] = c["text"] if c["number"] is None else c["number"]
        on_page: dict[int, int] = {}
        for (page, _), columns in sorted(found.items()):
            on_page[page] = on_page.get(page, 0) + 1
            id_, names = f"p{page}t{on_page[page]}", [columns[k][0] for k in sorted(columns)]
            n = max(max(v) for _, v in columns.values())
            values = [[columns[k][1].get(i) for k in sorted(columns)] for i in range(1, n + 1)]
            kinds = ["double" if all(isinstance(v, float) for v in columns[k][1].values()) else "string" for k in sorted(columns)]
            frame = spark.createDataFrame(values, ", ".join(f"`{name}` {kind}" for name, kind in zip(names, kinds)))
            tables.save(tidy(frame), topic, source, id_)
            out.append(table_records(tables.load(topic, source, id_, rows=True), topic, source, id_, page))
        if analyzer is not None:
            figures = pdf.select_figures(read.select("doc", F.inline("figures")))

            @F.pandas_udf("struct<caption:string,ocr_text:string,details:string>")
            def analyzed(content: pd.Series) -> pd.DataFrame:
                rows = [analyzer(bytes.fromhex(c), "image/png") for c in content]
                return pd.DataFrame([{k: r.get(k) for k in ("caption", "ocr_text", "details")} for r in rows], columns=["caption", "ocr_text", "details"])

            said = figures.select("page", "number", analyzed("content").alias("a")).select("page", "number", analysis_text(F.col("a.caption"), F.col("a.ocr_text"), F.col("a.details")).alias("text")).where("text <> ''")
            out.append(row(said, topic, source, "image", page=F.col("page"), image_path=F.concat(F.lit(f"{source}-p"), "page", F.lit("-"), "number", F.lit(".png"))))
        columns, rows = out[0].columns, out[0]
        for more in out[1:]:
            rows = rows.unionByName(more.select(columns))
        return spark.createDataFrame(rows.collect(), rows.schema)  # the records of one file

    return records
