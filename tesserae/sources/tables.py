"""Tables from CSV, JSON and XLSX files, and the store of full tables with its manifest."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import numeric
from tesserae.operators.kinds import infer_kinds
from tesserae.operators.table_query import TableInfo
from tesserae.sources import versions
from tesserae.sources.html import decoded

DELIMITERS, HEAD = ",;\t|", 8192
#: Spellings of a missing value in a CSV file.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Characters of Windows-1252 where Latin-1, which Spark reads, has controls.
_CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sniff_delimiter(head: str) -> str:
    """The delimiter that splits the first lines most evenly into the most fields; a comma if none does."""
    lines = [x for x in head.splitlines() if x.strip()][:20]

    def score(d: str) -> tuple:
        n = [len(re.sub(r'"[^"]*"', "", x).split(d)) - 1 for x in lines]
        return (bool(n) and min(n) > 0, n.count(n[0]) if n else 0, n[0] if n else 0)

    best = max(DELIMITERS, key=score)
    return best if score(best)[0] else ","


def encoding_of(head: bytes) -> str:
    """UTF-8 if the head is that, but for a character that its end may cut; else a single-byte encoding."""
    try:
        head[: max(0, len(head) - 3)].decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start >= len(head) - 6 and len(head) >= HEAD else "ISO-8859-1"


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, read by a stream."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns of the narrowest type that all values fit; lines with too many fields go, short ones are filled with nulls.

    Only the head is read to tell separator and encoding. A file is read in one piece only if a line has an odd number of
    quotes, as where a line end stands inside a value; others are split among tasks.
    """
    head = _head(spark, path)
    sep, enc = sniff_delimiter(decoded(head)), encoding_of(head)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    whole = not spark.read.text(path).where(odd).isEmpty()
    options = {"sep": sep, "encoding": enc, "header": True, "multiLine": whole, "quote": '"', "escape": '"', "enforceSchema": True}
    names = spark.read.options(**options).csv(path).columns
    names = [n.translate(_CP1252) for n in names] if enc == "ISO-8859-1" else names
    names = unique_names([n.lstrip("﻿") for n in (["" if re.fullmatch(r"_c\d+", n) else n for n in names])])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_extra", T.StringType()), T.StructField("_row", T.LongType())])
    raw = spark.read.options(**options).schema(T.StructType(schema.fields[:-1])).csv(path)
    raw = raw.where(F.col("_extra").isNull()).drop("_extra")
    raw = raw.select(*(F.when(~F.col(f"`{n}`").isin(*MISSING), F.col(f"`{n}`")).alias(n) for n in names))
    if enc == "ISO-8859-1":
        raw = raw.select(*(F.translate(F.col(f"`{n}`"), *_cp1252_pairs()).alias(n) for n in names))
    return narrowed(raw)


def _cp1252_pairs() -> tuple[str, str]:
    return "".join(map(chr, _CP1252)), "".join(_CP1252.values())


def narrowed(df: DataFrame) -> DataFrame:
    """Text columns whose values are all booleans, integers or numbers get that type: one pass over all of them."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    checks = []
    for i, n in enumerate(texts):
        c = F.col(f"`{n}`")
        checks += [F.bool_and(c.rlike(r"^[+-]?\d{1,18}$")).alias(f"i{i}"), F.bool_and(numeric(c).isNotNull()).alias(f"d{i}"), F.bool_and(c.isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"b{i}")]
        checks[-2] = F.bool_and(F.when(c.isNotNull(), numeric(c).isNotNull())).alias(f"d{i}")
    seen = df.agg(*checks).first() if checks else {}
    casts = {}
    for i, n in enumerate(texts):
        c = F.btrim(F.col(f"`{n}`"))
        kind = "boolean" if seen[f"b{i}"] else "long" if seen[f"i{i}"] else "double" if seen[f"d{i}"] else None
        if kind:
            casts[n] = c.cast(kind)
    return df.withColumns(casts) if casts else df


def unique_names(names: list[str]) -> list[str]:
    """Stripped; blank ones are `column`; repeated ones get _2, _3."""
    out: list[str] = []
    for n in names:
        n = (n or "").strip() or "column"
        k, name = 1, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def json_rows(text: str) -> list[dict]:
    """The objects of a list at the top, or of the longest list of objects one level down, flattened to dotted names."""
    data = json.loads(text.lstrip("﻿"))
    if isinstance(data, dict):
        lists = [v for v in data.values() if isinstance(v, list) and any(isinstance(x, dict) for x in v)]
        data = max(lists, key=len, default=[])
    rows = [dict(_flat(x)) for x in data if isinstance(x, dict)]
    heads = {k.split(".")[0] for r in rows for k in r}
    if len(heads) == 1 and all("." in k for r in rows for k in r):
        rows = [{k.split(".", 1)[1]: v for k, v in r.items()} for r in rows]
    return rows


def _flat(x: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for k, v in x.items():
        if isinstance(v, dict):
            yield from _flat(v, f"{prefix}{k}.")
        else:
            yield prefix + k, json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v


def xlsx_sheets(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(sheet name, rows) of a workbook, read from its XML parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list[str | None]] = []
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_M}row"):
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.iter(f"{_M}c")):
                    at = i
                    if ref := re.match("[A-Z]+", c.get("r") or ""):
                        at = -1
                        for ch in ref[0]:
                            at = (at + 1) * 26 + ord(ch) - 65
                    v = c.findtext(f"{_M}v")
                    if c.get("t") == "s" and v is not None:
                        v = shared[int(v)]
                    elif c.get("t") == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                    elif c.get("t") == "b" and v is not None:
                        v = str(v == "1")
                    cells[at] = v
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one file by id: `main`, or a workbook's sheets. Files of JSON and XLSX are read as a whole."""
    name = path.lower()
    if name.endswith(".csv"):
        return {"main": read_csv(spark, path)}
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    if name.endswith(".json"):
        rows = json_rows(decoded(content))
        return {"main": _frame(spark, list(dict.fromkeys(k for r in rows for k in r)), [list(r.items()) for r in rows])}
    out: dict[str, DataFrame] = {}
    for sheet, rows in xlsx_sheets(content):
        if len(rows) < 2:
            continue
        id_ = re.sub("[^A-Za-z0-9_.-]", "_", sheet).strip("_") or "x"
        while id_ in out:
            id_ += "_"
        width = max(map(len, rows))
        names = unique_names([c or "" for c in rows[0] + [None] * (width - len(rows[0]))])
        out[id_] = _frame(spark, names, [list(zip(names, r)) for r in rows[1:]])
    return out


def _frame(spark: SparkSession, names: list[str], rows: list[list[tuple]]) -> DataFrame:
    text = lambda v: None if v is None or v in MISSING else str(v)
    data = [tuple(text(dict(r).get(n)) for n in names) for r in rows]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique_names(names)])
    return narrowed(spark.createDataFrame(data, schema))


def tidy(df: DataFrame) -> DataFrame:
    """Unique names; rows and columns without any value go, as do nameless counters; nested values become JSON text."""
    df = df.toDF(*unique_names(df.columns))
    nested = {f.name: F.to_json(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    df = df.withColumns(nested) if nested else df
    df = df.where(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in df.columns)).isNotNull()) if df.columns else df
    checks = [F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]
    counters = [(i, c) for i, (c, t) in enumerate(df.dtypes) if t in ("int", "bigint") and (c.startswith("Unnamed") or re.fullmatch(r"column(_\d+)?", c))]
    checks += [F.struct(F.min(f"`{c}`").alias("low"), F.max(f"`{c}`").alias("high"), F.count(f"`{c}`").alias("n"), F.count_distinct(f"`{c}`").alias("d")).alias(f"k{i}") for i, c in counters]
    seen = df.agg(F.count("*").alias("rows"), *checks).first()
    drop = {c for i, c in enumerate(df.columns) if not seen[f"c{i}"]}
    for i, c in counters:
        k = seen[f"k{i}"]
        if k["low"] in (0, 1) and k["n"] == k["d"] == seen["rows"] and k["high"] - k["low"] == seen["rows"] - 1:
            drop.add(c)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in drop))


class TableStore:
    """Full tables as Parquet under topic folders, with a manifest of one row for each table."""

    SCHEMA = "topic_id string, source string, table_id string, rows long, columns array<struct<name:string,kind:string>>, path string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, topic: str, source: str, table_id: str) -> str:
        safe = [re.sub("[^A-Za-z0-9_.-]", "_", x).strip("_") or "x" for x in (source, table_id)]
        return f"{self.folder}/{topic}/{safe[0]}__{safe[1]}"

    def manifest(self) -> DataFrame:
        v = versions.newest(self.spark, f"{self.folder}/_manifest")
        return self.spark.createDataFrame([], self.SCHEMA) if v is None else self.spark.read.schema(self.SCHEMA).json(f"{self.folder}/_manifest/v{v}")

    def save(self, df: DataFrame, topic: str, source: str, table_id: str = "main") -> None:
        """Rows are numbered in `_row`, so that samples and first rows stay the same whoever reads them."""
        path = self.path(topic, source, table_id)
        df.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        saved = self.spark.read.parquet(path)
        kinds = infer_kinds(saved, row_column="_row")
        row = (topic, source, table_id, saved.count(), [(c, kinds[c]) for c in df.columns], path)
        new = self.spark.createDataFrame([row], self.SCHEMA)
        rest = self.manifest().join(new, ["topic_id", "source", "table_id"], "left_anti").select(*new.columns)
        versions.write(rest.unionByName(new).coalesce(1), f"{self.folder}/_manifest", "json")

    def load(self, topic: str, source: str, table_id: str = "main", rows: bool = False) -> DataFrame:
        fs, p = self._fs(self.path(topic, source, table_id))
        if not fs.exists(p):
            raise FileNotFoundError(f"no stored table {topic}/{source} [{table_id}]")
        df = self.spark.read.parquet(p.toString())
        return df if rows else df.drop("_row")

    def catalog(self, topics: list[str]) -> list[TableInfo]:
        """T1, T2, ... by the given order of topics, then source and table."""
        rows = [r for r in self.manifest().where(F.col("topic_id").isin(topics)).collect() if self._fs(r["path"])[0].exists(self._fs(r["path"])[1])]
        rows.sort(key=lambda r: (topics.index(r["topic_id"]), r["source"], r["table_id"]))
        return [TableInfo(f"T{i}", r["topic_id"], r["source"], r["table_id"], r["rows"], {c["name"]: c["kind"] for c in r["columns"]}) for i, r in enumerate(rows, 1)]

    def prune(self, topic: str, keep: set[tuple[str, str]]) -> list[tuple[str, str]]:
        """Deletes the topic's tables that are not kept, and files that no manifest row names."""
        rows = self.manifest()
        gone = unkept(rows.where(F.col("topic_id") == topic), self.spark.createDataFrame(list(keep), "source string, table_id string"))
        names = [(r["source"], r["table_id"]) for r in gone.select("source", "table_id").collect()]
        left = rows.join(gone, ["topic_id", "source", "table_id"], "left_anti").select(*rows.columns)
        versions.write(left.coalesce(1), f"{self.folder}/_manifest", "json")
        named = {r["path"].rsplit("/", 1)[1] for r in self.manifest().where(F.col("topic_id") == topic).select("path").collect()}
        fs, folder = self._fs(f"{self.folder}/{topic}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
        return names


def unkept(manifest: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of a manifest whose source and table_id are not in keep."""
    return manifest.join(keep, ["source", "table_id"], "left_anti").select(*manifest.columns)
