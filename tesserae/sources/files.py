"""Topics and their files: a scan of folders, and the kind of each file by its first bytes and its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kind that an extension claims, and names that are passed over.
KINDS = {
    ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".csv": "table", ".xlsx": "table",
    ".json": "table", ".txt": "text", ".md": "text", ".html": "text", ".htm": "text", ".docx": "text", ".log": "text",
}
IGNORED = ("topic.json", "readme.md", "thumbs.db", ".ds_store")
SNIFF = 8192


def topic_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """(topic_id, source, name, extension, length, content) of the files of all valid topics, folders within them included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data_dir)
    base = spark._jvm.org.apache.hadoop.fs.Path(data_dir)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    empty = _empty_files(spark, base)  # Spark's scan passes over these
    files = files.select("path", "length", "content")
    if empty:
        files = files.unionByName(spark.createDataFrame([(p, 0, b"") for p in empty], "path string, length long, content binary"))
    place = F.regexp_replace(F.substring(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 20), "^/+", "")
    rows = files.select(F.split(place, "/", 2).alias("p"), "length", "content").where(F.size("p") == 2)
    rows = rows.select(F.col("p")[0].alias("topic_id"), F.col("p")[1].alias("source"), "length", "content").where(F.col("topic_id").rlike("^[a-z0-9_]+$"))
    name = F.lower(F.element_at(F.split("source", "/"), -1))
    return rows.withColumn("name", name).withColumn("extension", F.regexp_extract("name", r"(\.[^.]+)$", 1)).orderBy("topic_id", "source")


def _empty_files(spark: SparkSession, base: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            out.append(f.getPath().toString())
    return out


def topics(files: DataFrame) -> DataFrame:
    """(id, name, description): from topic.json where there is one."""
    said = files.where((F.col("name") == "topic.json") & (F.col("source") == F.lower("source")) & ~F.contains("source", F.lit("/")))
    json = F.from_json(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), "name string, description string")
    said = said.select("topic_id", json.alias("j"))
    title = F.initcap(F.replace("topic_id", F.lit("_"), F.lit(" ")))
    out = files.select("topic_id").distinct().join(said, "topic_id", "left")
    name = F.coalesce(F.nullif(F.btrim("j.name"), F.lit("")), title)
    return out.select(F.col("topic_id").alias("id"), name.alias("name"), F.coalesce(F.nullif(F.btrim("j.description"), F.lit("")), F.concat(F.lit("Documents about "), name)).alias("description")).orderBy("id")


def magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47") | head.startswith("FFD8FF") | webp, "image").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole")


def json_kind(content: Column) -> Column:
    """table for a list of objects, at the top or one level down; text for other JSON; null if it is none."""
    v = F.try_parse_json(F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""))
    top = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(top.rlike("^ARRAY<OBJECT<") | top.rlike("^OBJECT<.*: ARRAY<OBJECT<"), "table").otherwise("text")


def route(files: DataFrame) -> DataFrame:
    """Adds `kind` (pdf, image, table, text) or `skip_reason`. What a file's bytes say goes before its name."""
    claims = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("extension")]
    rows = files.where(~F.col("name").isin(*IGNORED) & ~F.col("name").startswith("~$") & ~F.col("name").startswith("."))
    rows = rows.withColumn("claim", claims).withColumn("magic", magic(F.col("content")))
    office = F.col("extension").isin(".xlsx", ".docx")
    nul = F.contains(F.hex(F.substring("content", 1, SNIFF)).cast("string"), F.lit("00")) & F.exists(F.sequence(F.lit(1), F.least(F.length("content"), F.lit(SNIFF))), lambda i: F.hex(F.substring(F.col("content"), i, F.lit(1))) == "00")
    json = F.when(F.col("extension") == ".json", json_kind(F.col("content")))
    reason = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("claim").isNull(), F.concat(F.lit("unsupported type "), "extension"))
        .when(F.col("magic") == "ole", "legacy Office format")
        .when((F.col("magic") == "zip") & ~office, "a zip archive")
        .when(F.col("magic").isNull() & (F.col("claim").isin("pdf", "image") | office), F.concat(F.lit("not a real "), "extension"))
        .when(F.col("magic").isNull() & nul, "binary data")
        .when(F.col("magic").isNull() & (F.col("extension") == ".json") & json.isNull(), "broken JSON")
    )
    kind = F.when(F.col("magic").isin("pdf", "image"), F.col("magic")).when(F.col("extension") == ".json", json).otherwise(F.col("claim"))
    out = rows.withColumn("skip_reason", reason).withColumn("kind", F.when(F.col("skip_reason").isNull(), kind))
    return out.drop("claim", "magic", "name")
