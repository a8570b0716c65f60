"""What is done with PDF pages once a backend has read them. Backends are functions; none is built in.

blocks: page, seq, x0, y0, x1, y1, text. tables: page, x0, y0, x1, y1. figures: page, seq, digest, width, height, cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import hyphen_repair

#: Headings of a list of references, and of what may follow it.
REFERENCES = r"(?i)^\W*(?:\d+(?:\.\d+)*\.?\s*|[ivx]+\.\s*)?(references|bibliography|works cited|literature cited)\s*:?\W*$"
APPENDIX = r"(?i)^\W*(?:[a-z0-9]+[.)]\s*)?(appendix|appendices|supplementary|supplement)\b"


def outside_tables(blocks: DataFrame, tables: DataFrame, overlap: float = 0.6) -> DataFrame:
    """Blocks of which less than `overlap` lies inside a table of their page; their hyphenated line ends are mended."""
    b, t = blocks.alias("b"), tables.alias("t")
    wide = F.greatest(F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0"), F.lit(0.0))
    high = F.greatest(F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0"), F.lit(0.0))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    inside = (F.col("b.page") == F.col("t.page")) & (area > 0) & (wide * high >= overlap * area)
    return b.join(t, inside, "left_anti").select("b.*").withColumn("text", hyphen_repair(F.col("text")))


def without_running_heads(blocks: DataFrame, most_chars: int = 80, share: float = 0.5, least_pages: int = 4) -> DataFrame:
    """Short blocks that recur on half the pages or more of a document of four pages or more go."""
    key = F.regexp_replace(F.btrim("text"), r"\d+", "#")
    pages = blocks.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    heads = blocks.where(F.length("text") <= most_chars).groupBy("doc", key.alias("k")).agg(F.count_distinct("page").alias("on")).join(pages, "doc")
    heads = heads.where((F.col("pages") >= least_pages) & (F.col("on") >= F.col("pages") * share)).select("doc", "k")
    return blocks.withColumn("k", key).join(heads, ["doc", "k"], "left_anti").drop("k")


def without_references(blocks: DataFrame, earliest: float = 0.3) -> DataFrame:
    """Blocks before the last heading of a list of references, and on each page after it those from an appendix on."""
    order = Window.partitionBy("doc").orderBy("page", "seq")
    at = F.struct("page", "seq")
    b = blocks.withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn("all", F.sum(F.length("text")).over(Window.partitionBy("doc")))
    head = F.max(F.when(F.btrim("text").rlike(REFERENCES) & (F.col("before") >= earliest * F.col("all")), at)).over(Window.partitionBy("doc"))
    b = b.withColumn("cut", head).withColumn("back", F.min(F.when(F.btrim("text").rlike(APPENDIX) & (at > F.col("cut")), F.col("seq"))).over(Window.partitionBy("doc", "page")))
    keep = F.col("cut").isNull() | (at < F.col("cut")) | (F.col("back").isNotNull() & (F.col("seq") >= F.col("back")))
    return b.where(keep).drop("before", "all", "cut", "back")


def scanned_pages(pages: DataFrame, least_chars: int = 25) -> DataFrame:
    """Pages (doc, page, chars, images) with pictures but hardly any text."""
    return pages.where((F.col("images") > 0) & (F.col("chars") < least_chars))


def select_figures(figures: DataFrame, most: int = 25, least_side: int = 50, logo_pages: int = 3) -> DataFrame:
    """Figures without icons, rules, page backgrounds and logos; repeats once; the largest, numbered in page order."""
    f = figures.where((F.least("width", "height") >= least_side) & (F.greatest("width", "height") <= 10 * F.least("width", "height")) & (F.col("cover") < 0.95))
    pages = figures.groupBy("doc").agg(F.max("page").alias("pages"))
    logos = f.groupBy("doc", "digest").agg(F.count_distinct("page").alias("on")).join(pages, "doc").where(F.col("on") >= F.greatest(F.lit(logo_pages), F.ceil(F.col("pages") / 2))).select("doc", "digest")
    f = f.join(logos, ["doc", "digest"], "left_anti")
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("doc", "digest").orderBy("page", "seq"))).where("r = 1")
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.col("width") * F.col("height")), "page", "seq"))).where(F.col("r") <= most)
    return f.withColumn("number", F.row_number().over(Window.partitionBy("doc", "page").orderBy("seq"))).drop("r")


def tidy_tables(cells: DataFrame, least_columns: int = 2, least_filled: float = 0.5) -> DataFrame:
    """(doc, page, table, row, col, name, text, number) of the filled cells of what looks like a table.

    cells has doc, page, table, row, col, text; row 0 is the head. Empty rows and columns go, and rows and columns are
    numbered anew from 1. Two columns, one row and half of all cells filled make a table. Names that a backend made
    unique by a place in front (`0-Name`, `1-Name`) get it taken off where two columns so have one name; names that
    stand more than once are numbered from the second on, missing ones become `column n`. A column has numbers if every
    filled cell is a plain number, and none has zeros in front, as codes do.
    """
    one = ["doc", "page", "table"]
    text = F.nullif(F.btrim(F.regexp_replace("text", r"\s+", " ")), F.lit(""))
    c = cells.select(*one, "row", "col", text.alias("text"))
    body = c.where("row > 0 and text is not null")
    body = body.withColumn("r", F.dense_rank().over(Window.partitionBy(*one).orderBy("row"))).withColumn("k", F.dense_rank().over(Window.partitionBy(*one).orderBy("col")))
    whole = body.groupBy(*one).agg(F.max("r").alias("rows"), F.max("k").alias("columns"), F.count("*").alias("filled"))
    real = whole.where((F.col("columns") >= least_columns) & (F.col("filled") >= least_filled * F.col("rows") * F.col("columns"))).select(*one)
    number = F.regexp_replace("text", "[, ]", "")
    plain = number.rlike(r"^-?\d+(\.\d+)?$") & ~number.rlike(r"^-?0\d")
    by_column = body.groupBy(*one, "col").agg(F.max("k").alias("k"), F.bool_and(plain).alias("numeric"))
    heads = by_column.join(c.where("row = 0").select(*one, "col", F.col("text").alias("head")), [*one, "col"], "left")
    bare = F.regexp_replace("head", r"^\d+-", "")
    same = F.count("head").over(Window.partitionBy(*one, bare))
    marked = F.min((F.col("head") != bare).cast("int")).over(Window.partitionBy(*one, bare)) == 1
    heads = heads.withColumn("name", F.when((same > 1) & marked, bare).otherwise(F.col("head")))
    nth = F.row_number().over(Window.partitionBy(*one, "name").orderBy("col"))
    heads = heads.withColumn("nth", nth).withColumn("name", F.when(F.col("name").isNull(), F.concat(F.lit("column "), "k")).when(F.col("nth") > 1, F.concat("name", F.lit("_"), "nth")).otherwise(F.col("name")))
    out = body.join(real, one, "left_semi").join(heads.select(*one, "col", "name", "numeric"), [*one, "col"])
    return out.select(*one, F.col("r").alias("row"), F.col("k").alias("col"), "name", "text", F.when(F.col("numeric"), number.try_cast("double")).alias("number"))
