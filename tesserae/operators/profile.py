"""What a table holds, in words: one line for each column, and its rows as text in groups of about equal length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.config import DEFAULTS, Settings
from tesserae.operators import quantiles
from tesserae.operators.conditions import FAMILY, Cell
from tesserae.operators.kinds import infer_kinds, nan_to_null
from tesserae.operators.prep import sample


def number_text(x: float) -> str:
    """Whole numbers in full, large ones without decimals, others with three."""
    x = float(x)
    return str(int(x)) if x.is_integer() else f"{x:.0f}" if abs(x) >= 1e4 else f"{round(x, 3):g}"


def cell(c: Column, kind: T.DataType, most: int) -> Column:
    """A value as row text: whole floats as integers, others to four places; no pipes or line ends; cut with an ellipsis."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        r = F.bround(c.cast("double"), 4)
        short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", r), "0+$", ""), r"\.$", "")
        text = F.when((c % 1 == 0) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(short)
    else:
        text = F.initcap(c.cast("string")) if isinstance(kind, T.BooleanType) else c.cast("string")
    text = F.btrim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("/")), r"\s+", " "))
    return F.coalesce(F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…"))), F.lit(""))


def render_rows(df: DataFrame, row: str = "_row", cell_max: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(row, line): `n | a | b`. A map over the table; nothing is shuffled."""
    fields = [f for f in df.schema.fields if f.name != row]
    most = cell_max or max(20, min(settings.table_cell_max, 900 // max(1, len(fields))))
    df = nan_to_null(df)
    return df.select(F.col(row).alias("row"), F.concat_ws(" | ", F.col(row).cast("string"), *(cell(F.col(f"`{f.name}`"), f.dataType, most) for f in fields)).alias("line"))


def header_line(columns: list[str]) -> str:
    return "row | " + " | ".join(c[:40] for c in columns)


def sampled(df: DataFrame, n: int = DEFAULTS.table_embed_rows, row: str = "_row", seed: int = DEFAULTS.table_sample_seed) -> DataFrame:
    """n rows of the table, the same ones whenever it is asked: those with the least hash of their number."""
    return sample(df, row, n, seed)


def row_groups(lines: DataFrame, table: str = "table_id", chars: int = DEFAULTS.table_group_chars) -> DataFrame:
    """(table, first, last, lines array) of each group: a group closes when the next line would pass `chars`.

    Each group depends on where the one before closed, so a table's (sampled) lines are folded in one go.
    """

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        out = list(_packed(zip(pdf["row"], pdf["line"]), chars))
        return pd.DataFrame({table: [pdf[table].iloc[0]] * len(out), "first": [g[0][0] for g in out], "last": [g[-1][0] for g in out], "lines": [[x for _, x in g] for g in out]})

    return lines.groupBy(table).applyInPandas(groups, f"{table} {lines.schema[table].dataType.simpleString()}, first long, last long, lines array<string>")


def _packed(rows, chars: int) -> Iterator[list]:
    held, size = [], 0
    for n, line in rows:
        if held and size + len(line) > chars:
            yield held
            held, size = [], 0
        held.append((n, line))
        size += len(line) + 1
    if held:
        yield held


def _counted(df: DataFrame, columns: list[str], row: str | None) -> DataFrame:
    """(column, value, count, at): how often each value of each column occurs, and where first.

    All columns are unpivoted into one aggregation, which sums up before its shuffle.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    at = F.col(row) if row else F.monotonically_increasing_id()
    rows = df.select(at.alias("at"), pairs.alias("p")).where("p.value is not null")
    return rows.groupBy("p.column", "p.value").agg(F.count("*").alias("count"), F.min("at").alias("at"))


def value_counts(df: DataFrame, columns: list[str], n: int, row: str | None = None) -> DataFrame:
    """(column, value, count, r): the n most frequent values of each column, ties by first appearance."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "at", "value"))
    return _counted(df, columns, row).withColumn("r", rank).where(F.col("r") <= n).drop("at")


def profile(df: DataFrame, kinds: dict[str, str] | None = None, row: str | None = None, settings: Settings = DEFAULTS) -> dict[str, dict]:
    """Statistics of every column: sums and bounds of all in one aggregation, medians by nested histograms of all at once,
    and distinct and frequent values from one count of all columns' values."""
    df = nan_to_null(df)
    names = [c for c in df.columns if c != row]
    kinds = kinds or infer_kinds(df, row_column=row)
    aggs, figures = [F.count(F.lit(1)).alias("rows")], {}
    for i, c in enumerate(names):
        cell_ = Cell(df, c, kinds[c])
        aggs.append(F.count(cell_.raw).alias(f"n{i}"))
        if FAMILY[kinds[c]] == "figures":
            figures[c] = x = cell_.figure()
            aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}")]
        elif kinds[c] == "date":
            t = cell_.instant()
            aggs += [F.min(t).cast("date").cast("string").alias(f"min{i}"), F.max(t).cast("date").cast("string").alias(f"max{i}")]
        elif kinds[c] == "text":
            text = cell_.raw.cast("string")
            first = F.min_by(text, F.when(text.isNotNull(), F.col(row) if row else F.monotonically_increasing_id()))
            aggs += [F.avg(F.length(text)).alias(f"len{i}"), first.alias(f"one{i}")]
    seen = df.agg(*aggs).first().asDict()
    out = {}
    for i, c in enumerate(names):
        out[c] = {"kind": kinds[c], "missing": seen["rows"] - seen[f"n{i}"]} | {k: seen[f"{k}{i}"] for k in ("min", "max", "mean", "len", "one") if f"{k}{i}" in seen}
    if figures:
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), x.alias("x")) for c, x in figures.items())))
        for r in quantiles.median(df.select(pairs.alias("p")).select("p.column", "p.x"), ["column"], "x").collect():
            out[r["column"]]["median"] = r["value"]
        for c in figures:
            out[c].setdefault("median", None)
    counted = [c for c in names if kinds[c] not in ("date", "empty")]
    if counted:
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "at", "value"))
        counts = _counted(df, counted, row)
        for r in counts.groupBy("column").agg(F.count("*").alias("d")).collect():
            out[r["column"]]["d"] = r["d"]
        for c in counted:
            out[c].setdefault("d", 0)
        few = [c for c in counted if kinds[c] in ("boolean", "text") or (kinds[c] in ("integer", "decimal") and out[c]["d"] <= 10)]
        for r in counts.where(F.col("column").isin(few)).withColumn("r", rank).where(F.col("r") <= settings.table_enum_max).collect():
            out[r["column"]].setdefault("top", []).append((r["r"], r["value"], r["count"]))
    return out


def column_line(name: str, p: dict, settings: Settings = DEFAULTS) -> str:
    """A column in words."""
    top = lambda n: ", ".join(f"{v} ({c:,})" for _, v, c in sorted(p.get("top", []))[:n])
    numbers = lambda: ", ".join(f"{k} {number_text(p[k])}" for k in ("min", "max", "mean", "median"))
    kind = p["kind"]
    if kind == "empty":
        return f"- {name} (empty): all values missing"
    if kind == "boolean":
        line = f"- {name} (true/false): {top(5)}"
    elif kind in ("integer", "decimal"):
        line = f"- {name} ({kind}): {numbers()}" + (f"; values: {top(10)}" if p["d"] <= 10 else "")
    elif kind == "amount_text":
        line = f"- {name} (number stored as text; clean symbols before arithmetic): {numbers()}"
    elif kind == "date":
        line = f"- {name} (date): from {p['min']} to {p['max']}"
    elif p["d"] <= settings.table_enum_max:
        line = f"- {name} (text): values: {top(settings.table_enum_max)}"
    elif p["len"] > 60:
        line = f"- {name} (free text): avg {p['len']:.0f} chars, e.g. \"{' '.join(str(p['one']).split())[:80]}\""
    else:
        line = f"- {name} (text): {p['d']:,} unique values; most common: {top(5)}"
    line += f"; {p['missing']:,} missing" if p["missing"] else ""
    return line if len(line) <= settings.column_line_max else line[: settings.column_line_max - 1] + "…"


def table_title(source: str, table_id: str) -> str:
    import re

    if m := re.fullmatch(r"p(\d+)t(\d+)", table_id):
        return f"Table {source} (page {m[1]}, table {m[2]})"
    return f"Table {source}" + ("" if table_id == "main" else f" [sheet {table_id}]")


def table_records(df: DataFrame, topic: str, source: str, table_id: str = "main", page: int | None = None, row: str = "_row", settings: Settings = DEFAULTS) -> DataFrame:
    """The searchable records of one table: a summary, and its rows (a sample of a large table) in groups."""
    names = [c for c in df.columns if c != row]
    total = df.count()
    numbered = df.withColumn(row, (F.row_number().over(Window.orderBy(row)) if total <= settings.table_embed_rows else F.col(row) + 1).cast("long"))
    some = numbered if total <= settings.table_embed_rows else sampled(numbered, settings.table_embed_rows, row)
    kind = "rows" if total <= settings.table_embed_rows else "sample"
    title, head = table_title(source, table_id), header_line(names)
    described = profile(df.select(*[F.col(f"`{c}`") for c in names[: settings.summary_columns]], row), row=row, settings=settings)
    lines = [column_line(c, described[c], settings) for c in names[: settings.summary_columns]]
    lines += [f"- ... and {len(names) - settings.summary_columns} more columns"] * (len(names) > settings.summary_columns)
    first = [r["line"] for r in render_rows(numbered.orderBy(row).limit(3), row, settings=settings).orderBy("row").collect()]
    note = [f"Note: only a sample of {settings.table_embed_rows:,} of {total:,} rows is searchable as text; counts, sums and averages are computed over all rows with the table calculator."] * (kind == "sample")
    summary = "\n".join([f"{title} (topic {topic}): {total:,} rows x {len(names)} columns.", "Columns:", *lines, "First rows:", head, *first, *note])
    groups = row_groups(render_rows(some, row, settings=settings).withColumn("table_id", F.lit(table_id)), chars=settings.table_group_chars)
    what = F.concat(F.lit(f"{title}, {'sampled rows' if kind == 'sample' else 'rows'} "), "first", F.lit("-"), "last", F.lit(":"))
    body = groups.select(F.concat_ws("\n", what, F.lit(head), F.array_join("lines", "\n")).alias("text"), F.concat(F.lit(f"{kind}-"), "first", F.lit("-"), "last").alias("part"), "first")
    top = df.sparkSession.createDataFrame([(summary, "summary", -1)], "text string, part string, first long")
    rows = top.unionByName(body)
    none = F.lit(None).cast("string")
    return rows.select(F.lit(topic).alias("topic_id"), F.lit(source).alias("source"), F.col("first").cast("int").alias("ordinal"), "text", F.lit("table").alias("modality"), F.lit(page).cast("int").alias("page"), F.lit(table_id).alias("table_id"), "part", none.alias("image_path"), none.alias("heading"))
