"""Citations: which markers of an answer hold, grouped by the source they point to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS
from tesserae.functions.text import calculation_markers, chunk_markers, strip_markers


def check_markers(answers: DataFrame) -> DataFrame:
    """Adds valid, invalid, valid_calculations, invalid_calculations, uncited and clean_text.

    answers has text, used (declared chunk numbers), n_items, used_calculations and ok_calculations (numbers that worked).
    """
    declared = F.array_sort(F.array_distinct(F.concat("used", chunk_markers(F.col("text")))))
    calc = F.array_sort(F.array_distinct(F.concat("used_calculations", calculation_markers(F.col("text")))))
    out = answers.withColumn("_d", declared).withColumn("_c", calc)
    out = out.withColumn("valid", F.filter("_d", lambda n: n.between(1, F.col("n_items")))).withColumn("invalid", F.array_except("_d", "valid"))
    out = out.withColumn("valid_calculations", F.array_intersect("_c", "ok_calculations")).withColumn("invalid_calculations", F.array_except("_c", "ok_calculations"))
    items = F.when(F.col("n_items") > 0, F.sequence(F.lit(1), F.greatest("n_items", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    clean = strip_markers(F.col("text"), items, F.col("valid_calculations"))
    return out.withColumn("uncited", (F.size("valid") + F.size("valid_calculations")) == 0).withColumn("clean_text", clean).drop("_d", "_c")


def location(modality: Column, page: Column, table_id: Column, part: Column, heading: Column) -> Column:
    """Where in its source a chunk stands, for readers."""
    pdf = F.regexp_extract(table_id, r"^p(\d+)t(\d+)$", 1), F.regexp_extract(table_id, r"^p(\d+)t(\d+)$", 2)
    where = F.when(pdf[0] != "", F.concat(F.lit("p."), pdf[0], F.lit(", table "), pdf[1])).when(table_id.isNotNull() & (table_id != "main"), F.concat(F.lit("sheet "), table_id))
    rows = F.regexp_replace(F.regexp_replace(part, "^rows-", "rows "), "^sample-", "sample rows ")
    other = F.when(page > 0, F.concat(F.lit("p."), page)).when(heading != "", F.concat(F.lit("section: "), heading)).otherwise("")
    return F.when(modality == "table", F.concat_ws(", ", where, rows)).otherwise(other)


def sources(cited: DataFrame) -> DataFrame:
    """(answer_id, display, numbers, chunk_ids): cited chunks of each answer, grouped by what is shown for them."""
    place = location(*(F.col(c) for c in ("modality", "page", "table_id", "part", "heading")))
    display = F.concat_ws(" · ", "topic_id", "source", F.nullif(place, F.lit("")), "modality")
    both = F.array_sort(F.collect_list(F.struct("number", "chunk_id")))
    out = cited.groupBy("answer_id", display.alias("display")).agg(both.alias("b"))
    return out.select("answer_id", "display", F.col("b.number").alias("numbers"), F.col("b.chunk_id").alias("chunk_ids"))


def format_history(turns: DataFrame, messages: int = DEFAULTS.history_max_messages, chars: int = DEFAULTS.history_max_chars) -> DataFrame:
    """(conv_id, history): the last messages of each conversation, one line each. turns has conv_id, turn, role, text.

    Each task passes on its last few turns of a conversation only, so a very long one is cut down before the shuffle.
    """
    said = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    said = F.when(F.length(said) <= chars, said).otherwise(F.concat(F.substring(said, 1, chars), F.lit("…")))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), said)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.withColumn("_rank", rank).where(F.col("_rank") <= messages)
    both = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(both, lambda x: x["line"]), "\n").alias("history"))


# ---------------------------------------------------------------- one answer, on the driver


@dataclass
class Source:
    numbers: list[int]
    display: str
    chunk_ids: list[str] = field(default_factory=list)
    calculation: str | None = None

    @property
    def refs(self) -> str:
        return "".join(f"[{n}]" for n in self.numbers)


@dataclass
class Citations:
    sources: list[Source]
    invalid: list[int] = field(default_factory=list)
    invalid_calculations: list[int] = field(default_factory=list)
    uncited: bool = False
    text: str = ""


def strip_dangling(text: str, valid: set[int], valid_calculations: set[int]) -> str:
    keep = lambda m: m[0] if int(m[2]) in (valid_calculations if m[1] else valid) else ""
    return re.sub(r" ?\[(C?)(\d+)\]", keep, text)


def _place(item: dict) -> str:
    if item.get("modality") == "table":
        table, part = item.get("table_id") or "", item.get("part") or ""
        pdf = re.fullmatch(r"p(\d+)t(\d+)", table)
        first = f"p.{pdf[1]}, table {pdf[2]}" if pdf else f"sheet {table}" if table not in ("", "main") else ""
        return ", ".join(x for x in (first, re.sub("^sample-", "sample rows ", re.sub("^rows-", "rows ", part))) if x)
    return f"p.{item['page']}" if item.get("page") else f"section: {item['heading']}" if item.get("heading") else ""


def build_citations(text: str, answerable: bool, used: list[int], used_calculations: list[int], items: list[dict], calculations: list) -> Citations:
    """The sources of one answer; markers without one are taken out of its text."""
    if not answerable:
        return Citations([], text=text)
    declared = set(used) | {int(n) for n in re.findall(r"\[(\d+)\]", text)}
    valid = sorted(n for n in declared if 1 <= n <= len(items))
    shown: dict[str, Source] = {}
    for n in valid:
        item = items[n - 1]
        display = " · ".join(x for x in (item["topic_id"], item.get("source"), _place(item), item.get("modality")) if x)
        s = shown.setdefault(display, Source([], display))
        s.numbers.append(n)
        s.chunk_ids.append(item["id"])
    ok = {c.number: c for c in calculations if c.ok}
    asked = set(used_calculations) | {int(n) for n in re.findall(r"\[C(\d+)\]", text)}
    good = sorted(asked & set(ok))
    done = [Source([], f"{c.topic_id} · {c.source} · calculation: {c.description} ({c.rows_matched:,} of {c.rows_total:,} rows) · table", calculation=c.description) for c in map(ok.get, good)]
    found = [*shown.values(), *done]
    return Citations(found, sorted(declared - set(valid)), sorted(asked - set(good)), not found, strip_dangling(text, set(range(1, len(items) + 1)), set(good)))
