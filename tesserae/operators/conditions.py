"""Filters of the table calculator as conditions that Spark can push down.

A column's kind puts it into a family. Figures and dates are ordered: a filter's value becomes an interval of that order
(one point, or the hours of a day), and a comparison is a relation between a cell and the interval. Texts are compared
folded, true/false columns with a word for either. A null never passes, but for the test for missing values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import normalize, normalize_one, numeric, to_instant, to_number

#: What can be wrong with a request, by a short name.
PROBLEMS = {
    "comparison": "{op!r} is no comparison",
    "operation": "{op!r} is no operation",
    "which column": "{op} of which column?",
    "column": "this table has no column {name!r}",
    "no figures": "{name!r} holds {kind}, and {op} is for figures",
    "value": "{name!r} {op}: the value to compare with is missing",
    "not a figure": "{value!r} is not a figure as {name!r} holds them",
    "search in figures": "{name!r} holds figures, and contains searches in texts",
    "not a day": "{value!r} is not a date as {name!r} holds them; write YYYY-MM-DD",
    "dates are ordered": "{name!r} holds dates, which {op} does not compare",
    "true or false": "{name!r} is true or false, so ask == or != with one of the two",
    "texts have no order": "{name!r} holds texts, and {op} compares figures and dates",
}


class QueryError(Exception):
    """A request that cannot be computed. `problem` is a key of PROBLEMS; `suggestions` has what may have been meant."""

    def __init__(self, problem: str, suggestions: dict[str, list[str]] | None = None, **what):
        super().__init__(PROBLEMS[problem].format(**what))
        self.problem, self.suggestions = problem, suggestions or {}


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str | float | int | None = None
    values: tuple = ()

    def operands(self) -> list[str]:
        """What to compare with, as trimmed texts: the list of `in`, else the one value."""
        many = [str(v).strip() for v in self.values] if self.op == "in" else []
        one = "" if self.value is None else str(self.value).strip()
        if not many and not one:
            raise QueryError("value", name=self.column, op=self.op)
        return many or [one]


class Interval(NamedTuple):
    """From low up to high, which is not part of it; without high, low alone."""

    low: Column
    high: Column | None = None

    def holds(self, c: Column) -> Column:
        return c == self.low if self.high is None else (c >= self.low) & (c < self.high)

    def before(self, c: Column) -> Column:
        return c < self.low

    def after(self, c: Column) -> Column:
        return c > self.low if self.high is None else c >= self.high


#: Comparisons of an ordered family.
RELATIONS: dict[str, Callable[[Interval, Column], Column]] = {
    "==": lambda i, c: i.holds(c), "!=": lambda i, c: ~i.holds(c), "<": lambda i, c: i.before(c), "<=": lambda i, c: ~i.after(c), ">": lambda i, c: i.after(c), ">=": lambda i, c: ~i.before(c),
}
FAMILY = {"integer": "figures", "decimal": "figures", "amount_text": "figures", "date": "dates", "boolean": "truth", "text": "texts", "empty": "texts"}
TRUTH = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}


@dataclass(frozen=True)
class Cell:
    """A column of a table with its kind, and the views of it that filters and aggregates need."""

    df: DataFrame
    name: str
    kind: str

    @property
    def raw(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def type(self) -> str:
        return self.df.schema[self.name].dataType.typeName()

    @property
    def may_be_nan(self) -> bool:
        return self.type in ("double", "float")

    def present(self) -> Column:
        """NaN is a missing value."""
        return F.when(~F.isnan(self.raw), self.raw) if self.may_be_nan else self.raw

    def figure(self) -> Column:
        if self.kind == "amount_text":
            return to_number(self.raw)
        return numeric(self.raw) if self.type == "string" else self.present().cast("double")

    def instant(self) -> Column:
        return to_instant(self.raw) if self.type == "string" else self.raw.cast("timestamp")


def _figure_of(text: str, name: str) -> float:
    kept = "".join(x for x in text if x.isdecimal() or x in ".-")
    try:
        return float(kept)
    except ValueError:
        raise QueryError("not a figure", value=text, name=name) from None


def _figures(cell: Cell, f: Filter) -> Column:
    if f.op == "contains":
        raise QueryError("search in figures", name=cell.name)
    values = [_figure_of(x, cell.name) for x in f.operands()]
    c = cell.figure() if cell.type == "string" else cell.raw  # the bare column, so that the scan can skip by it
    if f.op == "in":
        return c.isin(values)
    passes = RELATIONS[f.op](Interval(F.lit(values[0])), c)
    return passes & ~F.isnan(c) if cell.may_be_nan and f.op in ("!=", ">", ">=") else passes  # NaN is above all figures


def _dates(cell: Cell, f: Filter) -> Column:
    if f.op not in RELATIONS:
        raise QueryError("dates are ordered", name=cell.name, op=f.op)
    text = f.operands()[0]
    at = cell.df.sparkSession.range(1).select(to_instant(F.lit(text)).cast("string")).first()[0]
    if at is None:
        raise QueryError("not a day", value=text, name=cell.name)
    c, kind = (cell.instant(), "timestamp") if cell.type == "string" else (cell.raw, cell.df.schema[cell.name].dataType)
    bound = lambda e: e.cast(kind)  # noqa: E731  in the column's own type, so that the scan can skip by it
    day = len(text) <= len("YYYY-MM-DD")
    high = bound(F.lit(at).cast("timestamp") + F.expr("interval 1 day")) if day else None
    return RELATIONS[f.op](Interval(bound(F.lit(at)), high), c)


def _truth(cell: Cell, f: Filter) -> Column:
    word = f.operands()[0].lower()
    if f.op not in ("==", "!=") or word not in TRUTH:
        raise QueryError("true or false", name=cell.name)
    return cell.raw == F.lit(TRUTH[word] == (f.op == "=="))


def _texts(cell: Cell, f: Filter) -> Column:
    if f.op in RELATIONS and f.op not in ("==", "!="):
        raise QueryError("texts have no order", name=cell.name, op=f.op)
    c, wanted = normalize(cell.raw.cast("string")), [normalize_one(x) for x in f.operands()]
    if f.op == "contains":
        return F.contains(c, F.lit(wanted[0]))
    return c.isin(wanted) if f.op != "!=" else ~c.isin(wanted)


_OF_FAMILY = {"figures": _figures, "dates": _dates, "truth": _truth, "texts": _texts}
OPS = (*RELATIONS, "in", "contains", "is_null", "not_null")


def condition(cell: Cell, f: Filter) -> Column:
    """True for the rows that the filter keeps."""
    if f.op not in OPS:
        raise QueryError("comparison", op=f.op)
    if f.op.endswith("_null"):
        missing = cell.raw.isNull()
        if cell.kind == "text":
            missing = missing | (F.btrim(cell.raw) == "")
        elif cell.may_be_nan:
            missing = missing | F.isnan(cell.raw)
        return missing if f.op == "is_null" else ~missing
    return _OF_FAMILY[FAMILY[cell.kind]](cell, f)
