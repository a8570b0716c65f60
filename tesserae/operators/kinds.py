"""The logical kind of each column: empty, boolean, integer, decimal, amount_text, date or text.

Kinds of all asked columns come from one aggregation. With a `row_column`, texts are judged by their first values in
its order (the first AMOUNT_ROWS for amounts, DATE_ROWS for dates), so that only a bounded head of the table is looked
at; without one there is no first value, and all values are judged in the same aggregation. Either way the same table
always gets the same kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import AMOUNT, DATE_HINT, to_instant

AMOUNT_ROWS, DATE_ROWS = 200, 50
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(df[f"`{c}`"]), df[f"`{c}`"]) for c in floats}) if floats else df


def named_kind(kind: str) -> str:
    """A kind in words for whoever asks."""
    return {"amount_text": "amounts as text", "boolean": "yes or no", "empty": "nothing"}.get(kind, kind)


def _text_checks(v: Column, early: Column) -> dict[str, Column]:
    """Aggregates over texts v that _text_kind() judges by; early marks those that dates are judged by."""
    share = lambda ok, where: F.avg(F.when(where, ok.cast("double")))
    some = v.isNotNull()
    dated = F.when(v.rlike(DATE_HINT), to_instant(v).isNotNull()).otherwise(F.lit(False))  # a text without a hint of a date is not parsed
    return {"n": F.count(v), "digits": F.bool_and(v.rlike(r"^\d+$")), "amount": share(v.rlike(AMOUNT), some), "hint": share(v.rlike(DATE_HINT), some & early), "date": share(dated, some & early)}


def _text_kind(seen: dict) -> str:
    if seen["n"] >= 3 and not seen["digits"] and seen["amount"] >= 0.95:
        return "amount_text"
    return "date" if seen["n"] >= 3 and min(seen["hint"], seen["date"]) >= 0.9 else "text"


def infer_kinds(df: DataFrame, columns: list[str] | None = None, row_column: str | None = None) -> dict[str, str]:
    row_column = row_column or ("_row" if "_row" in df.columns else None)
    fields = [f for f in df.schema.fields if f.name != row_column and (columns is None or f.name in columns)]
    checks = {}
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        c = F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
        checks[f"some{i}"] = F.max(c.isNotNull())
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            checks[f"whole{i}"] = F.bool_and(c % 1 == 0)
        if isinstance(f.dataType, T.StringType) and not row_column:
            checks |= {f"{k}{i}": v for k, v in _text_checks(c, F.lit(True)).items()}
    seen = df.agg(*(v.alias(k) for k, v in checks.items())).first().asDict() if checks else {}
    return {f.name: _kind(df, f, {k[: -len(str(i))]: v for k, v in seen.items() if k.rstrip("0123456789") + str(i) == k}, row_column) for i, f in enumerate(fields)}


def _kind(df: DataFrame, f: T.StructField, seen: dict, row_column: str | None) -> str:
    if not seen["some"]:
        return "empty"
    if isinstance(f.dataType, T.StringType):
        return _text_kind(_head(df, f.name, row_column) if row_column else seen)
    for types, kind in (((T.BooleanType,), "boolean"), (_DATES, "date"), ((T.IntegralType,), "integer")):
        if isinstance(f.dataType, types):
            return kind
    return ("integer" if seen["whole"] else "decimal") if "whole" in seen else "text"


def _head(df: DataFrame, name: str, row_column: str) -> dict:
    """The checks over the first values by row_column."""
    c = F.col(f"`{name}`")
    head = df.where(c.isNotNull()).orderBy(row_column).select(c.alias("v")).limit(AMOUNT_ROWS).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    return head.agg(*(v.alias(k) for k, v in _text_checks(F.col("v"), F.col("i") < DATE_ROWS).items())).first().asDict()
