"""Results as text, one string a cell, as result files of SQL tests hold them."""

from __future__ import annotations

import datetime
import decimal
import math

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Letters of column types in result files.
LETTERS = [((T.BooleanType,), "B"), ((T.DateType,), "D"), ((T.IntegralType,), "I"), ((T.TimestampType, T.TimestampNTZType), "P"), ((T.FractionalType,), "R"), ((T.StringType,), "T")]


def column_types(df: DataFrame) -> str:
    """A letter for each column: B, D, I, P, R, T, and ? for what has none."""
    return "".join(next((letter for kinds, letter in LETTERS if isinstance(f.dataType, kinds)), "?") for f in df.schema.fields)


def cell(value) -> str:
    """One value: NULL, (empty), true and false, numbers in plain notation of at most 12 decimals, the rest as it prints."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if not math.isfinite(value):
            return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
        value = decimal.Decimal(repr(value))
    if isinstance(value, decimal.Decimal):
        shown = f"{value.quantize(decimal.Decimal(1).scaleb(-12), context=decimal.Context(prec=400)):f}" if value.as_tuple().exponent < -12 else f"{value:f}"
        shown = shown.rstrip("0").rstrip(".") if "." in shown else shown
        return "0" if shown in ("-0", "") else shown
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex() or "(empty)"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, dict):  # Row.asDict of a struct, or a map
        return "{" + ", ".join(f"{k}: {cell(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(cell, value)) + "]"
    return str(value) or "(empty)"


def render(df: DataFrame) -> list[list[str]]:
    """All rows as text. They come to the driver, so give it the small results that tests compare."""
    return [[cell(v) for v in row.asDict(recursive=True).values()] if len(set(df.columns)) == len(df.columns) else [cell(v) for v in row] for row in df.collect()]
