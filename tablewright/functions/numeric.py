"""Numbers as web tables write them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FLOAT = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"
SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def python_float(text: Column) -> Column:
    """What Python's ``float`` reads, null where it reads nothing."""
    plain = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    return F.when(text.rlike(FLOAT) | text.rlike(SPECIAL), plain.try_cast("double"))


def is_number(text: Column) -> Column:
    return python_float(text).isNotNull()


def splits_thousands(text: Column) -> Column:
    """More than one part between commas, and one of three characters."""
    parts = F.split(text, ",")
    return (F.size(parts) > 1) & F.exists(parts, lambda p: F.length(p) == 3)


def to_float(text: Column) -> Column:
    """A cell's number, null if it has none.  Rules in order: with stops and
    commas, commas go; thousands' commas go; a single comma is a decimal one;
    several stops go; several commas go."""
    commas, stops = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))), F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    without = F.replace(text, F.lit(","), F.lit(""))
    plain = (
        F.when((commas > 0) & (stops > 0), without)
        .when(splits_thousands(text), without)
        .when(commas == 1, F.replace(text, F.lit(","), F.lit(".")))
        .when(stops > 1, F.replace(text, F.lit("."), F.lit("")))
        .when(commas > 1, without)
        .otherwise(text)
    )
    return python_float(plain)


def span_int(value: Column) -> Column:
    """A span attribute: an integer, else its first run of digits, else 1."""
    return F.coalesce(value.try_cast("int"), F.regexp_extract(value, "[0-9]+", 0).try_cast("int"), F.lit(1))


def strict_span_int(value: Column) -> Column:
    """A span attribute without semicolons around it, else 1."""
    return F.coalesce(F.regexp_replace(value, "^;+|;+$", "").try_cast("int"), F.lit(1))


@F.pandas_udf(StringType())
def format_number(s: pd.Series) -> pd.Series:
    """Whole numbers without decimals, others with two, rounded as Python
    does.  Applied after aggregation, so it sees one row a group."""
    return s.map(lambda x: None if pd.isna(x) else f"{x:.0f}" if float(x).is_integer() else f"{x:.2f}")


def exact_sum(x: Column) -> Column:
    """A sum that doesn't depend on the rows' order: in decimals, and in
    doubles where a number or the sum is too large for those, or not finite."""
    decimal = x.try_cast("decimal(28,10)")
    fits = F.count(decimal) == F.count(x)
    return F.coalesce(F.when(fits, F.try_sum(decimal).cast("double")), F.sum(x))
