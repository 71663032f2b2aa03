"""Text functions over cells, column names and rows.

All are JVM expressions but ``normal_form`` (Unicode NFKD, which Spark lacks).
A missing cell is the literal ``none``, never null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MISSING = "none"
#: Characters that a column name loses.
NAME_LOSES = ".+-?!*@%^&#=/\\:\"'()"
#: Month abbreviations and what they stand for.
MONTHS = {"Jan": "January", "Feb": "February", "Mar": "March", "Apr": "April", "Jun": "June", "Jul": "July", "Aug": "August", "Sep": "September", "Oct": "October", "Nov": "November", "Dec": "December"}
TITLE_SUFFIX = " - Wikipedia"
#: Entity tags that stand for numbers.
NUMERIC_TAGS = ("TIME", "PERCENT", "MONEY", "QUANTITY", "CARDINAL")
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """The words of a text, as Python's ``split()`` finds them."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Blanks collapsed to one space; ``none`` where nothing is left."""
    joined = F.array_join(words(F.coalesce(text, F.lit(""))), " ")
    return F.when(joined == "", F.lit(MISSING)).otherwise(joined)


def clean_name_token(token: Column) -> Column:
    return F.translate(token, NAME_LOSES, "")


def column_name(text: Column) -> Column:
    """A header's normalised name; a token of punctuation alone leaves an
    empty part."""
    return F.lower(F.array_join(F.transform(words(text), clean_name_token), "_"))


def expand_months(text: Column) -> Column:
    for short, long in MONTHS.items():
        text = F.replace(text, F.lit(short + " "), F.lit(long + " "))
    return text


def linearize_grid(grid: Column) -> Column:
    """``col: a | b | row 0: x | y`` of an array of rows, the header first."""
    head = F.concat(F.lit("col: "), F.array_join(F.get(grid, F.lit(0)), " | "))
    body = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), lambda r, i: F.concat(F.lit("row "), i.cast("string"), F.lit(": "), F.array_join(r, " | ")))
    return F.array_join(F.concat(F.array(head), body), " | ")


def linearize_row(names: Column, cells: Column) -> Column:
    """``a is x, b is y.`` without empty cells."""
    said = F.zip_with(names, cells, lambda n, c: F.when(c != "", F.concat(n, F.lit(" is "), c)))
    return F.concat(F.array_join(F.filter(said, lambda s: s.isNotNull()), ", "), F.lit("."))


def padded_cell(cells: Column, index: Column | int) -> Column:
    """A row's cell; beyond its end ``none``."""
    return F.coalesce(F.get(cells, F.lit(index) if isinstance(index, int) else index), F.lit(MISSING))


def plain_title(title: Column) -> Column:
    return F.replace(title, F.lit(TITLE_SUFFIX), F.lit(""))


def is_content_cell(value: Column) -> Column:
    return ~value.isin("", "-")


def is_unimportant(value: Column) -> Column:
    """A single digit or a year."""
    return value.rlike("^([0-9]|[0-9]{4})$")


def table_seed(table_id: Column) -> Column:
    """A table's 32-bit seed: SHA-256 of the quoted id modulo 2^32 - 1.  As
    2^32 is 1 there, that is the sum of the digest's eight words."""
    digest = F.sha2(F.concat(F.lit("'"), table_id, F.lit("'")), 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    return sum(parts[1:], parts[0]) % F.lit(2**32 - 1)


def is_statistic(text: Column, header: Column, tokens: Column, tags: Column) -> Column:
    """Whether a cell states a measured value."""
    bare = F.regexp_replace(text, "[,.:]", "")
    marked = text.rlike("[,.:]") & F.try_to_number(bare, F.lit("S999999999999999999")).isNotNull()
    pairs = F.arrays_zip(tokens.alias("t"), tags.alias("g"))
    numeric = F.size(F.filter(pairs, lambda p: p["g"].isin(*NUMERIC_TAGS)))
    other = F.size(F.filter(pairs, lambda p: ~p["g"].isin(*NUMERIC_TAGS) & ~p["t"].isin("(", ")")))
    return F.when(F.coalesce(header == "Year", F.lit(False)), F.lit(False)).when(marked, F.lit(True)).when(text.contains("°C") | text.contains("°F"), F.lit(True)).when(F.length(text).isin(1, 4), F.lit(False)).otherwise(numeric > other)


def tokens(text: Column) -> Column:
    """Tokens by rule: runs of word characters, and other characters singly."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def tokens_with_offsets(text: Column) -> Column:
    """``array<struct<text, start, end>>`` (code points, end exclusive): what
    the pattern matches and what lies between advance together."""
    pattern = r"(?U)\w+|[^\w\s]"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)").alias("out"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + p["g"]
        end = begin + F.length(p["m"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(p["m"].alias("text"), begin.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def sentences(paragraph: Column) -> Column:
    """Sentences by rule: a stop, exclamation or question mark ends one when
    blanks and an upper-case letter, digit or quote follow, unless a single
    capital or a common title stands before it."""
    return F.filter(F.transform(F.split(paragraph, r"(?U)(?<=[.!?])(?<!\b(?:\p{Lu}|Mr|Mrs|Ms|Dr|St|vs|No)\.)\s+(?=[\p{Lu}\p{N}\"'(])"), F.trim), lambda s: s != "")


@F.pandas_udf(StringType())
def normal_form(s: pd.Series) -> pd.Series:
    """Unicode NFKD."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))
