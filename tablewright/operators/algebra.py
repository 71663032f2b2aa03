"""Select-aggregate-where over all tables of a collection at once.

An expression compiles to one aggregation by ``table_id`` with conditional
aggregates: no row is filtered before the shuffle's map-side combining has
seen whether the table's column ranks or a comparison failed.  ``rows``:
``table_id, row_index`` and text columns.

A comparison that can't be made (``<`` or ``>`` on text) among rows that
earlier clauses kept voids its table's answer.  No surviving row, no answer;
all aggregations but COUNT and NONE need two rows, numeric ones a column whose
values all parse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact_sum, format_number, to_float

#: How aggregations and comparators are said.
SAID = {"NONE": "{}", "FIRST": "the first {}", "LAST": "the last {}", "LOWEST": "the lowest {}", "GREATEST": "the greatest {}", "SUM": "the total {}", "AVERAGE": "the average {}", "RANGE": "the range of {}", "FIRST_DIFF": "the difference of {} for first two", "LAST_DIFF": "the difference of {} for last two", "COUNT": "the count"}
COMPARED = {"=": "is", "<": "is less than", ">": "is greater than"}
NUMERIC = {"LOWEST", "GREATEST", "SUM", "AVERAGE", "RANGE", "FIRST_DIFF", "LAST_DIFF"}
AGGREGATIONS = tuple(SAID)


@dataclass(frozen=True)
class Where:
    column: str
    comparator: str
    value: str

    def holds(self) -> Column:
        """True, false, or null where the comparison can't be made."""
        text = F.col(f"`{self.column}`")
        if self.comparator == "=":
            return F.coalesce(text == self.value, F.lit(False))
        a, b = to_float(text), to_float(F.lit(self.value))
        return a > b if self.comparator == ">" else a < b

    def said(self) -> str:
        return f"{self.column} {COMPARED[self.comparator]} {self.value}"


@dataclass(frozen=True)
class Select:
    aggregation: str
    column: str | None = None

    def __post_init__(self) -> None:
        if self.aggregation not in SAID:
            raise ValueError(f"unknown aggregation {self.aggregation}")

    def said(self) -> str:
        return SAID[self.aggregation].format(self.column)


@dataclass(frozen=True)
class Expression:
    select: Select
    where: tuple[Where, ...] = ()

    def said(self) -> str:
        return self.select.said() + (" when " + " and ".join(w.said() for w in self.where) if self.where else "")

    def question(self) -> str:
        return f"What is {self.said()}"


def evaluate(rows: DataFrame, e: Expression) -> DataFrame:
    """``table_id, answer array<string>`` for each table; null: no answer."""
    alive, failed = F.lit(True), F.lit(False)
    for clause in e.where:
        holds = clause.holds()
        failed = failed | (alive & holds.isNull())
        alive = alive & F.coalesce(holds, F.lit(False))
    kind, column = e.select.aggregation, e.select.column
    text = F.col(f"`{column}`") if column else F.lit(None).cast("string")
    made = rows.select("table_id", "row_index", text.alias("text"), to_float(text).alias("number"), alive.alias("alive"), failed.alias("failed"))
    if kind.endswith("_DIFF"):
        made = steps(made, kind)
    kept_text, kept_number = F.when(F.col("alive"), F.col("text")), F.when(F.col("alive"), F.col("number"))
    at = F.when(F.col("alive"), F.col("row_index"))
    values = {
        "COUNT": lambda: F.count_if("alive").cast("double"),
        "NONE": lambda: F.array_sort(F.collect_set(F.when(F.col("alive") & (F.col("text") != ""), F.col("text")))),
        "FIRST": lambda: F.min_by(kept_text, at),
        "LAST": lambda: F.max_by(kept_text, at),
        "LOWEST": lambda: F.min_by(kept_text, F.when(F.col("alive"), F.struct("number", "row_index"))),
        "GREATEST": lambda: F.max_by(kept_text, F.when(F.col("alive"), F.struct(F.col("number"), (-F.col("row_index")).alias("back")))),
        "SUM": lambda: exact_sum(kept_number),
        "AVERAGE": lambda: exact_sum(kept_number) / F.count_if("alive"),
        "RANGE": lambda: F.max(kept_number) - F.min(kept_number),
        "FIRST_DIFF": lambda: F.min_by("step", at),
        "LAST_DIFF": lambda: F.max_by("step", at),
    }
    grouped = made.groupBy("table_id").agg(F.count_if("alive").alias("n"), F.bool_or("failed").alias("void"), F.bool_and(F.col("number").isNotNull()).alias("ranks"), values[kind]().alias("value"))
    ok = ~F.col("void") & (F.col("n") > 0)
    if kind not in ("COUNT", "NONE"):
        ok = ok & (F.col("n") >= 2)
    if kind in NUMERIC:
        ok = ok & F.col("ranks")
    if kind == "NONE":
        answer = F.when(F.size("value") > 0, F.col("value"))
    elif kind in ("FIRST", "LAST", "LOWEST", "GREATEST"):
        answer = F.array("value")
    else:
        answer = F.array(format_number(F.col("value")))
    return grouped.select("table_id", F.when(ok, answer).alias("answer"))


def steps(made: DataFrame, kind: str) -> DataFrame:
    """Differences between neighbours among surviving rows."""
    order = Window.partitionBy("table_id", "alive").orderBy("row_index")
    step = F.lead("number").over(order) if kind == "FIRST_DIFF" else F.lag("number").over(order)
    return made.withColumn("step", F.when(F.col("alive"), F.abs(F.col("number") - step)))


def strict_failures(rows: DataFrame, e: Expression) -> DataFrame:
    """``table_id, failed``: whether a comparison among surviving rows
    can't be made."""
    alive, failed = F.lit(True), F.lit(False)
    for clause in e.where:
        holds = clause.holds()
        failed = failed | (alive & holds.isNull())
        alive = alive & F.coalesce(holds, F.lit(False))
    return rows.groupBy("table_id").agg(F.bool_or(failed).alias("failed"))
