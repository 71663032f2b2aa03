"""Web tables as one long DataFrame of cells: typing, ranks, validity, text.

All tables of a collection are processed at once; ``table_id`` is the only
shuffle key.  ``cells``: ``table_id, row_index`` (0 in the body)``,
column_index, header, text``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import to_float
from ..functions.text import MISSING, clean_text, column_name, linearize_row, padded_cell
from ..session import spread


@dataclass(frozen=True)
class TableConfig:
    min_row_num: int = 4
    max_row_num: int = 30
    sampling_limit: int = 10
    prob_count_aggregation: float = 0.2
    sql_populate_size: int = 3
    retrieval_sampling_right_boundary: int | None = None
    retrieval_relevant_cell_length_limit: int | None = None
    no_process: bool = False


def table_id(tables: DataFrame) -> Column:
    """The given id, or the page URL's last ``=`` part and the table's index."""
    index = F.coalesce(F.col("page_table_index").cast("string"), F.lit("None"))
    made = F.concat(F.element_at(F.split("page_url", "="), -1), F.lit("-"), index)
    return F.coalesce(F.col("table_id"), made) if "table_id" in tables.columns else made


def melt(df: DataFrame, table_key: Column, row_order: Column, columns: list[str]) -> DataFrame:
    """A relation's rows as cells: each key is one table.  Headers are the
    column names; the array is exploded within the row, so only ranking the
    rows shuffles, to tasks whose size doesn't grow with the input."""
    nth = F.row_number().over(Window.partitionBy("table_id").orderBy("__order")) - 1
    keyed = df.select(table_key.cast("string").alias("table_id"), row_order.alias("__order"), *(F.col(c).cast("string").alias(c) for c in columns))
    rows = spread(keyed, "table_id").withColumn("row_index", nth)
    cells = F.posexplode(F.array(*(F.struct(F.lit(c).alias("header"), clean_text(F.col(c)).alias("text")) for c in columns)))
    return rows.select("table_id", "row_index", cells.alias("column_index", "c")).select("table_id", "row_index", "column_index", "c.header", "c.text")


def cells_of(tables: DataFrame) -> DataFrame:
    """``tables`` (``table_id, grid``) as cells; row 0 of a grid is its
    header, and a row's cells beyond the header are dropped."""
    body = tables.select("table_id", F.col("grid")[0].alias("head"), F.posexplode(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))).alias("row_index", "row"))
    zipped = F.slice(F.arrays_zip("head", "row"), 1, F.least(F.size("head"), F.size("row")))
    return body.select("table_id", "row_index", F.posexplode(zipped).alias("column_index", "c")).select("table_id", "row_index", "column_index", F.col("c.head").alias("header"), clean_text(F.col("c.row")).alias("text"))


def ranked(cells: DataFrame) -> DataFrame:
    """Adds ``number`` and ``rank``: dense, from 0, null unless the whole
    column parses.  A row that ends before the column counts as ``none``, which
    doesn't parse (rows without any cell after a table's last one are unknown).
    All windows are served by one shuffle on ``table_id`` and one sort."""
    column = Window.partitionBy("table_id", "column_index")
    ranks = cells.withColumn("number", to_float(F.col("text"))).withColumn("rank", F.dense_rank().over(column.orderBy("number")) - 1)
    # Only the first window sorts: its order holds those of the others, which come after it, as the last one refers to ``__n``.
    counted = ranks.withColumn("__n", F.count("number").over(column)).withColumn("__last", F.max(F.when(F.col("__n") >= 0, F.col("row_index"))).over(Window.partitionBy("table_id")))
    return counted.withColumn("rank", F.when(F.col("__n") == F.col("__last") + 1, F.col("rank"))).drop("__n", "__last")


def column_types(cells: DataFrame) -> DataFrame:
    """``table_id, column_index, header, column_type, is_grouped``: NUMBER if
    all values parse, else TEXT, grouped if a TEXT value repeats.  A row that
    ends before the column has ``none`` there.  Columns that the first row
    lacks have no type."""
    typed = cells.withColumn("number", to_float(F.col("text"))).groupBy("table_id", "column_index").agg(
        F.first("header").alias("header"), F.count(F.lit(1)).alias("n"), F.count("number").alias("parsed"), F.countDistinct("text").alias("different"),
        F.max((F.col("text") == MISSING).cast("int")).alias("empty"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"),
    )
    sized = typed.withColumn("rows", F.max("last_row").over(Window.partitionBy("table_id")) + 1)
    kind = F.when(F.col("first_row") > 0, F.lit(None)).when(F.col("parsed") == F.col("rows"), F.lit("NUMBER")).otherwise(F.lit("TEXT"))
    values = F.col("different") + F.when((F.col("n") < F.col("rows")) & (F.coalesce("empty", F.lit(0)) == 0), 1).otherwise(0)
    return sized.withColumn("column_type", kind).select("table_id", "column_index", "header", "column_type", F.coalesce((F.col("column_type") == "TEXT") & (values < F.col("rows")), F.lit(False)).alias("is_grouped"))


def is_valid_grid(grid: Column, config: TableConfig = TableConfig(), vocabulary: list[str] | None = None) -> Column:
    """Row count in bounds (the header counts), names neither empty nor
    repeated, at most two headers out of the vocabulary."""
    head = F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>"))
    names = F.transform(head, column_name)
    ok = F.size(grid).between(config.min_row_num, config.max_row_num) & (F.size(names) == F.size(F.array_distinct(names))) & ~F.array_contains(names, "")
    if vocabulary is not None:
        known = F.array(*map(F.lit, vocabulary))
        ok = ok & (F.size(F.filter(head, lambda h: ~F.array_contains(known, h))) <= 2)
    return ok


def valid_tables(tables: DataFrame, config: TableConfig = TableConfig(), vocabulary: list[str] | None = None) -> DataFrame:
    return tables.filter(is_valid_grid(F.col("grid"), config, vocabulary))


def row_texts(cells: DataFrame) -> DataFrame:
    """``table_id, row_index, said``: each row as ``name is text, ….``"""
    rows = cells.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "header", "text"))).alias("c"))
    return rows.select("table_id", "row_index", linearize_row(F.transform("c.header", column_name), F.col("c.text")).alias("said"))


def table_texts(cells: DataFrame) -> DataFrame:
    """``table_id, said``: all rows, in order, joined by a space."""
    rows = row_texts(cells).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "said"))).alias("r"))
    return rows.select("table_id", F.array_join("r.said", " ").alias("said"))


def grids(cells: DataFrame) -> DataFrame:
    """Cells back to ``table_id, grid`` with the header as row 0."""
    rows = cells.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "header", "text"))).alias("c"))
    whole = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", F.col("c.header").alias("h"), F.col("c.text").alias("t")))).alias("r"))
    return whole.select("table_id", F.concat(F.array(F.col("r")[0]["h"]), F.col("r.t")).alias("grid"))


def wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as rows with the named columns, for queries over them; a row that
    ends before a column has ``none`` there."""
    picks = [F.coalesce(F.max(F.when(F.col("header") == c, F.col("text"))), F.lit(MISSING)).alias(c) for c in columns]
    return cells.groupBy("table_id", "row_index").agg(*picks)


def cell_at(grid: Column, row: Column, column: Column) -> Column:
    """A grid's cell; row 0 is the header.  Beyond the end of a body row it is
    ``none``; rows that the grid lacks have no cells."""
    there = F.get(grid, row)
    return F.when((row > 0) & there.isNotNull(), padded_cell(there, column)).otherwise(F.get(there, column))
