"""Random queries for all tables, picked by seeded hashes.

A table's query is drawn as the original draws it: COUNT or a column, one of
the aggregations that answer for the column, then the first other column of
which some (value, comparator) leaves an answer, and one of those.  How many
rows a condition keeps follows from windows over its column, so all values of
all columns are candidates without being compared with each other.  Sampling
agrees with the original in distribution, not pick by pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact_sum, format_number, to_float
from .algebra import AGGREGATIONS, COMPARED, NUMERIC, SAID
from .tables import TableConfig
from .templates import seeded


def selections(cells: DataFrame, seed: int = 0, config: TableConfig = TableConfig()) -> DataFrame:
    """``table_id, aggregation, c, header``: for each table a COUNT with the
    configured probability, else one of the aggregations that have an answer
    without a condition, of a random column ``c``."""
    number = to_float(F.col("text"))
    columns = cells.groupBy("table_id", "column_index").agg(F.first("header").alias("header"), F.count(F.lit(1)).alias("n"), (F.count(number) == F.count(F.lit(1))).alias("ranks"), F.coalesce(F.bool_or(F.col("text") != ""), F.lit(False)).alias("says"))

    def ok(a: str) -> Column:
        if a in ("COUNT", "NONE"):
            return F.lit(True) if a == "COUNT" else F.col("says")
        return (F.col("n") >= 2) & (F.lit(a not in NUMERIC) | F.col("ranks"))

    options = F.filter(F.array(*(F.when(ok(a), F.lit(a)) for a in AGGREGATIONS)), lambda a: a.isNotNull())
    flat = columns.select("table_id", "column_index", "header", F.explode(options).alias("aggregation"))
    counted = F.pmod(seeded(seed, "table_id"), F.lit(1_000_000)) / 1_000_000 < config.prob_count_aggregation
    of = lambda c: F.when(F.col("aggregation") != "COUNT", F.col(c))
    key = F.struct(((F.col("aggregation") == "COUNT") != counted).alias("later"), seeded(seed + 1, "table_id", "column_index").alias("by_column"), "column_index", seeded(seed + 2, "table_id", "column_index", "aggregation").alias("by_aggregation"), "aggregation")
    return flat.groupBy("table_id").agg(F.min_by(F.struct("aggregation", of("column_index").alias("c"), of("header").alias("header")), key).alias("p")).select("table_id", "p.*")


def conditions(cells: DataFrame, picks: DataFrame, seed: int = 0) -> DataFrame:
    """``table_id, w, w_header, comparator, value``: a condition that leaves the
    picked selection an answer, for all tables and selections that can have
    one.  A column is picked among those with such a condition, then a
    condition uniformly over rows and comparators."""
    asked = picks.filter(~F.col("aggregation").endswith("_DIFF")).select("table_id", "c", F.col("header").alias("c_header"), F.when(F.col("aggregation").isin("COUNT", "NONE"), 1).otherwise(2).alias("need"))
    number = to_float(F.col("text"))
    row, column = Window.partitionBy("table_id", "row_index"), Window.partitionBy("table_id", "column_index")
    # Only rows with a cell of the selected column count; nothing is greater or less than NaN.
    counts = F.col("c").isNull() | F.bool_or(F.col("column_index") == F.col("c")).over(row)
    joined = cells.join(asked, "table_id").withColumn("number", number).withColumn("counts", counts).withColumn("real", F.col("counts") & ~F.isnan("number"))
    total = F.count_if("real").over(column)
    sized = joined.withColumns({
        "comparable": F.count("number").over(column) == F.count(F.lit(1)).over(column),
        "equal": F.count_if("counts").over(Window.partitionBy("table_id", "column_index", "text")),
        "greater": total - F.count_if("real").over(column.orderBy("number")),
        "less": total - F.count_if("real").over(column.orderBy(F.desc("number"))),
    })
    ordered = F.col("comparable") & ~F.isnan("number")
    kept = {"=": F.col("equal"), ">": F.when(ordered, F.col("greater")), "<": F.when(ordered, F.col("less"))}
    ways = F.filter(F.array(*(F.when(kept[c] >= F.col("need"), F.lit(c)) for c in COMPARED)), lambda c: c.isNotNull())
    fit = sized.filter((F.col("text") != "") & (F.col("c_header").isNull() | (F.col("header") != F.col("c_header"))))
    flat = fit.select("table_id", "column_index", "row_index", "header", "text", F.explode(ways).alias("comparator"))
    key = F.struct(seeded(seed + 3, "table_id", "column_index").alias("by_column"), "column_index", seeded(seed + 4, "table_id", "column_index", "row_index", "comparator").alias("by_condition"), "row_index", "comparator")
    return flat.groupBy("table_id").agg(F.min_by(F.struct(F.col("column_index").alias("w"), F.col("header").alias("w_header"), "comparator", F.col("text").alias("value")), key).alias("p")).select("table_id", "p.*")


def synthesize(cells: DataFrame, seed: int = 0, config: TableConfig = TableConfig()) -> DataFrame:
    """``table_id, question, answer``: one query a table with its answer; a
    COUNT with the configured probability, else an aggregation over a random
    column, with a condition on another column wherever one leaves an answer.
    Differences take no condition."""
    picks = selections(cells, seed, config)
    asked = picks.join(conditions(cells, picks, seed), "table_id", "left")
    at = lambda i: F.max(F.when(F.col("column_index") == F.col(i), F.col("text")))
    rows = cells.join(asked.select("table_id", "c", "w", "comparator", "value"), "table_id").groupBy("table_id", "row_index").agg(at("c").alias("text"), F.bool_or((F.col("column_index") == F.col("c")) | F.col("c").isNull()).alias("counts"), at("w").alias("on"), F.first("w").alias("w"), F.first("comparator").alias("comparator"), F.first("value").alias("value"))
    a, b = to_float(F.col("on")), to_float(F.col("value"))
    compared = F.when(F.col("comparator") == "=", F.col("on") == F.col("value")).otherwise(~F.isnan(a) & ~F.isnan(b) & F.when(F.col("comparator") == ">", a > b).otherwise(a < b))
    kept = rows.filter("counts").filter(F.col("w").isNull() | compared).withColumn("number", to_float(F.col("text")))
    kept = kept.withColumn("step", F.abs(F.col("number") - F.lead("number").over(Window.partitionBy("table_id").orderBy("row_index"))))
    low, high = F.struct("number", "row_index"), F.struct(F.col("number"), (-F.col("row_index")).alias("b"))
    stepped = F.when(F.col("step").isNotNull(), F.col("row_index"))
    stats = kept.groupBy("table_id").agg(
        F.count(F.lit(1)).cast("double").alias("COUNT"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("text") != "", F.col("text")))), " | ").alias("NONE"),
        F.min_by("text", "row_index").alias("FIRST"), F.max_by("text", "row_index").alias("LAST"), F.min_by("text", low).alias("LOWEST"), F.max_by("text", high).alias("GREATEST"),
        exact_sum(F.col("number")).alias("SUM"), (exact_sum(F.col("number")) / F.count("number")).alias("AVERAGE"), (F.max("number") - F.min("number")).alias("RANGE"),
        F.min_by("step", stepped).alias("FIRST_DIFF"), F.max_by("step", stepped).alias("LAST_DIFF"),
    )
    told = asked.join(stats, "table_id")
    numbers = [x for x in AGGREGATIONS if dict(stats.dtypes)[x] == "double"]
    pick = lambda names: F.coalesce(*(F.when(F.col("aggregation") == x, F.col(x)) for x in names))
    answer = F.when(F.col("aggregation").isin(numbers), F.coalesce(format_number(pick(numbers)), F.lit("nan"))).otherwise(pick([x for x in AGGREGATIONS if x not in numbers]))
    form = F.coalesce(*(F.when(F.col("aggregation") == x, F.lit(SAID[x])) for x in AGGREGATIONS))
    how = F.coalesce(*(F.when(F.col("comparator") == x, F.lit(COMPARED[x])) for x in COMPARED))
    where = F.when(F.col("w").isNotNull(), F.concat_ws(" ", F.lit(" when"), "w_header", how, "value")).otherwise("")
    return told.select("table_id", F.concat(F.lit("What is "), F.replace(form, F.lit("{}"), F.coalesce("header", F.lit(""))), where).alias("question"), answer.alias("answer"))


def retrieval_queries(cells: DataFrame, row_texts: DataFrame, seed: int = 0, config: TableConfig = TableConfig()) -> DataFrame:
    """``table_id, query, target``: ``header is value`` for a value picked
    among the first columns, and the rows with that value, said in order."""
    fit = cells.filter(F.col("text") != "")
    if config.retrieval_sampling_right_boundary is not None:
        fit = fit.filter(F.col("column_index") < config.retrieval_sampling_right_boundary)
    if config.retrieval_relevant_cell_length_limit is not None:
        fit = fit.filter(F.size(F.split("text", " ")) < config.retrieval_relevant_cell_length_limit)
    key = F.struct(seeded(seed, "table_id", "column_index", "row_index"), "column_index", "row_index")
    picked = fit.groupBy("table_id").agg(F.min_by(F.struct("column_index", "header", "text"), key).alias("p")).select("table_id", "p.*")
    rows = cells.join(picked.drop("header"), ["table_id", "column_index", "text"]).select("table_id", "row_index").distinct()
    said = rows.join(row_texts, ["table_id", "row_index"]).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "said"))).alias("r"))
    return picked.join(said, "table_id").select("table_id", F.concat_ws(" ", "header", F.lit("is"), "text").alias("query"), F.array_join("r.said", " ").alias("target"))
