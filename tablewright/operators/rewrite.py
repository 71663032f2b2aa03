"""Contrastive rewriting: one entity of a row is replaced by another row's
cell of the same column, everywhere it is mentioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import seeded


def contrastive(contexts: DataFrame, focus: DataFrame, cells: DataFrame, seed: int = 0) -> DataFrame:
    """``context_id, original_text, contrastive_text, replacements`` (original
    and replaced text and spans).  ``contexts``: ``context_id, table_id,
    text``; ``focus``: ``context_id, row_index, column_index, mentions``;
    ``cells``: ``table_id, row_index, column_index, text``.

    Rows with three focus entities in tables of three rows take part.
    Replacements with overlapping or touching spans void the context."""
    rows = focus.groupBy("context_id", "row_index").agg(F.count(F.lit(1)).alias("m"), F.min_by(F.struct("column_index", "mentions"), F.struct(seeded(seed, "context_id", "row_index", "column_index"), "column_index")).alias("e")).filter("m >= 3")
    tall = cells.groupBy("table_id").agg(F.countDistinct("row_index").alias("h")).filter("h > 2").select("table_id")
    named = contexts.join(tall, "table_id").join(rows, "context_id").select("context_id", "table_id", F.col("text").alias("said"), F.col("row_index").alias("own"), "e.column_index", "e.mentions")
    # Tables stay where they are: columns and rows are compared in ranges, as equal ones would be further keys to shuffle by.
    of = lambda named, c: named.join(cells.select("table_id", *(F.col(x).alias(f"c_{x}") for x in ("column_index", "row_index", "text"))), "table_id").filter(F.col("column_index").between(F.col("c_column_index"), F.col("c_column_index")) & c)
    mine = of(named, F.col("own").between(F.col("c_row_index"), F.col("c_row_index"))).withColumnRenamed("c_text", "old").drop("c_column_index", "c_row_index")
    fresh = of(mine, (F.col("own") != F.col("c_row_index")) & (F.col("old") != F.col("c_text")))
    picked = fresh.groupBy("table_id", "context_id", "own").agg(F.first("said").alias("said"), F.first("mentions").alias("mentions"), F.min_by("c_text", F.struct(seeded(seed, "context_id", "own", "c_row_index"), "c_row_index")).alias("new"))
    spans = picked.select("table_id", "context_id", "said", F.explode("mentions").alias("s"), "new").groupBy("table_id", "context_id", "said").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end", "new"))).alias("r"))
    clear = F.expr("forall(sequence(0, greatest(size(r) - 2, 0)), i -> size(r) < 2 OR r[i].end < r[least(i + 1, size(r) - 1)].start)")
    fold = F.expr(
        "aggregate(r, named_struct('at', 0, 'p', 0, 'o', cast(array() as array<string>), 'a', cast(array() as array<struct<original_text:string,replaced_text:string,start:int,end:int,new_start:int,new_end:int>>)),"
        " (x, s) -> named_struct('at', s.end, 'p', x.p + (s.start - x.at) + length(s.new), 'o', concat(x.o, array(substring(said, x.at + 1, s.start - x.at), s.new)),"
        " 'a', array_append(x.a, named_struct('original_text', substring(said, s.start + 1, s.end - s.start), 'replaced_text', s.new, 'start', s.start, 'end', s.end, 'new_start', x.p + (s.start - x.at), 'new_end', x.p + (s.start - x.at) + length(s.new)))),"
        " x -> named_struct('text', concat(array_join(x.o, ''), substring(said, x.at + 1)), 'replacements', x.a))"
    )
    return spans.filter(clear).withColumn("f", fold).select("context_id", F.col("said").alias("original_text"), F.col("f.text").alias("contrastive_text"), F.col("f.replacements").alias("replacements"), F.lit("NEGATIVE").alias("label"))
