"""(head, type, tail) triples from text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "head string, type string, tail string, doc_id string, sent_id string"


def parsed_triples(text: Column) -> Column:
    """``array<struct<head, type, tail>>`` of a model's linear output.

    A fold over its tokens: what stands after ``<triplet>`` is the head, after
    ``<subj>`` the tail, after ``<obj>`` the type.  The next ``<triplet>`` or
    ``<subj>`` emits what is pending once there is a type; only the former
    forgets the type, so a tail without one inherits it."""
    plain = F.regexp_replace(text, "<s>|<pad>|</s>", "")
    items = F.filter(F.split(plain, r"(?U)\s+"), lambda t: t != "")
    empty = F.expr("named_struct('in', 'x', 'head', '', 'tail', '', 'type', '', 'out', cast(array() as array<struct<head:string,type:string,tail:string>>))")

    def now(a: Column) -> Column:
        return F.struct(F.trim(a["head"]).alias("head"), F.trim(a["type"]).alias("type"), F.trim(a["tail"]).alias("tail"))

    def step(a: Column, t: Column) -> Column:
        mark = t.isin("<triplet>", "<subj>", "<obj>")
        out = F.when(t.isin("<triplet>", "<subj>") & (a["type"] != ""), F.array_append(a["out"], now(a))).otherwise(a["out"])
        more = lambda part, state: F.when((a["in"] == state) & ~mark, F.concat(a[part], F.lit(" "), t)).otherwise(a[part])
        return F.struct(
            F.when(mark, t).otherwise(a["in"]).alias("in"),
            F.when(t == "<triplet>", F.lit("")).otherwise(more("head", "<triplet>")).alias("head"),
            F.when(t == "<subj>", F.lit("")).otherwise(more("tail", "<subj>")).alias("tail"),
            F.when((t == "<triplet>") | (t == "<obj>"), F.lit("")).otherwise(more("type", "<obj>")).alias("type"),
            out.alias("out"),
        )

    def end(a: Column) -> Column:
        whole = (a["head"] != "") & (a["type"] != "") & (a["tail"] != "")
        return F.when(whole, F.array_append(a["out"], now(a))).otherwise(a["out"])

    return F.aggregate(items, empty, step, end)


def triples(df: DataFrame) -> DataFrame:
    """``df`` (``doc_id, sent_id, text``) to rows of ``SCHEMA``."""
    each = df.select(F.col("doc_id").cast("string"), F.col("sent_id").cast("string"), F.explode(parsed_triples(F.col("text"))).alias("t"))
    return each.select("t.head", "t.type", "t.tail", "doc_id", "sent_id")


def entity_links(df: DataFrame) -> DataFrame:
    """``df`` (``doc_id, sent_id, text, links array<struct<start, length,
    entity>>``) to ``LINK_TO`` rows of ``SCHEMA``."""
    each = df.select(F.col("doc_id").cast("string"), F.col("sent_id").cast("string"), "text", F.explode("links").alias("l"))
    return each.select(F.col("text").substr(F.col("l.start") + 1, F.col("l.length")).alias("head"), F.lit("LINK_TO").alias("type"), F.col("l.entity").alias("tail"), "doc_id", "sent_id")


def generated(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> DataFrame:
    """``doc_id, sent_id, text`` with a model's output for each text.  The
    model is loaded once a partition and sees ``batch`` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for g in batches:
            said = [x for i in range(0, len(g), batch) for x in model(g["text"].iloc[i : i + batch].tolist())]
            yield g.assign(text=said)

    return df.select(F.col("doc_id").cast("string"), F.col("sent_id").cast("string"), "text").mapInPandas(run, "doc_id string, sent_id string, text string")
