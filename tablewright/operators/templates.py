"""SQL templates with slots, compiled once and populated for all tables.

A template such as ``SELECT [COLUMN_TEXT_0] FROM W WHERE [COLUMN_NUMBER_1] >
[NUMBER]`` is parsed on the driver into slots.  For each table, columns of the
slots' types and a value of the last column named are picked by a seeded hash,
so a pick is reproducible at any partitioning.  Columns are addressed by index
and values compared as numbers where the column is one; ``populate_all`` also
executes the SQL."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.numeric import to_float
from ..functions.text import column_name
from .tables import TableConfig, column_types

SLOT = re.compile(r"\[(COLUMN)_(\w+)_(\d+)\]|\[(TEXT|NUMBER|LIMIT_VALUE)\]")


@dataclass(frozen=True)
class Slot:
    token: str
    #: column, value, literal
    kind: str
    type: str = ""
    literal: str = ""
    #: The slot of the column a value belongs to.
    of: str = ""


class Template:
    """``slots`` in order of appearance; ``valid`` is false where a value comes
    before any column or doesn't fit its column."""

    def __init__(self, template: str):
        self.tokens = ["ROWID" if t == "ID" else t for t in template.split()]
        self.text = " ".join(self.tokens)
        self.slots: list[Slot] = []
        self.valid = True
        column: Slot | None = None
        seen: dict[str, Slot] = {}
        for i, token in enumerate(self.tokens):
            m = SLOT.fullmatch(token)
            if not m:
                continue
            if m[1]:
                column = seen.setdefault(token, Slot(token, "column", m[2]))
                self.slots.append(column)
            elif m[4] == "LIMIT_VALUE":
                self.slots.append(Slot(token, "literal", literal="1"))
            elif column is None:
                self.valid = False
            elif column.type == m[4] or column.type == f"GROUPED_{m[4]}":
                self.slots.append(Slot(token, "value", m[4], of=column.token))
            elif m[4] == "NUMBER" and i >= 2 and self.tokens[i - 2] == ")":
                self.slots.append(Slot(token, "literal", literal="2"))
            else:
                self.valid = False
        self.columns = [s for i, s in enumerate(self.slots) if s.kind == "column" and s not in self.slots[:i]]


def seeded(seed: int, *of: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def sample_columns(cells: DataFrame, kind: str, k: int, seed: int = 0, used: DataFrame | None = None) -> DataFrame:
    """``table_id, nth, column_index, header``: ``k`` columns of a type picked
    without replacement, none for tables with fewer; ``used`` (``table_id,
    column_index``) are left out."""
    typed = column_types(cells)
    fit = typed.filter("is_grouped" if kind == "GROUPED_TEXT" else F.col("column_type") == kind)
    if used is not None:
        fit = fit.join(used, ["table_id", "column_index"], "left_anti")
    order = Window.partitionBy("table_id").orderBy(seeded(seed, "table_id", "column_index"), "column_index")
    picked = fit.withColumn("nth", F.row_number().over(order) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("table_id")))
    return picked.filter((F.col("m") >= k) & (F.col("nth") < k)).select("table_id", "nth", "column_index", "header")


def sample_value(cells: DataFrame, columns: DataFrame, seed: int = 0) -> DataFrame:
    """``table_id, column_index, value``: one body cell of each given column,
    uniform over rows."""
    key = F.struct(seeded(seed, "table_id", "column_index", "row_index"), "row_index")
    return cells.join(columns.select("table_id", "column_index"), ["table_id", "column_index"]).groupBy("table_id", "column_index").agg(F.min_by("text", key).alias("value"))


def populate(cells: DataFrame, template: Template, seed: int = 0) -> DataFrame:
    """``table_id, sql`` and, for each column slot i, ``c<i>`` (its index) and
    ``v<i>`` (the value picked from it)."""
    if not template.valid:
        return cells.select("table_id", F.lit(None).cast("string").alias("sql")).filter("false")
    by_type: dict[str, list[int]] = {}
    for i, s in enumerate(template.columns):
        by_type.setdefault(s.type, []).append(i)
    out = cells.select("table_id").distinct()
    for n, (kind, places) in enumerate(by_type.items()):
        picked = sample_columns(cells, kind, len(places), seed + n)
        valued = picked.join(sample_value(cells, picked, seed), ["table_id", "column_index"])
        slots = [x for nth, i in enumerate(places) for x in (F.max(F.when(F.col("nth") == nth, F.col("column_index"))).alias(f"c{i}"), F.max(F.when(F.col("nth") == nth, F.col("header"))).alias(f"h{i}"), F.max(F.when(F.col("nth") == nth, F.col("value"))).alias(f"v{i}"))]
        out = out.join(valued.groupBy("table_id").agg(*slots), "table_id")
    where = {s.token: i for i, s in enumerate(template.columns)}
    slots = iter(template.slots)
    parts = []
    for token in template.tokens:
        if not SLOT.fullmatch(token):
            parts.append(F.lit(token))
            continue
        s = next(slots)
        if s.kind == "column":
            parts.append(column_name(F.col(f"h{where[s.token]}")))
        elif s.kind == "literal":
            parts.append(F.lit(s.literal))
        else:
            v = F.col(f"v{where[s.of]}")
            parts.append(F.to_json(F.struct(v.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("x")))) - 6) if s.type == "TEXT" else to_float(v).cast("string"))
    return out.withColumn("sql", F.concat_ws(" ", *parts)).drop(*(f"h{i}" for i in range(len(template.columns))))


def linearized_answer(items: Column) -> Column:
    """Items joined by `` | ``; null where blank, ``0``, ``None`` or longer
    than 200 words."""
    said = F.array_join(items, " | ")
    return F.when((F.trim(said) != "") & ~said.isin("0", "None") & (F.size(F.split(F.trim(said), r"\s+")) <= 200), said)


def select_where(cells: DataFrame, picks: DataFrame, out: str, on: str, comparator: str = "=") -> DataFrame:
    """Executes ``SELECT out FROM W WHERE on <comparator> value`` for every
    table: ``picks`` has ``table_id`` and the slots' columns ``out``, ``on``
    and the value's, ``v`` with the slot's number."""
    value = "v" + on[1:]
    known = picks.select("table_id", F.col(out).alias("o"), F.col(on).alias("w"), F.col(value).alias("v"))
    joined = cells.join(known, "table_id")
    rows = joined.groupBy("table_id", "row_index").agg(F.max(F.when(F.col("column_index") == F.col("o"), F.col("text"))).alias("out"), F.max(F.when(F.col("column_index") == F.col("w"), F.col("text"))).alias("on"), F.first("v").alias("v"))
    a, b = to_float(F.col("on")), to_float(F.col("v"))
    test = {"=": F.col("on") == F.col("v"), ">": a > b, "<": a < b}[comparator]
    kept = rows.filter(test).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "out"))).alias("r"))
    return kept.select("table_id", linearized_answer(F.col("r.out")).alias("answer"))


def scalar_difference(rows: DataFrame, column: str, key: str, first: Column, second: Column) -> DataFrame:
    """``(SELECT column WHERE key = first) - (SELECT …  = second)`` for every
    table; of several rows the first counts."""
    f, k = to_float(F.col(column)), F.col(key)
    return rows.groupBy("table_id").agg((F.min_by(F.when(k == first, f), F.when(k == first, F.col("row_index"))) - F.min_by(F.when(k == second, f), F.when(k == second, F.col("row_index")))).alias("value"))


def ordered_first(rows: DataFrame, out: str, by: str, descending: bool = False) -> DataFrame:
    """``SELECT out ORDER BY by LIMIT 1`` for every table."""
    f = to_float(F.col(by))
    key = F.when(f.isNotNull(), F.struct((-f if descending else f).alias("f"), F.col("row_index")))
    return rows.groupBy("table_id").agg(F.min_by(out, key).alias("value"))


def having_count(rows: DataFrame, by: str, more_than: int = 2) -> DataFrame:
    """``SELECT by GROUP BY by HAVING COUNT ( by ) > n`` for every table."""
    groups = rows.groupBy("table_id", by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)
    return groups.groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_list(by)), " | ").alias("answer"))


def said(rows: Iterator[tuple]) -> str | None:
    """``linearized_answer`` of a cursor's rows, read no further than needed."""
    items, words = [], 0
    try:
        for row in rows:
            for x in map(str, row):
                items.append(x)
                words += len(x.split()) + (len(items) > 1)
            if words > 200:
                return None
    except sqlite3.Error as e:
        unless_full(e)
    answer = " | ".join(items)
    return answer if answer.strip() and answer not in ("0", "None") else None


def unless_full(e: sqlite3.Error) -> None:
    """SQL that fails has no answer; a full or broken disk is no such failure."""
    if getattr(e, "sqlite_errorname", "").startswith(("SQLITE_FULL", "SQLITE_IOERR", "SQLITE_NOMEM", "SQLITE_CANTOPEN")):
        raise e


def filled(db: sqlite3.Connection, columns: list[tuple[str, str | None]], cells: Iterator[tuple]) -> bool:
    """Whether ``W`` could be made of cells in order; ``ROWID`` counts from 1."""
    if any(kind is None for _, kind in columns):
        return False
    try:
        db.execute(f"CREATE TABLE W ( {', '.join(f'{name} {kind.lower()}' for name, kind in columns)} )")
        db.executemany(f"INSERT INTO W VALUES ({','.join('?' * len(columns))})", ([c[5] for c in row] for _, row in groupby(cells, itemgetter(2))))
    except sqlite3.Error as e:
        unless_full(e)
        return False
    return True


def executed(asked: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """``table_id, template, sql, exec``: of each table's SQL (``asked``:
    ``table_id, template, sql, nth``, tried by ``nth``) the first ``most`` that
    have an answer which ``linearized_answer`` keeps, with that answer.

    SQLite runs it, as templates may hold whatever it accepts; SQL or tables
    that it refuses have no answer.  Tables come sorted, and each is streamed
    into a temporary database that spills to disk, so no table is held in
    memory."""
    none = F.lit(0).cast("bigint")
    kinds = column_types(cells).select("table_id", F.lit(1).alias("kind"), none.alias("a"), F.col("column_index").alias("b"), column_name(F.col("header")).alias("name"), F.col("column_type").alias("text"))
    sql = asked.select("table_id", F.lit(0).alias("kind"), F.col("nth").alias("a"), F.lit(0).alias("b"), F.col("template").alias("name"), F.col("sql").alias("text"))
    body = cells.select("table_id", F.lit(2).alias("kind"), F.col("row_index").cast("bigint").alias("a"), F.col("column_index").alias("b"), F.lit(None).cast("string").alias("name"), "text")
    schema = StructType([cells.schema["table_id"], *(StructField(c, StringType()) for c in ("template", "sql", "exec"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        for table, of in groupby(rows, itemgetter(0)):
            tried: list[tuple[str, str]] = []
            columns: list[tuple[str, str | None]] = []
            kept = []
            for kind, part in groupby(of, itemgetter(1)):
                if kind == 0:
                    tried = [(r[4], r[5]) for r in part]
                elif tried and kind == 1:
                    columns = [(r[4], r[5]) for r in part]
                elif tried:
                    with closing(sqlite3.connect("")) as db:
                        if not filled(db, columns, part):
                            continue
                        for template, text in tried:
                            try:
                                answer = said(db.execute(text))
                            except (sqlite3.Error, sqlite3.Warning) as e:
                                unless_full(e)
                                continue
                            if answer is not None:
                                kept.append((table, template, text, answer))
                            if len(kept) >= most:
                                break
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept, strict=True)], names=schema.names)

    stream = sql.unionByName(kinds).unionByName(body).repartition("table_id").sortWithinPartitions("table_id", "kind", "a", "b")
    return stream.mapInArrow(run, schema)


def populate_all(cells: DataFrame, templates: list[str], seed: int = 0, config: TableConfig = TableConfig()) -> DataFrame:
    """``table_id, template, sql, exec``: in seeded order, up to
    ``sql_populate_size`` templates a table whose SQL has an answer, and it."""
    made = None
    for i, t in enumerate(templates):
        one = populate(cells, Template(t), seed + 7 * i).select("table_id", F.lit(t).alias("template"), "sql")
        made = one if made is None else made.unionByName(one)
    return executed(made.withColumn("nth", seeded(seed, "table_id", "template")), cells, config.sql_populate_size)
