"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
from collections.abc import Iterator
from contextlib import suppress
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, taken from
    ``spark.checkpoint.dir``.  Only where that is unset and one machine runs
    all (tests) a temporary folder is made; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tablewright-checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, read from shared storage
    by whatever follows, so that losing an executor costs no recomputation of
    the texts.  Only for rows without texts."""
    ensure_checkpoint_dir(df.sparkSession)
    # A checkpoint keeps the partitioning that its plan promised; where adaptive
    # execution coalesced it, a union that relies on the promise fails.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    if next(SETTLED) % CLEAN_EVERY == 0:
        clean(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark removes the shuffles and checkpoints of tables that nobody refers to
#: when the driver happens to collect its garbage.  Where many small tables
#: follow each other that is made to happen after so many of them.
CLEAN_EVERY = 2
SETTLED = count(1)


def clean(spark: SparkSession) -> None:
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone: other columns, whatever
    their names, never reach an operator."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each slice has at most ``most`` bytes of
    ``column``, or one row.  This bounds a task's memory where texts are long;
    after the last one what the task has freed goes back to the system."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < len(sizes):
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Hands freed memory back to the system: a worker that lives on through
    other stages then doesn't keep what one stage needed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shards_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of a filter of hashes: its size is fixed, whatever it holds.
FILTER_BITS = 1 << 23


def filter_words(keys: DataFrame, key: str) -> DataFrame:
    """A filter of the hashes ``key`` as rows ``word, bits`` of 64 bits, at most
    ``FILTER_BITS / 64`` of them, which bounds its broadcast."""
    slot = F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1))
    return keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def parted(rows: DataFrame, key: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash ``key`` surely isn't in the filter, and the others.
    A narrow stage: what it lets pass needs no shuffle."""
    words = words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    met = rows.join(F.broadcast(words), F.shiftright(F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1)), 6) == F.col("__word"), "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(__bits, cast({key} & 63 as int)) & 1L"), F.lit(0)) == 1
    return met.filter(~hit).drop("__word", "__bits"), met.filter(hit).drop("__word", "__bits")


def as_struct(docs: DataFrame) -> Column:
    """All columns as one, so that their names clash with no other."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))
