"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are the digits, base 256, of a number; its fingerprint is
that number modulo a 128-bit prime.  Chunks are fingerprinted on their own and
combined by length-shifted arithmetic, ``f(ab) = f(a) 256^len(b) + f(b)``, so
chunks of one huge document can be hashed by different tasks
(``combine_chunks``).  Equal fingerprints only propose: each proposed row is
then compared with the row that stays, chunk by chunk, as a stream.

Plan: one narrow stage makes fingerprints (settled: about 100 bytes a row);
one aggregation with map-side combining finds groups of several rows, so a group
with a third of all rows still sends one row a task; groups are settled, so
that the join that hands them to their rows can be split where it is skewed.
Texts of proposed rows alone are compared: a filter of their hashes, of a fixed
size, tells at the scan which rows can be meant, and only those are shuffled.  A
group's rows are dealt over ``ceil(size / SALT_ROWS)`` salts, and one text that
stays is copied to each salt, so no task gets an unbounded group and a task
holds two texts at a time.  Rows that turn out unequal (a collision) form a
group of their own in the next round, until none is left.  A huge document is a
row, so one task reads it; it is hashed chunk by chunk, and documents that are
stored as rows of chunks are hashed by as many tasks (``combine_chunks``).

Defined cases: null text equals empty text; ``normalise`` maps texts before
anything else (nothing by default); ties are impossible between different
``doc_id``; of repeated rows with the same ``doc_id`` exactly one is kept; null
``doc_id`` sorts before all others; other columns are ignored; an empty table
gives an empty result.  Of chunks: null text is empty, repeated equal rows count
once; documents whose chunks aren't numbered 0, 1, ... without a gap, or have
two texts for a number, have null fingerprints; a null ``doc_id`` is one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_struct, filter_words, parted, settled, slices, texts

#: The largest prime under 2^128.
PRIME = (1 << 128) - 159
CHUNK_BYTES = 1 << 16
SALT_ROWS = 200


def fingerprint(data: bytes) -> int:
    return int.from_bytes(data, "big") % PRIME


def combine(head: int, tail: int, tail_bytes: int) -> int:
    """The fingerprint of head's bytes followed by tail's."""
    return (head * pow(256, tail_bytes, PRIME) + tail) % PRIME


def fingerprint_stream(data: bytes, chunk: int = CHUNK_BYTES) -> int:
    view, total = memoryview(data), 0
    for i in range(0, len(view), chunk):
        part = view[i : i + chunk]
        total = combine(total, fingerprint(part), len(part)) if i else fingerprint(part)
    return total


def halves(f: int) -> tuple[int, int]:
    """As two signed 64-bit columns."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(f >> 64), signed(f & (1 << 64) - 1)


def same_bytes(a: bytes, b: bytes, chunk: int = CHUNK_BYTES) -> bool:
    """Chunkwise comparison that stops at the first difference."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + chunk] == y[i : i + chunk] for i in range(0, len(x), chunk))


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, fp_hi, fp_lo, n_bytes, text_sha256`` and the columns ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [x.encode() for x in batch.column("text").to_pylist()]
            hi, lo = zip(*(halves(fingerprint_stream(x)) for x in data), strict=True)
            out = {"doc_id": batch.column("doc_id"), "fp_hi": pa.array(hi, pa.int64()), "fp_lo": pa.array(lo, pa.int64()), "n_bytes": pa.array(map(len, data), pa.int64()), "text_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())}
            yield pa.RecordBatch.from_pydict(out | {c: batch.column(c) for c in more})

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, "doc_id long, fp_hi long, fp_lo long, n_bytes long, text_sha256 string" + "".join(f", {c} {kinds[c]}" for c in more))


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """``doc_id, fp_hi, fp_lo, n_bytes`` of documents stored as rows
    ``doc_id, chunk int, text``: each chunk is hashed where it lies, and a
    document's few hashes meet to be combined in order."""
    hashed = fingerprints(texts(chunks, "chunk"), "chunk").dropDuplicates(["doc_id", "chunk", "fp_hi", "fp_lo", "n_bytes"])

    def run(g: pa.Table) -> pa.Table:
        rows = sorted(zip(*(g.column(c).to_pylist() for c in ("chunk", "fp_hi", "fp_lo", "n_bytes")), strict=True), key=lambda r: (r[0] is None, r))
        found: tuple[int | None, int | None, int | None] = (None, None, None)
        if [r[0] for r in rows] == list(range(len(rows))):
            total = size = 0
            for _, hi, lo, n in rows:
                total = combine(total, (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1, n)
                size += n
            found = (*halves(total), size)
        return pa.table({"doc_id": g.column("doc_id").slice(0, 1)} | {c: pa.array([v], pa.int64()) for c, v in zip(("fp_hi", "fp_lo", "n_bytes"), found, strict=True)})

    return hashed.drop("text_sha256").groupBy("doc_id").applyInArrow(run, "doc_id long, fp_hi long, fp_lo long, n_bytes long")


GROUP = ["round", "fp_hi", "fp_lo", "n_bytes"]


def unequal(docs: DataFrame, proposed: DataFrame) -> DataFrame:
    """``doc_id, mark`` of proposed rows whose text is not that of the row that
    stays.  ``proposed``: ``doc_id, mark, keep_id, keep_mark, group_size`` and
    GROUP, each ``doc_id, mark`` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, b""
        for batch in slices(batches):
            docs_out, marks_out = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "salt", "stays", "doc_id", "mark", "text")), strict=True):
                *key, stays, doc, mark, text = row
                data = text.encode()
                if key != group:
                    if not stays:
                        raise ValueError("a group came without the row that stays")
                    group, held = key, data
                elif not same_bytes(held, data):
                    docs_out.append(doc)
                    marks_out.append(mark)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs_out, pa.int64()), "mark": pa.array(marks_out, pa.int64())})

    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    # Places in the scan deal rows, so that repeated ones spread too.
    meant = parted(docs.withColumn("deal", F.monotonically_increasing_id()), "mark", filter_words(proposed, "mark"))[1]
    rows = meant.alias("t").join(proposed.alias("p"), F.expr("t.doc_id <=> p.doc_id AND t.mark = p.mark")).select("t.doc_id", "t.mark", "t.text", "t.deal", *GROUP, "keep_id", "keep_mark", "group_size")
    heads = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))).dropDuplicates(GROUP)
    copies = heads.select(*GROUP, F.lit(True).alias("stays"), "doc_id", "mark", "text", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = copies.unionByName(rows.select(*GROUP, F.lit(False).alias("stays"), "doc_id", "mark", "text", F.pmod(F.hash("deal"), salts).alias("salt")))
    keys = [*GROUP, "salt"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("stays").desc()).mapInArrow(run, "doc_id long, mark long")


def grouped(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows of ``source`` (``doc_id, text, mark``) with a
    number ``rid`` each, and the groups of several equal texts."""
    # A mark tells rows of one doc_id with different texts apart.
    hashed = settled(fingerprints(source, "mark").withColumns({"round": F.lit(0), "rid": F.monotonically_increasing_id()}))
    top = 0
    while True:
        last = F.max(F.struct("doc_id", "rid", "mark"))
        groups = settled(hashed.groupBy(*GROUP).agg(last.alias("top"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select(*GROUP, F.col("top.doc_id").alias("keep_id"), F.col("top.rid").alias("keep_rid"), F.col("top.mark").alias("keep_mark"), "group_size"))
        proposed = settled(hashed.filter(F.col("round") == top).join(groups, GROUP).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", *GROUP, "keep_id", "keep_mark", "group_size"))
        wrong = settled(unequal(source, proposed))
        if wrong.isEmpty():
            return hashed, groups
        off = wrong.dropDuplicates().withColumn("off", F.lit(1))
        hashed = settled(hashed.alias("h").join(off.alias("o"), F.expr("h.doc_id <=> o.doc_id AND h.mark = o.mark"), "left").select("h.doc_id", "fp_hi", "fp_lo", "n_bytes", "text_sha256", "h.mark", "rid", (F.col("round") + F.coalesce("off", F.lit(0))).alias("round")))
        top += 1


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row
    of ``docs``.  The largest ``doc_id`` of equal texts stays."""
    source = texts(docs)
    if normalise is not None:
        source = source.select("doc_id", normalise(F.col("text")).alias("text"))
    hashed, groups = grouped(source.withColumn("mark", F.xxhash64("text")))
    alone = F.col("group_size").isNull()
    return hashed.join(groups, GROUP, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.when(alone, F.lit(True)).otherwise(F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.  Repeated rows of
    one ``doc_id`` and text are one row.  Only rows of groups are shuffled."""
    hashed, groups = grouped(texts(docs).withColumn("mark", F.xxhash64("text")))
    members = settled(hashed.join(groups, GROUP).select("doc_id", "mark", (F.col("rid") == F.col("keep_rid")).alias("kept")).groupBy("doc_id", "mark").agg(F.max("kept").alias("kept")))
    rows = docs.select(as_struct(docs).alias("row"), "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    sure, maybe = parted(rows, "mark", filter_words(members, "mark"))
    met = maybe.alias("r").join(members.alias("m"), F.expr("r.doc_id <=> m.doc_id AND r.mark = m.mark"), "left")
    alone, stay = met.filter("m.kept IS NULL").select("r.row"), met.filter("m.kept").select("r.row", "r.doc_id", "r.mark").dropDuplicates(["doc_id", "mark"]).select("row")
    return sure.select("row").unionByName(alone).unionByName(stay).select("row.*")
