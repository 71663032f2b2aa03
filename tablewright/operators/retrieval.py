"""BM25 retrieval and training pairs.

A document's row keeps the queries' words alone, as numbers.  These short rows
are shuffled once, by ``doc_id``; frequencies and scores are counted where they
lie, and a task gives its best documents of each query, so pairs of queries and
documents are never shuffled.  The queries are held whole by each task, the
documents never are."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from ..functions.text import linearize_grid
from ..session import spread

K1, B = 0.9, 0.4

#: What parts words, as in the query's SQL; bytes of text that are
#: cut at once; cells of documents and queries that are scored at once.
BETWEEN_WORDS = r"[^\pL\pM\pN_]+"
CUT_BYTES, CELLS = 4 << 20, 1 << 20


def words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word and the number of its text."""
    cut = pc.split_pattern_regex(pc.utf8_lower(text), BETWEEN_WORDS)
    found = cut.flatten()
    full = pc.not_equal(found, "")
    return pc.list_parent_indices(cut).filter(full).to_numpy().astype(np.int64), found.filter(full)


def query_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, found = words(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(owner)), found], names=["query_id", "word"])


def with_first(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """``df`` with column ``name`` of the single row of ``row`` in the first
    row of each task, null in the others: a task needs it once."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return df.crossJoin(F.broadcast(row.select(F.col(name).alias("__first")))).select(*df.columns, F.when(first, F.col("__first")).alias(name))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``CUT_BYTES`` of text, or one row."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64) // CUT_BYTES
    at = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for start, end in zip(at, at[1:]):
        yield batch.slice(start, end - start)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its number of words (null without text), and the places of
    the queries' words in their sorted list with their frequencies."""
    known = None
    for batch in batches:
        if known is None:
            known = batch.column("known")[0].values
        for piece in slices(batch):
            owner, found = words(piece.column("text"))
            length = pa.array(np.bincount(owner, minlength=piece.num_rows), mask=piece.column("text").is_null().to_numpy(zero_copy_only=False))
            place = pc.index_in(found, value_set=known)
            held = place.is_valid().to_numpy(zero_copy_only=False)
            both, tf = np.unique(owner[held] * len(known) + place.drop_null().to_numpy(), return_counts=True)
            owner, term = np.divmod(both, max(1, len(known)))
            ends = pa.array(np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), length, *lists], names=["doc_id", "len", "terms", "tfs"])


def merged(rows: pa.Table) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, and of each posting its id's place, length,
    term and frequency.  Rows that share id and length are one document."""
    rank = pc.rank(rows.column("doc_id"), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) - 1
    _, one = np.unique(rank, return_index=True)
    terms = rows.column("terms").combine_chunks()
    owner = pc.list_parent_indices(terms).to_numpy().astype(np.int64)
    term, tf = terms.flatten().to_numpy().astype(np.int64), rows.column("tfs").combine_chunks().flatten().to_numpy()
    length = pc.fill_null(rows.column("len"), 0).to_numpy()
    most, kinds = length.max(initial=0) + 1, term.max(initial=0) + 1
    document, of = np.unique(rank * most + length, return_inverse=True)
    both, of = np.unique(of[owner] * kinds + term, return_inverse=True)
    owner, term = np.divmod(both, kinds)
    rank, length = np.divmod(document[owner], most)
    return rows.column("doc_id").take(pa.array(one)), rank, length, term, np.bincount(of, weights=tf, minlength=len(both))


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some) if some else None


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies by term; rows, texts and words as terms -1 to -3."""
    rows = gathered(batches)
    if rows is not None:
        df = np.bincount(merged(rows)[3])
        term, length = np.flatnonzero(df), rows.column("len")
        total = [len(length), len(length) - length.null_count, pc.sum(length).as_py() or 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2, -3], term]).astype(np.int32)), pa.array(np.concatenate([total, df[term]]).astype(np.int64))], names=["term", "n"])


def best(query: np.ndarray, key: np.ndarray, document: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each query by falling key, then document."""
    order = np.lexsort((document, -key, query))
    start = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - start < k]


def scores(k: int, k1: float, b: float):
    """The best documents of each query among a task's, by blocks of documents.
    ``key`` is the score in millionths, as the order has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        model = rows.column("model")[0]
        known, asked, held = model["known"].values, model["asked"].values, model["counts"].values
        count = dict(zip(held.field("term").to_pylist(), held.field("n").to_pylist(), strict=True))
        n, average = count[-1], count[-3] / max(1, count[-2])
        df = np.array([count.get(t, 0) for t in range(len(known))], float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        ids, owner, length, term, tf = merged(rows)
        gain = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)) if len(term) else tf

        # the queries of each term, one after the other
        said, queries = asked.field("words"), len(asked)
        place = pc.index_in(said.flatten(), value_set=known).to_numpy().astype(np.int64)
        both, times = np.unique(place * queries + pc.list_parent_indices(said).to_numpy(), return_counts=True)
        of, query = np.divmod(both, max(1, queries))
        start = np.searchsorted(of, np.arange(len(known) + 1))
        many = np.diff(start)[term]

        kept = tuple(np.empty(0, t) for t in (np.int64, float, np.int64, float))
        ends, done = np.searchsorted(owner, np.arange(len(ids) + 1)), np.concatenate([[0], np.cumsum(many)])
        sums, low = done[ends], 0
        while low < len(ids) and queries:
            high = int(np.searchsorted(sums, sums[low] + CELLS, "right")) - 1
            high = max(low + 1, min(high, low + CELLS // queries, len(ids)))
            p = slice(ends[low], ends[high])
            at = np.repeat(start[term[p]] - (done[p] - done[p.start]), many[p]) + np.arange(done[p.stop] - done[p.start])
            cell = query[at] * (high - low) + np.repeat(owner[p] - low, many[p])
            score = np.bincount(cell, weights=np.repeat(gain[p], many[p]) * times[at], minlength=queries * (high - low)).reshape(queries, high - low)
            key = np.where(score > 0, np.floor(score * 1e6 + 0.5), -1)
            bar = np.partition(key, high - low - k, axis=1)[:, [high - low - k]] if 0 < k < high - low else 0
            q, d = np.nonzero((key >= bar) & (key >= 0))
            met = [np.concatenate(x) for x in zip(kept, (q, key[q, d], d + low, score[q, d]), strict=True)]
            first = best(*met[:3], k)
            kept = tuple(x[first] for x in met)
            low = high
        q, key, d, score = kept
        yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(q)), ids.take(pa.array(d)).combine_chunks(), pa.array(score), pa.array(key)], names=["query_id", "doc_id", "score", "key"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int = 3, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, score, place`` of the ``k`` best documents.
    ``docs``: ``doc_id, text``; ``queries``: ``query_id, text``; a term that a
    query repeats counts each time.  All of a document's rows meet in one task,
    so repeated ids count as they do in the SQL."""
    doc_id, query_id = docs.schema["doc_id"].dataType, queries.schema["query_id"].dataType
    asked = queries.select("query_id", "text").mapInArrow(query_words, StructType().add("query_id", query_id).add("word", StringType()))
    known = asked.agg(F.sort_array(F.collect_set("word")).alias("known"))
    short = StructType().add("doc_id", doc_id).add("len", LongType()).add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    rows = spread(with_first(docs.select("doc_id", "text"), known, "known").mapInArrow(postings, short), "doc_id")
    held = rows.mapInArrow(counts, StructType().add("term", IntegerType()).add("n", LongType())).groupBy("term").agg(F.sum("n").alias("n"))
    by_query = asked.groupBy("query_id").agg(F.collect_list("word").alias("words"))
    model = known.crossJoin(by_query.agg(F.collect_list(F.struct("query_id", "words")).alias("asked"))).crossJoin(held.agg(F.collect_list(F.struct("term", "n")).alias("counts")))
    hit = StructType().add("query_id", query_id).add("doc_id", doc_id).add("score", DoubleType()).add("key", DoubleType())
    hits = with_first(rows, model.select(F.struct("known", "asked", "counts").alias("model")), "model").mapInArrow(scores(k, k1, b), hit)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("key")


def partial_ratio(a: str, b: str) -> int:
    """Similarity, 0 to 100, of the shorter text and the best part of the
    longer one of its length."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    matcher, best = SequenceMatcher(None, short, long, autojunk=False), 0.0
    for i, j, _ in matcher.get_matching_blocks():
        start = max(0, j - i)
        best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
        if best > 0.995:
            return 100
    return int(round(100 * best))


@F.pandas_udf(IntegerType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def hard_negatives(hits: DataFrame, below: int = 85) -> DataFrame:
    """Hits (``query_id, original, sent``) less similar to the original than
    ``below``."""
    return hits.filter(similarity(F.col("sent"), F.col("original")) < below)


def training_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """``query_id, table, text, label``: negatives 0, the positive 1."""
    no = negatives.select("query_id", "table", F.col("sent").alias("text"), F.lit(0).alias("label"))
    return no.unionByName(positives.select("query_id", "table", "text", F.lit(1).alias("label")))


def facts(grid: Column, highlighted: Column) -> Column:
    """The header and the highlighted rows, said."""
    rows = F.array_sort(F.array_distinct(F.array_union(F.array(F.lit(0)), F.transform(highlighted, lambda h: h[0]))))
    return linearize_grid(F.transform(rows, lambda i: F.get(grid, i)))


def passage_examples(pairs: DataFrame) -> DataFrame:
    """Table as query, its sentence as the positive passage."""
    passage = F.struct(F.lit("").alias("docid"), F.col("page_title").alias("title"), F.col("text").alias("text"))
    none = F.expr("cast(array() as array<struct<docid:string,title:string,text:string>>)")
    return pairs.filter(F.size("grid") >= 2).select(F.col("example_id").alias("query_id"), linearize_grid(F.col("grid")).alias("query"), F.array(passage).alias("positive_passages"), none.alias("negative_passages"))


def encoded(df: DataFrame, encode, column: str = "text", longest: int = 256) -> DataFrame:
    """``ids`` from a given encoder over batches, cut to ``longest``; the
    source column goes."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != column) + ", ids array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield g.drop(columns=column).assign(ids=[list(encode(t))[:longest] for t in g[column]])

    return df.mapInPandas(run, schema.lstrip(", "))
