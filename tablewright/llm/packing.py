"""Best-fit packing by sums of squares.

Each document goes where the sum, over all residual gaps, of the squared
number of open sequences with that gap becomes smallest.  Placing size ``s``
into gap ``g`` changes that sum by ``2 (N[g-s] - N[g]) + 2``, an exact fit by
``1 - 2 N[s]`` and a new sequence by ``2 N[B-s] + 1``: only the counts by gap
are needed, never the sequences themselves.

Plan: tokenise where the text lies and keep the pieces' sizes only, settle
those few bytes a piece, deal them by hash into shards of about
``SHARD_PIECES`` (their number follows the table's size, so a shard is bounded
at any scale), pack each shard, then pack the sequences that stayed open in
groups of ``MERGED_SHARDS`` shards as if they were items.  Texts and tokens are
never shuffled.

Defined cases: null and empty texts are one piece of one token (the separator);
documents longer than a sequence are cut into whole sequences with the shorter
piece first; texts of any length are encoded whole, long runs of blanks
included; equal rows are packed each; a null ``doc_id`` stays null and changes
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import settled, shards_for, slices, texts

SHARD_PIECES = 1 << 16
MERGED_SHARDS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def library_encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file's own merges in a compiled encoder.  ``Vocabulary``
    has checked that ids rank merges, which is what that encoder goes by."""
    v = Vocabulary(path)
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)


#: Runs of blanks from this length on are encoded on their own, as the compiled
#: encoder's pattern backtracks over them.  Where they begin and end, words do too.
LONG_BLANKS = regex.compile(r"\p{White_Space}{10000,}")


def token_ids(coder: tiktoken.Encoding, text: str) -> np.ndarray:
    """The text's ids.  A run's last blank belongs to the word after it, if
    there is one before the text or a special token ends the run."""
    parts, at = [], 0
    for m in LONG_BLANKS.finditer(text):
        last = m.end() == len(text) or any(text.startswith(x, m.end()) for x in coder.special_tokens_set)
        end = m.end() if last else m.end() - 1
        parts += [coder.encode_to_numpy(text[at : m.start()], allowed_special="all"), np.array(coder._encode_single_piece(text[m.start() : end]), np.uint32)]
        at = end
    parts.append(coder.encode_to_numpy(text[at:] if at else text, allowed_special="all"))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    n = -(-total // size)
    first = total - (n - 1) * size
    return [(0, first)] + [(first + i * size, size) for i in range(n - 1)]


def tokenised_pieces(docs: DataFrame, vocabulary: str, size: int, separator: int, keep_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(vocabulary)
        for batch in slices(batches):
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(token_ids(coder, text).astype("<u4"), np.array([separator], "<u4"))
                for i, (start, n) in enumerate(cut(len(ids), size)):
                    part = ids[start : start + n]
                    rows.append((doc, i, start, n, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        kept.append(part.astype("<i4"))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and its offset there; and each bin's fill.

    Items are placed from the largest down, equal sizes in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    never = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        gap, best = capacity, (2 * int(count[capacity - s]) + 1 if s < capacity else 0)
        if s < capacity:
            here = count[s:capacity]
            change = 2 * (count[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = never
            k = int(change.argmin())
            if change[k] <= best and here[k]:
                gap = s + k
        if gap == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if (left := gap - s) > 0:
            count[left] += 1
            stacks[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset`` (gapless
    from 0 within a sequence), and ``ids`` where kept."""
    pieces = tokenised_pieces(docs, vocabulary, size, separator, keep_ids)
    pieces = settled(pieces)
    shards = shards_for(pieces.count(), SHARD_PIECES)
    columns = [*pieces.columns]
    schema = PIECES + ", ids array<int>" * keep_ids + ", shard long, bin long, bin_offset long, fill long"

    def first(g: pa.Table) -> pa.Table:
        g = g.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, fill = sum_of_squares(g.column("length").to_numpy(), size)
        for name, values in (("bin", bins), ("bin_offset", offsets), ("fill", fill[bins])):
            g = g.append_column(name, pa.array(values, pa.int64()))
        return g

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards).cast("long")))
    placed = settled(dealt.groupBy("shard").applyInArrow(first, schema))

    def second(g: pa.Table) -> pa.Table:
        g = g.sort_by([("fill", "descending"), ("shard", "ascending"), ("bin", "ascending")])
        bins, offsets, _ = sum_of_squares(g.column("fill").to_numpy(), size)
        lead = np.unique(bins, return_index=True)[1][bins]  # each new sequence's first old one
        moved = {"shard": g.column("shard"), "bin": g.column("bin"), "to_shard": g.column("shard").take(pa.array(lead)), "to_bin": g.column("bin").take(pa.array(lead)), "moved": pa.array(offsets, pa.int64())}
        return pa.table(moved)

    open_bins = placed.filter(F.col("fill") < size).groupBy("shard", "bin").agg(F.max("fill").alias("fill"))
    merged = open_bins.withColumn("merge", F.floor(F.col("shard") / MERGED_SHARDS)).groupBy("merge").applyInArrow(second, "shard long, bin long, to_shard long, to_bin long, moved long")
    to = F.coalesce("to_shard", "shard") * F.lit(1 << 32) + F.coalesce("to_bin", "bin")
    return placed.join(merged, ["shard", "bin"], "left").select(*columns, to.alias("sequence_id"), (F.col("bin_offset") + F.coalesce("moved", F.lit(0))).alias("offset"))
