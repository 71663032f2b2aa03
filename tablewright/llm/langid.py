"""Language identification by compression.

For each learned language a zstandard raw-content dictionary is made of sample
texts.  A text is compressed, whole, against each dictionary; the language
whose dictionary gives the smallest result is chosen.  Where the margin to the
second is narrow the choice is marked ``rejected`` (the language stays, with a
low score).

Texts and samples are reduced to lower-case words of letters first, so that
layout, digits and capitals don't decide.  One setting of the compressor holds
for all texts, long and short.

Sample: for each language the documents with the smallest hash in each of
``DOCUMENTS`` hash buckets; each gives an equal share of the dictionary, a run
of ``DICTIONARY_BYTES // DOCUMENTS`` bytes of its words at a place that its hash
tells.  The sample's bound is one of rows: DOCUMENTS a language, and at most
``MAX_LANGUAGES`` languages (``ValueError`` beyond).  Shares are cut where the
texts lie, so the driver gets 22 MiB at most; tasks get the dictionaries as a
broadcast.

Defined cases: null texts and texts without a letter give ``und`` with score 0;
ties go to the language with more training documents, then by name; rows
without ``lang`` or ``doc_id`` teach nothing; rows of one ``doc_id`` and
language count as one document of the sample; if nothing can be learned every
text is ``und``; texts of any length are compressed whole, one at a time;
repeated rows give repeated results; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

DOCUMENTS = 256
DICTIONARY_BYTES = 110 << 10
MAX_LANGUAGES = 200
LEVEL, MIN_MATCH = 9, 4
#: A margin under this share of the smaller size is narrow.
NARROW = 0.01
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def reduced(text: str) -> bytes:
    return " ".join(WORDS.findall(text.lower())).encode()


@dataclass(frozen=True)
class Languages:
    """Dictionaries, in the order that ties go by."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        def make(content: bytes) -> zstandard.ZstdCompressor:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False, write_content_size=False, min_match=MIN_MATCH)
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=words, compression_params=params)

        return [(lang, make(c)) for lang, c in self.dictionaries]


def share(data: bytes, h: int, size: int) -> bytes:
    """At most ``size`` bytes of whole words, from a place that ``h`` tells."""
    if len(data) <= size:
        return data
    at = h % (len(data) - size + 1)
    start = at and data.find(b" ", at - 1) + 1
    return data[start : at + size].rpartition(b" ")[0] if 0 < start < at + size or not at else b""


def held_in(docs: DataFrame, test: Column) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & test)


def learn(docs: DataFrame, test: Column) -> Languages:
    """Dictionaries from the rows of ``docs`` for which ``test`` holds."""
    rows = held_in(docs, test).select("lang", "text", F.xxhash64(F.lit("langid"), F.col("doc_id")).alias("h"))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(DOCUMENTS)).alias("bucket")).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).limit(DOCUMENTS * MAX_LANGUAGES + 1).collect()
    if len(picks) > DOCUMENTS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not picks:
        return Languages(())
    size = DICTIONARY_BYTES // DOCUMENTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces = [share(reduced(t), h & (1 << 63) - 1, size) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "piece": pa.array(pieces, pa.binary())})

    chosen = docs.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in picks], "lang string, h long")
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).mapInArrow(cut, "lang string, h long, piece binary").groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    sizes: dict[str, int] = {}
    for r in picks:
        sizes[r["lang"]] = sizes.get(r["lang"], 0) + r["n"]
    content: dict[str, list[bytes]] = {k: [] for k in sizes}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        content[r["lang"]].append(bytes(r["piece"]))
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    return Languages(tuple((k, c) for k in order if (c := b" ".join(content[k]).strip())))


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(languages.dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Languages(shared.value).compressors()
        for batch in slices(batches):
            langs, scores, margins, rejected = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = reduced(text)
                if not data or not tools:
                    found = ("und", 0.0, 0.0, True)
                else:
                    sizes = [(len(tool.compress(data)), i, lang) for i, (lang, tool) in enumerate(tools)]
                    sizes.sort()
                    lead = sizes[1][0] - sizes[0][0] if len(sizes) > 1 else sizes[0][0]
                    margin = lead / max(1, sizes[0][0])
                    found = (sizes[0][2], 1 - math.exp(-lead / 4) / 2, margin, margin < NARROW)
                for column, value in zip((langs, scores, margins, rejected), found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "margin": pa.array(margins, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
