"""Token counts by section, from one encoding of the whole document.

A document is encoded once.  Tokens' byte spans are the running sums of their
byte lengths, brought to code point offsets; sections are the text's lines,
spans whose ends a column gives, or fields: columns that are joined to one text
and encoded together.  Both sides are sorted and gapless, so the interval join
is a binary search.  A token that crosses a border goes,
by an explicit rule, to the section that holds most of its code points, and of
equal shares to the earlier one.

One narrow stage: no shuffle; memory follows the longest text.

Defined cases: null and empty texts have one empty section with no tokens; a
line's break belongs to the line it ends; given ends are sorted and cut to the
text, nulls among them go, and the text's own end closes the last section, so
a null array is one section; null fields are empty, but keep their place; a
separator belongs to the field before it; empty sections have no tokens; tokens
that are part of one code point count for the section of that code point; long
runs of blanks are encoded like any text; repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import slices, texts
from .packing import library_encoder, token_ids


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, its break included; at least one line."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if len(ends) and ends[-1] == len(points) else np.append(ends, len(points))


def token_ends(data: bytes, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point spans [start, end) of tokens; a token inside one code point
    spans that code point."""
    lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])  # lead bytes before each byte
    ends = np.cumsum(byte_lengths[ids])
    starts = ends - byte_lengths[ids]
    inside = ~np.append(lead, True)[starts] if len(starts) else np.zeros(0, bool)
    return points[starts] - inside, points[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Each token's section: the one with most of its code points, of equal
    ones the earlier.  ``sections``: their ends."""
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, ends, side="left")
    out = np.minimum(first, len(sections) - 1)
    for i in np.flatnonzero(last > first).tolist():
        borders = np.concatenate([[starts[i]], sections[first[i] : last[i]], [ends[i]]])
        out[i] = first[i] + int(np.diff(borders).argmax())
    return out


def given_ends(ends: list[int | None] | None, length: int) -> np.ndarray:
    found = np.sort(np.clip(np.array([e for e in ends or [] if e is not None], dtype=np.int64), 0, length))
    return found if len(found) and found[-1] == length else np.append(found, length)


def section_tokens(docs: DataFrame, vocabulary: str, ends: str | None = None, fields: tuple[str, ...] = (), separator: str = "\n") -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing`` for each section of
    each document (code points, end exclusive); ``n_crossing`` counts those
    of its tokens that also touch other sections.

    Sections are the lines of ``text``; with ``ends`` (the name of a column of
    integer arrays) the spans that end there; with ``fields`` the text is these
    columns joined by ``separator``, and each is a section."""
    if fields and ends:
        raise ValueError("sections are given by ends or by fields")
    if fields:
        each = [F.concat(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(separator if i < len(fields) - 1 else "")) for i, c in enumerate(fields)]
        closed = [sum((F.length(x) for x in each[: i + 1]), F.lit(0)).cast("long") for i in range(len(fields))]
        rows = docs.select("doc_id", F.concat(*each).alias("text"), F.array(*closed).alias("ends"))
    elif ends:
        rows = texts(docs, F.col(f"`{ends}`").cast("array<long>").alias("ends"))
    else:
        rows = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(vocabulary)
        lengths = np.array([len(b) for b in Vocabulary(vocabulary).bytes], dtype=np.int64)
        for batch in slices(batches):
            parts: list[tuple[np.ndarray, ...]] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = token_ids(coder, text).astype(np.int64)
                if fields:
                    sections = np.array(batch.column("ends")[row].as_py(), dtype=np.int64)
                else:
                    sections = given_ends(batch.column("ends")[row].as_py(), len(text)) if ends else line_ends(text)
                first, last = token_ends(text.encode(), ids, lengths)
                owner = attribute(first, last, sections)
                crossing = np.searchsorted(sections, last, side="left") > np.searchsorted(sections, first, side="right")
                n = len(sections)
                parts.append((np.full(n, row), np.arange(n), np.concatenate([[0], sections[:-1]]), sections, np.bincount(owner, minlength=n) if len(ids) else np.zeros(n, np.int64), np.bincount(owner[crossing], minlength=n)))
            row, section, start, end, tokens, across = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), "section": pa.array(section, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "n_crossing": pa.array(across, pa.int64())})

    return rows.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
