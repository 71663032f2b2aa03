"""Media columns: ISO base media files, written and walked box by box.

``payload`` bytes are stored as uncompressed 8-bit grey frames, one sample a
frame, in a fragment-free file (``ftyp moov mdat``).  ``walk`` decodes nested
boxes and the sample tables (``stsd mdhd stts stsc stsz stco co64 stss``) into
codec, duration, sample count and the byte range of every keyframe; it never
touches the payload.  Reading the payload back goes by the decoded tables.

One narrow stage, one document at a time: memory follows the longest text.

The digest column ``feature`` tells of the boxes, whose tables follow from the
number of frames, so texts of equal length share it.

Defined cases: null and empty texts give one frame of padding; texts of any
length are stored whole; truncated, foreign or inconsistent files (a table or
box missing or cut off, samples outside the file, keyframes without a sample)
raise ``ValueError``; boxes of unknown type are skipped; several and nested
tracks are all read; 64-bit box sizes and boxes that run to the end of the file
are read; repeated rows give repeated results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

WIDTH, HEIGHT = 24, 24
FRAME = WIDTH * HEIGHT
TIMESCALE, FRAME_TICKS = 25, 1
KEY_EVERY, CHUNK_SAMPLES = 12, 8
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


UNITY = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    size = max(1, -(-len(data) // FRAME)) * FRAME
    return data + b"\xff" * (size - len(data))


def store(payload: bytes) -> bytes:
    """A file with ``payload`` (whole frames) as its samples."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is one or more whole frames")
    n = len(payload) // FRAME
    chunks, last = -(-n // CHUNK_SAMPLES), n % CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES)] if n >= CHUNK_SAMPLES else []
    runs += [(chunks, last)] if last else []
    keys = list(range(1, n + 1, KEY_EVERY))
    ftyp = box(b"ftyp", b"isom", u32(512), b"isomiso2")

    def moov(first: int) -> bytes:
        at = [first + i * CHUNK_SAMPLES * FRAME for i in range(chunks)]
        wide = at[-1] >= 1 << 32
        offsets = full(b"co64", 0, u32(chunks), struct.pack(f">{chunks}Q", *at)) if wide else full(b"stco", 0, u32(chunks), u32(*at))
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", WIDTH, HEIGHT), u32(0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
        stbl = box(b"stbl", full(b"stsd", 0, u32(1), entry), full(b"stts", 0, u32(1, n, FRAME_TICKS)), full(b"stsc", 0, u32(len(runs)), *(u32(a, b, 1) for a, b in runs)), full(b"stsz", 0, u32(FRAME, n)), offsets, full(b"stss", 0, u32(len(keys), *keys)))
        minf = box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, u32(1), full(b"url ", 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, u32(0, 0, TIMESCALE, n * FRAME_TICKS), struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", 0, u32(0), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", 7, u32(0, 0, 1, 0, n * FRAME_TICKS), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), UNITY, u32(WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", 0, u32(0, 0, TIMESCALE, n * FRAME_TICKS, 0x10000), struct.pack(">H", 0x100), bytes(10), UNITY, bytes(24), u32(2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0))  # offsets may turn out wide; then the box is longer
    made = moov(len(ftyp) + size + head)
    if len(made) != size:
        made = moov(len(ftyp) + len(made) + head)
    return ftyp + made + box(b"mdat", payload)


@dataclass(frozen=True)
class Track:
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    n_samples: int
    #: Byte ranges [start, end) of samples and of keyframes, as two-column arrays.
    samples: np.ndarray
    keyframes: np.ndarray


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the bodies of the boxes at one level."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit where it is")
        yield kind, start + head, start + size
        start += size


def walk(data: bytes) -> list[Track]:
    """The tracks of a file, from its sample tables alone."""
    view, tracks, kinds = memoryview(data), [], set()

    def gather(start: int, end: int, found: dict[bytes, tuple[int, int]]) -> None:
        for kind, a, b in boxes(view, start, end):
            if kind == b"trak":
                own: dict[bytes, tuple[int, int]] = {}
                gather(a, b, own)
                tracks.append(track(view, own))
            elif kind in NESTED:
                gather(a, b, found)
            else:
                found[kind] = a, b

    try:
        for kind, a, b in boxes(view):
            kinds.add(kind)
            if kind == b"moov":
                gather(a, b, {})
    except (struct.error, KeyError, IndexError, OverflowError, RecursionError) as e:
        raise ValueError(f"a malformed file: {e!r}") from e
    if b"ftyp" not in kinds or b"moov" not in kinds:
        raise ValueError("no ISO media file")
    return tracks


def track(view: memoryview, at: dict[bytes, tuple[int, int]]) -> Track:
    def table(kind: bytes, skip: int, width: int, big: bool = False) -> np.ndarray:
        a, b = at[kind]
        (n,) = struct.unpack_from(">I", view, a + skip)
        if a + skip + 4 + n * width * (8 if big else 4) > b:
            raise ValueError(f"table {kind!r} is cut off")
        return np.frombuffer(view[a + skip + 4 : b], dtype=">u8" if big else ">u4", count=n * width).astype(np.int64).reshape(n, width)

    a, _ = at[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", view, a + 20) if view[a] == 1 else struct.unpack_from(">II", view, a + 12)
    entry = at[b"stsd"][0] + 8
    codec = bytes(view[entry + 4 : entry + 8]).decode("latin-1")
    width, height = struct.unpack_from(">HH", view, entry + 32)
    fixed, n = struct.unpack_from(">II", view, at[b"stsz"][0] + 4)
    if fixed * n > len(view):
        raise ValueError("more samples than the file holds")
    sizes = np.full(n, fixed, np.int64) if fixed else table(b"stsz", 8, 1)[:, 0]
    starts = table(b"co64", 4, 1, True)[:, 0] if b"co64" in at else table(b"stco", 4, 1)[:, 0]
    runs = table(b"stsc", 4, 3)
    spans = np.diff(np.append(runs[:, 0], len(starts) + 1))
    if n and (runs[0, 0] != 1 or (spans < 0).any() or int((runs[:, 1] * spans).sum()) != n):
        raise ValueError("stsc and stsz disagree")
    chunk = np.repeat(np.arange(len(starts)), np.repeat(runs[:, 1], spans))[:n]
    before = np.cumsum(sizes) - sizes
    lead = np.searchsorted(chunk, chunk)  # each sample's first in its chunk
    first = starts[chunk] + before - before[lead]
    samples = np.stack([first, first + sizes], axis=1)
    keys = table(b"stss", 4, 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
    ticks = table(b"stts", 4, 2)
    if int(ticks[:, 0].sum()) != n:
        raise ValueError("stts and stsz disagree")
    if n and (samples.min() < 0 or samples.max() > len(view)) or len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("samples or keyframes lie outside")
    return Track(codec, width, height, timescale, duration, n, samples, samples[keys])


def read_back(data: bytes, t: Track) -> bytes:
    return b"".join(data[a:b] for a, b in t.samples.tolist())


def describe(t: Track) -> str:
    """Codec, frame size, duration, counts, the first and last keyframe's byte
    range and a checksum over all of them."""
    ranges = t.keyframes.astype("<i8")
    return f"{t.codec.strip()}:{t.width}x{t.height}:{t.duration}/{t.timescale}:{t.n_samples}:{len(ranges)}:{ranges[0][0]}-{ranges[0][1]}:{ranges[-1][0]}-{ranges[-1][1]}:{zlib.crc32(ranges.tobytes()):08x}"


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text stored as a media file, with what its boxes tell; with
    ``keep_media`` the file and the keyframes' byte ranges too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration_s", "n_keyframes", "feature")}
            media, ranges = [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                stored = store(padded(raw))
                (t,) = walk(stored)
                payload = read_back(stored, t)
                row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), t.codec.strip(), t.duration / t.timescale, len(t.keyframes), describe(t))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                if keep_media:
                    media.append(stored)
                    ranges.append([{"start": a, "end": b} for a, b in t.keyframes.tolist()])
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "codec", "feature") else pa.float64() if k == "duration_s" else pa.int64()) for k, v in out.items()}
            if keep_media:
                columns |= {"media": pa.array(media, pa.binary()), "keyframes": pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, n_keyframes long, feature string"
    return texts(docs).mapInArrow(run, schema + ", media binary, keyframes array<struct<start:long,end:long>>" * keep_media)
