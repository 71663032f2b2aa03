"""N-gram Jaccard self-join in metric space: pivots, Voronoi regions, windows
from the triangle inequality, regions joined recursively and exactly.

``1 - J`` is a metric on sets of shingles.  Distances between unrelated
documents are all close to 1, so regions around *documents* alone don't part
them.  Two levels of pivots do:

1. The first level's pivots are the sets of a single shingle, ordered by how
   few documents hold that shingle (unknown and rare ones first, then by
   count).  A document's region is the first of its shingles.  A document that
   is to reach every partner within distance 0.2 is replicated to the regions
   of its first ``n - ceil(0.8 n) + 1`` shingles: a partner shares at least
   ``ceil(0.8 n)`` of its ``n`` shingles, so one of these.
2. Inside a region documents are pivots: the one that holds the most frequent
   shingles (the middle of a group of near copies) and one by hash.  All
   members are compared with the pivots, exactly.  Members within 0.2 of a
   pivot are one component and need no comparison with each other.  What is
   left, pairs of members not known to be one component, must lie in the window
   that the triangle inequality leaves, ``|d(x,p) - d(y,p)| <= 0.2`` for each
   pivot, and in the window of sizes.  Regions with many such members are
   joined again with new pivots; small ones by comparing the pairs left.
   Before sets are compared, their sketches are: parities in 1024 cells, a
   projection that never lengthens the distance |x| + |y| - 2 |x and y|, which
   must be at most a ninth of |x| + |y|.

Cost at scale: counts are made over all documents (shingles whose hash lies in
the lower half of the range, as packed arrays); what tasks get of them is
bounded, ``BITMAP_BITS`` bits telling which shingles may occur twice and the
``MOST_FREQUENT`` shingles of the highest counts.  Both only order and prune:
without them results are the same.  Hot regions are aggregated before they
are shuffled, equal sets count once, and no stage emits all pairs of a group.
Sets are rebuilt only for documents that share a region.

Shingles and sets are known by 64-bit hashes.

Defined cases: null, empty and blank texts have no shingles, link with nothing
and are their own component; texts of fewer words than a shingle are one
shingle; equal sets link; repeated rows are in one component; null ``doc_id``
takes part but doesn't name a component unless it is alone; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, shards_for, slices, texts

WORDS = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 80
BITMAP_BITS = 25
MOST_FREQUENT = 1 << 18
FREQUENT_FROM = 4
BUCKET_ROWS = 8192
#: Longs of a set's sketch: the parity of its shingles in each of 64 times as
#: many cells.  Sketches differ in no more bits than sets in elements.
SKETCH = 16
SMALL_REGION = 32
MOST_ROUNDS = 1
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
HALF = np.uint64(1 << 63)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.  ``bytes`` lower and
    split just as the contract says: A-Z, and blanks 9-13 and 32."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    g = h[:n].copy()
    for k in range(1, words):
        g = g * FACTORS[(k - 1) % 4] + h[k : k + n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    g.sort()
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def sketch(g: np.ndarray) -> np.ndarray:
    cells = np.bincount((g & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def close(x: str, y: str) -> str:
    """SQL: sizes and sketches allow a link."""
    differ = " + ".join(f"bit_count({x}.k{i} ^ {y}.k{i})" for i in range(SKETCH))
    return f"100 * least({x}.n, {y}.n) >= {PERCENT} * greatest({x}.n, {y}.n) AND {100 + PERCENT} * ({differ}) <= {100 - PERCENT} * ({x}.n + {y}.n)"


def set_id(g: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63)


class Counts:
    """What tasks know of the counts: a bitmap over the lower half of the hash
    range, and the most frequent shingles with the logarithm of their count."""

    def __init__(self, bits: np.ndarray, keys: np.ndarray, levels: np.ndarray):
        self.bits, self.keys, self.levels = bits, keys, levels

    def level(self, g: np.ndarray, single: np.ndarray) -> np.ndarray:
        """0 for shingles of one document, 1 for rare and 2 for unknown ones,
        then by count."""
        out = np.where(g >= HALF, np.uint8(2), np.where(single, np.uint8(0), np.uint8(1)))
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = self.keys[i] == g
            out[hit] = self.levels[i[hit]] + np.uint8(1)
        return out

    def single(self, g: np.ndarray) -> np.ndarray:
        """Whether a shingle surely occurs in one document alone."""
        at = np.minimum(g, HALF - np.uint64(1)) >> np.uint64(63 - BITMAP_BITS)
        bit = self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        return (bit == 0) & (g < HALF)


def count_shingles(docs: DataFrame, rows: int, words: int) -> Counts:
    """Counts over all documents.  Keys travel packed, six bytes each, by
    bucket of the hash range; a bucket holds about ``BUCKET_ROWS`` documents'
    share and gives its slice of the bitmap."""
    power = min(BITMAP_BITS - 3, max(6, (shards_for(rows, BUCKET_ROWS) - 1).bit_length()))
    buckets, shift = 1 << power, np.uint64(63 - power)
    most = max(1, MOST_FREQUENT >> power)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            g = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            g = np.sort(g[g < HALF])
            cuts = np.searchsorted(g, np.arange(buckets, dtype=np.uint64) << shift).tolist() + [len(g)]
            # 48 bits below the bucket's own are kept.
            low = (g << np.uint64(power + 1)) >> np.uint64(16)
            packed = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "keys": pa.array([packed[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())})

    def count(g: pd.DataFrame) -> pd.DataFrame:
        bucket = int(g["bucket"].iloc[0])
        raw = np.frombuffer(b"".join(g["keys"]), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        keys, n = np.unique(wide.view("<u8")[:, 0], return_counts=True)
        twice = keys[n > 1] >> np.uint64(48 - (BITMAP_BITS - power))
        slot = np.zeros(1 << (BITMAP_BITS - power), np.uint8)
        slot[twice.astype(np.int64)] = 1
        often = np.flatnonzero(n >= FREQUENT_FROM)
        often = often[np.argsort(-n[often], kind="stable")[:most]]
        return pd.DataFrame({"bucket": [bucket], "bits": [np.packbits(slot, bitorder="little").tobytes()], "keys": [keys[often].tobytes()], "levels": [np.minimum(np.log2(n[often]), 60).astype(np.uint8).tobytes()]})

    packed = texts(docs).select("text").mapInArrow(emit, "bucket int, keys binary")
    found = packed.groupBy("bucket").applyInPandas(count, "bucket int, bits binary, keys binary, levels binary").collect()
    size = (1 << (BITMAP_BITS - power)) // 8
    bits = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    frequent, levels = [], []
    for r in found:
        bits[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        frequent.append(np.frombuffer(r["keys"], "<u8") | np.uint64(r["bucket"]) << np.uint64(48))
        levels.append(np.frombuffer(r["levels"], np.uint8))
    if not frequent:
        return Counts(bits, np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    keys, level = np.concatenate(frequent), np.concatenate(levels)
    order = np.argsort(keys)
    return Counts(bits, keys[order], level[order])


class Prefixes:
    """A document's regions."""

    def __init__(self, counts: Counts, power: int):
        self.counts, self.power = counts, power

    def of(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        """The regions' shingles and the mean level of all shingles."""
        kept = self.kept(g)
        single = self.counts.single(g)
        level = self.counts.level(np.where(g < HALF, kept, g), single)
        n = len(g)
        first = n - (PERCENT * n + 99) // 100 + 1
        order = np.lexsort((g, level))[:first]
        return g[order][~single[order]], float(level.mean())

    def kept(self, g: np.ndarray) -> np.ndarray:
        """Lower-half hashes as ``Counts`` knows them: bucket, then 48 bits."""
        bucket = g >> np.uint64(63 - self.power)
        return bucket << np.uint64(48) | (g << np.uint64(self.power + 1)) >> np.uint64(16)


def signed(g: np.ndarray) -> np.ndarray:
    return g.view(np.int64)


def document_regions(docs: DataFrame, counted: Broadcast, rows: int, words: int) -> DataFrame:
    """``doc_id, sid, n, level, regions`` for each document; ``sid`` null for
    documents without shingles."""
    power = min(BITMAP_BITS - 3, max(6, (shards_for(rows, BUCKET_ROWS) - 1).bit_length()))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(counted.value, power)
        for batch in slices(batches):
            ids, sizes, levels, regions = [], [], [], []
            for text in batch.column("text").to_pylist():
                g = shingles(text, words)
                if len(g):
                    keys, level = prefixes.of(g)
                else:
                    keys, level = g, 0.0
                ids.append(set_id(g) if len(g) else None)
                sizes.append(len(g))
                levels.append(level)
                regions.append(signed(keys))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "sid": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "level": pa.array(levels, pa.float64()), "regions": pa.array(regions, pa.list_(pa.int64()))})

    return texts(docs).mapInArrow(run, "doc_id long, sid long, n long, level double, regions array<long>")


def sets_of(docs: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """``sid, items, n`` and the sketch ``k0 ..`` for the sets named in
    ``known`` (``sid, doc_id``: one document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"sid": pa.array([set_id(g) if len(g) else None for g in sets], pa.int64()), "items": pa.array([signed(g) for g in sets], pa.list_(pa.int64())), "n": pa.array([len(g) for g in sets], pa.int64())} | dict(zip(bits, map(pa.array, np.stack([sketch(g) for g in sets]).T), strict=True)))

    bits = [f"k{i}" for i in range(SKETCH)]
    wanted = known.select(F.col("doc_id").alias("__doc")).distinct()
    rows = texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi").select("text")
    return rows.mapInArrow(run, "sid long, items array<long>, n long, " + ", ".join(f"{b} long" for b in bits)).filter("sid IS NOT NULL").join(known.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, distance, linked`` of pairs of sets, exactly; without the pairs
    whose sizes or sketches exclude a link."""
    marks = sets.drop("items")
    pairs = pairs.join(marks.alias("s"), F.col("a") == F.col("s.sid")).join(marks.alias("t"), F.col("b") == F.col("t.sid")).filter(close("s", "t")).select("a", "b")
    x, y = sets.select(F.col("sid").alias("a"), F.col("items").alias("x")), sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("total"))
    union = F.col("total") - F.col("both")
    return met.select("a", "b", (1 - F.col("both") / union).alias("distance"), (100 * F.col("both").cast("long") >= PERCENT * union.cast("long")).alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b``): the smallest node
    reachable.  Rounds of two steps that hang a node's larger and smaller
    neighbours on the smallest; no node's neighbours are collected."""
    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = settled(small)
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def region_links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``a, b``) that connect what is connected.  ``cells``: region
    ``key, sid, n, level``, each set once a region."""
    tested = None
    links = None
    left = cells
    for turn in range(MOST_ROUNDS + 1):
        pivots = left.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max_by("sid", "level").alias("p1"), F.min("sid").alias("p2")).filter("m > 1")
        regions = settled(left.join(pivots, "key"))
        stars = regions.select(F.col("sid").alias("a"), F.explode(F.array("p1", "p2")).alias("b"), "n").filter("a <> b").groupBy("a", "b").agg(F.first("n").alias("n"))
        if tested is not None:
            stars = stars.join(tested, ["a", "b"], "left_anti")
        known = settled(compared(stars.select("a", "b"), sets))
        tested = known if tested is None else tested.unionByName(known)
        linked = known.filter("linked").select("a", "b")
        links = linked if links is None else links.unionByName(linked)
        open_ = regions
        for x, y, name in (("sid", "p1", "1"), ("sid", "p2", "2"), ("p1", "p2", "12")):
            found = tested.select(F.col("a").alias(x), F.col("b").alias(y), F.col("distance").alias(f"d{name}"), F.col("linked").alias(f"l{name}"))
            open_ = open_.join(found, [x, y], "left")
        # Members in one ball are one component; so are two balls whose pivots link.
        ball = F.when(F.col("l1"), F.col("p1")).when(F.col("l2") & F.coalesce("l12", F.lit(False)), F.col("p1")).when(F.col("l2"), F.col("p2")).otherwise(F.col("sid"))
        open_ = open_.filter("sid <> p1 AND sid <> p2").select("key", "sid", "n", "level", "d1", "d2", ball.alias("root"))
        several = open_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key", "m")
        open_ = settled(open_.join(several, "key"))
        last = turn == MOST_ROUNDS
        small = open_ if last else open_.filter(F.col("m") <= SMALL_REGION)
        small = small.select("key", "sid", "root", "d1", "d2").join(sets.drop("items"), "sid")
        # Sizes within the bound are of one scale or of neighbouring ones.
        small = small.withColumn("own", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))))
        x, y = small.withColumn("scale", F.explode(F.array(F.col("own"), F.col("own") + 1))).alias("x"), small.alias("y")
        window = " AND ".join(f"coalesce(abs(x.d{p} - y.d{p}) <= {1 - PERCENT / 100 + 1e-9}, true)" for p in ("1", "2"))
        pairs = x.join(y, F.expr(f"x.key = y.key AND x.scale = y.own AND (x.own < y.own OR x.sid < y.sid) AND x.root <> y.root AND {close('x', 'y')} AND {window}")).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
        links = links.unionByName(compared(pairs, sets).filter("linked").select("a", "b"))
        left = open_.filter(F.col("m") > SMALL_REGION).select("key", "sid", "n", "level")
        if last or left.isEmpty():
            return links
        links = settled(links)
    raise AssertionError("unreachable")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document."""
    rows = docs.count()
    counted = docs.sparkSession.sparkContext.broadcast(count_shingles(docs, rows, words))
    found = settled(document_regions(docs, counted, rows, words))
    counted.destroy()  # what follows reads the settled rows
    cells = found.filter("sid IS NOT NULL").select("sid", "n", "level", F.explode("regions").alias("key")).groupBy("key", "sid").agg(F.max("n").alias("n"), F.max("level").alias("level"))
    met = cells.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    cells = settled(cells.join(met, "key", "left_semi"))
    active = cells.select("sid").distinct()
    known = settled(found.join(active, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))
    sets = settled(sets_of(docs, known, words))
    labels = components(region_links(cells, sets))
    # Equal sets are one node; a component's name is its smallest document.
    rooted = found.join(labels, found["sid"] == labels["node"], "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    names = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(names, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that name their component, with their columns."""
    kept = near_duplicates(docs, words).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
