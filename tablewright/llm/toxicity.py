"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) chain over a text's words; a word's features are its
core, prefixes and suffix, hashed.  Documents carry labels, words don't, so
training words are labelled first: a word of a toxic document is toxic if one
of its features occurs nearly only in toxic training documents (``PURITY``),
and so often that chance doesn't explain it (``DEVIATIONS`` above the mean).
Words' weights, bias and the potentials between states are fitted to these
labels by gradient ascent on the likelihood of whole documents: observed minus
expected counts of words and of pairs of states.  Forward-backward marginals
then tag every word of every document, and the document's score is a logistic
function of the marginals' sum, maximum and rate, fitted on documents that the
field has not seen.

The model is fitted on a bounded sample: at most ``PER_CLASS`` labelled
documents of each class, those with the smallest hash, whole; the scorer weighs
the classes by their counts over all labelled rows.  The bound is one of rows:
the one task that fits holds their words as 32-bit numbers.  The model is sent
to the tasks as one array of 2^``BITS`` weights.  Scoring is one narrow stage
over whole texts; memory follows ``SLICE_BYTES`` or the longest text.

Defined cases: null and empty texts score as documents without a toxic word;
repeated rows give repeated results; a null ``doc_id`` is scored like any other
and matches no label; several labels of one document count as toxic if one
does, several texts of one labelled ``doc_id`` teach by the smallest; without
labels of both classes everything scores 0; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, texts

PER_CLASS = 1400
BITS = 18
PURITY = 0.93
DEVIATIONS = 5.0
SLICE_BYTES = 2 << 20
ROUNDS = 40
SPAN_FROM = 0.5
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
PREFIXES, SUFFIX = (3, 4, 5, 6), 3


def powers(n: int = 1024, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, np.uint64))


POWERS = powers()


def hashes(strings: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of strings, from their bytes and places."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(strings) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[place & (len(POWERS) - 1)])])
    h = total[ends[1:]] - total[ends[:-1]] + POWERS[seed]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of words, and the words that have them."""
    core = pc.replace_substring_regex(pc.utf8_lower(words), EDGE, "")
    length = pc.utf8_length(core).to_numpy(zero_copy_only=False)
    owners, found = [np.arange(len(words))], [hashes(core, 0)]
    for seed, k, cut in [*((k, k, (0, k)) for k in PREFIXES), (9, SUFFIX, (-SUFFIX, None))]:
        own = np.flatnonzero(length > k)
        owners.append(own)
        found.append(hashes(pc.utf8_slice_codeunits(core.take(pa.array(own)), *cut), seed))
    return np.concatenate(owners), np.concatenate(found)


def words_of(documents: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the documents' words end to end as places among them,
    and the numbers of words."""
    lists = pc.utf8_split_whitespace(documents)
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, owner = words.filter(full).dictionary_encode(), owner.filter(full)
    lengths = np.bincount(owner.to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(documents))
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), lengths


@dataclass(frozen=True)
class Field:
    """Weights of hashed features for the toxic state, the potentials between
    states [from][to], and the document score's coefficients."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    scorer: np.ndarray


def both_ways(odds: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The toxic state's share in each word's forward and backward vector.

    ``odds``: each word's potential for toxic over clean, documents end to end,
    beginning at ``starts``.  A document's first word forgets what came before,
    so all documents are one chain.  It is cut into about sqrt(n) blocks that
    run side by side: first each block's product of transfer matrices, then the
    blocks' border vectors, then the words inside."""
    n = len(odds)
    block = max(1, math.ceil(math.sqrt(n)))
    count = -(-n // block)

    def grid(values: np.ndarray, rest: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([values, np.full(block * count - n, rest)]).reshape(count, block).T)

    first = np.zeros(n, bool)
    first[starts] = True
    a00, a10 = grid(np.where(first, 1.0, moves[0, 0]), 1.0), grid(np.where(first, 1.0, moves[1, 0]), 0.0)
    a01, a11 = grid(np.where(first, 1.0, moves[0, 1]) * odds, 0.0), grid(np.where(first, 1.0, moves[1, 1]) * odds, 1.0)
    p00, p01, p10, p11 = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for t in range(block):
        p00, p01 = p00 * a00[t] + p01 * a10[t], p00 * a01[t] + p01 * a11[t]
        p10, p11 = p10 * a00[t] + p11 * a10[t], p10 * a01[t] + p11 * a11[t]
        total = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
    products = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
    before, after = np.empty(count), np.empty(count)
    share = 0.5
    for k, (w00, w01, w10, w11) in enumerate(products):
        before[k] = share
        one, zero = (1 - share) * w01 + share * w11, (1 - share) * w00 + share * w10
        share = one / (one + zero)
    share = 0.5
    for k in range(count - 1, -1, -1):
        after[k] = share
        w00, w01, w10, w11 = products[k]
        one, zero = w10 * (1 - share) + w11 * share, w00 * (1 - share) + w01 * share
        share = one / (one + zero)
    forward, backward = np.empty((block, count)), np.empty((block, count))
    q = before
    for t in range(block):
        one = (1 - q) * a01[t] + q * a11[t]
        q = one / (one + (1 - q) * a00[t] + q * a10[t])
        forward[t] = q
    q = after
    for t in range(block - 1, -1, -1):
        backward[t] = q
        one = a10[t] * (1 - q) + a11[t] * q
        q = one / (one + a00[t] * (1 - q) + a01[t] * q)
    return forward.T.ravel()[:n], backward.T.ravel()[:n]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return (np.cumsum(lengths) - lengths)[lengths > 0]


def joined(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    hit = f * b
    return hit / (hit + (1 - f) * (1 - b))


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of each word by forward-backward."""
    return joined(*both_ways(odds, starts_of(lengths), moves)) if len(odds) else np.zeros(0)


def pair_counts(odds: np.ndarray, starts: np.ndarray, moves: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected numbers of pairs of states [from][to] inside documents."""
    inside = np.ones(len(odds), bool)
    inside[starts] = False
    at = np.flatnonzero(inside)
    head, tail, o = f[at - 1], b[at], odds[at]
    each = np.stack([(1 - head) * moves[0, 0] * (1 - tail), (1 - head) * moves[0, 1] * o * tail, head * moves[1, 0] * (1 - tail), head * moves[1, 1] * o * tail])
    return (each / each.sum(axis=0)).sum(axis=1).reshape(2, 2)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: constant, log of the expected toxic words, largest
    marginal, root of the rate."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(owner, p, len(lengths))
    top = np.zeros(len(lengths))
    np.maximum.at(top, owner, p)
    return np.stack([np.ones(len(lengths)), np.log1p(total), top, np.sqrt(total / np.maximum(lengths, 1))], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of the training texts and their features."""

    def __init__(self, documents: pa.Array):
        words, self.flat, self.lengths = words_of(documents)
        owner, found = features(words)
        order = np.argsort(owner, kind="stable")
        self.owner = owner[order]
        names, self.feature = np.unique(found[order], return_inverse=True)
        self.slot = (names & np.uint64((1 << BITS) - 1)).astype(np.int64)
        self.n_words, self.n_features = len(words), len(names)

    def labelled(self, toxic: np.ndarray) -> np.ndarray:
        """Distinct words that count as toxic inside toxic documents."""
        n = np.zeros((2, self.n_features))
        first = np.searchsorted(self.owner, np.arange(self.n_words + 1))
        for end, size, y in zip(np.cumsum(self.lengths), self.lengths, toxic, strict=True):
            own = np.unique(self.flat[end - size : end])
            many = first[own + 1] - first[own]
            at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            n[y, np.unique(self.feature[at])] += 1
        share = n[1] / max(toxic.sum(), 1), n[0] / max((1 - toxic).sum(), 1)
        q = toxic.mean()
        above = (n[1] - q * n.sum(axis=0)) / np.sqrt(np.maximum(n.sum(axis=0), 1) * q * (1 - q))
        pure = (above >= DEVIATIONS) & (share[0] >= PURITY * (share[0] + share[1]))
        out = np.zeros(self.n_words, dtype=bool)
        out[self.owner[pure[self.feature]]] = True
        return out


class Ascent:
    """Adam's steps."""

    def __init__(self, shape: tuple[int, ...], rate: float):
        self.rate, self.step = rate, 0
        self.first, self.second = np.zeros(shape), np.zeros(shape)

    def by(self, slope: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.99 * self.second + 0.01 * slope**2
        return self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-6)


def fit_field(documents: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> Field:
    """The field fitted on the first two thirds, the scorer on the rest."""
    train = np.arange(len(documents)) % 3 != 2
    words = Words(documents.filter(pa.array(train)))
    y = toxic[train]
    starts = starts_of(words.lengths)
    truth = (words.labelled(y)[words.flat] & (np.repeat(y, words.lengths) == 1)).astype(float)
    seen_words = np.bincount(words.flat, truth, words.n_words)
    inside = np.ones(len(truth), bool)
    inside[starts] = False
    at = np.flatnonzero(inside)
    seen_pairs = np.bincount((2 * truth[at - 1] + truth[at]).astype(np.int64), minlength=4).reshape(2, 2)
    slot = words.slot[words.feature]
    weights, bias = np.zeros(1 << BITS), np.full(1, -3.0)
    potentials = np.log((seen_pairs + 1) / (seen_pairs + 1).sum(axis=1, keepdims=True))
    for_weights, for_bias, for_pairs = Ascent(weights.shape, 0.2), Ascent((1,), 0.1), Ascent((2, 2), 0.05)
    for _ in range(ROUNDS):
        odds = np.exp(np.clip(np.bincount(words.owner, weights[slot], words.n_words) + bias, -15, 15))[words.flat]
        moves = np.exp(potentials)
        f, b = both_ways(odds, starts, moves) if len(odds) else (odds, odds)
        gap = seen_words - np.bincount(words.flat, joined(f, b), words.n_words)
        pairs = pair_counts(odds, starts, moves, f, b)
        weights = weights + for_weights.by(np.bincount(slot, gap[words.owner], 1 << BITS) - 0.05 * weights)
        bias = bias + for_bias.by(gap.sum(keepdims=True))
        potentials = potentials + for_pairs.by(seen_pairs - pairs - 0.05 * potentials)
    field = Field(weights, float(bias[0]), np.exp(potentials), np.zeros(4))
    rest = documents.filter(pa.array(~train))
    x = np.zeros((0, 4))
    if len(rest):
        p, lengths, _, _ = tag(field, rest)
        x = summary(p, lengths)
    return Field(weights, field.bias, field.moves, logistic(x, toxic[~train], weight[~train]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
    return w


def tag(field: Field, documents: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Marginals of all words, end to end, the numbers of words, and the words
    as ``words_of`` gives them."""
    words, flat, lengths = words_of(documents)
    owner, found = features(words)
    total = field.bias + np.bincount(owner, field.weights[(found & np.uint64((1 << BITS) - 1)).astype(np.int64)], len(words))
    return marginals(np.exp(np.clip(total, -15, 15))[flat], lengths, field.moves), lengths, words, flat


def labelled_sample(docs: DataFrame, labels: DataFrame, test: Column) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, toxic, h`` of the bounded sample, and the number of
    labelled documents of each class."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(test).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64(F.lit("toxicity"), F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    picks = marks.filter("toxic = 1").orderBy("h", "doc_id").limit(PER_CLASS).unionByName(marks.filter("toxic = 0").orderBy("h", "doc_id").limit(PER_CLASS))
    chosen = docs.sparkSession.createDataFrame(picks.collect(), "doc_id long, toxic int, h long")
    return texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("h").alias("h")), totals


def learn(docs: DataFrame, labels: DataFrame, test: Column) -> Field | None:
    """The field from labelled rows for which ``test`` holds (a condition on
    ``doc_id``); None where a class is missing.  One task fits it, so that the
    driver meets neither texts nor features, but the weights alone."""
    sample, totals = labelled_sample(docs, labels, test)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        rows = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("doc_id", "ascending")])
        toxic = rows.column("toxic").to_numpy().astype(np.int64)
        if 0 < toxic.sum() < len(toxic):
            each = np.array([totals.get(k, 0) / max(1, int((toxic == k).sum())) for k in (0, 1)])
            field = fit_field(rows.column("text").combine_chunks(), toxic, each[toxic] / max(each[toxic].mean(), 1e-9))
            del rows
            give_back()
            arrays = {"weights": field.weights, "moves": field.moves.ravel(), "scorer": field.scorer}
            yield pa.RecordBatch.from_pydict({"bias": pa.array([float(field.bias)])} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})

    found = sample.repartition(1).mapInArrow(fit, "bias double, weights binary, moves binary, scorer binary").first()
    if found is None:
        return None
    weights, moves, scorer = (np.frombuffer(found[k]) for k in ("weights", "moves", "scorer"))
    return Field(weights, found["bias"], moves.reshape(2, 2), scorer)


def judged(field: Field | None, documents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """What ``tag`` gives, with the documents' scores in the third place."""
    if field is None:
        words, flat, lengths = words_of(documents)
        return np.zeros(len(flat)), lengths, np.zeros(len(documents)), words, flat
    p, lengths, words, flat = tag(field, documents)
    return p, lengths, sigmoid(summary(p, lengths) @ field.scorer), words, flat


def without_toxic(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of ``docs`` that ``score`` doesn't predict as toxic, each judged
    by its own text, whatever its id; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, most=SLICE_BYTES):
            scores = judged(field, pc.fill_null(batch.column("text"), ""))[2]
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, field: Field | None, keep_spans: bool = True) -> DataFrame:
    """``doc_id, score, predicted, n_toxic_words`` for each document, and with
    ``keep_spans`` the toxic words' character offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, most=SLICE_BYTES):
            p, lengths, scores, words, flat = judged(field, batch.column("text"))
            hits = p >= SPAN_FROM
            ends = np.cumsum(lengths)
            before = np.concatenate([[0], np.cumsum(hits)])
            n_hits = before[ends] - before[ends - lengths]
            out = {
                "doc_id": batch.column("doc_id"),
                "score": pa.array(scores, pa.float64()),
                "predicted": pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
                "n_toxic_words": pa.array(n_hits, pa.int64()),
            }
            if keep_spans:
                spans: list[list[dict[str, int]]] = [[] for _ in range(len(lengths))]
                for i in np.flatnonzero(n_hits).tolist():
                    own = slice(ends[i] - lengths[i], ends[i])
                    places = split_spans(batch.column("text")[i].as_py(), words.take(pa.array(flat[own])).to_pylist())
                    spans[i] = [{"start": a, "end": b} for (a, b), hit in zip(places, hits[own].tolist(), strict=True) if hit]
                out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, score double, predicted int, n_toxic_words long"
    return texts(docs).mapInArrow(run, schema + ", spans array<struct<start:long,end:long>>" * keep_spans)


def split_spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the text's ``words``, given in order, lie."""
    out, at = [], 0
    for w in words:
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out
