"""Byte-level byte-pair encoding: speculate, verify, and merge only what fails.

A word (a piece of the pre-tokeniser) is first cut greedily into the longest
vocabulary entries.  A sequence of tokens is what byte-pair merging gives
exactly when every token encodes to itself and every *adjacent pair* does, so
the second step tests all adjacent pairs of all words of a batch at once, with
numpy.  Only words with a failing pair undergo exact merging.

The pair test undoes merges on both sides of the border, latest merge first;
if a merge across the border had come earlier than the merge being undone,
byte-pair merging would have crossed the border and the pair fails.

Defined cases: null and empty texts have no tokens; texts of any length are
encoded whole (exact merging uses a heap, so one long word costs n log n);
the special token's string is one token; repeated rows give repeated results;
columns other than ``doc_id`` and ``text`` are ignored; an empty table gives
an empty result with the same schema.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts

#: Fixed value: the byte-level pre-tokeniser's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a Python worker before it starts afresh.
REMEMBERED = 700_000
NONE = np.int64(-1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file of the tokenizers library, as numpy tables.

    Ids must rank merges: the token made by an earlier merge has the smaller
    id.  ``ValueError`` otherwise, as the pair test rests on it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        keys, made, last = [], [], -1
        for m in spec["model"]["merges"]:
            a, b = (m.split(" ") if isinstance(m, str) else m)
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            if t <= last or t <= max(a, b):
                raise ValueError("ids do not rank merges")
            last = t
            self.left[t], self.right[t] = a, b
            keys.append(a << 32 | b)
            made.append(t)
        self.merged = dict(zip(keys, made, strict=True))
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_made = np.array(made, dtype=np.int64)[order]
        self.longest = max(map(len, self.ids))
        whole = np.array(made, dtype=np.int64)
        good = np.ones(size, dtype=bool)
        good[whole] = self.compatible(self.left[whole], self.right[whole], whole)
        self.self_coded = good

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging a and b makes, or -1."""
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair_keys, k), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == k, self.pair_made[i], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether merging the pair's bytes gives back the pair
        (with ``before``: whether no merge before that one crosses the border)."""
        n = len(a)
        ok = np.ones(n, dtype=bool)
        at = np.arange(n)
        a, b = a.copy(), b.copy()
        limit = np.full(n, np.iinfo(np.int64).max) if before is None else before.copy()
        while len(at):
            across = self.lookup(a, b)
            crossed = (across != NONE) & (across < limit)
            ok[at[crossed]] = False
            # Undo the later of the two sides' merges; of equal tokens, the right
            # one's.  A token without a merge stands as it is.
            split_a, split_b = self.right[a] != a, self.left[b] != b
            first = split_a & ((a > b) | ~split_b)
            second = split_b & ~first
            limit = np.where(first, a, np.where(second, b + 1, limit))
            a, b = np.where(first, self.right[a], a), np.where(second, self.left[b], b)
            go = ~crossed & (first | second)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def speculate(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, ids = [], 0, len(word), self.ids
        if word in ids:
            return [ids[word]]
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = ids.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: of all adjacent pairs the earliest merge first, the
        leftmost of equal ones."""
        tokens = [self.ids[word[i : i + 1]] for i in range(len(word))]
        merged, n = self.merged, len(tokens)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(t, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (t := merged.get(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            t, i, a, b = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else n
            if j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = t, -1
            after[i] = k = after[j]
            if k < n:
                ahead[k] = i
                if (u := merged.get(t << 32 | tokens[k])) is not None:
                    heapq.heappush(heap, (u, i, t, tokens[k]))
            if (p := ahead[i]) >= 0 and (u := merged.get(tokens[p] << 32 | t)) is not None:
                heapq.heappush(heap, (u, p, tokens[p], t))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words needed exact merging."""
        guess = [self.speculate(w) for w in words]
        sizes = np.array([len(g) for g in guess], dtype=np.int64)
        flat = np.array([t for g in guess for t in g], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), dtype=bool)
        bad[word[~self.self_coded[flat]]] = True
        same = word[:-1] == word[1:]
        pairs, where = np.unique(flat[:-1][same] << 32 | flat[1:][same], return_inverse=True)
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[word[:-1][same][fails[where]]] = True
        for i in np.flatnonzero(bad):
            guess[i] = self.merge(words[i])
        return guess, int(bad.sum())


class Encoder:
    """Encodes texts with a vocabulary and remembers words."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        parts: list[list[str]] = []
        for text in batch:
            words: list[str] = []
            for piece in self.specials.split(text) if self.specials else [text]:
                if piece in self.vocabulary.special:
                    words.append(piece)
                else:
                    words += self.words.findall(piece)
            parts.append(words)
        new = list({w for words in parts for w in words if w not in known})
        plain = [w for w in new if w not in self.vocabulary.special]
        for w, ids in zip(plain, self.vocabulary.encode_words([w.encode() for w in plain])[0], strict=True):
            known[w] = np.array(ids, dtype="<u4").tobytes()
        for w, i in self.vocabulary.special.items():
            known[w] = np.array([i], dtype="<u4").tobytes()
        return [b"".join([known[w] for w in words]) for words in parts]

    def decode(self, ids: bytes) -> str:
        table = self.vocabulary.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each document, and
    with ``keep_ids`` the tokens (``ids array<int>``) and the decoded text.
    One narrow stage: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in slices(batches):
            coded = coder.encode(batch.column("text").to_pylist())
            decoded = [coder.decode(x) for x in coded]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
            if keep_ids:
                out["ids"] = pa.array([np.frombuffer(x, dtype="<i4") for x in coded], pa.list_(pa.int32()))
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return texts(docs).mapInArrow(run, schema)
