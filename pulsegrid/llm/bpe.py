"""Byte-level BPE encoding and decoding over a rank file.

Two tiers. The distinct pre-tokens of each part of a batch go to a minimal perfect hash (two-level displacement, built once
per worker), which resolves those that are vocabulary entries in a few array operations. The others are merged by a heap over
linked bytes; a worker remembers what it has merged, in MEMORY bytes at most. A text is one row, so no shuffle takes
place. Memory does not grow with a batch or a text but by 4 bytes for each id: parts of PART_CHARS characters are split,
encoded and sent off one after the other, and a longer text is encoded PIECES pre-tokens at a time.

A null or empty text has no tokens; repeated rows each get the same answer; long texts and long pre-tokens take
O(n log n); an empty table gives an empty table. `tokens` and `encode` keep all other columns; one that has the name of a
result is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of_batches, plain_names

#: Bytes of merged pre-tokens that a worker remembers, half of them the last, half those before, and what each takes besides its
#: own bytes and those of its ids.
MEMORY, ENTRY = 80_000_000, 170
#: Characters of text that are encoded at a time, and pre-tokens of a longer text.
PART_CHARS, PIECES = 500_000, 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit polynomial hashes of byte strings, all at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words) or not lengths.sum():
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    back = np.repeat(ends, lengths) - np.arange(len(data)) - 1
    powers = np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers[back])])
    return _mix(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots. Each bucket of keys has a displacement that sends them to free
    slots; a bucket of one key has its slot's number, as a negative displacement, instead."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.keys = keys
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        h = _hashes(keys)
        if len(np.unique(h)) != len(keys):
            raise ValueError("two vocabulary entries share a hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot = np.full(self.n, -1, np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):  # full buckets first, all of one size side by side
            left, shift = np.flatnonzero(sizes == size), 0
            while len(left):
                shift += 1
                if len(left) <= 16:  # one after the other, many displacements at once
                    own = order[starts[left[0]] + np.arange(size)]
                    tried = np.arange(shift, shift + 2000)
                    at = np.sort(self._place(h[own][None, :], tried[:, None]), axis=1)
                    good = (self.slot[at] < 0).all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
                    if not good.any():
                        shift += len(tried) - 1
                        continue
                    self.shift[left[0]] = found = tried[good.argmax()]
                    self.slot[self._place(h[own], np.full(size, found))] = own
                    left, shift = left[1:], 0
                    continue
                own = order[starts[left][:, None] + np.arange(size)]
                at = self._place(h[own], np.full(own.shape, shift))
                free = (self.slot[at] < 0).all(axis=1)
                first = np.zeros(free.sum() * size, bool)
                first[np.unique(at[free].ravel(), return_index=True)[1]] = True  # no slot is given twice
                free[free] = first.reshape(-1, size).all(axis=1)
                self.shift[left[free]] = shift
                self.slot[at[free]] = own[free]
                left = left[~free]
        alone, empty = np.flatnonzero(sizes == 1), np.flatnonzero(self.slot < 0)
        self.shift[alone] = -1 - empty
        self.slot[empty] = order[starts[alone]]

    def _place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = (_mix(h + shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.n)).astype(np.int64)
        return np.where(shift < 0, -1 - shift, moved)

    def find(self, words: list[bytes]) -> list[int]:
        """The index of each word among the keys, or -1."""
        if not self.n or not words:
            return [-1] * len(words)
        h = _hashes(words)
        at = self._place(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])
        return [i if self.keys[i] == w else -1 for i, w in zip(self.slot[at].tolist(), words, strict=True)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: of all neighbouring parts, the pair of the lowest rank (leftmost of equals) is joined again and again."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    get = ranks.get
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    # a heap entry is one number: rank, first byte, end; its parts take `bits` bits each
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [(r << bits | i) << bits | (i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        x = pop(heap)
        stop = x & mask
        i = x >> bits & mask
        j = nxt[i]
        if j >= n or end[j] != stop:
            continue  # one of the two has been joined to another part meanwhile
        nxt[j] = n + 1
        end[i] = stop
        nxt[i] = k = stop
        if k < n:
            prv[k] = i
            e = end[k]
            if (r := get(word[i:e])) is not None:
                push(heap, (r << bits | i) << bits | e)
        h = prv[i]
        if h >= 0 and (r := get(word[h:stop])) is not None:
            push(heap, (r << bits | h) << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder over a rank file: a line has a token in base64 and its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        keys = list(ranks)
        self.ids = [array("i", [ranks[k]]).tobytes() for k in keys]
        self.whole = PerfectHash(keys)
        self.bytes = {i: k for k, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.pattern = regex.compile(pattern)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0
        #: Pre-tokens that each tier has answered: the hash, the memory of merged ones, the heap.
        self.answered = [0, 0, 0]

    def _merged(self, word: bytes) -> bytes:
        """The ids of a word that is no vocabulary entry and not among the last ones, as bytes of int32."""
        if (ids := self.older.get(word)) is None:
            self.answered[2] += 1
            ids = array("i", merge(word, self.ranks)).tobytes()
        else:
            self.answered[1] += 1
        self.size += len(word) + len(ids) + ENTRY
        if self.size > MEMORY // 2:
            self.known, self.older, self.size = {}, self.known, len(word) + len(ids) + ENTRY
        if self.size <= MEMORY // 2:  # else this one alone is too long
            self.known[word] = ids
        else:
            self.size = 0
        return ids

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pre-tokens, one after the other, and how many each has."""
        number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        words = [p.encode() for p in number]
        each = []
        for word, i in zip(words, self.whole.find(words), strict=True):
            if i >= 0:
                self.answered[0] += 1
                each.append(self.ids[i])
            elif (ids := self.known.get(word)) is not None:
                self.answered[1] += 1
                each.append(ids)
            else:
                each.append(self._merged(word))
        flat = np.frombuffer(b"".join(each), np.int32)
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        counts = n[at]
        skip = np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(counts) - counts), counts)
        return flat[skip + np.arange(len(skip))], counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and where each text's begin (and the last one's end)."""
        if len(texts) == 1:
            made, matches = [], self.pattern.finditer(texts[0])
            while pieces := [m.group() for m in islice(matches, PIECES)]:
                made.append(self._ids(pieces)[0])
            ids = np.concatenate(made) if made else np.zeros(0, np.int32)
            return ids, np.array([0, len(ids)])
        split = [self.pattern.findall(t) for t in texts]
        ids, counts = self._ids(list(chain.from_iterable(split)))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(p) for p in split], dtype=np.int64)])]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """SHA-256 of the ids as text, joined by commas, and of the bytes that they decode to."""
        text = ",".join(map(self.names.__getitem__, ids))
        return hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_codecs: dict[str, Codec] = {}


def load(spec: bytes, pattern: str) -> Codec:
    """The codec of a rank file's bytes; one per worker."""
    name = hashlib.sha256(spec + pattern.encode()).hexdigest()
    if name not in _codecs:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line)}
        _codecs[name] = Codec(ranks, pattern)
    return _codecs[name]


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch, in lists of PART_CHARS characters or one text of more, with the place of the first."""
    part, size, first = [], 0, 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        if part and size + len(text) > PART_CHARS:
            yield first, part
            part, size = [], 0
        first = first if part else i
        part.append(text)
        size += len(text)
    if part:
        yield first, part


#: The columns that can be made of a text.
COLUMNS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def _over_texts(docs: DataFrame, text: str, path: str, pattern: str, names: list[str]) -> DataFrame:
    """docs with some of COLUMNS in place of the text; the rank file (under 1 MB) is broadcast."""
    bytes_of_batches(docs.sparkSession)
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in names]

    def columns(codec: Codec, part: list[str]) -> list[pa.Array]:
        ids, at = codec.encode_all(part)
        made = {"n_tokens": lambda: pa.array(np.diff(at)), "ids": lambda: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))}
        if "ids_sha256" in names:
            digests = [codec.digests(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            made |= {"ids_sha256": lambda: pa.array([d[0] for d in digests]), "decoded_sha256": lambda: pa.array([d[1] for d in digests])}
        return [made[n]() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(shared.value, pattern)
        for batch in batches:
            for first, part in _parts(batch.column(len(kept))):
                some = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays(some.columns[: len(kept)] + columns(codec, part), some.schema.names[: len(kept)] + names)

    own = plain_names(docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")))
    out = own.mapInArrow(run, ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)] + [f"{n} {COLUMNS[n]}" for n in names]))
    return out.toDF(*[f.name for f in kept], *names)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with `ids` (array of int) in place of the text."""
    return _over_texts(docs, text, path, pattern, ["ids"])


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with `decoded` (binary), the bytes of the ids; null for null."""
    with open(path, "rb") as f:
        vocabulary = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def joined(s: pd.Series) -> pd.Series:
        get = shared.value.__getitem__
        return s.map(lambda x: None if x is None else b"".join(map(get, x)))

    return tokens.withColumn("decoded", joined(F.col(ids)))


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with n_tokens, ids and the digests of the ids and of the bytes that they decode to, in place of the text."""
    return _over_texts(docs, "text", path, pattern, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    return _over_texts(docs.select("doc_id", "text"), "text", path, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"])
