"""Removal of repeated substrings: every byte covered by a `LENGTH`-byte string that also starts anywhere else.

Suffixes are sorted bucket by bucket, but only those that can have an equal. A bucket is named by an anchor: of all
GRAM-byte strings inside a suffix's first LENGTH bytes, the one of the smallest hash. Equal strings have equal anchors at
equal places, so they meet in one bucket, and the suffixes of one anchor place form a run of neighbours. Runs take one row
instead of one row for each suffix:

1. each text gives its runs (about one in 70 bytes): anchor, digest of the run's text, place;
2. an anchor that occurs once is dropped, with all its suffixes; runs that have an equal are repeated as they are;
3. what is left, buckets of unequal runs, is compared suffix by suffix: one run of each kind is sent, with its text, to its
   bucket's task, which takes its buckets block by block (see `Block`). The suffixes of a block are sorted by their first
   PERIOD bytes; longer ties are resolved by ranks that are computed before for a difference cover of the places: for any
   two places there is a distance below PERIOD at which both have a rank. Neighbours are then compared byte by byte;
4. a bucket of more than MAX_RUNS kinds of runs would be too much for a task, so it is divided, and its parts take the same
   steps: a suffix has `rest` bytes besides its anchor, so it has half of them on the anchor's left or on its right, and equal
   suffixes have the same there. This half joins the anchor (see `_extended`): a run falls into two at most, of suffixes that go
   left and right, and the longer anchors name the new buckets. Parts that are equal as a whole need no sort, again. After 8
   divisions at most an anchor is all of a suffix, and its bucket one kind.

Anchors of many runs are kept by a broadcast of their names, so that no task gets all runs of one.

Texts are UTF-8 bytes; null is empty; strings never cross texts; rows of equal id and text are documents of their own, so
each repeats the other; an empty table gives an empty table. Long texts are cut into overlapping segments, so a task's
memory does not grow with a text but for the text itself. Runs are held equal by 64-bit digests within an anchor, which is one
of 64 bits itself; suffixes by their bytes. `digest` reads doc_id and text alone, `remove` keeps all other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, bytes_of_batches, materialize, plain_names, row_key

LENGTH, GRAM = 200, 64
SEGMENT = 1 << 19
#: Buffers of texts are shorter than 2 to this power.
PLACE_BITS = 21
#: Kinds of runs that one bucket may have, about 1.5 MB; larger ones are divided.
MAX_RUNS = 5_000
#: Suffixes that are sorted at a time, but for those of one anchor place.
SORTED = 300_000
BROADCAST_ROWS = 500_000
#: Anchors of more runs than this are broadcast; there is one for so many runs at most.
HOT_RUNS = 2_000
#: A difference cover. Every distance below PERIOD lies between two of its places, modulo PERIOD.
PERIOD, COVER = 64, (0, 1, 2, 5, 14, 16, 34, 42, 59)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(n, base, _U)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=_U)
    return _powers[base][:n]


class Hashes:
    """Digests of any piece of a buffer, from sums over its 8-byte strings, each mixed and weighted by its place."""

    def __init__(self, raw: bytes) -> None:
        n = len(raw)
        eight = np.zeros(n, _U)
        padded = raw + bytes(16)
        for k in range(min(8, n)):
            part = np.frombuffer(padded, "<u8", count=(n - k + 7) // 8, offset=k)
            eight[k::8] = part
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_mix(eight + _U(_BASE)) * _powers_of(_BASE, max(n, 1))[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Digests of buffer[start : start + length], for lengths of 8 and more."""
        inverse = _powers_of(_INVERSE, len(self.sums))
        return _mix((self.sums[start + length - 7] - self.sums[start]) * inverse[start] + np.asarray(length).astype(_U))


def runs_of(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The runs of some texts: text number, first suffix, number of suffixes, anchor's digest, the run's digest, anchor's place from the first suffix."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes >= LENGTH)
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    h = Hashes(b"".join(parts))
    total = int(sizes.sum())
    grams = h.at(np.arange(total - GRAM + 1), GRAM)
    if total >> PLACE_BITS:
        raise ValueError("too many bytes at a time")
    bits = _U(PLACE_BITS)  # the same for all buffers: a near tie of two hashes is broken alike everywhere
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=_U)
    done, width = 1, LENGTH - GRAM + 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    counts = sizes[some] - LENGTH + 1
    owner = np.repeat(some, counts)
    starts = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    anchor = (low[starts] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.concatenate([first, [len(anchor)]]))
    lo, a = starts[first], anchor[first]
    kind = _mix(h.at(lo, n + LENGTH - 1) + (a - lo).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    return owner[first], lo - begins[owner[first]], n, grams[a].view(np.int64), kind.view(np.int64), a - lo


def segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text with their places; each suffix of LENGTH bytes lies in exactly one."""
    for at in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
        yield at, raw[at : at + SEGMENT + LENGTH - 1]


def _runs(docs: DataFrame) -> DataFrame:
    """anchor, kind, row, lo and shape of every run of (row, text); shape holds n and at, the anchor's place from lo, as n * 256 + at."""

    def of(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        owner, lo, n, anchor, kind, at = runs_of([h[2] for h in held])
        rows, places = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, kind, rows[owner], lo + places[owner], n * 256 + at)], ["anchor", "kind", "row", "lo", "shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                if len(raw) < LENGTH:
                    continue
                for at, piece in segments(raw):
                    held.append((rows[i].as_py(), at, piece))
                    size += len(piece)
                    if size >= SEGMENT:
                        yield of(held)
                        held, size = [], 0
        if held:
            yield of(held)

    return docs.select("row", "text").mapInArrow(run, "anchor bigint, kind bigint, row bigint, lo bigint, shape bigint")


def _cut(texts: DataFrame) -> DataFrame:
    """texts (row, text, runs: array of (anchor, kind, lo, n, same, at)) → a row for each run with its bytes."""
    names = ["anchor", "kind", "row", "lo", "same", "at", "piece"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, row = (batch.column(1)[i].as_py() or "").encode(), batch.column(0)[i].as_py()
                out = [(r["anchor"], r["kind"], row, r["lo"], r["same"], r["at"], raw[r["lo"] : r["lo"] + r["n"] + LENGTH - 1]) for r in batch.column(2)[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names)

    return texts.select("row", "text", "runs").mapInArrow(run, "anchor bigint, kind bigint, row bigint, lo bigint, same bigint, at bigint, piece binary")


def _spans(rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Neighbouring repeated suffixes (row, place; in order) as (row, start, end) of the bytes that they cover."""
    cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([cut[1:], [len(at)]])[: len(cut)] - 1
    return pa.RecordBatch.from_arrays([pa.array(rows[cut]), pa.array(at[cut]), pa.array(at[last] + LENGTH)], ["row", "start", "end"])


_DISTANCE = np.zeros((PERIOD, PERIOD), np.int64)  # by two places: how far on both are in the cover
for _d in range(PERIOD - 1, -1, -1):
    _in = np.isin((np.arange(PERIOD) + _d) % PERIOD, COVER)
    _DISTANCE[np.ix_(_in, _in)] = _d


class Block:
    """A buffer with what its suffixes are compared by."""

    def __init__(self, raw: bytes) -> None:
        n = len(raw)
        padded = raw + bytes(5 * PERIOD + 16)  # what comes after LENGTH bytes only orders equals
        size = n + 4 * PERIOD
        self.eight = np.zeros(size, _U)  # the 8 bytes at each place, as numbers in the order of the bytes
        for k in range(8):
            self.eight[k::8] = np.frombuffer(padded, ">u8", count=(size - k + 7) // 8, offset=k)
        self.rank = self._cover_ranks(n)

    def _cover_ranks(self, n: int) -> np.ndarray:
        """For the places of the cover, ranks of all that follows: by PERIOD bytes first, then doubled until all differ."""
        places = (np.arange(0, n + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        places = places[places < n + PERIOD]
        rank = np.zeros(n + 5 * PERIOD, np.int64)
        order = np.lexsort([self.eight[places + k] for k in range(PERIOD - 8, -1, -8)])
        new = np.zeros(len(places), bool)
        for k in range(0, PERIOD, 8):
            x = self.eight[places + k][order]
            new[1:] |= x[1:] != x[:-1]
        rank[places[order]] = np.cumsum(new) + 1
        step, kinds = PERIOD, int(new.sum()) + 1
        while kinds < len(places) and step < n + PERIOD:
            after = places + step
            key = rank[places] * (len(places) + 2) + np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)], 0)
            found, inverse = np.unique(key, return_inverse=True)
            rank[places] = inverse + 1
            step, kinds = 2 * step, len(found)
        return rank

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 by the order of the suffixes at a and b, to the buffer's end."""
        out = np.zeros(len(a), np.int8)
        left = np.arange(len(a))
        for k in range(0, PERIOD, 8):
            x, y = self.eight[a[left] + k], self.eight[b[left] + k]
            out[left] = (x > y).astype(np.int8) - (x < y)
            left = left[x == y]
        far = _DISTANCE[a[left] % PERIOD, b[left] % PERIOD]
        x, y = self.rank[a[left] + far], self.rank[b[left] + far]
        out[left] = (x > y).astype(np.int8) - (x < y)
        return out

    def sorted(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places at, which come in buckets of these sizes, with each bucket sorted: all buckets are merged side by side."""
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size, t = np.repeat(sizes, sizes), np.arange(len(at)) - start
        w = 1
        while w < sizes.max(initial=0):
            some = np.flatnonzero(size > w)
            base, mine, m, own = start[some], t[some], size[some], at[some]
            run = mine // w
            first = np.minimum((run ^ 1) * w, m)  # of the run that mine is merged with
            lo, hi, even = first.copy(), np.minimum(first + w, m), run % 2 == 0
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.compare(at[base[open_] + mid], own[open_])
                go = (c < 0) | ((c == 0) & ~even[open_])
                lo[open_], hi[open_] = np.where(go, mid + 1, lo[open_]), np.where(go, hi[open_], mid)
            merged = at.copy()
            merged[base + (run & ~1) * w + (mine - run * w) + (lo - first)] = own
            at, w = merged, 2 * w
        return at

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether LENGTH bytes are equal."""
        left = np.arange(len(a))
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            left = left[self.eight[a[left] + k] == self.eight[b[left] + k]]
        out = np.zeros(len(a), bool)
        out[left] = True
        return out


def _sorted_buckets(pieces: DataFrame) -> DataFrame:
    """(row, start, end) of the repeated bytes of the runs that occur once, block after block.

    Suffixes of one anchor can be equal only where the anchor stands at the same place in them: these are sorted together.
    """

    def settle(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.fromiter((len(h[4]) for h in held), np.int64, len(held))
        counts, begins = sizes - LENGTH + 1, np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(held)), counts)
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        bucket = np.unique(np.array([h[0] for h in held], np.int64), return_inverse=True)[1]
        named = bucket[owner] * LENGTH + np.array([h[6] for h in held], np.int64)[owner] - place
        order = np.argsort(named, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], named[order][1:] != named[order][:-1]]))
        groups = np.diff(np.concatenate([first, [len(order)]]))
        many = np.repeat(groups > 1, groups)
        order, groups = order[many], groups[groups > 1]
        block = Block(b"".join(h[4] for h in held))
        spot = begins[owner] + place
        number = np.empty(int(sizes.sum()), np.int64)
        number[spot] = np.arange(len(spot))
        hits, ends, begin = [np.zeros(0, np.int64)], np.cumsum(groups), 0
        while begin < len(groups):  # some buckets at a time
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SORTED, side="right")))
            some = groups[begin:end]
            at = block.sorted(spot[order[ends[end - 1] - some.sum() : ends[end - 1]]], some)
            equal = block.same(at[:-1], at[1:])
            equal[np.cumsum(some)[:-1] - 1] = False
            repeated = np.zeros(len(at), bool)
            repeated[1:] = equal
            repeated[:-1] |= equal
            hits.append(number[at[repeated]])
            begin = end
        hit = np.sort(np.concatenate(hits))
        once = np.array([h[3] for h in held]) == 1
        hit = hit[once[owner[hit]]]
        rows, lo = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
        return _spans(rows[owner[hit]], place[hit] + lo[owner[hit]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(j).to_pylist() for j in range(7)]
            for r in zip(*columns, strict=True):
                if held and r[0] == held[-1][0]:
                    if r[5] == held[-1][5]:
                        continue  # from a repeated row
                elif size >= SEGMENT:
                    yield settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield settle(held)

    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor", "kind")
    return ordered.select("anchor", "row", "lo", "same", "piece", "kind", "at").mapInArrow(run, "row bigint, start bigint, end bigint")


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _extended(texts: DataFrame, rest: int) -> DataFrame:
    """texts (row, text, runs) → anchor, kind, row, lo, shape and same of the runs' parts, with anchors longer by half of rest.

    The suffixes of a run that have so many bytes on the anchor's left take them into the anchor, the others those on its right.
    """
    half = (rest + 1) // 2
    names = ["anchor", "kind", "row", "lo", "shape", "same"]

    def parts(raw: bytes, row: int, r: dict) -> Iterator[tuple]:
        lo, n, at = r["lo"], r["n"], r["at"]
        left = min(n, max(0, at - half + 1))
        for begin, count, new in ((0, left, at - half), (left, n - left, at - left)):
            if count:
                start = lo + begin
                # the bytes that join the anchor: at its left end, or behind its right one
                more = raw[start + new : start + new + half] if not begin and left else raw[lo + at + LENGTH - rest : lo + at + LENGTH - rest + half]
                anchor = _digest(r["anchor"].to_bytes(8, "little", signed=True), b"l" if not begin and left else b"r", more)
                yield anchor, _digest(bytes([new]), raw[start : start + count + LENGTH - 1]), row, start, count * 256 + new, r["same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, row = (batch.column(1)[i].as_py() or "").encode(), batch.column(0)[i].as_py()
                out = [x for r in batch.column(2)[i].as_py() for x in parts(raw, row, r)]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(6)], names)

    return texts.select("row", "text", "runs").mapInArrow(run, "anchor bigint, kind bigint, row bigint, lo bigint, shape bigint, same bigint")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(row, start, end): bytes to remove, in spans that may overlap. keyed: row and text."""
    bytes_of_batches(keyed.sparkSession)
    runs = _runs(keyed)
    buckets = materialize(runs.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1"))
    hot = at_most(buckets.filter(F.col("total") > HOT_RUNS).select("anchor", F.lit(True).alias("hot")), BROADCAST_ROWS)
    # runs of hot anchors need no partner: they are dealt evenly
    dealt = runs.join(hot, "anchor", "left").withColumn("key", F.when(F.col("hot"), F.xxhash64("row", "lo")).otherwise(F.col("anchor")))
    cold = buckets.filter(F.col("total") <= HOT_RUNS).select(F.col("anchor").alias("key"), F.lit(True).alias("cold"))
    met = materialize(dealt.drop("hot").join(cold, "key", "left").filter("cold or key <> anchor").select("anchor", "kind", "row", "lo", "shape"))
    met = met.withColumn("same", F.lit(1).cast("long"))
    n, at = F.shiftright("shape", 8), F.col("shape") % 256
    spans, rest = [], LENGTH - GRAM
    while True:
        kinds = materialize(met.groupBy("anchor", "kind").agg(F.sum("same").alias("same"), F.min(F.struct("row", "lo", "shape")).alias("one")))
        equal = met.join(kinds.filter("same > 1").select("anchor", "kind"), ["anchor", "kind"], "left_semi")
        spans.append(equal.select("row", F.col("lo").alias("start"), (F.col("lo") + n + (LENGTH - 1)).alias("end")))
        sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        large = F.col("kinds") > (MAX_RUNS if rest else F.lit(2**62))
        unequal = materialize(kinds.join(sizes, "anchor").select("one.*", "anchor", "kind", "same", large.alias("large")))
        spans.append(_sorted_buckets(_cut(_with_runs(keyed, unequal.filter("not large"), n, at))))
        if not unequal.filter("large").limit(1).count():
            break
        met = materialize(_extended(_with_runs(keyed, unequal.filter("large"), n, at), rest))
        rest -= (rest + 1) // 2
    out = spans[0]
    for part in spans[1:]:
        out = out.unionByName(part)
    return out


def _with_runs(keyed: DataFrame, runs: DataFrame, n: Column, at: Column) -> DataFrame:
    """row, text and runs of the texts that have some."""
    own = runs.select("row", F.struct("anchor", "kind", "lo", n.alias("n"), "same", at.alias("at")).alias("run"))
    own = materialize(own.groupBy("row").agg(F.collect_list("run").alias("runs")))
    return keyed.join(at_most(own.select("row"), BROADCAST_ROWS), "row", "left_semi").join(own, "row")


def _strip(docs: DataFrame, text_column: str, out: str, row) -> DataFrame:  # noqa: ANN001
    """docs (any columns, text, spans last) with what row(raw bytes, merged spans) returns in place of text and spans."""
    names = [part.split()[0] for part in out.split(", ")]
    kept = [f for f in docs.schema.fields if f.name not in (text_column, "__spans", *names)]

    def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
        done: list[list[int]] = []
        for start, end in sorted((s["start"], s["end"]) for s in spans or []):
            if done and start <= done[-1][1]:
                done[-1][1] = max(done[-1][1], end)
            else:
                done.append([start, end])
        return [(a, b) for a, b in done]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(len(kept)), batch.column(len(kept) + 1)
            rows = [row((texts[i].as_py() or "").encode(), merged(spans[i].as_py())) for i in range(batch.num_rows)]
            made = [pa.array([r[j] for r in rows]) if rows else pa.array([], pa.string()) for j in range(len(names))]
            if rows:
                yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + made, batch.schema.names[: len(kept)] + names)

    own = plain_names(docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_column}`"), "__spans"))
    return own.mapInArrow(run, ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)] + [out])).toDF(*[f.name for f in kept], *names)


def _left(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]])


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with `__spans`, null where nothing is repeated; only texts with spans are shuffled where their keys can be broadcast."""
    keyed = docs.withColumn("__row", row_key("doc_id", "text"))
    spans = repeated_spans(keyed.select(F.col("__row").alias("row"), "text"))
    spans = materialize(spans.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "end")).alias("__spans")))
    keys = at_most(spans.select("__row"), BROADCAST_ROWS)
    hit = keyed.join(keys, "__row", "left_semi").join(spans, "__row")
    clean = keyed.join(keys, "__row", "left_anti").withColumn("__spans", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    return hit.unionByName(clean).drop("__row")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def row(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_left(raw, spans)).hexdigest()

    return _strip(_with_spans(docs.select("doc_id", "text")), "text", "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", row)


def remove(docs: DataFrame) -> DataFrame:
    """docs with `kept` (binary, what is left of the text's bytes) in place of the text."""
    return _strip(_with_spans(docs), "text", "kept binary", lambda raw, spans: (_left(raw, spans),))
