"""MinHash near-dedup with bottom-k sketches.

One hash function over shingles of words; a document's sketch is the K smallest values of its set. Documents of equal sets
are one class. Inverted lists of the classes' sketch values give candidates: two sets of the wanted similarity share at
least LEAST_SHARED of the values that both keep (all but surely, see `least_shared`), so only a prefix of each sketch needs
a place in the lists, rarest values first; a value that many documents hold, such as one of a common passage, stays out of the
lists of those that have enough others. In a list, members are first compared with one member, so that a large group of near
copies becomes one component with as many comparisons as it has members. Classes of lists that still span components get
places in exact lists over their full sets (`_listed`), whose prefixes are far shorter, and members of different components
are compared there. Before a comparison, the union of the two sketches estimates the similarity; what passes is
confirmed on the full sets.

A text without words (or null) has an empty set and is linked with nothing. Rows of equal id and text are one document; a
null id takes part, but is no component's name unless the whole component has none. Very long texts are read whole, one at a
time, with 8 bytes for each shingle; an empty table gives an empty table. Only id and text are read, of any other columns.

Rows and sets are told apart by 128 bits: sets have two digests, of which the first names the class. Of sets that share it alone,
all but one get another name (`_renamed`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import at_most, bytes_of_batches, materialize, wide_key
from .components import connected_components

K = 32
#: A pair of the wanted similarity is missed with this probability at most, for each pair.
MISS = 1e-6
BROADCAST_ROWS = 500_000
#: Sizes in one size class of the exact lists differ by this part at most.
CLASS_WIDTH = 0.03
PARITIES = 1024
_PARTS = np.uint64(PARITIES)

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of `size` words; of all its words if it has fewer; none without words.

    Words are what stands between ASCII blanks, with A to Z lower-cased: just what bytes.lower and bytes.split take.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    data = _mix(np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + _ODD[0])
    place = np.arange(len(data), dtype=np.int64) - np.repeat(ends - lengths, lengths)
    # a word's hash is the sum of its bytes, each multiplied by a number for its place in the word
    each = _mix(data + place.astype(np.uint64) * _ODD[1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    h = _mix(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64) * _ODD[2])
    run = min(size, len(h))
    total = np.full(len(h) - run + 1, np.uint64(run))
    for i in range(run):
        total = _mix(total * _ODD[3] + h[i : len(h) - run + 1 + i])
    return np.unique(total)


def least_shared(threshold: float, k: int = K, miss: float = MISS) -> int:
    """The largest s such that fewer than s of k draws of chance `threshold` come with a probability of `miss` at most."""
    total, s = 0.0, 0
    while total + (p := math.comb(k, s) * threshold**s * (1 - threshold) ** (k - s)) <= miss:
        total, s = total + p, s + 1
    return max(1, s)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row (wide_key), n (set size), set and second (digests of the set; null if empty) and sketch, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(2), []
            for i in range(len(texts)):
                s = shingles(texts[i].as_py() or "", size)
                whole = _mix(s + _ODD[4]).sum(dtype=np.uint64) + np.array([len(s)], np.uint64) * _ODD[5]
                second = _mix(s ^ _ODD[6]).sum(dtype=np.uint64) + np.array([len(s)], np.uint64) * _ODD[3]
                out.append((len(s), *(int(x.view(np.int64)[0]) if len(s) else None for x in (whole, second)), s[:K].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([o[j] for o in out], pa.int64()) for j in range(3)), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                ["doc_id", "row", "n", "set", "second", "sketch"],
            )

    own = docs.select(F.col("doc_id").cast("long"), wide_key("doc_id", "text").alias("row"), "text")
    return own.mapInArrow(run, "doc_id bigint, row struct<a:bigint,b:bigint>, n bigint, `set` bigint, second bigint, sketch array<bigint>")


def _renamed(rows: DataFrame) -> DataFrame:
    """rows with `set` as the name of their class: of sets that share their first digest, all but one are named by both."""
    both = rows.filter(F.col("set").isNotNull()).groupBy("set", "second").agg(F.lit(1).alias("one"))
    shared = both.groupBy("set").agg(F.count("*").alias("n"), F.min("second").alias("least")).filter("n > 1").select("set", "least")
    shared = materialize(shared)
    if shared.isEmpty():
        return rows
    other = F.col("least").isNotNull() & (F.col("second") != F.col("least"))
    return materialize(rows.join(at_most(shared, BROADCAST_ROWS), "set", "left").withColumn("set", F.when(other, F.xxhash64("set", "second")).otherwise(F.col("set"))).drop("least"))


def _prefixes(classes: DataFrame, shared: int, threshold: float) -> DataFrame:
    """(value, set, n, weight): the values under which a class is listed, of those that several classes hold; weight counts
    how many others hold the values of its sketch."""
    values = classes.select("set", "n", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    kept = F.least(F.col("n"), F.lit(K))
    must = F.least(F.lit(shared), F.ceil(F.col("n") * threshold - 1e-9))
    held = values.join(common, "value")
    order = F.row_number().over(Window.partitionBy("set").orderBy("df", "value"))
    alone = kept - F.count("*").over(Window.partitionBy("set"))  # values that nobody else holds come first of all
    weight = F.sum("df").over(Window.partitionBy("set"))
    placed = held.select("value", "set", "n", weight.alias("weight"), (order + alone).alias("at"), (kept - must + 1).alias("upto"))
    return placed.filter("at <= upto").select("value", "set", "n", "weight")


def _likely(a: str, b: str, shared: int, threshold: float) -> Column:
    """Whether sketches a and b can belong to sets of the wanted similarity: of the K smallest values of their union, enough are in both."""
    union = F.slice(F.array_sort(F.transform(F.array_union(a, b), lambda v: F.struct((F.shiftrightunsigned(v, 1)).alias("high"), v.alias("v")))), 1, K)
    both = F.size(F.array_intersect(F.transform(union, lambda x: x["v"]), F.array_intersect(a, b)))
    return F.when(F.size(union) < K, both >= threshold * F.size(union) - 1e-9).otherwise(both >= shared)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts: set and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(len(a)):
                if last is None or last[0] != b[i]:
                    last = (b[i], shingles(batch.column(3)[i].as_py() or "", size))
                one, two = shingles(batch.column(2)[i].as_py() or "", size), last[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = texts.select(F.col("set").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("set").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def _labelled(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("set"))
    return lists.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _listed(involved: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(value, small, large, set, n, own): places of classes in exact lists over their full sets. involved: set and n.

    Values that several of these classes hold are put in order, rarest first. Two sets of sizes n and m that meet the
    threshold share `need(n, m)` values, so the first one that they share comes before place n - need(n, m) + 1 of the one and
    m - need(n, m) + 1 of the other. A class therefore has a place under a value and a pair of size classes only if that
    can hold for partners of that size; sizes of one class differ by CLASS_WIDTH at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = shingles(batch.column(1)[i].as_py() or "", size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), batch.column(0)[i].as_py(), np.int64)), pa.array(s.view(np.int64))], ["set", "value"])

    values = texts.select("set", "text").mapInArrow(run, "`set` bigint, value bigint")
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    held = values.join(common, "value").join(involved, "set")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("set"))
    held = held.withColumn("at", alone + F.row_number().over(Window.partitionBy("set").orderBy("df", "value")))
    width = math.log(1 + CLASS_WIDTH)
    of = lambda c: F.floor(F.log(c) / width)
    held = held.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).withColumn("own", of(F.col("n")))
    reach = F.sequence(of(F.col("n") * percent / 100), of(F.col("n") * 100 / percent + 1))
    held = held.select("value", "set", "n", "own", "at", F.explode(reach).alias("other"))
    least = F.greatest(F.floor(F.exp(F.col("other") * width)), F.ceil(F.col("n") * percent / 100 - 1e-9))
    need = F.ceil((F.col("n") + least) * percent / (100 + percent) - 1e-9)
    fits = held.filter(F.col("at") <= F.col("n") - need + 1)
    return fits.select("value", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large"), "set", "n", "own")


def _parities(texts: DataFrame, size: int) -> DataFrame:
    """(set, bits): for each of PARITIES parts of the values' range, whether a set holds an odd number of values there.

    Two sets differ in at least as many values as their bits differ, so bits bound the similarity from above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                odd = np.bincount((_mix(shingles(batch.column(1)[i].as_py() or "", size)) % _PARTS).astype(np.int64), minlength=PARITIES) & 1
                out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["set", "bits"])

    return texts.select("set", "text").mapInArrow(run, "`set` bigint, bits array<bigint>")


def _across(lists: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """(set, other): members of one list, of its two size classes, that lie in different components and can be similar by
    their sizes and parities. Of a list's largest component, members are compared with those outside it only."""
    key = ["value", "small", "large"]
    roots = lists.groupBy(*key, "root").agg(F.count("*").alias("members"), F.min("own").alias("least"), F.max("own").alias("most"))
    top = roots.groupBy(*key).agg(F.max_by("root", F.struct("members", "root")).alias("top"), F.count("*").alias("roots"), F.min("least").alias("least"), F.max("most").alias("most"))
    top = top.filter("roots > 1 and least = small and most = large").drop("roots", "least", "most")
    live = materialize(lists.join(top, key).join(parities, "set"))
    other = live.select(*key, F.col("set").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"), F.col("own").alias("other_own"), F.col("bits").alias("other_bits"))
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other_bits")[i])) for i in range(PARITIES // 64)])
    near = (F.col("n") + F.col("m") - apart) * 100 >= (F.col("n") + F.col("m") + apart) * percent
    sizes = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    once = (F.col("other_root") == F.col("top")) | (F.col("set") < F.col("other"))
    return live.filter("root <> top").join(other, key).filter((F.col("root") != F.col("other_root")) & (F.col("own") + F.col("other_own") == F.col("small") + F.col("large")) & sizes & once & near).select("set", "other")


def link_classes(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect all that are linked. classes: set, n, sketch, row."""
    threshold = percent / 100
    shared = least_shared(threshold)
    lists = materialize(_prefixes(classes, shared, threshold))
    small = classes.select("set", "n", "sketch", "row")
    keyed = docs.select(wide_key("doc_id", "text").alias("row"), "text")
    links, tried, roots = None, None, None

    def texts_of(sets: DataFrame) -> DataFrame:
        ends = materialize(sets.join(small.select("set", "row"), "set"))
        return keyed.join(at_most(ends, BROADCAST_ROWS), "row").dropDuplicates(["set"]).select("set", "text")

    for last in (False, True):
        now = _labelled(lists, roots)
        spread = now.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("set", "n", "root"), F.struct(-F.col("weight"), "set")).alias("pivot")).filter("lo <> hi")
        live = now.join(spread, "value")
        if not last:  # with the member that has most in common with the others
            near = live.filter("root <> pivot.root").select("set", "n", F.col("pivot.set").alias("other"), F.col("pivot.n").alias("m"))
            near = near.filter((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent))
        else:
            involved = materialize(live.select("set", "n").distinct())
            texts = texts_of(involved.select("set"))
            near = _across(_labelled(_listed(involved, texts, size, percent), roots), _parities(texts, size), percent)
        pairs = near.select(F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        sides = [small.select(F.col("set").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
        pairs = materialize(pairs.join(sides[0], "a").join(sides[1], "b").filter(_likely("sketch_a", "sketch_b", shared, threshold)).select("a", "b"))
        if pairs.isEmpty():
            continue
        tried = pairs
        found = materialize(_confirmed(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()), size, percent))
        links = found if links is None else links.unionByName(found)
        if not last:
            roots = connected_components(links, 2, settle=False)
    return links if links is not None else docs.sparkSession.createDataFrame([], "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable), kept (id is the component's)."""
    return _near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row (wide_key), n_shingles, component_id and keeper (row of the component's first document: of the smallest id, then row)."""
    bytes_of_batches(docs.sparkSession)
    rows = _renamed(materialize(sketch(docs, size)))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    classes = materialize(
        rows.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min_by(F.struct("doc_id", "row", "n", "sketch"), first).alias("x")).select("set", "x.doc_id", "x.row", "x.n", "x.sketch")
    )
    links = link_classes(classes, docs, size, percent)
    roots = connected_components(links)
    named = classes.select("set", first.alias("first")).join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    names = named.groupBy("root").agg(F.min("first").alias("first"))
    named = named.select("set", "root").join(names, "root").select("set", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keeper"))
    out = rows.select("doc_id", "row", "n", "set").join(named, "set", "left")
    alone = F.col("set").isNull()
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("keeper")).alias("keeper"))


def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component; all columns stay. Rows of equal id and text are one document, null ids and texts
    included; documents without words are linked with nothing, so each of them stays."""
    found = materialize(_near_duplicates(docs, size, percent).select("row", "keeper"))
    gone = materialize(found.filter("row <> keeper").select(F.col("row").alias("__row")).distinct())
    left = docs.withColumn("__row", wide_key("doc_id", "text")).join(at_most(gone, BROADCAST_ROWS), "__row", "left_anti")
    repeated = materialize(found.filter("row = keeper").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row").alias("__row")))
    if not repeated.isEmpty():  # only these rows are moved
        repeated = at_most(repeated, BROADCAST_ROWS)
        once = left.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
        left = left.join(repeated, "__row", "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
