"""Ranked lexical search by bag deduplication: for each item, the TOP documents of the highest integer BM25 scores.

Items are taken in blocks of a bounded number of terms. For each block every text of the corpus is read whole and restricted to
the block's vocabulary: what is left of it is its bag, the frequencies of these terms, and its length m relative to the mean.
Documents of equal bag and m have equal scores with every item, so they form a class: grouped by a hash of both and verified by
both themselves. Each class is scored once, by numpy over many classes and items at a time; of each item, tasks keep the TOP
classes by score and smallest doc_id, which hold its TOP documents. At last the chosen classes are expanded to members by
ascending doc_id, at most TOP of each, and ranked.

Scores: a term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document's score is the sum over the item's terms, repeats
included, of weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + (25 n N) div L. N counts documents with a term, L their terms.

Null and empty texts, and those without a term, count in nothing and are never found; items without terms have no rows; rows of
equal item_id and text are one item, those of one id and different texts items of their own; repeated documents are documents of
their own; ids that are null come last among equal scores. Texts are cut at blanks while they are counted, so memory grows with a
text's distinct terms only. Tables may have other columns of any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import at_most, bytes_of_batches, written

TOP = 20
#: Terms of all items of a block, about; an item of more is a block of its own.
BLOCK_TERMS = 100_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 20
#: Scores of classes and items, and what they are summed up from, that a task holds at a time, about.
CELLS = 1 << 20
#: Chosen classes of a block are broadcast up to this count.
BROADCAST_ROWS = 100_000

#: Bytes of terms, lower-cased; all others become blanks.
_TERMS = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i > 0x7F else 0x20 for i in range(256))


def term_counts(raw: bytes) -> Counter:
    """How often each term stands in a text's UTF-8 bytes."""
    plain = raw.translate(_TERMS)
    if len(plain) <= PIECE:
        return Counter(plain.split())
    counts: Counter = Counter()
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms), terms (numbers in the vocabulary, ascending) and tfs, for every text with a term."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, at, terms, tfs = [], [], [0], [], []
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                if counts := term_counts(texts[i].as_py() or b""):
                    own = sorted((number[w], c) for w, c in counts.items() if w in number)
                    ids.append(i)
                    ns.append(sum(counts.values()))
                    terms += [t for t, _ in own]
                    tfs += [c for _, c in own]
                    at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def _kept(item: np.ndarray, score: np.ndarray, first: np.ndarray, top: int) -> np.ndarray:
    """Which candidates are among their item's best, by score and then by the smallest first."""
    order = np.lexsort((first, -score, item))
    start = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
    return order[place < top]


def _best_classes(classes: DataFrame, postings: tuple[np.ndarray, ...], weights: np.ndarray, n_items: int, top: int) -> DataFrame:
    """item (number in the block), score, first and the class, of each task's best classes of each item."""
    begins, items, repeats = postings  # of each term: the items that hold it, and how often

    def scores(m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(m)), sizes)
        gain = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[owner]))
        many = begins[terms + 1] - begins[terms]
        at = np.repeat(begins[terms] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out = np.zeros(len(m) * n_items, np.int64)
        cell = np.repeat(owner * n_items, many) + items[at]
        value = np.repeat(gain, many) * repeats[at]
        # sums of halves, which are exact as doubles
        for shift in (0, 26):
            out += np.bincount(cell, ((value >> shift) & ((1 << 26) - 1)) if not shift else value >> shift, len(out)).astype(np.int64) << shift
        return out.reshape(len(m), n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        item, score, first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.ones(n_items, np.int64)
        for whole in batches:
            parts = np.concatenate([[0], np.cumsum(begins[(t := whole.column(4).flatten().to_numpy()) + 1] - begins[t])])
            work = parts[whole.column(4).offsets.to_numpy() - whole.column(4).offsets[0].as_py()] + np.arange(whole.num_rows + 1) * n_items
            end = 0
            while end < whole.num_rows:
                begin, end = end, max(end + 1, int(np.searchsorted(work, work[end] + CELLS, side="right")) - 1)
                batch = whole.slice(begin, end - begin)
                m, ids = batch.column(2).to_numpy(), batch.column(3).fill_null(np.iinfo(np.int64).max).to_numpy()
                found = scores(m, np.diff(batch.column(4).offsets.to_numpy()), batch.column(4).flatten().to_numpy().astype(np.int64), batch.column(5).flatten().to_numpy())
                row, col = np.nonzero(found >= least)
                item, score, first = np.concatenate([item, col]), np.concatenate([score, found[row, col]]), np.concatenate([first, ids[row]])
                part = pa.Table.from_batches([batch]).take(pa.array(row))
                held = part if held is None else pa.concat_tables([held, part])
                some = _kept(item, score, first, top)
                item, score, first, held = item[some], score[some], first[some], held.take(pa.array(some)).combine_chunks()
                full = np.flatnonzero(np.bincount(item, minlength=n_items) >= top)
                lowest = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, item, score)
                least[full] = lowest[full]
        if held is not None and len(item):
            for part in held.append_column("item", pa.array(item, pa.int32())).append_column("score", pa.array(score)).to_batches(max_chunksize=1000):
                yield part

    kind = classes.schema["first"].dataType.simpleString()
    return classes.mapInArrow(run, f"a bigint, b bigint, m bigint, first {kind}, terms array<int>, tfs array<bigint>, item int, score bigint")


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """item_id, rank, doc_id and score of a block's items: rows of item_id and text."""
    spark = docs.sparkSession
    counts = [term_counts((r["text"] or "").encode()) for r in rows]
    vocabulary = sorted(set().union(*counts))
    number = {w: i for i, w in enumerate(vocabulary)}
    each = sorted((number[w], i, c) for i, own in enumerate(counts) for w, c in own.items())
    terms, items, repeats = (np.array([e[j] for e in each], np.int64) for j in range(3))
    bags = written(_bags(docs, vocabulary), "bags")
    sums = bags.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in bags.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * sums["N"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    m = F.expr(f"75L + (25L * n * {sums['N']}L) div {max(1, sums['L'])}L")
    bag = ["a", "b", "m", "terms", "tfs"]
    hashed = bags.filter(F.size("terms") > 0).withColumn("m", m).select("doc_id", F.xxhash64("m", "terms", "tfs").alias("a"), F.xxhash64(F.lit(1), "m", "terms", "tfs").alias("b"), "m", "terms", "tfs")
    classes = hashed.groupBy(*bag).agg(F.min("doc_id").alias("first")).select("a", "b", "m", "first", "terms", "tfs")
    bytes_of_batches(spark)
    best = _best_classes(classes, (np.searchsorted(terms, np.arange(len(vocabulary) + 1)), items, repeats), weights, len(rows), top)
    order = [F.desc("score"), F.asc_nulls_last("first"), "a", "b"]
    chosen = best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("place") <= top)
    chosen = written(chosen.drop("place", "first"), "classes")
    members = hashed.join(at_most(chosen.select(*bag).distinct(), BROADCAST_ROWS), bag).select("a", "b", "m", "doc_id")
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("a", "b", "m").orderBy(F.asc_nulls_last("doc_id")))).filter(F.col("place") <= top).drop("place")
    ranked = chosen.select("item", "score", "a", "b", "m").join(members, ["a", "b", "m"])
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= top)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(rows)), pa.int32()), "item_id": pa.array([r["item_id"] for r in rows])}))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best documents. docs: doc_id and text; items: item_id and text."""
    asked = items.select("item_id", "text").filter("text is not null").distinct()
    asked = asked.withColumn("size", F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))).filter("size > 0")
    asked = written(asked, "items")
    total = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        if rows:
            found = _block(docs.select("doc_id", "text"), rows, top)
            found = written(found, "ranked") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("item_id", items), ("doc_id", docs))]
        return docs.sparkSession.createDataFrame([], f"{kinds[0]}, rank int, {kinds[1]}, score bigint")
    return out
