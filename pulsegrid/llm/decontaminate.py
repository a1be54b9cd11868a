"""Benchmark decontamination by winnowing.

Of the hashes of all `gram`-word runs of a text, the smallest in every window of `span` words is kept, so two texts that share
`span` words share a kept hash. Kept hashes of documents and benchmark items are joined; where a document's window has one, the
hit is extended to the whole window, which has to be one of an item's, and windows that touch or overlap are put together to
runs of hit words. No Python.

A document gives one row for each of its windows, whatever its items: neither its words nor an item's stand beside a place, so
words that are repeated thousands of times cost no more than others. Items shorter than `span` words are windows of their own
length, found in the same pass by the smallest run in them (by themselves, if shorter than `gram`).

Null and empty texts have no words and are never hit; very long texts are read whole, with a few bytes for each word; repeated
rows each get the same answer; items of equal text all count; empty tables give an empty table, or no hits. Only the named
columns are read. Keys of rows and hashes of windows have 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import at_most, materialize, wide_key, words_of

SPAN, GRAM = 13, 4
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Kept hashes and windows of the benchmark and keys of documents are broadcast up to these counts, else shuffled.
BROADCAST_ROWS = 1_000_000
#: A window that many documents hold is dealt to so many tasks where windows are shuffled.
SALTS = 16


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _hash(hashes: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(k)])


def _grams(hashes: Column, k: int) -> Column:
    """A hash of every run of k words."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda _, i: _hash(hashes, i, k))


def _least(values: Column, width: int, then) -> Column:  # noqa: ANN001
    """then(the smallest of every `width` neighbours): neighbourhoods are doubled until they are wide enough."""

    def widened(low: Column, done: int) -> Column:
        step = min(done, width - done)
        if not step:
            return then(low)
        some = F.greatest(F.size(low) - step, F.lit(0))
        return _let(F.zip_with(F.slice(low, 1, some), F.slice(low, step + 1, some), lambda a, b: F.least(a, b)), lambda x: widened(x, done + step))

    return widened(values, 1)


def _windows(df: DataFrame, lengths: list[int], gram: int, keys: list[str]) -> DataFrame:
    """df (words) → keys, k (window's length), low (its kept hash: of its smallest run, or its own if it is shorter than one), g and h
    (128 bits of all of it) and at (its place), for every window."""

    def of(g: Column, h: Column, grams: Column, k: int) -> Column:
        shape = lambda low, i: F.struct(F.lit(k).alias("k"), low.alias("low"), _hash(g, i, k).alias("g"), _hash(h, i, k).alias("h"), i.alias("at"))
        return _let(_grams(g, k), lambda low: F.transform(low, shape)) if k < gram else _least(grams, k - gram + 1, lambda low: F.transform(low, shape))

    first, second = F.transform("words", lambda w: F.xxhash64(w)), F.transform("words", lambda w: F.xxhash64(F.lit(1), w))
    made = _let(first, lambda g: _let(second, lambda h: _let(_grams(g, gram), lambda grams: F.concat(*[of(g, h, grams, k) for k in lengths]))))
    return df.select(*keys, F.explode(made).alias("w")).select(*keys, "w.*")


def _kept(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """key and low: what a document can share with a window of such lengths. Where there are windows of several lengths, which keep
    their smallest runs at different places, all runs are given."""
    short, some = [k for k in lengths if k < gram], [k for k in lengths if k >= gram]

    def lows(g: Column) -> Column:
        each = [_grams(g, k) for k in short]
        if some:
            each.append(_let(_grams(g, gram), lambda x: _least(x, some[0] - gram + 1 if len(some) == 1 else 1, lambda low: low)))
        return F.array_distinct(F.concat(*each))

    return df.select("key", F.explode(_let(F.transform("words", lambda w: F.xxhash64(w)), lows)).alias("low"))


def _tokens(df: DataFrame, text: str, *keys: Column | str) -> DataFrame:
    return df.select(*keys, words_of(F.col(text)).alias("words"))


def find_hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Maximal runs of hit words as (key, first, last), where key is wide_key(doc_id, text), and (key, item_id) of the items hit."""
    texts = materialize(_tokens(items, "text", "item_id").filter(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(span))))
    lengths = sorted(r["n"] for r in texts.select("n").distinct().collect()) or [span]  # at most span rows
    window = ["k", "low", "g", "h"]
    held = materialize(_windows(texts, lengths, gram, ["item_id", "n"]).filter("k = n").select("item_id", *window).distinct())
    windows = materialize(held.select(*window).distinct())
    kept = at_most(windows.select("low").distinct(), BROADCAST_ROWS)
    keyed = docs.select(wide_key("doc_id", "text").alias("key"), "text")
    near = materialize(_kept(_tokens(keyed, "text", "key"), lengths, gram).join(kept, "low", "left_semi").select("key").distinct())
    some = keyed.join(at_most(near, BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"])
    places = _windows(_tokens(some, "text", "key"), lengths, gram, ["key"])
    if windows.count() <= BROADCAST_ROWS:
        hits = places.join(F.broadcast(windows), window, "left_semi")
    else:
        salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = places.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, [*window, "salt"], "left_semi").drop("salt")
    hits = materialize(hits)
    spans = hits.groupBy("key", F.col("at").alias("first")).agg((F.col("first") + F.max("k") - 1).alias("last"))
    w = Window.partitionBy("key").orderBy("first")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")
    owners = hits.select("key", *window).distinct().join(held, window).select("key", "item_id").distinct()
    return runs, owners


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated."""
    runs, owners = find_hits(docs, items, span)
    counted = runs.groupBy("key").agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("n_hit"))
    owners = owners.select("key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = owners.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    n_words = F.size(words_of(F.col("text"))).cast("long")
    every = docs.select("doc_id", wide_key("doc_id", "text").alias("key"), n_words.alias("n_words"))
    out = every.join(counted.join(listed, "key", "left"), "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones; all columns stay."""
    bad = contamination(docs, items).filter("contaminated").select(F.col("key").alias("__key")).distinct()
    return docs.join(at_most(materialize(bad), BROADCAST_ROWS), wide_key("doc_id", "text") == F.col("__key"), "left_anti")
