"""Prefix trie of conversations by ROLLUP over positional columns of turn ids.

A turn's id is made of its role and text (128 bits, and the words of the text). A conversation is cut into blocks of WIDTH turns;
a row holds one block: its root, the node that the blocks before it lead to, and a column of a turn id for each position. One
ROLLUP over (root, t1, ..., tWIDTH) aggregates all prefixes of all blocks together; grouping_id tells a group's depth. Roots are
known before: a node's key combines hashes of its turn ids, each with its position, so blocks need no order.

Sums over subtrees (leaves, tokens) are a second ROLLUP, over the nodes. What lies in later blocks is summed up by block first,
and the blocks' roots form a tree of the same kind, WIDTH times as flat; its subtree sums, by the same function, go to the nodes
that these roots are. So conversations of any length take one such step for each power of WIDTH in it.

`rebuild` lets conversations share first turns, as a template store would: conversation c begins with the first h turns of
conversation c - c % GROUP, h = crc32(c) % (HEAD + 1), and goes on with its own after its first h.

Turns stand in order of `turn`, nulls first; equal ones by role and the digest of the text. Null roles and texts are empty. Rows without a conv_id
belong to no conversation and are left out. Conversations without a turn (also by `rebuild`) end at the root. Repeated rows are
turns of their own. Other columns are not read; an empty table has no nodes. Turns of a conversation are numbered by one sort,
and the ids of members that end at a node are hashed in one stream, as their digest asks for; neither is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WIDTH = 8
HEAD, GROUP = 3, 20
#: Ids that are joined to one text before they are hashed.
CHUNK = 4096
_TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), and t: a turn's id (a, b) and the words of its text (w)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    turn = F.struct(F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), words.alias("w"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint"), "turn", role.alias("role"), F.md5(text).alias("digest"), turn.alias("t"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest"))
    return own.select("conv_id", pos.alias("pos"), "t")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, and (conv_id, n), also of those that have none."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    c = F.col("conv_id")
    sizes = sizes.withColumns({"h": F.crc32(c.cast("string")) % (HEAD + 1), "from": c - c % GROUP})
    heads = written(turns.filter((c % GROUP == 0) & (F.col("pos") <= HEAD)).select(c.alias("from"), "pos", "t"), "heads")
    lengths = heads.groupBy("from").agg(F.count("*").alias("has"))
    sizes = sizes.join(lengths, "from", "left").withColumn("took", F.least("h", F.coalesce("has", F.lit(0))))
    sizes = written(sizes.select("conv_id", "own", "h", "from", "took"), "sizes")
    first = sizes.join(heads, "from").filter("pos <= h").select("conv_id", "pos", "t")
    rest = turns.join(sizes, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("took")).cast("int").alias("pos"), "t")
    n = F.col("took") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return first.unionByName(rest), sizes.select("conv_id", n.cast("long").alias("n"))


def _mixed(t: Column, pos: Column) -> tuple[Column, Column]:
    """What a turn at a place adds to the keys of the nodes below; nothing, if there is none."""
    return tuple(F.when(t.isNotNull(), F.xxhash64(t[x], pos.cast("long"))).otherwise(F.lit(0).cast("long")) for x in "ab")


def _key(root: Column, start: Column, columns: list[Column]) -> Column:
    """The key of the node that these turns lead to from a root at depth start."""
    mixed = [_mixed(t, start + (j + 1)) for j, t in enumerate(columns)]
    return F.struct(*[reduce(lambda x, y: x.bitwiseXOR(y), [m[i] for m in mixed], root[x]).alias(x) for i, x in enumerate("ab")])


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def blocks_of(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, block (from 0), root, t1 ..., key (the node at the block's end) for every block of every conversation, a blank one if it has no turn."""
    block, place = F.floor((F.col("pos") - 1) / WIDTH).cast("long"), (F.col("pos") - 1) % WIDTH + 1
    a, b = _mixed(F.col("t"), F.col("pos"))
    cut = turns.withColumns({"block": block, "j": place}).groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("j") == j, F.col("t"))).alias(f"t{j}") for j in range(1, WIDTH + 1)], F.bit_xor(a).alias("xa"), F.bit_xor(b).alias("xb")
    )
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({x: F.bit_xor(x).over(so_far) for x in ("xa", "xb")} | {f"own_{x}": F.col(x) for x in ("xa", "xb")})
    key = F.struct(F.col("xa").alias("a"), F.col("xb").alias("b"))
    root = F.struct(F.col("xa").bitwiseXOR(F.col("own_xa")).alias("a"), F.col("xb").bitwiseXOR(F.col("own_xb")).alias("b"))
    cut = cut.select("conv_id", "block", root.alias("root"), *_TURNS, key.alias("key"))
    none = sizes.filter("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), _root().alias("root"), *[F.lit(None).cast(turns.schema["t"].dataType).alias(t) for t in _TURNS], _root().alias("key"))
    return cut.unionByName(none)


def _depth(columns: list[str]) -> Column:
    """How many columns a group of ROLLUP(root, columns) keeps; -1 for all rows together."""
    return F.lit(len(columns)) - F.bit_count("g")


def nodes_of(blocks: DataFrame) -> DataFrame:
    """block, root, t1 ..., k (turns after the root), key, parent, least conv_id, n_convs, w of every node but the trie's root."""
    rolled = blocks.rollup("root", *_TURNS).agg(F.grouping_id().alias("g"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("block").alias("block"))
    rolled = rolled.withColumn("k", _depth(_TURNS))
    columns, k = [F.col(t) for t in _TURNS], F.col("k")
    last = F.coalesce(*[F.when(k == j + 1, c) for j, c in enumerate(columns)])
    above = [F.when(k > j + 1, c) for j, c in enumerate(columns)]
    start = F.col("block") * WIDTH
    nodes = rolled.filter((k > 0) & last.isNotNull())  # blank columns of shorter conversations make no nodes
    return nodes.select("block", "root", *_TURNS, k.cast("int").alias("k"), (start + k).alias("depth"), _key(F.col("root"), start, columns).alias("key"), _key(F.col("root"), start, above).alias("parent"), "conv_id", "n_convs", last["w"].alias("w"))


def subtree_sums(items: DataFrame, paths: DataFrame | None, level: int, columns: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, values): sums over each item's subtree, itself included, and (root, values): sums over all below each block's root.

    items: key, root, k (columns that are set), columns, values. paths: block roots as items of the level above, see `_paths`.
    """
    sums = [F.sum(v).alias(v) for v in values]
    below = items.groupBy("root").agg(*sums)
    if paths is not None:
        below = written(below, "below")
        own = paths.filter(F.col("level") == level + 1)
        more = paths.filter(F.col("level") > level + 1)
        upper = own.join(below.withColumnRenamed("root", "key"), "key").select("key", "root", "k", *[f"p{j}" for j in range(1, WIDTH + 1)], *values)
        deeper, tops = subtree_sums(upper, more if more.limit(1).count() else None, level + 1, [f"p{j}" for j in range(1, WIDTH + 1)], values)
        # below the trie's root lies what its own block holds and what lies below the roots in it
        top = below.unionByName(tops).filter(F.col("root") == _root()).groupBy("root").agg(*sums)
        all_below = deeper.unionByName(top.withColumnRenamed("root", "key"))
        all_below = written(all_below, "deeper")
        extra = all_below.select("key", *[F.col(v).alias(f"more_{v}") for v in values])
        items = items.join(extra, "key", "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}).drop(*[f"more_{v}" for v in values])
        below = all_below.withColumnRenamed("key", "root")
    rolled = items.rollup("root", *columns).agg(F.grouping_id().alias("g"), *sums, F.min("k").alias("least"), F.min_by("key.a", "k").alias("a"), F.min_by("key.b", "k").alias("b"))
    # of the items below a prefix, the one that ends there is the least
    found = rolled.withColumn("depth", _depth(columns)).filter((F.col("depth") > 0) & (F.col("least") == F.col("depth")))
    return found.select(F.struct("a", "b").alias("key"), *values), below


def _paths(blocks: DataFrame, longest: int) -> DataFrame | None:
    """level, key, root, k, p1 ...: each block root but the trie's own as an item at levels 1, 2, ...: on level i, roots of every
    WIDTH^(i-1)-th block are items, and WIDTH of them, from the one that they come after, make a block."""
    out, level, step = None, 1, 1
    while longest > step * WIDTH:
        some = blocks.filter((F.col("block") > 0) & (F.col("block") % step == 0)).select("conv_id", (F.col("block") / step).cast("long").alias("i"), F.col("root").alias("key"))
        some = some.withColumns({"of": F.floor((F.col("i") - 1) / WIDTH).cast("long"), "k": ((F.col("i") - 1) % WIDTH + 1).cast("int")})
        w = Window.partitionBy("conv_id", "of").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        placed = some.select("*", *[F.max(F.when(F.col("k") == j, F.col("key"))).over(w).alias(f"p{j}") for j in range(1, WIDTH + 1)])
        ends = some.filter(F.col("k") == WIDTH).select("conv_id", (F.col("of") + 1).alias("of"), F.col("key").alias("root"))
        placed = placed.join(ends, ["conv_id", "of"], "left").withColumn("root", F.coalesce("root", _root()))
        placed = placed.dropDuplicates(["key"]).select(F.lit(level).alias("level"), "key", "root", "k", *[f"p{j}" for j in range(1, WIDTH + 1)])
        out = placed if out is None else out.unionByName(placed)
        level, step = level + 1, step * WIDTH
    return None if out is None else written(out, "paths")


def _ends(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, n_ends and ends_sha256 of every node at which conversations end."""
    last = F.greatest(F.floor((F.col("n") - 1) / WIDTH), F.lit(0))
    ends = blocks.join(sizes, "conv_id").filter(F.col("block") == last).select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring ids of one node as one text."""
        key, ids = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "first": [ids[0]], "n": [len(ids)], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for a, b, c in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if ids and (key != (a, b) or len(ids) >= CHUNK):
                    yield made()
                    ids = []
                key = a, b
                ids.append(c)
        if ids:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "n_ends": [n], "ends_sha256": [state.hexdigest()]})

        for batch in batches:
            for a, b, _, m, text in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                if key != (a, b):
                    if state is not None:
                        yield made()
                    key, state, n = (a, b), hashlib.sha256(text.encode()), m
                else:
                    state.update(b"," + text.encode())
                    n += m
        if state is not None:
            yield made()

    single = ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    one = single.filter("n = 1").select("a", "b", F.col("n").alias("n_ends"), F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    several = ends.join(single.filter("n > 1").select("a", "b"), ["a", "b"], "left_semi")
    chunks = several.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(joined, "a bigint, b bigint, first bigint, n bigint, ids string")
    many = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a bigint, b bigint, n_ends bigint, ends_sha256 string")
    return one.unionByName(many).select(F.struct("a", "b").alias("key"), "n_ends", "ends_sha256")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos and t, as of `turns_of`; sizes: conv_id and n, also of conversations without turns.
    """
    sizes = written(sizes, "lengths")
    longest = sizes.agg(F.max("n")).first()[0]
    blocks = written(blocks_of(turns, sizes), "blocks")
    ends = written(_ends(blocks, sizes), "ends")
    below = nodes_of(blocks).join(ends, "key", "left")
    top = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    leaf = F.when(F.coalesce("n_ends", F.lit(0)) == F.col("n_convs"), 1).otherwise(0).cast("long")
    nodes = below.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("w")})
    nodes = written(nodes, "nodes")
    values = ["n_leaves", "saved_tokens"]
    paths = _paths(blocks, longest or 0)
    sums, under = subtree_sums(nodes.select("key", "root", "k", *_TURNS, *values), paths, 0, _TURNS, values)
    none = F.sha2(F.lit(""), 256)
    # the root's row: what members, ends and sums tell of it, put together
    own = lambda df: df.filter(F.col("key") == _root())
    known = top.withColumn("key", _root()).unionByName(own(ends), allowMissingColumns=True).unionByName(own(under.withColumnRenamed("root", "key")).select("key", *values), allowMissingColumns=True)
    start = known.groupBy("key").agg(*[F.max(c).alias(c) for c in ("conv_id", "n_convs", "ends_sha256", *values)])
    start = start.select("key", F.lit(None).cast(nodes.schema["key"].dataType).alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    rest = nodes.drop(*values).join(sums, "key").select("key", "parent", "conv_id", "depth", "n_convs", *values, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    every = start.unionByName(rest)
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(children, "key", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = written(turns_of(conversations), "turns")
    return prefix_trie(*rebuild(turns))
