"""Sharding by balanced label propagation.

Rows of equal text are linked. Every row starts in a shard by its hash. Then, in rounds of joins, linked rows move to the
shard that holds most of their neighbours, as far as the target's quota allows, which cuts few links and keeps shards even.
Rows of one group in one shard are interchangeable, so the rounds work on a row for each group and shard, with their number:
a hot group costs no more than any other.

At last `balance` makes the law `rows` exact (counts differ by one at most). It works on counts of groups by shard and size:
shards that hold too much give whole groups away, and these fill the others, largest first, smaller groups making room. A
group is cut only if it is larger than a shard or if no shard can make room for it. No Python but for these counts.

Ranks come from counts by bucket and row numbers inside buckets of about ROWS_PER_BUCKET rows, never from one sorted task.
The driver sees the number of rows, in each round at most BINS x shards x shards counts, and one count for each shard and
group size (sizes that differ are at most the square root of twice the rows). What it sends back, which groups move and where
the few that are cut are cut, is no larger.

Null texts are empty texts and are linked to them; repeated rows are rows of their own; null ids are allowed; an empty table
gives an empty table. Texts are hashed whole. Only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most, materialize, small_table

#: Quotas leave some slack while rows move; the balance at the end makes shards exactly even.
SHARDS, ROUNDS, SLACK = 24, 3, 0.25
BINS, ROWS_PER_BUCKET = 16, 2000
#: Parts of a group of equal texts for each bucket that its rows would fill.
PARTS = 16
#: Groups of more rows are joined by a broadcast of their keys; there is one for so many rows at most, and beyond BROADCAST_ROWS they are shuffled.
HOT_ROWS, BROADCAST_ROWS = 2000, 500_000
FLOWS = "own int, best int, bin int"
Cell = tuple[int, int]  # a shard and a size of groups in it


def _part(parts: Column, *by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.greatest(parts, F.lit(1)))


def keyed_rows(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, grp (equal texts share it) and shard, where a row starts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("grp"))
    return rows.withColumn("shard", _part(F.lit(shards), F.lit(7), F.col("doc_id"), F.col("grp")).cast("int"))


def _admitted(flows: list, loads: Counter, quota: int) -> list[tuple[int, int, int]]:
    """Which flows (from shard, to shard, bin) may go, largest first, so that no shard exceeds its quota; leavers make room for others."""
    out, left = [], sorted(flows, key=lambda f: (-f["n"], f["own"], f["best"], f["bin"]))
    while left:
        stay = []
        for f in left:
            if loads[f["best"]] + f["n"] <= quota:
                loads[f["best"]] += f["n"]
                loads[f["own"]] -= f["n"]
                out.append((f["own"], f["best"], f["bin"]))
            else:
                stay.append(f)
        if len(stay) == len(left):
            break
        left = stay
    return out


def _best(cells: DataFrame, turn: int) -> DataFrame:
    """(grp, best): the shard that holds most of a group; ties fall evenly on shards."""
    return cells.groupBy("grp").agg(F.max_by("shard", F.struct("n", F.xxhash64("grp", "shard", F.lit(turn)))).alias("best"))


def propagate(cells: DataFrame, loads: Counter, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """(grp, home): where each group has most of its rows after so many rounds of moves. cells: grp, shard and n, the rows of a
    group in a shard; loads: rows in each shard, those without neighbours included."""
    for turn in range(rounds):
        wished = materialize(cells.join(_best(cells, turn), "grp").withColumn("bin", _part(F.lit(BINS), F.col("grp")).cast("int")))
        flows = wished.filter(F.col("best") != F.col("shard")).groupBy(F.col("shard").alias("own"), "best", "bin").agg(F.sum("n").alias("n")).collect()
        go = _admitted(flows, loads, quota)
        if not go:
            break
        allowed = F.broadcast(small_table(cells.sparkSession, go, FLOWS).withColumn("go", F.lit(True)))  # BINS x shards x shards rows at most
        moved = wished.withColumnRenamed("shard", "own").join(allowed, ["own", "best", "bin"], "left")
        cells = moved.groupBy("grp", F.when(F.col("go"), F.col("best")).otherwise(F.col("own")).alias("shard")).agg(F.sum("n").alias("n"))
    return _best(cells, rounds).withColumnRenamed("best", "home")


class Balance:
    """Which groups move so that every shard holds just what it may. held: groups of each (shard, size); capacity: rows by shard.

    Groups of one cell are numbered from 0: `moves` has (first, last, to) for groups of a cell, `cuts` has (first, last, to)
    for rows of one group (shard, size, number).
    """

    def __init__(self, held: dict[Cell, int], capacity: list[int]) -> None:
        self.capacity = capacity
        self.moves: dict[Cell, list[tuple[int, int, int]]] = defaultdict(list)
        self.cuts: dict[tuple[int, int, int], list[tuple[int, int, int]]] = defaultdict(list)
        self.own = [Counter() for _ in capacity]
        for (k, size), n in held.items():
            self.own[k][size] += n
        self.given: Counter = Counter()
        self.pool: dict[int, list[list[int]]] = defaultdict(list)  # size → [home, first number, groups]
        self.free = [c - sum(s * n for s, n in own.items()) for c, own in zip(capacity, self.own, strict=True)]
        for k in range(len(capacity)):
            for size in [s for s in self.own[k] if s > capacity[k]]:
                self._give(k, size, self.own[k][size])
            if self.free[k] < 0:
                self._make_room(k, 0, 2**63)
        while self.pool:
            size = max(self.pool)
            for home, first, n in self.pool.pop(size):
                self._place(home, size, first, n)

    def _give(self, k: int, size: int, n: int) -> None:
        first = self.given[k, size]
        self.pool[size].append([k, first, n])
        self.given[k, size] += n
        self.own[k][size] -= n
        self.free[k] += size * n

    def _make_room(self, k: int, rows: int, below: int) -> bool:
        """Whether shard k can have so many rows free, giving away groups smaller than `below`; if so, it has."""
        need, leave = rows - self.free[k], []
        for size in sorted((s for s, n in self.own[k].items() if n and s < below), reverse=True):
            if n := min(self.own[k][size], need // size):
                leave.append((size, n))
                need -= size * n
        if need > 0:
            used = dict(leave)
            more = min((s for s, n in self.own[k].items() if s < below and n > used.get(s, 0)), default=None)
            if more is None:
                return False
            leave.append((more, 1))
        for size, n in leave:
            self._give(k, size, n)
        return True

    def _place(self, home: int, size: int, first: int, n: int) -> None:
        for k in sorted(range(len(self.free)), key=lambda k: -self.free[k]):
            if some := min(n, self.free[k] // size):
                self.moves[home, size].append((first, first + some, k))
                self.free[k] -= size * some
                first, n = first + some, n - some
        for number in range(first, first + n):
            if (k := self._roomy(size)) is not None:
                self.moves[home, size].append((number, number + 1, k))
                self.free[k] -= size
                continue
            done = 0
            while done < size:  # cut it, into as few parts as may be
                k = self._roomy(min(size - done, max(self.capacity)))
                k = max(range(len(self.free)), key=lambda k: self.free[k]) if k is None else k
                part = min(size - done, self.free[k])
                self.cuts[home, size, number].append((done, done + part, k))
                self.free[k] -= part
                done += part

    def _roomy(self, rows: int) -> int | None:
        """A shard that has so many rows free, or makes room for them."""
        for k in sorted(range(len(self.free)), key=lambda k: -self.free[k]):
            if self.capacity[k] >= rows and (self.free[k] >= rows or self._make_room(k, rows, rows)):
                return k
        return None


def _numbered(df: DataFrame, keys: list[str], rows: Column, by: Column, order: list[str | Column]) -> DataFrame:
    """df with `no`, from 0 within the keys; rows: about how many rows the keys have. From counts by bucket, and numbers inside buckets."""
    spread = materialize(df.withColumn("bucket", _part(F.ceil(rows / ROWS_PER_BUCKET), by)))
    counts = spread.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "bucket", F.coalesce(before, F.lit(0)).alias("__from"))
    inside = spread.withColumn("no", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1)
    return inside.join(at_most(materialize(starts), 100_000), [*keys, "bucket"]).withColumn("no", F.col("__from") + F.col("no")).drop("bucket", "__from")


def _where(intervals: str, no: str) -> Column:
    """The shard of the interval in which a number lies, or null."""
    return F.get(F.filter(intervals, lambda x: (F.col(no) >= x["first"]) & (F.col(no) < x["last"])), 0)["to"]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = materialize(keyed_rows(docs, shards))
    cells = materialize(rows.groupBy("grp", "shard").agg(F.count("*").alias("n")))
    sums = cells.groupBy("grp").agg(F.sum("n").alias("same"))
    groups = materialize(cells.join(sums.filter("same > 1"), "grp"))
    loads = Counter({r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()})
    grouped = Counter({r["shard"]: r["n"] for r in groups.groupBy("shard").agg(F.sum("n").alias("n")).collect()})
    alone = {k: loads[k] - grouped[k] for k in range(shards)}
    total = loads.total()
    capacity = [-(-(k + 1) * total // shards) - -(-k * total // shards) for k in range(shards)]

    home = propagate(groups.select("grp", "shard", "n"), Counter(loads), int(total / shards * (1 + SLACK)) + 1)
    homes = materialize(home.join(groups.groupBy("grp").agg(F.first("same").alias("same")), "grp"))
    held = {(r["home"], r["same"]): r["n"] for r in homes.groupBy("home", "same").agg(F.count("*").alias("n")).collect()}
    plan = Balance(held | {(k, 1): n for k, n in alone.items() if n}, capacity)

    interval = "array<struct<first:bigint,last:bigint,to:int>>"
    named = lambda x: [dict(zip(("first", "last", "to"), i, strict=True)) for i in x]
    moves = small_table(spark, [(k, size, held.get((k, size), alone[k]), named(x)) for (k, size), x in plan.moves.items()], f"home int, same bigint, cell bigint, moves {interval}")
    cuts = small_table(spark, [(*key, named(x)) for key, x in plan.cuts.items()], f"home int, same bigint, no bigint, cuts {interval}")

    # groups: only cells from which some move, or are cut, are numbered
    touched = {(k, size) for k, size in plan.moves if size > 1} | {key[:2] for key in plan.cuts}
    marks = F.broadcast(small_table(spark, [(*c, held[c]) for c in touched], "home int, same bigint, cell bigint"))
    numbered = _numbered(homes.join(marks, ["home", "same"]), ["home", "same"], F.col("cell"), F.col("grp"), ["grp"])
    numbered = numbered.select("grp", "home", "same", "no").join(F.broadcast(moves.drop("cell")), ["home", "same"], "left").join(F.broadcast(cuts), ["home", "same", "no"], "left")
    settled = numbered.select("grp", "same", F.coalesce(_where("moves", "no"), F.col("home")).alias("to"), "cuts")
    settled = materialize(homes.join(marks, ["home", "same"], "left_anti").select("grp", "same", F.col("home").alias("to"), F.lit(None).cast(interval).alias("cuts")).unionByName(settled))

    # rows of large groups are joined by broadcast, so that none of these meets in one task
    large = F.col("same") > HOT_ROWS
    hot = at_most(settled.filter(large), BROADCAST_ROWS).withColumnRenamed("to", "hot_to").withColumnRenamed("cuts", "hot_cuts").withColumnRenamed("same", "hot_same")
    dealt = rows.withColumnRenamed("shard", "start").join(hot, "grp", "left")
    dealt = dealt.withColumn("key", F.when(F.col("hot_to").isNull(), F.col("grp")).otherwise(F.xxhash64("doc_id", F.lit(11))))
    dealt = materialize(dealt.join(settled.filter(~large).withColumnRenamed("grp", "key"), "key", "left").select(
        "doc_id", "size", "text_crc32", "grp", "start", F.coalesce("hot_same", F.when(F.col("key") == F.col("grp"), F.col("same"))).alias("same"),
        F.coalesce("hot_to", F.when(F.col("key") == F.col("grp"), F.col("to"))).alias("to"), F.when(F.col("hot_to").isNull(), F.col("cuts")).otherwise(F.col("hot_cuts")).alias("cuts"),
    ))

    cut = _numbered(dealt.filter(F.col("cuts").isNotNull()), ["grp"], F.col("same"), F.col("doc_id"), ["doc_id"]).withColumn("shard", _where("cuts", "no"))
    single = dealt.filter("to is null").join(F.broadcast(moves.filter("same = 1").select(F.col("home").alias("start"), "cell", "moves")), "start", "left")
    moving = _numbered(single.filter("moves is not null"), ["start"], F.col("cell"), F.xxhash64("doc_id", "grp"), ["grp", "doc_id"]).withColumn("shard", F.coalesce(_where("moves", "no"), F.col("start")))
    names = ["doc_id", "size", "text_crc32", "grp", "shard", F.coalesce("same", F.lit(1)).alias("same")]
    whole = dealt.filter(F.col("to").isNotNull() & F.col("cuts").isNull()).withColumn("shard", F.col("to"))
    placed = whole.select(*names).unionByName(single.filter("moves is null").withColumn("shard", F.col("start")).select(*names)).unionByName(moving.select(*names)).unionByName(cut.select(*names))
    # rows of a group stay together in some parts of it, many for a large one, so that no bucket gets all of them
    parts = F.greatest(F.lit(8), F.ceil(F.col("same") * (PARTS / ROWS_PER_BUCKET)))
    slots = _numbered(placed, ["shard"], F.lit(max(1, total // shards)), F.xxhash64("grp", _part(parts, F.col("doc_id"))), ["grp", "doc_id"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("no").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_groups(docs: DataFrame, sharded: DataFrame) -> DataFrame:
    """One row on groups of equal texts: n_groups (of two rows or more), n_cut (that lie in several shards), least_cut (those
    larger than the largest shard, which any law would cut) and cut_links (shards of each group beyond the first, added up).

    sharded: what `shard` returns for docs; ids must be distinct.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text, F.crc32(text)).alias("grp")).join(sharded.select("doc_id", "shard"), "doc_id")
    cells = own.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("grp").agg(F.sum("n").alias("same"), F.count("*").alias("parts")).filter("same > 1")
    largest = sharded.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("parts") > 1).alias("n_cut"), F.count_if(F.col("same") > largest).alias("least_cut"), F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("cut_links"))
