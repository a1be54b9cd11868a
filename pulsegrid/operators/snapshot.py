"""Comparing a desired snapshot with the stored one, and applying the difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(desired: DataFrame, actual: DataFrame, key: str = "id", checksum: str | None = None, compare: list[str] | None = None, check_duplicates: bool = True) -> DataFrame:
    """(key, op): create, update or delete; equal rows are left out.

    Only the key and what is compared is read, so a wide table is joined as a narrow one; `apply_diff` fetches the rest.
    The checksum wins over compare; without either there are no updates. A key twice on one side is an error.
    """
    compared = [checksum] if checksum else (compare or [])

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col(key), F.struct(F.lit(1), *compared).alias(name))
        if check_duplicates:
            twice = F.raise_error(F.concat(F.lit(f"{name} has a key twice: "), F.col(key).cast("string"))).cast("string")
            own = own.groupBy(key).agg(F.count("*").alias("n"), F.first(name).alias(name))
            own = own.withColumn(name, F.when(F.when(F.col("n") > 1, twice).isNull(), F.col(name)))
        return own

    both = side(desired, "desired").join(side(actual, "actual"), key, "full_outer")
    same = [F.col(f"desired.{c}").eqNullSafe(F.col(f"actual.{c}")) for c in compared]
    changed = ~reduce(lambda a, b: a & b, same) if same else F.lit(False)
    op = F.when(F.col("actual").isNull(), "create").when(F.col("desired").isNull(), "delete").when(changed, "update")
    return both.select(key, op.alias("op")).filter("op is not null")


#: Ranges that a range of the digest tree falls into, and levels at most; ranges of so few rows are not divided any more, and
#: the driver holds so many that differ at most.
FANOUT, LEVELS, LEAF_ROWS, MOST_RANGES = 16, 6, 16, 100_000


def digest_tree_diff(desired: DataFrame, actual: DataFrame, key: str = "id", checksum: str = "checksum", fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, most: int = MOST_RANGES) -> DataFrame:
    """(key, op) like `snapshot_diff` with a checksum, for snapshots that are nearly equal: what is equal is not shuffled row by row.

    Rows lie in leaves: of integer keys ranges, of others a hash. A range of leaves is summed up by the number of its rows and two
    sums of their hashes, which need no order. Each level compares the ranges below those that differed above, until few rows are
    in one, or more than `most` differ; then the rows in what differs are joined. Sums are added up where the rows are, so where
    tables are stored by key, a level shuffles about one row for each range. Keys must be unique on each side; one that stands
    twice is an error if its range is joined.
    """
    leaves, shown = fanout**LEVELS, [F.col(key).cast("string"), F.struct(F.col(checksum).isNull(), F.col(checksum).cast("string"))]
    leaf = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(leaves))
    if desired.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        low, high = desired.select(key).unionByName(actual.select(key)).agg(F.min(key).cast("decimal(20,0)"), F.max(key).cast("decimal(20,0)")).first()
        step = 1 if low is None else int(high - low) // leaves + 1
        leaf = F.expr(f"cast((cast(`{key}` as decimal(20,0)) - {int(low or 0)}BD) div {step} as bigint)")
    sides = [df.select(key, checksum, leaf.alias("__leaf"), F.xxhash64(*shown).alias("__a"), F.xxhash64(F.lit(1), *shown).alias("__b")) for df in (desired, actual)]

    def among(df: DataFrame, ranges: list[int] | None, width: int) -> DataFrame:
        if ranges is None:
            return df
        held = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in ranges], "__upper bigint"))
        return df.join(held, F.expr(f"__leaf div {width}") == F.col("__upper"), "left_semi")

    def summed(df: DataFrame, width: int, name: str) -> DataFrame:
        total = F.struct(F.count("*").alias("n"), F.sum(F.col("__a").cast("decimal(20,0)")), F.sum(F.col("__b").cast("decimal(20,0)")))  # no overflow
        return df.groupBy(F.expr(f"__leaf div {width}").alias("range")).agg(total.alias(name))

    differ, above, rows = None, leaves, None
    for level in range(1, LEVELS + 1):
        width = leaves // fanout**level
        both = summed(among(sides[0], differ, above), width, "d").join(summed(among(sides[1], differ, above), width, "a"), "range", "full_outer")
        other = ~F.col("d").eqNullSafe(F.col("a"))
        if rows is None:
            rows = both.agg(F.sum(F.coalesce("d.n", F.lit(0)) + F.coalesce("a.n", F.lit(0)))).first()[0] or 0
        found = [r[0] for r in both.filter(other).select("range").limit(most + 1).collect()]
        if len(found) > most:
            break
        differ, above = found, width
        if not found or rows / fanout**level <= leaf_rows:
            break
    some = [among(df, differ, above).select(key, checksum) for df in sides]
    return snapshot_diff(some[0], some[1], key, checksum)


def apply_diff(actual: DataFrame, desired: DataFrame, diff: DataFrame, key: str = "id") -> DataFrame:
    """The new snapshot: changed keys leave, created and updated ones come from desired in full width."""
    kept = actual.join(diff.filter("op <> 'create'").select(key), key, "left_anti")
    fresh = desired.join(diff.filter("op <> 'delete'").select(key), key, "left_semi")
    return kept.unionByName(fresh.select(*actual.columns))
