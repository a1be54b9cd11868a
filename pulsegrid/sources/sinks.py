"""Writing: keyed, repeatable sinks over tables of Parquet files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, MapType, StructField, StructType, VariantType

from ..operators.upserts import fold_upserts

#: Buckets of a keyed table, and batches of additions of which the last one writes its partitions anew.
BUCKETS, MAX_ADDS = 16, 32


def first_rows(rows: DataFrame, keys: list[str], order: str | list[str] | None = None) -> DataFrame:
    """One row of each key: the first by `order`, then by all columns that can be ordered, so that a repeated run takes the same."""
    by = [order] if isinstance(order, str) else list(order or [])
    rest = [f.name for f in rows.schema.fields if f.name not in (*keys, *by) and not isinstance(f.dataType, MapType | VariantType)]
    others = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in keys]) if len(rows.columns) > len(keys) else F.struct(F.lit(1).alias("__one"))
    least = rows.groupBy(*keys).agg(F.min_by(others, F.struct(F.lit(0), *[F.col(f"`{c}`") for c in (*by, *rest)])).alias("__first"))
    return least.select(*[F.col(f"`{c}`") if c in keys else F.col("__first")[c].alias(c) for c in rows.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, key: str | list[str], order: str | list[str] | None = None) -> DataFrame:
    """target and those rows whose key is new; of equal keys the first wins (see `first_rows`), so a repeated run changes nothing."""
    keys = [key] if isinstance(key, str) else key
    return target.unionByName(first_rows(rows, keys, order).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, changes: DataFrame, key: str, order: list[str], mutable: list[str]) -> DataFrame:
    """target after changes in their order: a new key is inserted, of a known one only the mutable columns change."""
    columns = target.columns
    old = target.select("*", F.lit(0).alias("__new"), *[F.lit(None).cast(changes.schema[o].dataType).alias(f"__{o}") for o in order])
    new = changes.select(*columns, F.lit(1).alias("__new"), *[F.col(o).alias(f"__{o}") for o in order])
    touched = changes.select(key).distinct()
    kept = target.join(touched, key, "left_anti")
    folded = fold_upserts(old.join(touched, key, "left_semi").unionByName(new), key, ["__new", *[f"__{o}" for o in order]], mutable)
    return kept.unionByName(folded.select(*columns))


def update_column(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """target with one column set where changes (key, column) say so; unknown keys do nothing, a null is set too."""
    new = changes.select(key, F.col(column).alias("__value"), F.lit(True).alias("__set"))
    out = target.join(new, key, "left")
    return out.withColumn(column, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(column))).select(*target.columns)


def delete_ids(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


class BucketedTable:
    """A Parquet table in a folder, partitioned by buckets of a hash of its key (and by the column `by`, if there is one).

    A batch reads the partitions that its keys fall into and writes them anew, by Spark's dynamic partition overwrite. As that
    replaces one partition after the other, what is to be there is written beside the table first: a batch that is tried again
    finds it and only puts it in place, so a batch that broke off anywhere leaves no other table than one that did not. Rows
    that never change are appended if their key is new, which can be tried again as well. A partition holds a row that marks
    it, so that it can become empty. One writer at a time. Choose `buckets` so that one of them is work for one task. With a
    table format that has row-level MERGE, `DataFrame.mergeInto` takes the place of `merge`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, buckets: int = BUCKETS, by: str | None = None) -> None:
        self.spark, self.path, self.key, self.buckets, self.by = spark, path.rstrip("/"), key, buckets if key else 1, by
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.partitions = [*([by] if by else []), "__bucket"]
        self.stored = StructType([*[f for f in self.schema.fields if f.name != by], StructField("__void", BooleanType()), *[f for f in self.schema.fields if f.name == by], StructField("__bucket", IntegerType())])

    def _read(self, path: str, schema: StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            return None

    def bucket_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def read(self, touched: list[tuple] | None = None) -> DataFrame:
        """The table, or some of its partitions."""
        held = self._read(f"{self.path}/data", self.stored)
        if held is None:
            return self.spark.createDataFrame([], self.schema)
        if touched is not None:
            of: dict[object, list[int]] = {}
            for *by, bucket in touched:
                of.setdefault(by[0] if by else None, []).append(bucket)
            parts = [F.col("__bucket").isin(b) & (F.col(self.by) == v if self.by else F.lit(True)) for v, b in of.items()]
            held = held.filter(reduce(lambda x, y: x | y, parts, F.lit(False)))
        return held.filter("not __void").select(*self.schema.names)

    def touched(self, rows: DataFrame) -> list[tuple]:
        """The partitions that rows fall into; there are as many as buckets, for each value of `by`."""
        return sorted(tuple(r) for r in rows.select(*([self.by] if self.by else []), self.bucket_of(self.key or "").alias("b")).distinct().collect())

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, F.lit(False).alias("__void"), self.bucket_of(self.key or "").alias("__bucket")).select(*self.stored.names)

    def _staged(self) -> int | None:
        """The batch of what is written beside the table, if that is complete."""
        if self._read(f"{self.path}/staged/_SUCCESS", StructType.fromDDL("x int")) is None:
            return None
        row = self.spark.read.parquet(f"{self.path}/staged").select("__batch").first()
        return row and row[0]

    def _put(self) -> None:
        staged = self.spark.read.schema(StructType([*self.stored.fields, StructField("__batch", LongType())])).parquet(f"{self.path}/staged").drop("__batch")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partitions).parquet(f"{self.path}/data")

    def _replace(self, rows: DataFrame, touched: list[tuple], batch: int | None) -> None:
        marks = self.spark.createDataFrame(touched, ", ".join(f"`{p}` {self.stored[p].dataType.simpleString()}" for p in self.partitions))
        marks = marks.select(*[F.col(f.name) if f.name in self.partitions else F.lit(f.name == "__void" or None).cast(f.dataType).alias(f.name) for f in self.stored.fields])
        every = self._dealt(rows).unionByName(marks).withColumn("__batch", F.lit(batch).cast("long"))
        # a file for each partition, so that putting them in place needs no shuffle
        every.repartition(len(touched), *self.partitions).write.mode("overwrite").parquet(f"{self.path}/staged")
        self._put()

    def write(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        values = [()] if not self.by else [tuple(r) for r in self.read().select(self.by).unionByName(rows.select(self.by)).distinct().collect()]
        self._replace(rows, [(*v, b) for v in values for b in range(self.buckets)], None)

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> list[tuple]:
        """Replace the partitions that keys of changes fall into by apply(what they hold, changes); returns these partitions."""
        if touched := self.touched(changes):
            if batch is not None and self._staged() == batch:
                self._put()
            else:
                self._replace(apply(self.read(touched), changes), touched, batch)
        return touched

    def append_new(self, rows: DataFrame, batch: int | None = None) -> list[tuple]:
        """Add the rows whose key is new, without writing what is there; every MAX_ADDS-th batch writes its partitions as one."""
        if not self.key:
            raise ValueError("a table without a key cannot tell which rows are new")
        if batch is not None and batch % MAX_ADDS == MAX_ADDS - 1:
            return self.merge(rows, lambda old, new: insert_ignore(old, new.select(*self.schema.names), self.key), batch)
        if touched := self.touched(rows):
            fresh = first_rows(rows, [self.key]).join(self.read(touched).select(self.key), self.key, "left_anti")
            self._dealt(fresh).repartition(len(touched), *self.partitions).write.mode("append").partitionBy(*self.partitions).parquet(f"{self.path}/data")
        return touched


class Progress:
    """Resume marks: the last id written for (environment, type, from, to)."""

    def __init__(self, table: BucketedTable) -> None:
        self.table = table

    def last_id(self, environment: str, kind: str, from_ts: int, to_ts: int) -> int | None:
        row = self.table.read().filter((F.col("environment_id") == environment) & (F.col("history_type") == kind) & (F.col("from_ts") == from_ts) & (F.col("to_ts") == to_ts)).agg(F.max("last_id")).first()
        return row[0]

    def save(self, environment: str, kind: str, from_ts: int, to_ts: int, last_id: int) -> None:
        old = self.table.read()
        mark = self.table.spark.createDataFrame([(environment, kind, from_ts, to_ts, last_id)], self.table.schema)
        self.table.write(old.join(mark.drop("last_id"), ["environment_id", "history_type", "from_ts", "to_ts"], "left_anti").unionByName(mark))
