"""Counts and checks over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def migration_counts(table: DataFrame, key: str, last_id: int, low: int, high: int) -> DataFrame:
    """(migrated 0 or 1, n) of the rows low..high, before and after a checkpoint."""
    return table.filter(F.col(key).between(low, high)).groupBy(F.when(F.col(key) <= last_id, 1).otherwise(0).alias("migrated")).agg(F.count("*").alias("n"))


def joined_count(facts: DataFrame, objects: DataFrame, on: str, key: str, upto: int) -> DataFrame:
    """How many facts up to an id have their object."""
    return facts.filter(F.col(key) <= upto).join(objects.select(on), on).agg(F.count("*").alias("n"))


def responsible_instances(instances: DataFrame) -> DataFrame:
    """Environments with more than one responsible instance: (environment_id, n)."""
    return instances.filter("responsible").groupBy("environment_id").agg(F.count("*").alias("n")).filter("n > 1")


def count_prefix(table: DataFrame, column: str, prefix: str) -> DataFrame:
    return table.filter(F.col(column).startswith(prefix)).agg(F.count("*").alias("n"))


def change_counters(applied: DataFrame, time: str = "ts", kind: str = "kind") -> DataFrame:
    """(second, kind, n): applied changes per second."""
    return applied.groupBy(F.window(time, "1 second").getField("start").alias("second"), kind).agg(F.count("*").alias("n"))


def stream_change_counters(applied: DataFrame, time: str = "ts", kind: str = "kind", late: str = "10 seconds") -> DataFrame:
    """The same for a stream: a second is put out once no more of it is awaited, `late` behind the newest change; what comes even
    later is left out (Spark counts it in numRowsDroppedByWatermark). time is a timestamp."""
    counted = applied.withWatermark(time, late).groupBy(F.window(time, "1 second"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("second"), kind, "n")
