"""Overdue objects: next update before now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overdue_diff(next_update: DataFrame, overdue: DataFrame, now: float, key: str = "id") -> DataFrame:
    """(key, action): mark what has become overdue, unmark what no longer is or has gone. now counts in whole seconds."""
    late = next_update.filter(F.col("next_update") < F.lit(int(now))).select(key, F.lit(True).alias("late")).distinct()
    known = overdue.select(key, F.lit(True).alias("known")).distinct()
    both = late.join(known, key, "full_outer")
    action = F.when(F.col("known").isNull(), "mark").when(F.col("late").isNull(), "unmark")
    return both.select(key, action.alias("action")).filter("action is not null")


def apply_overdue(overdue: DataFrame, diff: DataFrame, key: str = "id") -> DataFrame:
    kept = overdue.select(key).join(diff.filter("action = 'unmark'"), key, "left_anti")
    return kept.unionByName(diff.filter("action = 'mark'").select(key))


def seed_overdue(states: DataFrame, key: str = "id") -> DataFrame:
    return states.filter(F.col("is_overdue")).select(key)
