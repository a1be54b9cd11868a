"""Values that depend on what came before, per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import PENDING


def previous_hard_state(events: DataFrame, key: list[str], order: list[str], state: str, name: str = "previous_hard_state", carried: DataFrame | None = None) -> DataFrame:
    """events with the value of the run of equal states before the present one; PENDING in the first run.

    carried: (key, last_state, before_last), what an earlier increment ended with; see `carry`.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(state).over(w)
    if carried is None:
        out = events.withColumn("__before", before)
        first = F.lit(PENDING)
    else:
        out = events.join(carried.select(*key, F.col("last_state").alias("__last"), F.col("before_last").alias("__first")), key, "left").withColumn("__before", F.coalesce(before, F.col("__last")))
        first = F.coalesce(F.col("__first"), F.lit(PENDING))
    new_run = F.when(F.col("__before").isNotNull() & (F.col("__before") != F.col(state)), F.col("__before"))
    out = out.withColumn("__turn", new_run).withColumn(name, F.coalesce(F.last("__turn", ignorenulls=True).over(w), first).cast("int"))
    return out.drop("__before", "__turn", "__last", "__first")


def carry(done: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """(key, last_state, before_last) after an increment, for the next one: the states of the last run and of the one before.

    By the last place of each state, so what is sent of an object is a row for each of its few states, and nothing is sorted.
    """
    last = done.filter(F.col(state).isNotNull()).groupBy(*key, F.col(state).alias("__state")).agg(F.max(F.struct(*order)).alias("__at"))
    two = last.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__at", "__state")), asc=False).alias("__x"))
    return two.select(*key, F.get("__x", F.lit(0))["__state"].alias("last_state"), F.coalesce(F.get("__x", F.lit(1))["__state"], F.lit(PENDING)).alias("before_last"))


def pair_start_end(events: DataFrame, key: list[str], order: list[str], is_start: Column, time: str, name: str = "start_time") -> DataFrame:
    """events with the start's time: a start's own; an end's from the event just before it, if that is a start, else null."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = events.withColumn("__start", F.when(is_start, F.col(time)))
    return out.withColumn(name, F.when(is_start, F.col(time)).otherwise(F.lag("__start").over(w))).drop("__start")
