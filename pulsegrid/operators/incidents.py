"""Reconciling open incidents with the present states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incident_diff(incidents: DataFrame, states: DataFrame, key: str = "object_id", require_incidents: bool = True) -> DataFrame:
    """The states to submit: new, or of another severity or muting than the incident. Without any incident nothing is sent,
    unless require_incidents is False."""
    old = incidents.select(key, F.struct("severity", "muted").alias("old"))
    changed = ~(F.col("old.severity").eqNullSafe(F.col("severity")) & F.col("old.muted").eqNullSafe(F.col("muted")))
    out = states.join(old, key, "left").filter(F.col("old").isNull() | changed)
    if require_incidents:
        out = out.join(F.broadcast(incidents.limit(1).select(F.lit(1).alias("__any"))), F.lit(1) == F.col("__any"), "left_semi")
    return out.withColumn("reason", F.when(F.col("old").isNull(), "new").otherwise("changed")).drop("old")


def obsolete_incidents(incidents: DataFrame, snapshot: DataFrame, deleted: DataFrame, object_type: str, key: str = "object_id") -> DataFrame:
    """Incidents of deleted objects, and of objects of the snapshot's type that it does not hold."""
    gone = incidents.join(deleted.select(key), key, "left_semi")
    absent = incidents.filter(F.col("object_type") == object_type).join(snapshot.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti")
    return gone.unionByName(absent)


def updated_outputs(states: DataFrame, last_sync_ms: int) -> DataFrame:
    """States with an output that have been updated since a sync."""
    return states.filter(F.col("output").isNotNull() & (F.col("last_update") >= last_sync_ms))
