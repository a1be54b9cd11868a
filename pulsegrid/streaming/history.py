"""History streams: events fan out into detail, user, unified and availability tables, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import KINDS, detail_rows, history_rows, user_rows
from ..operators.sla import sla_downtime_rows, sla_state_rows
from ..sources.schemas import SCHEMAS, UPSERTS
from ..sources.sinks import BUCKETS, BucketedTable, insert_ignore, upsert


def fan_out(kind: str, events: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """The rows that a batch of events makes, by table, in the order in which tables are written."""
    table, _, _ = KINDS[kind]
    own = events.drop(*order)
    out = {table: detail_rows(kind, events, order).drop(*order)}
    if kind == "notification" and "users_notified_ids" in events.columns:
        out[table] = out[table].drop("users_notified_ids")
        out["user_notification_history"] = user_rows(events)
    out["history"] = history_rows(kind, own)
    if kind == "state":
        out["sla_history_state"] = sla_state_rows(own)
    if kind == "downtime":
        out["sla_history_downtime"] = sla_downtime_rows(own)
    return out


def history_tables(spark: SparkSession, base: str, kind: str, buckets: int = BUCKETS) -> dict[str, BucketedTable]:
    """The tables that a kind's events fill, each in a folder of its own below base."""
    names = [KINDS[kind][0], "history"] + {"notification": ["user_notification_history"], "state": ["sla_history_state"], "downtime": ["sla_history_downtime"]}.get(kind, [])
    return {n: BucketedTable(spark, f"{base.rstrip('/')}/{n}", SCHEMAS[n], UPSERTS[n][0], buckets) for n in names}


def write_batch(kind: str, events: DataFrame, tables: dict[str, BucketedTable], n: int, order: list[str]) -> None:
    """Write a batch's rows; a later table only after the earlier ones. Done twice, it leaves the same tables.

    Rows that never change are added; where columns may change, the buckets that the batch's keys fall into are written anew.
    """
    events = events.persist()
    try:
        for name, rows in fan_out(kind, events, order).items():
            key, mutable = UPSERTS[name]
            table = tables[name]
            shaped = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])
            if mutable and name != "user_notification_history":
                when = F.struct(*mutable)  # of each key there is one row
                table.merge(shaped.withColumn("__when", when), lambda old, new, key=key, mutable=mutable: upsert(old, new, key, ["__when"], mutable), n)
            elif table.key:
                table.append_new(shaped, n)
            else:
                table.merge(shaped, lambda old, new, key=key: insert_ignore(old, new, key), n)
    finally:
        events.unpersist()


def start_history_stream(stream: DataFrame, kind: str, tables: dict[str, BucketedTable], checkpoint: str, order: list[str], **trigger: object) -> StreamingQuery:
    """Structured Streaming keeps the position and commits it after all tables are written."""
    return (
        stream.writeStream.foreachBatch(lambda events, n: write_batch(kind, events, tables, n, order))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drop_repeats(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream that two writers feed, each event once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])
