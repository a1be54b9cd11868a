"""Ordered change streams: upserts and deletes by stream position, applied to tables batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import message, stream_id
from ..operators.customvars import flatten_customvars
from ..operators.incidents import updated_outputs
from ..operators.overdue import apply_overdue, overdue_diff
from ..operators.upserts import latest_changes
from ..sources.scans import known_changes
from ..sources.sinks import BUCKETS, BucketedTable, Progress, delete_ids

#: Position columns that a table keeps, so that an older change cannot overwrite a newer one, or revive what is deleted.
POSITION = "__ms bigint, __seq bigint, __deleted boolean"
#: What a store of changes holds: the last payload of every object of every type.
STORE = f"redis_key string, id string, payload string, {POSITION}"


def positioned(changes: DataFrame) -> DataFrame:
    """changes with ms and seq; a missing or unknown runtime_type is an error."""
    p = stream_id("stream_id")
    wrong = F.raise_error(F.concat(F.lit("bad runtime_type: "), F.coalesce("runtime_type", F.lit("null")))).cast("string")
    kind = F.when(F.col("runtime_type").isin("upsert", "delete"), F.col("runtime_type")).otherwise(wrong)
    return changes.withColumn("runtime_type", kind).withColumn("__ms", p["ms"]).withColumn("__seq", p["seq"])


def payload_of(schema: StructType) -> Column:
    """The payload of an upsert by its schema. Bad JSON, and an upsert without a payload, are errors; a delete has none."""
    missing = F.raise_error(F.concat(F.lit("no payload for "), F.coalesce(F.col("stream_id"), F.lit("a change")))).cast("string")
    text = F.when(F.col("runtime_type") == "upsert", F.coalesce("payload", missing))
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def apply_changes(target: DataFrame, changes: DataFrame, schema: StructType, key: str = "id", marks_ms: int | None = None) -> DataFrame:
    """target (schema and POSITION) after changes (stream_id, runtime_type, key, payload JSON): the last change of a key wins.

    Deleted keys stay as marks with their position; `live` leaves them out. With marks_ms, marks that lie so far behind the
    newest position go; a change that comes even later than that is then taken as new.
    """
    last = latest_changes(positioned(changes).select(key, "stream_id", "runtime_type", "payload", "__ms", "__seq"), [key], ["__ms", "__seq"])
    v = payload_of(schema)
    parsed = last.withColumn("__v", v)
    fields = [F.col(key) if n == key else F.col("__v")[n].alias(n) for n in schema.names]
    new = parsed.select(*fields, "__ms", "__seq", (F.col("runtime_type") == "delete").alias("__deleted"))
    out = latest_changes(target.unionByName(new), [key], ["__ms", "__seq"]).select(*target.columns)
    if marks_ms is None:
        return out
    newest = positioned(changes).agg(F.max("__ms")).first()[0]
    return out if newest is None else out.filter(~F.col("__deleted") | (F.col("__ms") >= newest - marks_ms))


def live(target: DataFrame) -> DataFrame:
    return target.filter("not __deleted").drop("__ms", "__seq", "__deleted")


CUSTOMVAR = StructType([StructField(n, StringType()) for n in ("id", "environment_id", "name", "value")])


def expand_customvars(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variables and their flat rows from changes of custom variables (payload: the variable). A delete is an error."""
    wrong = F.raise_error(F.lit("custom variables cannot be deleted by a change")).cast("string")
    checked = changes.withColumn("runtime_type", F.when(F.col("runtime_type") == "upsert", F.col("runtime_type")).otherwise(wrong))
    own = checked.select("id", payload_of(CUSTOMVAR).alias("v")).select("id", *[F.col("v")[n].alias(n) for n in CUSTOMVAR.names if n != "id"])
    return own, flatten_customvars(own)


def write_customvars(changes: DataFrame, customvar: BucketedTable, customvar_flat: BucketedTable, n: int) -> None:
    """A batch of changes of custom variables to both tables: the last value of each variable, and its flat rows in place of
    those it had. customvar_flat's buckets are by customvar_id, so that a variable's rows lie together."""
    last = latest_changes(positioned(changes), ["id"], ["__ms", "__seq"]).persist()
    try:
        own, flat = expand_customvars(last)
        own = own.withColumn("name_checksum", F.sha1("name")).select(*customvar.schema.names)
        customvar.merge(own, lambda old, new: delete_ids(old, new).unionByName(new), n)
        gone = own.select(F.col("id").alias("customvar_id"))
        empty = gone.select(*[F.col("customvar_id") if f.name == "customvar_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in customvar_flat.schema.fields])
        # a row without an id stands for each variable, so that buckets of variables without flat rows are written too
        rows = flat.select(*customvar_flat.schema.names).unionByName(empty)
        customvar_flat.merge(rows, lambda old, new: old.join(gone, "customvar_id", "left_anti").unionByName(new.filter("id is not null")), n)
    finally:
        last.unpersist()


def change_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketedTable:
    """One table for objects of all types, partitioned by type and bucket."""
    return BucketedTable(spark, path, STORE, "id", buckets, by="redis_key")


def apply_to_store(held: DataFrame, changes: DataFrame, schemas: dict[str, StructType], marks_ms: int | None = None) -> DataFrame:
    """held (STORE) after changes of all types at once: of each type and id the last one counts. Payloads are checked by the
    schemas of their types, unknown types are errors. marks_ms as for `apply_changes`, by type."""
    last = latest_changes(positioned(known_changes(changes, list(schemas))).select("redis_key", "id", "stream_id", "runtime_type", "payload", "__ms", "__seq"), ["redis_key", "id"], ["__ms", "__seq"])
    parsed = F.coalesce(*[F.when(F.col("redis_key") == k, payload_of(v).isNotNull()) for k, v in schemas.items()])
    deleted = F.col("runtime_type") == "delete"
    new = last.withColumn("payload", F.when(F.coalesce(parsed, F.lit(False)) & ~deleted, F.col("payload"))).select("redis_key", "id", "payload", "__ms", "__seq", deleted.alias("__deleted"))
    out = latest_changes(held.unionByName(new), ["redis_key", "id"], ["__ms", "__seq"]).select(*held.columns)
    if marks_ms is None:
        return out
    newest = new.groupBy("redis_key").agg(F.max("__ms").alias("__newest"))
    return out.join(F.broadcast(newest), "redis_key", "left").filter(~F.col("__deleted") | F.col("__newest").isNull() | (F.col("__ms") >= F.col("__newest") - marks_ms)).select(*held.columns)


def objects_of(store: BucketedTable, redis_key: str, schema: StructType, key: str = "id") -> DataFrame:
    """The live objects of one type, which is a partition of the store."""
    rows = store.read().filter((F.col("redis_key") == redis_key) & ~F.col("__deleted")).select("id", F.from_json("payload", schema).alias("v"))
    return rows.select(*[F.col("id").alias(key) if n == key else F.col("v")[n].alias(n) for n in schema.names])


def start_change_stream(stream: DataFrame, store: BucketedTable, schemas: dict[str, StructType], checkpoint: str, customvars: tuple[str, BucketedTable, BucketedTable] | None = None, marks_ms: int | None = None, **trigger: object) -> StreamingQuery:
    """Apply a stream of changes to a store, all types of a batch in one write, however many there are; schemas: redis_key →
    schema; customvars: the key of custom variables and their two tables. Unknown keys are errors. A batch writes the
    partitions that its keys fall into. With marks_ms, marks of deleted objects go so far behind the newest change of their
    type, and a change that comes even later is taken as new; without, they stay."""

    def batch(changes: DataFrame, n: int) -> None:
        changes = known_changes(changes, [*schemas, *([customvars[0]] if customvars else [])]).persist()
        try:
            own = F.col("redis_key") == customvars[0] if customvars else F.lit(False)
            store.merge(changes.filter(~own), lambda held, new: apply_to_store(held, new, schemas, marks_ms), n)
            if customvars:
                write_customvars(changes.filter(own), customvars[1], customvars[2], n)
        finally:
            changes.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def overdue_pass(next_update: DataFrame, overdue: BucketedTable, now_ms: int, key: str = "id") -> DataFrame:
    """One pass at a time: what has become overdue enters the table, what no longer is leaves it. Returns the changes (key, action)."""
    diff = overdue_diff(next_update, overdue.read(), now_ms / 1000, key).persist()
    overdue.merge(diff, lambda old, new: apply_overdue(old, new, key).select(*overdue.schema.names))
    return diff


def output_pass(states: DataFrame, last_sync_ms: int, sink: Callable[[DataFrame], None]) -> None:
    """One pass of the output sync: object, message and time of the states whose output was updated since the last one."""
    changed = updated_outputs(states, last_sync_ms)
    sink(changed.withColumn("message", message("output", "long_output")))


def start_overdue(spark: SparkSession, next_update: Callable[[], DataFrame], overdue: BucketedTable, checkpoint: str, seconds: float = 2, clock: Callable[[], int] | None = None) -> StreamingQuery:
    """The overdue pass every so many seconds, over what next_update() reads then; the table of overdue objects is its state."""
    return periodic(spark, seconds, lambda now: overdue_pass(next_update(), overdue, clock() if clock else now).unpersist(), checkpoint)


def start_output_sync(
    spark: SparkSession, states: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, since_ms: int, seconds: float = 300, progress: Progress | None = None, environment: str = "",
) -> StreamingQuery:
    """The output sync every so many seconds: each pass takes what was updated since the pass before began. With progress, a
    sync that is started again goes on where the last one stopped."""
    mark = (environment, "output_sync", 0, 0)
    last = [(progress.last_id(*mark) if progress else None) or since_ms]

    def step(now: int) -> None:
        output_pass(states(), last[0], sink)
        last[0] = now
        if progress:
            progress.save(*mark, now)

    return periodic(spark, seconds, step, checkpoint)


def periodic(spark, seconds: float, step: Callable[[int], None], checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Run a step every so many seconds, as a stream driven by the clock; step gets the time in ms."""
    import time

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: step(int(time.time() * 1000))).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()
