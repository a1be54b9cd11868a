import json
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pulsegrid.plans import adapters
from pulsegrid.sources.scans import read_history_stream
from pulsegrid.sources.schemas import SCHEMAS
from pulsegrid.sources.sinks import BucketedTable, Progress
from pulsegrid.streaming import changes, stateful
from pulsegrid.streaming.history import drop_repeats, start_history_stream

CHANGE = "stream_id string, redis_key string, runtime_type string, id string, payload string"
OBJECT = StructType([StructField("id", StringType()), StructField("n", LongType())])


def feed(spark, path, rows, schema, parts=1):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(path)


def run_changes(spark, base, rows):
    feed(spark, f"file://{base}/in", rows, CHANGE, 3)
    store = changes.change_store(spark, f"file://{base}/objects", 4)
    stream = read_history_stream(spark, f"file://{base}/in", CHANGE, 1)
    changes.start_change_stream(stream, store, {"objects": OBJECT, "others": OBJECT}, f"file://{base}/ck").awaitTermination()
    return changes.objects_of(store, "objects", OBJECT)


def change(ms, seq, kind, i, key="objects"):
    return (f"{ms}-{seq}", key, kind, str(i), json.dumps({"n": ms}))


def test_created_then_deleted(spark, tmp_path):
    rows = [r for i in range(60) for r in (change(i, 0, "upsert", i), change(i, 1, "delete", i))]
    random.Random(3).shuffle(rows)
    assert run_changes(spark, tmp_path, rows).count() == 0


def test_deleted_then_created(spark, tmp_path):
    rows = [r for i in range(60) for r in (change(i, 0, "delete", i), change(i, 1, "upsert", i))]
    random.Random(4).shuffle(rows)
    assert run_changes(spark, tmp_path, rows).count() == 60


@pytest.mark.parametrize("bad", [change(1, 0, "patch", 1), ("1-0", "objects", None, "1", "{}"), change(1, 0, "upsert", 1, "unknown"), ("1-0", "objects", "upsert", "1", '{"n":'), ("1-0", "objects", "upsert", "1", None), ("1-0", "objects", "upsert", "1", '{"n":"x"}')])
def test_bad_changes(spark, tmp_path, bad):
    with pytest.raises(StreamingQueryException):
        run_changes(spark, tmp_path, [bad])


def test_marks_go(spark):
    table = spark.createDataFrame([("old", None, 100, 0, True), ("new", None, 900, 0, True), ("here", 1, 1, 0, False)], f"id string, n bigint, {changes.POSITION}")
    rows = spark.createDataFrame([change(1000, 0, "upsert", "x")], CHANGE)
    assert {r.id for r in changes.apply_changes(table, rows, OBJECT, marks_ms=500).collect()} == {"new", "here", "x"}
    assert {r.id for r in changes.apply_changes(table, rows, OBJECT).collect()} == {"old", "new", "here", "x"}


def test_types_in_one_write(spark, tmp_path):
    """40 types in as many jobs as one; a batch that is tried again, also when it broke off, leaves the same store."""
    jobs = []
    for name, types in (("one", 1), ("many", 40)):
        store = changes.change_store(spark, f"file://{tmp_path}/{name}", 2)
        schemas = {f"type{k}": OBJECT for k in range(types)}
        rows = lambda ms: spark.createDataFrame([change(ms + i % 3, i, "delete" if i % 5 == 0 and ms else "upsert", i, f"type{i % types}") for i in range(200)], CHANGE)  # noqa: E731, B023
        spark.sparkContext.setJobGroup(name, name)
        for n, ms in enumerate((0, 10, 5)):
            store.merge(rows(ms), lambda held, new, schemas=schemas: changes.apply_to_store(held, new, schemas), n)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        held = lambda: sorted((r.redis_key, r.id, r.payload, r["__ms"]) for r in store.read().collect())  # noqa: E731, B023
        before = held()
        assert len(before) == 200 and all(x[3] >= 10 for x in before)
        assert sum(changes.objects_of(store, t, OBJECT).count() for t in schemas) == 160
        spark.range(1).select(F.lit(0).alias("n")).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}/data/redis_key=type0/__bucket=0")  # half put in place
        store.merge(rows(5), lambda held, new: held.limit(0), 2)
        assert held() == before
    assert jobs[1] <= jobs[0] + 6


def test_customvar_tables(spark, tmp_path):
    tables = [BucketedTable(spark, f"file://{tmp_path}/{t}", SCHEMAS[t], k, 4) for t, k in (("customvar", "id"), ("customvar_flat", "customvar_id"))]
    value = lambda v: json.dumps({"environment_id": "e", "name": "n", "value": v})
    for n, rows in enumerate([[("1-0", "a", "[1,2]"), ("1-1", "b", "{}"), ("0-9", "a", "[7]")], [("2-0", "a", "[3]")]]):
        part = spark.createDataFrame([(p, "customvar", "upsert", i, value(v)) for p, i, v in rows], CHANGE)
        changes.write_customvars(part, *tables, n)
    assert {r.id: r.value for r in tables[0].read().collect()} == {"a": "[3]", "b": "{}"}
    assert sorted((r.customvar_id, r.flatname, r.flatvalue) for r in tables[1].read().collect()) == [("a", "n[0]", "3"), ("b", "n", None)]
    with pytest.raises(Exception, match="cannot be deleted"):
        changes.write_customvars(spark.createDataFrame([("3-0", "customvar", "delete", "a", None)], CHANGE), *tables, 2)


def test_periodic_passes(spark, tmp_path):
    """Overdue objects and changed outputs, each as a stream driven by the clock."""
    table = BucketedTable(spark, f"file://{tmp_path}/overdue", "id string", "id", 2)
    nu = spark.createDataFrame([("a", 10), ("b", 20)], "id string, next_update bigint")
    times = iter([15_000, 25_000] + [25_000] * 1000)
    sent, q = [], changes.start_overdue(spark, lambda: nu, table, f"file://{tmp_path}/ck1", 0.2, lambda: next(times))
    states = spark.createDataFrame([("a", 2_000_000_000_000, "out", None), ("b", 5, "out", "more")], "id string, last_update bigint, output string, long_output string")
    progress = Progress(BucketedTable(spark, f"file://{tmp_path}/progress", SCHEMAS["migration_progress"]))
    sync = lambda n: changes.start_output_sync(spark, lambda: states, lambda df: sent.append([tuple(x) for x in df.select("id", "message").collect()]), f"file://{tmp_path}/ck{n}", 6, 0.2, progress, "env")
    r = sync(2)
    end = time.time() + 60
    while time.time() < end and (len(sent) < 2 or table.read().count() < 2):
        time.sleep(0.3)
    q.stop()
    r.stop()
    assert {x.id for x in table.read().collect()} == {"a", "b"} and sent[0] == [("a", "out")]
    assert abs(progress.last_id("env", "output_sync", 0, 0) - time.time() * 1000) < 60_000


def test_customvar_changes(spark):
    rows = spark.createDataFrame([("1-0", "customvar", "upsert", "v", '{"environment_id":"e","name":"n","value":"[1,{\\"a\\":2}]"}')], CHANGE)
    own, flat = changes.expand_customvars(rows)
    assert own.first().name == "n" and {r.flatname: r.flatvalue for r in flat.collect()} == {"n[0]": "1", "n[1].a": "2"}


@pytest.mark.parametrize("kind", ["comment", "notification", "state", "downtime"])
def test_history_stream(spark, sf, tmp_path, kind):
    events = adapters.history_events(adapters.events(spark, sf))[kind]
    for part in (0, 1, 0):  # the first part comes twice, as from two writers
        events.filter(f"event_id % 2 = {part} or '{kind}' in ('notification', 'state') and {part} = 0").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    names = {"comment": ["comment_history"], "notification": ["notification_history", "user_notification_history"], "state": ["state_history", "sla_history_state"], "downtime": ["downtime_history", "sla_history_downtime"]}[kind]
    tables = {n: BucketedTable(spark, f"file://{tmp_path}/{n}", SCHEMAS[n]) for n in [*names, "history"]}
    schema = events.schema
    stream = read_history_stream(spark, f"file://{tmp_path}/in", schema, 1)
    if kind == "state":
        stream = stream.selectExpr("*", "'hard' as state_type", "0 as hard_state", "99 as previous_hard_state")
    start_history_stream(stream, kind, tables, f"file://{tmp_path}/ck", ["ms"]).awaitTermination()
    n = events.count()
    assert tables[names[0]].read().count() == n and tables["history"].read().count() == n
    if kind == "notification":
        assert tables["user_notification_history"].read().count() == 3 * n
    if kind in ("state", "downtime"):
        assert tables[names[1]].read().count() == n


def test_reorder(spark, tmp_path):
    rng = random.Random(5)
    messages = [(f"{1000 + i + rng.choice([0, 0, 0, -5])}-{i % 7}", f"m{i}", "env") for i in range(200)]
    feed(spark, f"file://{tmp_path}/in", messages, "stream_id string, payload string, environment string", 4)
    stream = spark.readStream.schema("stream_id string, payload string, environment string").option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    writer = stateful.reorder(stream, "environment", delay_ms=1500).writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck")
    q = stateful.start_stateful(writer, spark)
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("released").count() < len(messages):
            time.sleep(0.5)
        rows = sorted(spark.table("released").collect(), key=lambda r: r.release)
    finally:
        q.stop()
    assert sorted(r.payload for r in rows) == sorted(m for _, m, _ in messages)
    assert [r.release for r in rows] == list(range(200))
    # what is released together is in order
    assert sum((a.ms, a.seq) > (b.ms, b.seq) for a, b in zip(rows, rows[1:], strict=False)) <= 4


def test_heartbeats(spark, tmp_path):
    feed(spark, f"file://{tmp_path}/in", [("a",), ("b",)], "source string")
    stream = spark.readStream.schema("source string").parquet(f"file://{tmp_path}/in")
    writer = stateful.heartbeats(stream, silence_ms=1500).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck")
    q = stateful.start_stateful(writer, spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKSDB
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("beats").count() < 4:
            time.sleep(0.5)
        got = sorted(map(tuple, spark.table("beats").collect()))
    finally:
        q.stop()
    assert got == [("a", "active"), ("a", "lost"), ("b", "active"), ("b", "lost")]


def test_repeats(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "event_id int, t string").selectExpr("event_id", "cast(t as timestamp) as ts").write.parquet(f"file://{tmp_path}/in")
    stream = drop_repeats(spark.readStream.schema("event_id int, ts timestamp").parquet(f"file://{tmp_path}/in"), "ts")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2]


def test_periodic(spark, tmp_path):
    seen = []
    q = changes.periodic(spark, 0.5, seen.append, f"file://{tmp_path}/ck")
    end = time.time() + 30
    while time.time() < end and len(seen) < 2:
        time.sleep(0.2)
    q.stop()
    assert len(seen) >= 2


def test_reorder_batch(spark):
    rows = [("2-0", 1), ("1-5", 2), ("1-5", 1), ("1-10", 0)]
    out = stateful.reorder_batch(spark.createDataFrame(rows, "stream_id string, arrival int")).collect()
    assert [tuple(r) for r in out] == [("1-5", 1), ("1-5", 2), ("1-10", 0), ("2-0", 1)]


def test_stream_change_counters(spark, tmp_path):
    """Seconds close behind the watermark (that of the batch before decides what is late); what comes later still is left out."""
    from pulsegrid.operators.audit import change_counters, stream_change_counters

    parts = [[("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:30", "b")], [("2024-01-01 00:00:31", "c")], [("2024-01-01 00:00:02", "late"), ("2024-01-01 00:00:25", "in time")], [("2024-01-01 00:01:00", "end")]]
    for rows in parts:
        spark.createDataFrame(rows, "t string, kind string").selectExpr("cast(t as timestamp) as ts", "kind").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = stream_change_counters(stream).writeStream.format("memory").queryName("counters").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r.second)[14:], r.kind, r.n) for r in spark.table("counters").collect())
    assert got == [("00:01", "a", 2), ("00:25", "in time", 1), ("00:30", "b", 1), ("00:31", "c", 1)]
    batch = change_counters(spark.read.schema("ts timestamp, kind string").parquet(f"file://{tmp_path}/in"))
    assert {r.kind: r.n for r in batch.collect()} == {"a": 2, "b": 1, "c": 1, "late": 1, "in time": 1, "end": 1}
