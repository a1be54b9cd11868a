"""The monitoring model on the driver's tables: events become states, downtimes, history; customers and orders become objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import millis, sha1_id
from ..operators.sequence import previous_hard_state

ENV = "env"
MONTH = (1704067200000, 30)  # 2024-01-01 in ms, days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def as_events(raw: DataFrame) -> DataFrame:
    """event_id, user_id, event_type, value, props, ms, and the object: odd users are services of the even one before."""
    odd = F.col("user_id") % 2 == 1
    host = F.when(odd, F.col("user_id") - 1).otherwise(F.col("user_id")).cast("string")
    return raw.select(
        "event_id", "user_id", "event_type", "value", "props", millis("ts").alias("ms"), F.when(odd, "service").otherwise("host").alias("object_type"),
        host.alias("host_id"), F.when(odd, F.col("user_id").cast("string")).alias("service_id"),
    )


def raw_states(ev: DataFrame) -> DataFrame:
    hard = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return ev.filter("event_type <> 'view'").select(
        F.col("event_id").alias("id"), "user_id", "object_type", "host_id", "service_id", F.col("ms").alias("event_time"), F.when(F.col("event_type") == "click", "soft").otherwise("hard").alias("state_type"), hard.alias("hard_state")
    )


def states(ev: DataFrame) -> DataFrame:
    """Hard states with the previous hard state."""
    return previous_hard_state(raw_states(ev).filter("state_type = 'hard'"), ["user_id"], ["event_time", "id"], "hard_state")


def downtimes(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type = 'view'").select(
        F.col("event_id").alias("downtime_id"), "user_id", "object_type", "host_id", "service_id", F.col("ms").alias("start_time"), (F.col("ms") + F.floor(F.col("value") * 60000)).cast("bigint").alias("end_time"),
        (F.col("ms") + F.floor(F.col("value") * 30000)).cast("bigint").alias("cancel_time"), (F.col("event_id") % 4 == 0).alias("has_been_cancelled"),
    )


def days(ev: DataFrame) -> DataFrame:
    """Thirty daily intervals for each object."""
    start, n = MONTH
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("d")
    return ev.select("host_id", "service_id").distinct().select("*", each).select("host_id", "service_id", (F.lit(start) + F.col("d") * F.lit(86400000)).cast("bigint").alias("start"), (F.lit(start) + (F.col("d") + 1) * F.lit(86400000)).cast("bigint").alias("end"))


def history_events(ev: DataFrame) -> dict[str, DataFrame]:
    """Events of all six kinds, each in the columns of its kind."""
    meta = lambda df, kind: df.withColumns({"environment_id": F.lit(ENV), "endpoint_id": F.lit(None).cast("string"), "event_type": kind})
    own = ev.drop("props").withColumnRenamed("event_type", "source_type")
    of = lambda *types: own.filter(F.col("source_type").isin(*types))
    even = F.col("event_id") % 2 == 0
    third = F.col("event_id") % 3 == 0
    ms, plus = F.col("ms"), (F.col("ms") + F.floor(F.col("value") * 1000)).cast("bigint")
    key = F.col("event_id").cast("string")
    return {
        "acknowledgement": meta(of("purchase"), F.when(even, "ack_set").otherwise("ack_clear")).withColumns({"id": key, "set_time": ms, "clear_time": F.when(~third, plus)}),
        "comment": meta(of("signup"), F.when(even, "comment_add").otherwise("comment_remove")).withColumns({"comment_id": key, "entry_time": ms, "remove_time": F.when(~third, plus), "expire_time": (ms + 5000).cast("bigint")}),
        "downtime": meta(of("view"), F.when(even, "downtime_start").otherwise("downtime_end")).withColumns({"downtime_id": key, "start_time": ms, "end_time": plus, "cancel_time": (ms + 1).cast("bigint"), "has_been_cancelled": F.when(~third, F.col("event_id") % 4 == 1)}),
        "flapping": meta(of("click"), F.when(even, "flapping_start").otherwise("flapping_end")).withColumns({"id": key, "start_time": ms, "end_time": F.when(~third, plus)}),
        "notification": meta(of("error").filter(even), F.lit("notification")).withColumns({"id": sha1_id(key), "send_time": ms, "users_notified_ids": F.to_json(F.transform(F.array(F.col("user_id"), F.col("user_id") + 1, F.col("user_id") + 2), lambda u: sha1_id(u)))}),
        "state": meta(of("error").filter(~even), F.lit("state_change")).withColumns({"id": key, "event_time": ms}),
    }


def changes(ev: DataFrame) -> DataFrame:
    """A change stream: errors delete, all else upserts the object's last value."""
    return ev.select(
        F.concat(F.col("ms").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("stream_id"), F.lit("objects").alias("redis_key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("runtime_type"), F.col("user_id").cast("string").alias("id"), F.to_json(F.struct("event_type", F.col("event_id").alias("n"))).alias("payload"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Desired and actual objects of `part`: some missing on either side, some of another price."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    check = F.sha1(F.concat_ws("|", F.col("id").cast("string"), "name", F.round(F.col("price") * 100).cast("bigint").cast("string")))
    desired = part.filter("id % 5 <> 0")
    actual = part.filter("id % 7 <> 0").withColumn("price", F.when(F.col("id") % 11 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return desired.withColumn("checksum", check), actual.withColumn("checksum", check)


def objects(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """hosts (customers), services (orders), host groups (nations) and service groups (priorities), with their members."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    priority = F.sha1("o_orderpriority")
    return {
        "hosts": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("display_name"), (F.col("c_custkey") % 3 == 0).alias("is_volatile")),
        "services": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("host_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("display_name")),
        "hostgroups": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("display_name")),
        "hostgroup_members": c.select(F.col("c_custkey").alias("host_id"), F.col("c_nationkey").alias("hostgroup_id")),
        "servicegroups": o.select(priority.alias("id"), F.col("o_orderpriority").alias("name"), F.lower("o_orderpriority").alias("display_name")).distinct(),
        "servicegroup_members": o.select(F.col("o_orderkey").alias("service_id"), priority.alias("servicegroup_id")),
    }


def dependencies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suppliers depend on nations (hosts), nations on regions (redundancy groups). Some references are broken on purpose."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    sup, nat, reg = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    no = F.lit(None).cast("string")
    nodes = s.select(sup.alias("id"), sup.alias("host_id"), no.alias("service_id"), no.alias("redundancy_group_id"))
    nodes = nodes.unionByName(n.select(nat.alias("id"), nat.alias("host_id"), no.alias("service_id"), F.when(F.col("n_nationkey") % 10 == 9, F.lit("r0")).alias("redundancy_group_id")))
    nodes = nodes.unionByName(r.select(reg.alias("id"), no.alias("host_id"), no.alias("service_id"), reg.alias("redundancy_group_id")))
    up = s.select(F.concat(F.lit("e"), sup).alias("id"), sup.alias("from_node_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to_node_id"))
    up = up.unionByName(s.select(F.concat(F.lit("g"), sup).alias("id"), sup.alias("from_node_id"), F.concat(F.lit("r"), (F.col("s_nationkey") % 6).cast("string")).alias("to_node_id")))
    edges = up.withColumn("dependency_edge_state_id", F.when(F.substring("id", 1, 1) == "e", F.col("id")).otherwise(F.lit("none")))
    hosts = s.filter("s_suppkey % 4 <> 0").select(sup.alias("id"), F.col("s_name").alias("name")).unionByName(n.select(nat.alias("id"), F.col("n_name").alias("name")))
    groups = r.select(reg.alias("id"), F.col("r_name").alias("display_name"))
    return {"nodes": nodes, "edges": edges, "hosts": hosts, "services": s.limit(0).select(sup.alias("id")), "groups": groups, "edge_states": up.select("id").filter("id like 'e%'")}


def legacy(ev: DataFrame) -> dict[str, DataFrame]:
    """Legacy rows of all kinds from events, joined to their objects."""
    e, sec, usec = F.col("event_id"), F.expr("ms div 1000"), ((F.col("ms") % 1000) * 1000).cast("int")
    timed = lambda c: F.when(e % 7 != 0, c)  # noqa: E731  # rows without a time are left out by the converters
    own = ev.withColumns({"objecttype_id": F.when(F.col("object_type") == "host", 1).otherwise(2), "name1": F.col("host_id"), "name2": F.coalesce("service_id", F.lit("")), "name": F.concat(F.lit("n"), e.cast("string"))})
    of = lambda *types: own.filter(F.col("event_type").isin(*types))
    obj, zero = ["objecttype_id", "name1", "name2"], F.lit(0).cast("bigint")
    later = F.when(e % 3 == 0, zero).otherwise(sec + 5)
    comment = of("signup").select(
        e.alias("commenthistory_id"), timed(sec).alias("entry_time"), usec.alias("entry_time_usec"), F.when(e % 2 == 0, 1).otherwise(4).alias("entry_type"), F.lit("me").alias("author_name"), F.lit("text").alias("comment_data"), F.lit(0).alias("is_persistent"),
        zero.alias("expiration_time"), later.alias("deletion_time"), F.lit(0).alias("deletion_time_usec"), "name", *obj,
    )
    downtime = of("view").select(
        e.alias("downtimehistory_id"), sec.alias("entry_time"), F.lit("me").alias("author_name"), F.lit("text").alias("comment_data"), F.lit(1).alias("is_fixed"), F.lit(60).cast("bigint").alias("duration"), timed(sec).alias("scheduled_start_time"),
        F.when(e % 2 == 0, zero).otherwise(sec + 90).alias("scheduled_end_time"), F.when(e % 5 == 0, 0).otherwise(1).alias("was_started"), sec.alias("actual_start_time"), usec.alias("actual_start_time_usec"), later.alias("actual_end_time"),
        F.lit(0).alias("actual_end_time_usec"), F.when(e % 4 == 0, 1).otherwise(0).alias("was_cancelled"), zero.alias("trigger_time"), "name", F.lit("").alias("triggered_by"), *obj,
    )
    flapping = of("click", "view").select(
        e.alias("flappinghistory_id"), timed(sec).alias("event_time"), usec.alias("event_time_usec"), F.when(F.col("event_type") == "click", 1000).otherwise(1001).alias("event_type"), F.col("value").alias("percent_state_change"), F.lit(5.0).alias("low_threshold"), F.lit(9.0).alias("high_threshold"), *obj,
    )
    notification = of("error").select(
        e.alias("notification_id"), (e % 9).cast("int").alias("notification_reason"), timed(sec).alias("end_time"), usec.alias("end_time_usec"), ((F.expr("event_id div 2") + F.col("user_id")) % 4).cast("int").alias("state"), F.lit("out").alias("output"), F.when(e % 2 == 0, "long").alias("long_output"), F.lit(2).alias("contacts_notified"), *obj,
    )
    state = of("error", "purchase", "signup", "click").select(
        e.alias("statehistory_id"), timed(sec).alias("state_time"), usec.alias("state_time_usec"), F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "purchase", 1).otherwise(0).alias("state"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("state_type"),
        F.lit(1).alias("current_check_attempt"), F.lit(3).alias("max_check_attempts"), F.lit(0).alias("last_state"), (e % 3).cast("int").alias("last_hard_state"), F.lit("out").alias("output"), F.lit(None).cast("string").alias("long_output"), F.lit(None).cast("string").alias("check_source"), *obj,
    )
    return {"comment": comment, "acknowledgement": comment, "downtime": downtime, "flapping": flapping, "notification": notification, "state": state}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where that is unset a local session gets a
    local one; a cluster's executors could not read it, so there it is an error."""
    import re
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-shared-")
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 16).parquet(sf_dir)
