"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import audit, customvars, enrich, graph, history, incidents, overdue, retention, sequence, sla, snapshot, upserts
from .plans import adapters as A
from .sources import scans, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sid(*parts: str) -> str:
    """SQL of functions.scalars.sha1_id."""
    one = "octet_length(encode(coalesce(cast({0} as varchar), '')))::varchar || ':' || coalesce(cast({0} as varchar), '')"
    return "sha1(" + " || ".join(one.format(p) for p in parts) + ")"


EV = """ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ms, CASE WHEN user_id % 2 = 1 THEN 'service' ELSE 'host' END AS object_type,
  cast(CASE WHEN user_id % 2 = 1 THEN user_id - 1 ELSE user_id END AS varchar) AS host_id, CASE WHEN user_id % 2 = 1 THEN cast(user_id AS varchar) END AS service_id FROM events)"""
RAW = """raw AS (SELECT event_id AS id, user_id, object_type, host_id, service_id, ms AS event_time, CASE WHEN event_type = 'click' THEN 'soft' ELSE 'hard' END AS state_type,
  CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS hard_state FROM ev WHERE event_type <> 'view')"""
ST = """st0 AS (SELECT *, lag(hard_state) OVER (PARTITION BY user_id ORDER BY event_time, id) AS b FROM raw WHERE state_type = 'hard'),
st AS (SELECT * EXCLUDE (b), coalesce(last_value(CASE WHEN b <> hard_state THEN b END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 99) AS previous_hard_state FROM st0)"""
DT = """dt AS (SELECT event_id AS downtime_id, user_id, object_type, host_id, service_id, ms AS start_time, ms + cast(floor(value * 60000) AS bigint) AS end_time, ms + cast(floor(value * 30000) AS bigint) AS cancel_time,
  event_id % 4 = 0 AS has_been_cancelled FROM ev WHERE event_type = 'view')"""


# availability


@query(f"""WITH {EV}, {RAW}, {ST}, {DT},
iv AS (SELECT user_id, object_type, host_id, service_id, 1704067200000 + d * 86400000 AS s, 1704067200000 + (d + 1) * 86400000 AS e FROM (SELECT DISTINCT user_id, object_type, host_id, service_id FROM ev), range(30) r(d)),
ini AS (SELECT iv.user_id, iv.object_type, iv.host_id, iv.service_id, s, e, coalesce(max_by(hard_state, (event_time, id)) FILTER (event_time <= s), min_by(previous_hard_state, (event_time, id)) FILTER (event_time > s), any_value(iv.user_id % 3), 0) AS h
  FROM iv LEFT JOIN st USING (user_id) GROUP BY ALL),
x AS (SELECT user_id, s, s AS t, -1 AS p, '' AS id, h, NULL AS pv, 0 AS a FROM ini
  UNION ALL SELECT user_id, s, event_time, 0, cast(id AS varchar), hard_state, previous_hard_state, 0 FROM ini JOIN st USING (user_id) WHERE event_time > s AND event_time < e
  UNION ALL SELECT user_id, s, greatest(start_time, s), 1, '', NULL, NULL, 1 FROM ini JOIN dt USING (user_id) WHERE start_time < e AND CASE WHEN has_been_cancelled THEN cancel_time ELSE end_time END >= s
  UNION ALL SELECT user_id, s, de, 2, '', NULL, NULL, -1 FROM ini JOIN (SELECT *, CASE WHEN has_been_cancelled THEN cancel_time ELSE end_time END AS de FROM dt) USING (user_id) WHERE start_time < e AND de >= s AND de < e
  UNION ALL SELECT user_id, s, e, 3, '', NULL, NULL, 0 FROM ini),
w AS (SELECT *, t - coalesce(lag(t) OVER k, s) AS seg, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id, s ORDER BY t, p, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st,
  coalesce(sum(a) OVER (PARTITION BY user_id, s ORDER BY t, p, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM x WINDOW k AS (PARTITION BY user_id, s ORDER BY t, p, id)),
g AS (SELECT user_id, s, sum(CASE WHEN pv = 99 THEN seg ELSE 0 END)::bigint AS o, sum(CASE WHEN coalesce(pv, 0) <> 99 AND st <> 99 AND n = 0 AND st > CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END THEN seg ELSE 0 END)::bigint AS b FROM w GROUP BY ALL)
SELECT host_id, service_id, s AS start, e AS end, ((2000000 * (e - s - o - b) + (e - s - o)) // (2 * (e - s - o))) / 10000.0 AS ok_percent FROM ini JOIN g USING (user_id, s)""")
def sla_ok_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    down = sla.sla_downtime_rows(A.downtimes(ev))
    current = ev.select("host_id", "service_id", (F.col("user_id") % 3).cast("int").alias("hard_state")).distinct()
    out = sla.sla_ok_percent(A.states(ev), down, A.days(ev), current)
    return out.withColumn("ok_percent", F.col("ok_percent").cast("double"))


@query(f"WITH {EV}, {RAW} SELECT id, user_id, object_type, host_id, service_id, event_time, hard_state FROM raw WHERE state_type = 'hard'")
def sla_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sla.sla_state_rows(A.raw_states(A.events(spark, sf_dir)))


@query(f"WITH {EV}, {DT} SELECT downtime_id, user_id, object_type, host_id, service_id, start_time AS downtime_start, CASE WHEN has_been_cancelled THEN cancel_time ELSE end_time END AS downtime_end FROM dt")
def sla_downtime_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sla.sla_downtime_rows(A.downtimes(A.events(spark, sf_dir)))


@query(f"WITH {EV}, {RAW} SELECT id, user_id, object_type, host_id, service_id, event_time, hard_state FROM raw WHERE state_type = 'hard'")
def backfill_sla_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.raw_states(A.events(spark, sf_dir))
    return sla.backfill_sla_states(sla.sla_state_rows(raw).filter("id % 3 = 0"), raw)


@query(f"WITH {EV}, {DT} SELECT downtime_id, user_id, object_type, host_id, service_id, start_time AS downtime_start, CASE WHEN has_been_cancelled THEN cancel_time ELSE end_time END AS downtime_end FROM dt")
def backfill_sla_downtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.downtimes(A.events(spark, sf_dir))
    return sla.backfill_sla_downtimes(sla.sla_downtime_rows(raw).filter("downtime_id % 3 = 0"), raw)


@query(f"WITH {EV}, {RAW}, {ST}, q AS (SELECT DISTINCT user_id FROM ev) SELECT q.user_id, coalesce(max_by(hard_state, (event_time, id)) FILTER (event_time <= 1705000000000), min_by(previous_hard_state, (event_time, id)) FILTER (event_time > 1705000000000), 0) AS initial FROM q LEFT JOIN st USING (user_id) GROUP BY 1")
def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    asked = ev.select("host_id", "service_id").distinct().withColumns({"start": F.lit(1705000000000), "end": F.lit(1705000000001)})
    out = sla.initial_states(A.states(ev), asked)
    return out.select(F.coalesce("service_id", "host_id").cast("bigint").alias("user_id"), "initial")


# sequences


@query(f"WITH {EV}, {RAW}, {ST} SELECT id, user_id, event_time, hard_state, previous_hard_state FROM st")
def previous_hard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.states(A.events(spark, sf_dir)).select("id", "user_id", "event_time", "hard_state", "previous_hard_state")


@query(f"""WITH {EV}, f AS (SELECT event_id, user_id, event_type = 'click' AS is_start, ms FROM ev WHERE event_type IN ('click', 'view'))
SELECT event_id, user_id, is_start, ms, CASE WHEN is_start THEN ms ELSE lag(CASE WHEN is_start THEN ms END) OVER (PARTITION BY user_id ORDER BY event_id) END AS start_time FROM f""")
def pair_start_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).filter("event_type in ('click', 'view')").select("event_id", "user_id", (F.col("event_type") == "click").alias("is_start"), "ms")
    return sequence.pair_start_end(ev, ["user_id"], ["event_id"], F.col("is_start"), "ms")


CHANGES = f"""{EV}, ch AS (SELECT cast(user_id AS varchar) AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS runtime_type, event_type, event_id AS n, ms,
  row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS k FROM ev)"""


@query(f"WITH {CHANGES} SELECT id, runtime_type, n, ms FROM ch WHERE k = 1")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = A.changes(A.events(spark, sf_dir))
    at = S.stream_id("stream_id")
    own = ch.select("id", "runtime_type", at["seq"].alias("n"), at["ms"].alias("ms"))
    return upserts.latest_changes(own, ["id"], ["ms", "n"])


@query(f"WITH {EV} SELECT event_id::varchar AS id, ms AS event_time, (event_id % 4)::int AS hard_state, ((event_id + 1) % 4)::int AS previous_hard_state FROM ev WHERE event_type = 'error' AND event_id % 2 = 1 AND event_id % 3 <> 0")
def history_stream_sla_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability rows that the stream writes besides: hard states alone."""
    return _history_tables(spark, sf_dir, "state")["sla_history_state"].read().select("id", "event_time", "hard_state", "previous_hard_state")


@query(f"WITH {EV} SELECT event_id::varchar AS downtime_id, ms AS downtime_start, CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 1 THEN ms + 1 ELSE ms + cast(floor(value * 1000) AS bigint) END AS downtime_end FROM ev WHERE event_type = 'view'")
def history_stream_sla_downtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_tables(spark, sf_dir, "downtime")["sla_history_downtime"].read().select("downtime_id", "downtime_start", "downtime_end")


@query(f"WITH {EV}, u AS (SELECT event_id, unnest([user_id, user_id + 1, user_id + 2]) AS u FROM ev WHERE event_type = 'error' AND event_id % 2 = 0) SELECT {sid('event_id')} AS notification_history_id, {sid('u')} AS user_id FROM u")
def history_stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_tables(spark, sf_dir, "notification")["user_notification_history"].read().select("notification_history_id", "user_id")


@query(f"WITH {CHANGES} SELECT id, event_type, n FROM ch WHERE k = 1 AND runtime_type = 'upsert'")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    from .streaming import changes

    schema = StructType.fromDDL("id string, event_type string, n bigint")
    empty = spark.createDataFrame([], f"id string, event_type string, n bigint, {changes.POSITION}")
    ch = A.changes(A.events(spark, sf_dir))
    first = changes.apply_changes(empty, ch.filter("pmod(xxhash64(stream_id), 2) = 0"), schema)
    return changes.live(changes.apply_changes(first, ch.filter("pmod(xxhash64(stream_id), 2) = 1"), schema))


@query(f"""WITH {EV} SELECT user_id AS id, min_by(event_type, (ms, event_id)) AS first_type, min(ms) AS entry_time, arg_max_null(CASE WHEN event_id % 3 <> 0 THEN ms END, (ms, event_id)) AS remove_time FROM ev GROUP BY 1""")
def fold_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    rows = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("first_type"), F.col("ms").alias("entry_time"), F.when(F.col("event_id") % 3 != 0, F.col("ms")).alias("remove_time"), F.struct("ms", "event_id").alias("at"))
    return upserts.fold_upserts(rows, "id", ["at"], ["remove_time"]).drop("at")


# snapshots

PARTS = """p AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part),
desired AS (SELECT *, sha1(id::varchar || '|' || name || '|' || cast(round(price * 100) AS bigint)::varchar) AS checksum FROM p WHERE id % 5 <> 0),
actual AS (SELECT *, sha1(id::varchar || '|' || name || '|' || cast(round(price * 100) AS bigint)::varchar) AS checksum FROM (SELECT id, name, CASE WHEN id % 11 = 0 THEN price + 1 ELSE price END AS price FROM p WHERE id % 7 <> 0))"""
DIFF = "diff AS (SELECT coalesce(d.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'create' WHEN d.id IS NULL THEN 'delete' ELSE 'update' END AS op FROM desired d FULL JOIN actual a ON d.id = a.id WHERE a.id IS NULL OR d.id IS NULL OR a.checksum <> d.checksum)"


@query(f"WITH {PARTS}, {DIFF} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_diff(*A.snapshots(spark, sf_dir), checksum="checksum")


@query(f"WITH {PARTS}, {DIFF} SELECT * FROM diff")
def snapshot_diff_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.digest_tree_diff(*A.snapshots(spark, sf_dir))


@query(f"WITH {PARTS} SELECT coalesce(d.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'create' WHEN d.id IS NULL THEN 'delete' ELSE 'update' END AS op FROM desired d FULL JOIN actual a ON d.id = a.id WHERE a.id IS NULL OR d.id IS NULL OR a.price IS DISTINCT FROM d.price")
def snapshot_diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_diff(*A.snapshots(spark, sf_dir), compare=["name", "price"])


@query(f"WITH {PARTS} SELECT coalesce(d.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'create' ELSE 'delete' END AS op FROM desired d FULL JOIN actual a ON d.id = a.id WHERE a.id IS NULL OR d.id IS NULL")
def snapshot_diff_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_diff(*A.snapshots(spark, sf_dir))


@query(f"WITH {PARTS} SELECT id, name, price, checksum FROM desired")
def apply_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired, actual = A.snapshots(spark, sf_dir)
    return snapshot.apply_diff(actual, desired, snapshot.snapshot_diff(desired, actual, checksum="checksum"))


@query(f"WITH {PARTS}, {DIFF} SELECT d.* FROM desired d JOIN diff USING (id) WHERE op <> 'delete'")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired, actual = A.snapshots(spark, sf_dir)
    diff = snapshot.snapshot_diff(desired, actual, checksum="checksum").filter("op <> 'delete'")
    full = scans.fetch_by_ids(desired.drop("checksum"), diff)
    sums = desired.select("id", F.col("checksum").alias("properties_checksum"))
    return scans.attach_checksums(full, sums).withColumnRenamed("properties_checksum", "checksum")


@query("SELECT printf('%08x', p_partkey) AS id, p_name AS name, p_size AS size FROM part")
def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    pairs = part.select(F.format_string("%08X", "p_partkey").alias("field"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("value"))
    return scans.read_snapshot(pairs, "name string, size int")


@query("SELECT p_partkey AS id, p_retailprice AS price FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def scan_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    return scans.scan_scoped(part.select(F.col("p_brand").alias("environment_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), brand, ["id", "price"])


# overdue

NEXT = f"{EV}, nu AS (SELECT user_id AS id, max(ms) // 1000 + cast(floor(arg_max(value, (ms, event_id))) AS bigint) AS next_update FROM ev WHERE user_id % 7 <> 0 GROUP BY 1), od AS (SELECT DISTINCT user_id AS id FROM ev WHERE user_id % 5 = 0)"
NOW = 1706600000.7


def _overdue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = A.events(spark, sf_dir)
    last = ev.filter("user_id % 7 <> 0").groupBy(F.col("user_id").alias("id")).agg(F.max("ms").alias("ms"), F.max_by("value", F.struct("ms", "event_id")).alias("v"))
    return last.select("id", (F.expr("ms div 1000") + F.floor("v")).cast("bigint").alias("next_update")), ev.filter("user_id % 5 = 0").select(F.col("user_id").alias("id")).distinct()


@query(f"WITH {NEXT} SELECT id, 'mark' AS action FROM nu WHERE next_update < 1706600000 AND id NOT IN (SELECT id FROM od) UNION ALL SELECT id, 'unmark' FROM od WHERE id NOT IN (SELECT id FROM nu WHERE next_update < 1706600000)")
def overdue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overdue.overdue_diff(*_overdue(spark, sf_dir), NOW)


@query(f"WITH {NEXT} SELECT id FROM nu WHERE next_update < 1706600000")
def apply_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    nu, od = _overdue(spark, sf_dir)
    return overdue.apply_overdue(od, overdue.overdue_diff(nu, od, NOW))


@query(f"WITH {NEXT} SELECT id FROM od")
def seed_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    return overdue.seed_overdue(ev.select(F.col("user_id").alias("id"), (F.col("user_id") % 5 == 0).alias("is_overdue")).distinct())


# sinks


@query(f"WITH {EV} SELECT user_id AS id, min_by(event_type, (ms, event_id)) AS kind FROM ev WHERE user_id % 2 = 1 GROUP BY 1 UNION ALL SELECT DISTINCT user_id, 'old' FROM ev WHERE user_id % 2 = 0")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    old = ev.filter("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.lit("old").alias("kind")).distinct()
    new = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.struct("ms", "event_id").alias("at"))
    return sinks.insert_ignore(old.withColumn("at", F.lit(None).cast(new.schema["at"].dataType)), new, "id", "at").drop("at")


@query(f"""WITH {EV} SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'old' ELSE min_by(event_type, (ms, event_id)) END AS kind, arg_max(ms, (ms, event_id)) AS last_ms FROM ev GROUP BY 1""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    old = ev.filter("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.lit("old").alias("kind"), F.lit(0).cast("bigint").alias("last_ms")).distinct()
    new = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("ms").alias("last_ms"), F.struct("ms", "event_id").alias("at"))
    return sinks.upsert(old, new, "id", ["at"], ["last_ms"])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END AS size FROM part")
def update_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    changed = part.filter("id % 4 = 0").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit(1).alias("size")))
    return sinks.update_column(part.withColumn("size", F.lit(0)), changed, "id", "size")


@query("SELECT p_partkey AS id, p_size AS size FROM part WHERE p_partkey % 4 <> 0")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return sinks.delete_ids(part, part.filter("id % 4 = 0"))


# history

_T = "event_id % 3 = 0"
_P = "ms + cast(floor(value * 1000) AS bigint)"
HIST = f"""{EV}, h AS (
SELECT event_id::varchar AS id, CASE WHEN event_id % 2 = 0 THEN 'ack_set' ELSE 'ack_clear' END AS event_type, CASE WHEN event_id % 2 = 0 THEN ms WHEN NOT {_T} THEN {_P} END AS event_time, 'acknowledgement' AS kind, event_id::varchar AS ref, object_type, host_id, service_id FROM ev WHERE event_type = 'purchase'
UNION ALL SELECT event_id::varchar, CASE WHEN event_id % 2 = 0 THEN 'comment_add' ELSE 'comment_remove' END, CASE WHEN event_id % 2 = 0 THEN ms WHEN NOT {_T} THEN {_P} ELSE ms + 5000 END, 'comment', event_id::varchar, object_type, host_id, service_id FROM ev WHERE event_type = 'signup'
UNION ALL SELECT event_id::varchar, CASE WHEN event_id % 2 = 0 THEN 'downtime_start' ELSE 'downtime_end' END, CASE WHEN event_id % 2 = 0 THEN ms WHEN {_T} THEN NULL WHEN event_id % 4 = 1 THEN ms + 1 ELSE {_P} END, 'downtime', event_id::varchar, object_type, host_id, service_id FROM ev WHERE event_type = 'view'
UNION ALL SELECT event_id::varchar, CASE WHEN event_id % 2 = 0 THEN 'flapping_start' ELSE 'flapping_end' END, CASE WHEN event_id % 2 = 0 THEN ms WHEN NOT {_T} THEN {_P} END, 'flapping', event_id::varchar, object_type, host_id, service_id FROM ev WHERE event_type = 'click'
UNION ALL SELECT event_id::varchar, 'notification', ms, 'notification', {sid('event_id')}, object_type, host_id, service_id FROM ev WHERE event_type = 'error' AND event_id % 2 = 0
UNION ALL SELECT event_id::varchar, 'state_change', ms, 'state', event_id::varchar, object_type, host_id, service_id FROM ev WHERE event_type = 'error' AND event_id % 2 = 1)"""
REFS = ", ".join(f"CASE WHEN kind = '{r.removesuffix('_history_id')}' THEN ref END AS {r}" for r in history.REFERENCES)


@query(f"WITH {HIST} SELECT id, 'env' AS environment_id, object_type, host_id, service_id, event_type, event_time, {REFS} FROM h")
def unify_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unify_history(A.history_events(A.events(spark, sf_dir))).drop("endpoint_id")


def _event_time_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: history.history_rows(kind, A.history_events(A.events(spark, sf_dir))[kind]).select("id", "event_type", "event_time")


for _kind in history.KINDS:
    QUERIES[f"event_time_{_kind}"] = _event_time_query(_kind)
    ORACLE_SQL[f"event_time_{_kind}"] = f"WITH {HIST} SELECT id, event_type, event_time FROM h WHERE kind = '{_kind}'"


@query(f"WITH {HIST} SELECT id, event_time, list_position({history.S.HISTORY_ORDER!r}, event_type)::bigint AS ordinal, row_number() OVER (PARTITION BY host_id ORDER BY event_time NULLS FIRST, list_position({history.S.HISTORY_ORDER!r}, event_type), id) AS place FROM h")
def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    h = history.unify_history(A.history_events(A.events(spark, sf_dir)))
    w = Window.partitionBy("host_id").orderBy("event_time", S.history_ordinal("event_type"), "id")
    return h.select("id", "event_time", S.history_ordinal("event_type").alias("ordinal"), F.row_number().over(w).cast("bigint").alias("place"))


@query(f"WITH {EV} SELECT {sid('event_id')} AS notification_history_id, {sid('user_id + k')} AS user_id, sha1(unhex({sid('event_id')}) || unhex({sid('user_id + k')})) AS id, 'env' AS environment_id FROM ev, range(3) r(k) WHERE event_type = 'error' AND event_id % 2 = 0")
def user_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.user_rows(A.history_events(A.events(spark, sf_dir))["notification"])


LOW, HIGH = 1704500000000, 1705500000000
#: For each kind, a time of its detail rows that is the event's own.
_DETAIL = {"acknowledgement": "set_time", "comment": "entry_time", "downtime": "start_time", "flapping": "start_time", "notification": "send_time", "state": "event_time"}


def _windowed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    kinds = A.history_events(A.events(spark, sf_dir))
    hosts = A.objects(spark, sf_dir)["hosts"].withColumn("id", F.col("id").cast("string"))
    _, key, reference = history.KINDS[kind]
    details = kinds[kind].select(key, F.col(_DETAIL[kind]).alias("detail_ms"))
    return history.history_window(history.unify_history(kinds), details, hosts, reference, key, LOW, HIGH)


for _kind in history.KINDS:
    QUERIES[f"history_window_{_kind}"] = lambda spark, sf_dir, kind=_kind: _windowed(spark, sf_dir, kind).select("id", "event_time", "host_name", history.KINDS[kind][2], "detail_ms")
    ORACLE_SQL[f"history_window_{_kind}"] = f"WITH {HIST} SELECT h.id, h.event_time, c.c_name AS host_name, h.ref AS {history.KINDS[_kind][2]}, ev.ms AS detail_ms FROM h JOIN customer c ON c.c_custkey::varchar = h.host_id JOIN ev ON ev.event_id::varchar = h.id WHERE kind = '{_kind}' AND event_time > {LOW} AND event_time < {HIGH}"


@query(f"WITH {HIST} SELECT h.id, h.event_time, c.c_name AS host_name, h.ref AS downtime_history_id FROM h JOIN customer c ON c.c_custkey::varchar = h.host_id WHERE kind = 'downtime' AND event_time > {LOW} AND event_time < {HIGH}")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, "downtime").select("id", "event_time", "host_name", "downtime_history_id")


@query(f"""WITH {HIST} SELECT h.id, c.c_name AS host_name, {sid('ev.user_id + k')} AS user_id, u.c_name AS user_name FROM h JOIN customer c ON c.c_custkey::varchar = h.host_id JOIN ev ON ev.event_id::varchar = h.id LEFT JOIN range(3) r(k) ON ev.event_id % 4 = 0
LEFT JOIN customer u ON u.c_custkey = ev.user_id + k WHERE kind = 'notification' AND event_time > {LOW} AND event_time < {HIGH}""".replace(sid("ev.user_id + k"), f"CASE WHEN k IS NOT NULL THEN {sid('ev.user_id + k')} END"))
def notified_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = A.history_events(A.events(spark, sf_dir))["notification"].filter("event_id % 4 = 0")
    users = A.table(spark, sf_dir, "customer").select(S.sha1_id("c_custkey").alias("id"), F.col("c_name").alias("name"))
    window = _windowed(spark, sf_dir, "notification")
    return history.with_notified_users(window, history.user_rows(sent), users).select("id", "host_name", "user_id", "user_name")


@query(f"""WITH {EV} SELECT event_id::varchar AS id, CASE WHEN event_id % 2 = 0 THEN 'why ' || event_id::varchar WHEN event_id % 3 = 0 OR event_id % 4 <> 1 THEN 'Downtime expired' WHEN event_id % 8 = 1 THEN 'Downtime was cancelled (cancelled by me)' ELSE 'Downtime was cancelled' END AS message FROM ev WHERE event_type = 'view'
UNION ALL SELECT event_id::varchar, CASE WHEN event_id % 2 = 0 THEN printf('Checkable started flapping (Current flapping value %.2f%% > high threshold %.2f%%)', value, 30.0::double) ELSE printf('Checkable stopped flapping (Current flapping value %.2f%% < low threshold %.2f%%)', value, 25.5::double) END FROM ev WHERE event_type = 'click'
UNION ALL SELECT event_id::varchar, CASE WHEN event_id % 3 <> 0 THEN 'Acknowledgement was cleared' || CASE WHEN event_id % 5 = 0 THEN ' (cleared by me)' ELSE '' END WHEN event_id % 2 = 0 THEN 'why' ELSE 'Checkable was acknowledged' END FROM ev WHERE event_type = 'purchase'""")
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = A.history_events(A.events(spark, sf_dir))
    e = F.col("event_id")
    down = kinds["downtime"].select("event_id", S.downtime_message("event_type", F.concat(F.lit("why "), e.cast("string")), "has_been_cancelled", F.when(e % 8 == 1, "me")).alias("message"))
    flapping = kinds["flapping"].select("event_id", S.flapping_message("value", F.when(e % 2 == 1, F.col("value")), F.lit(25.5), F.lit(30.0)).alias("message"))
    acks = kinds["acknowledgement"].select("event_id", S.acknowledgement_message("set_time", "clear_time", F.when(e % 2 == 0, "why"), F.when(e % 5 == 0, "me")).alias("message"))
    return down.unionByName(flapping).unionByName(acks).select(e.cast("string").alias("id"), "message")


@query(f"WITH {HIST} SELECT cast(floor(min(event_time) / 1000) AS bigint) AS cut_over FROM h")
def earliest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.earliest_event_second(history.unify_history(A.history_events(A.events(spark, sf_dir))))


# retention

CUT = 1706054400000  # seven days before 2024-01-31


@query(f"WITH {EV} SELECT event_id AS id, event_type, ms FROM ev WHERE NOT (user_id % 3 <> 0 AND event_type IN ('click', 'error', 'view') AND ms < CASE event_type WHEN 'view' THEN {CUT} + 5 * 86400000 WHEN 'click' THEN {CUT} ELSE {CUT} - 23 * 86400000 END)")
def apply_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    ev = A.events(spark, sf_dir).withColumn("environment_id", F.when(F.col("user_id") % 3 == 0, "other").otherwise("env"))
    names = {"click": ("comment_history", "comment_id", "remove_time"), "view": ("downtime_history", "downtime_id", "end_time"), "error": ("sla_history_state", "id", "event_time"), "purchase": ("acknowledgement_history", "id", "clear_time")}
    tables = {t: ev.filter(F.col("event_type") == kind).select("environment_id", "event_type", F.col("event_id").alias(key), F.col("ms").alias(time)) for kind, (t, key, time) in names.items()}
    kept = retention.apply_retention(tables, "env", datetime(2024, 1, 31), 7, 30, {"acknowledgement": 0, "downtime": 2})
    out = ev.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), "event_type", "ms")
    for t, key, time in names.values():
        out = out.unionByName(kept[t].select(F.col(key).alias("id"), "event_type", F.col(time).alias("ms")))
    return out


@query(f"WITH {EV} SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'own' END AS environment_id, ms AS event_time FROM ev WHERE NOT (event_id % 3 <> 0 AND ms < 1705500000000)")
def retention_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by environment and day: old days leave as partitions, the cutoff's own day is written anew."""
    import uuid

    name = f"events_{uuid.uuid4().hex}"
    rows = A.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "other").otherwise("own").alias("environment_id"), F.col("ms").alias("event_time"))
    retention.save_by_day(rows, name, "event_time", path=f"{A.scratch(spark, 'retention')}/events")
    for _ in range(2):
        left = retention.drop_old_days(spark, name, "event_time", "own", 1705500000000)
    return left.select("id", "environment_id", "event_time")


@query(f"WITH {HIST} SELECT id, kind FROM h WHERE NOT (kind = 'comment' AND try_cast(ref AS bigint) % 4 = 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = A.history_events(A.events(spark, sf_dir))
    gone = kinds["comment"].filter("cast(comment_id as bigint) % 4 = 0").select("comment_id")
    left = retention.cascade(history.unify_history(kinds), gone, "comment_history_id", "comment_id")
    kind = F.coalesce(*[F.when(F.col(r).isNotNull(), r.removesuffix("_history_id")) for r in history.REFERENCES])
    return left.select("id", kind.alias("kind"))


@query(f"WITH {EV} SELECT object_type AS environment_id, 'state' AS category, count(*) FILTER (ms < {CUT}) AS n_old, count(*) FILTER (ms >= {CUT}) AS n_kept, count(*) FILTER (ms IS NULL) AS n_open FROM ev GROUP BY 1")
def retention_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention_audit(A.events(spark, sf_dir).withColumn("environment_id", F.col("object_type")), "ms", CUT, "state")


# custom variables


NESTED = """n AS (SELECT event_id AS id, props, '{"p": ' || props || ', "list": [' || event_id::varchar || ', null, {"e": ' || event_id::varchar || 'e7}], "empty": {}, "text": "a.b"}' AS j FROM events)"""


@query(f"""WITH {NESTED} SELECT id, 'props.p.' || k AS flatname, json_extract_string(props, '$.' || k) AS flatvalue FROM (SELECT id, props, unnest(json_keys(props)) AS k FROM n)
UNION ALL SELECT id, 'props.list[0]', id::varchar FROM n UNION ALL SELECT id, 'props.list[1]', 'null' FROM n UNION ALL SELECT id, 'props.list[2].e', id::varchar || 'e7' FROM n UNION ALL SELECT id, 'props.empty', NULL FROM n UNION ALL SELECT id, 'props.text', 'a.b' FROM n""")
def flatten_customvars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    nested = F.concat(F.lit('{"p": '), "props", F.lit(', "list": ['), e, F.lit(', null, {"e": '), e, F.lit('e7}], "empty": {}, "text": "a.b"}'))
    ev = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("props").alias("name"), nested.alias("json"))
    return customvars.flatten_json(ev, "name", "json", keep=["id"])


def _customvars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = A.table(spark, sf_dir, "events")
    own = ev.select(F.col("event_id").cast("string").alias("id"), F.lit(A.ENV).alias("environment_id"), F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("name"), F.col("props").alias("value"))
    return own, ev.select(F.col("user_id").alias("host_id"), F.col("event_id").cast("string").alias("customvar_id"))


@query("WITH p AS (SELECT event_id, user_id, 'v' || (event_id % 4)::varchar AS name, unnest(json_keys(props)) AS k, props FROM events) SELECT user_id AS host_id, name, name || '.' || k AS flatname, json_extract_string(props, '$.' || k) AS flatvalue FROM p")
def object_flat_customvars(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, links = _customvars(spark, sf_dir)
    return customvars.object_flat_customvars(links, own, customvars.flatten_customvars(own), "host_id")


@query("SELECT user_id AS host_id, 'v' || (event_id % 4)::varchar AS name, min_by(props, event_id) AS value FROM events GROUP BY 1, 2")
def object_customvars(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, links = _customvars(spark, sf_dir)
    first = links.join(own.select(F.col("id").alias("customvar_id"), "name"), "customvar_id").groupBy("host_id", "name").agg(F.min(F.col("customvar_id").cast("bigint")).cast("string").alias("customvar_id"))
    return customvars.object_customvars(first.select("host_id", "customvar_id"), own, "host_id").select("host_id", F.explode("vars").alias("name", "value"))


@query(f"""WITH p AS (SELECT event_id AS id, event_id % 3 <> 0 OR event_id % 15 = 0 AS desired, event_id % 5 <> 0 AS actual, 'v' || (event_id % 4)::varchar AS name, props FROM events)
SELECT {sid("'env'", "id", "name || '.' || k", "json_extract_string(props, '$.' || k)")} AS id, CASE WHEN desired THEN 'create' ELSE 'delete' END AS op, 'flat' AS side FROM (SELECT *, unnest(json_keys(props)) AS k FROM p WHERE desired <> actual)
UNION ALL SELECT id::varchar, CASE WHEN desired THEN 'create' ELSE 'delete' END, 'own' FROM p WHERE desired <> actual""")
def customvar_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = _customvars(spark, sf_dir)
    e = F.col("id").cast("bigint")
    desired, actual = own.filter((e % 3 != 0) | (e % 15 == 0)), own.filter(e % 5 != 0)
    rows, flat = customvars.customvar_diff(desired, actual, customvars.flatten_customvars(actual))
    return flat.withColumn("side", F.lit("flat")).unionByName(rows.withColumn("side", F.lit("own")))


# objects and groups


@query("SELECT DISTINCT c_custkey AS host_id, n_name AS name, lower(n_name) AS display_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hostgroups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    return enrich.groups_of(o["hostgroup_members"], o["hostgroups"], "host_id", "hostgroup_id")


@query("SELECT DISTINCT o_custkey AS host_id, o_orderpriority AS name, lower(o_orderpriority) AS display_name FROM orders")
def servicegroups_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    return enrich.servicegroups_of_hosts(o["servicegroup_members"], o["services"], o["servicegroups"])


@query("SELECT o_custkey AS host_id, o_orderkey AS id, 'order ' || o_orderkey::varchar AS name, o_orderstatus AS display_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 = 0")
def services_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    return enrich.services_of_hosts(o["services"], o["hosts"].filter("is_volatile"))


STATES_NOW = f"""{EV}, {RAW}, {ST}, last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) = 1),
ob AS (SELECT c_custkey AS user_id, c_name AS n, lower(c_name) AS d, c_custkey % 3 = 0 AS vol FROM customer),
e AS (SELECT l.user_id, l.object_type, l.host_id, l.service_id, l.hard_state, l.previous_hard_state, h.n AS host_name, h.d AS host_display, s.n AS service_name, s.d AS service_display, l.user_id % 4 = 0 AS dt, l.user_id % 5 = 0 AS ack, l.user_id % 6 = 0 AS flap, l.id
  FROM last l JOIN ob h ON h.user_id::varchar = l.host_id LEFT JOIN ob s ON s.user_id::varchar = l.service_id WHERE NOT (l.hard_state = 99 OR (l.hard_state = 0 AND l.previous_hard_state = 99)) AND (l.service_id IS NULL OR s.n IS NOT NULL) AND (l.user_id % 9 <> 0 OR h.vol)),
sev AS (SELECT *, CASE WHEN object_type = 'service' THEN ['ok', 'warning', 'crit', 'err'][hard_state + 1] ELSE ['ok', 'crit'][hard_state + 1] END AS severity, dt OR ack OR flap AS muted FROM e)"""


def _state_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = A.events(spark, sf_dir)
    st = upserts.latest_changes(A.states(ev), ["user_id"], ["event_time", "id"])
    flag = lambda k: F.col("user_id") % k == 0
    st = st.withColumns({"environment_id": F.lit(A.ENV), "state_type": F.when(flag(9), "soft").otherwise("hard"), "output": F.concat(F.lit("event "), F.col("id").cast("string")), "long_output": F.when(flag(2), F.lit("more")), "in_downtime": flag(4), "is_acknowledged": flag(5), "is_flapping": flag(6)})
    c = A.objects(spark, sf_dir)["hosts"].withColumn("id", F.col("id").cast("string"))
    hosts = c.select(F.col("id").alias("host_id"), F.col("name").alias("host_name"), F.col("display_name").alias("host_display_name"), "is_volatile")
    no = F.lit(None).cast("string")
    odd = c.filter("cast(id as bigint) % 2 = 1").select(F.col("id").alias("service_id"), F.col("name").alias("service_name"), F.col("display_name").alias("service_display_name"), (F.col("id").cast("bigint") - 1).cast("string").alias("host_id"))
    objects = hosts.withColumns({"service_id": no, "service_name": no, "service_display_name": no}).unionByName(odd.join(hosts, "host_id"))
    return enrich.build_state_events(st, objects)


@query(f"""WITH {STATES_NOW} SELECT host_id, service_id, host_name || coalesce('/' || service_name, '') || '/env' AS tags, CASE WHEN service_id IS NULL THEN host_display ELSE host_display || ': ' || service_display END AS name,
CASE WHEN service_id IS NULL THEN '/monitoring/host?name=' || replace(host_name, '#', '%23') ELSE '/monitoring/service?name=' || replace(service_name, '#', '%23') || '&host.name=' || replace(host_name, '#', '%23') END AS url,
'event ' || id::varchar || CASE WHEN user_id % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS message, severity, muted,
CASE WHEN NOT muted THEN 'Checkable is not muted (no active downtime, no acknowledgement, and not flapping)' ELSE 'Checkable is muted due to' || CASE WHEN dt THEN ' currently active downtime' ELSE '' END || CASE WHEN ack AND dt THEN ', and an acknowledgement' WHEN ack THEN ' an acknowledgement' ELSE '' END
|| CASE WHEN flap AND (dt OR ack) THEN ', and flapping as well' WHEN flap THEN ' flapping state' ELSE '' END || '.' END AS muted_reason, severity = 'ok' AND NOT muted AS close, NOT (severity = 'ok' AND NOT muted) AND hard_state = previous_hard_state AS notify FROM sev WHERE severity IS NOT NULL""")
def build_state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.concat_ws("/", F.col("tags")["host"], F.col("tags")["service"], F.col("tags")["environment"])
    return _state_events(spark, sf_dir)[0].select("host_id", "service_id", tags.alias("tags"), "name", "url", "message", "severity", "muted", "muted_reason", "close", "notify")


@query(f"WITH {STATES_NOW} SELECT host_id, service_id, hard_state FROM sev WHERE severity IS NULL")
def rejected_state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_events(spark, sf_dir)[1].select("host_id", "service_id", "hard_state")


@query(f"""WITH {STATES_NOW} SELECT s.host_id, s.service_id, CASE WHEN s.service_id IS NULL THEN (SELECT count(*) FROM orders WHERE o_custkey::varchar = s.host_id) ELSE (SELECT count(*) FROM orders WHERE o_orderkey::varchar = s.service_id) END AS n_services,
(SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey::varchar = s.host_id) AS hostgroup, s.object_type AS type,
(SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE CASE WHEN s.service_id IS NULL THEN o_custkey::varchar = s.host_id ELSE o_orderkey::varchar = s.service_id END) AS servicegroups,
(s.host_id::bigint % 3 = 0)::varchar AS host_volatile, (SELECT o_orderstatus FROM orders WHERE o_orderkey::varchar = s.service_id) AS service_status FROM sev s WHERE severity IS NOT NULL""")
def enrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, _ = _state_events(spark, sf_dir)
    o = A.objects(spark, sf_dir)
    text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    hg = text(enrich.groups_of(o["hostgroup_members"], o["hostgroups"], "host_id", "hostgroup_id"), "host_id")
    sg = text(enrich.groups_of(o["servicegroup_members"], o["servicegroups"], "service_id", "servicegroup_id"), "service_id")
    hsg = text(enrich.servicegroups_of_hosts(o["servicegroup_members"], o["services"], o["servicegroups"]), "host_id")
    hv = text(o["hosts"].select(F.col("id").alias("host_id"), F.create_map(F.lit("volatile"), F.col("is_volatile").cast("string")).alias("vars")), "host_id")
    sv = text(o["services"].select(F.col("id").alias("service_id"), F.create_map(F.lit("status"), F.col("display_name")).alias("vars")), "service_id")
    out = enrich.enrich_events(ev, text(o["services"], "id", "host_id"), hg, sg, hsg, hv, sv)
    r = F.from_json("relations", "services array<struct<name:string>>, hostgroups array<struct<name:string>>, servicegroups array<struct<name:string>>, object struct<type:string>, vars struct<host:map<string,string>,service:map<string,string>>")
    return out.select(
        "host_id", "service_id", F.coalesce(F.size(r["services"]), F.lit(0)).cast("bigint").alias("n_services"), r["hostgroups"][0]["name"].alias("hostgroup"), r["object"]["type"].alias("type"),
        F.when(F.size(r["servicegroups"]) > 0, F.array_join(r["servicegroups"]["name"], ",")).alias("servicegroups"), r["vars"]["host"]["volatile"].alias("host_volatile"), r["vars"]["service"]["status"].alias("service_status"),
    )


@query(f"WITH {STATES_NOW} SELECT CASE WHEN service_id IS NULL THEN {sid(chr(39) + 'env' + chr(39), 'host_name')} ELSE {sid(chr(39) + 'env' + chr(39), 'host_name || chr(33) || service_name')} END AS object_id, severity FROM sev WHERE severity IS NOT NULL")
def incident_object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_events(spark, sf_dir)[0].select(enrich.incident_object_id().alias("object_id"), "severity")


# incidents

INC = f"{EV}, s AS (SELECT user_id AS object_id, arg_max(event_type, (ms, event_id)) AS severity, user_id % 4 = 0 AS muted, any_value(object_type) AS object_type FROM ev GROUP BY 1), i AS (SELECT object_id, CASE WHEN object_id % 3 = 0 THEN severity ELSE 'click' END AS severity, object_id % 8 = 0 AS muted, object_type FROM s WHERE object_id % 5 <> 0)"


def _incidents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = A.events(spark, sf_dir)
    s = ev.groupBy(F.col("user_id").alias("object_id")).agg(F.max_by("event_type", F.struct("ms", "event_id")).alias("severity"), F.first("object_type").alias("object_type")).withColumn("muted", F.col("object_id") % 4 == 0)
    i = s.filter("object_id % 5 <> 0").withColumns({"severity": F.when(F.col("object_id") % 3 == 0, F.col("severity")).otherwise("click"), "muted": F.col("object_id") % 8 == 0})
    return i, s


@query(f"WITH {INC} SELECT s.object_id, s.severity, s.muted, s.object_type, CASE WHEN i.object_id IS NULL THEN 'new' ELSE 'changed' END AS reason FROM s LEFT JOIN i USING (object_id) WHERE i.object_id IS NULL OR i.severity <> s.severity OR i.muted <> s.muted")
def incident_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.incident_diff(*_incidents(spark, sf_dir))


@query(f"WITH {INC} SELECT object_id, object_type FROM i WHERE object_id % 11 = 0 OR (object_type = 'host' AND object_id % 6 <> 0)")
def obsolete_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = _incidents(spark, sf_dir)
    return incidents.obsolete_incidents(i, s.filter("object_id % 6 = 0"), s.filter("object_id % 11 = 0"), "host").select("object_id", "object_type")


@query(f"WITH {EV} SELECT event_id AS id, ms AS last_update FROM ev WHERE event_id % 3 <> 0 AND ms >= 1705000000000")
def updated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ms").alias("last_update"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("output"))
    return incidents.updated_outputs(ev, 1705000000000).drop("output")


# dependencies

DEP = """up AS (SELECT 'es' || s_suppkey::varchar AS id, 's' || s_suppkey::varchar AS f, 'n' || s_nationkey::varchar AS t FROM supplier UNION ALL SELECT 'gs' || s_suppkey::varchar, 's' || s_suppkey::varchar, 'r' || (s_nationkey % 6)::varchar FROM supplier),
nodes AS (SELECT 's' || s_suppkey::varchar AS id, 's' || s_suppkey::varchar AS host_id, NULL::varchar AS grp FROM supplier UNION ALL SELECT 'n' || n_nationkey::varchar, 'n' || n_nationkey::varchar, CASE WHEN n_nationkey % 10 = 9 THEN 'r0' END FROM nation UNION ALL SELECT 'r' || r_regionkey::varchar, NULL, 'r' || r_regionkey::varchar FROM region),
hosts AS (SELECT 's' || s_suppkey::varchar AS id, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'n' || n_nationkey::varchar, n_name FROM nation),
grps AS (SELECT 'r' || r_regionkey::varchar AS id, r_name AS display_name FROM region)"""


@query(f"WITH {DEP} SELECT h.name AS child, p.name AS parent_host, g.display_name AS parent_group FROM up JOIN nodes c ON c.id = up.f JOIN hosts h ON h.id = c.host_id JOIN nodes n ON n.id = up.t LEFT JOIN hosts p ON p.id = n.host_id LEFT JOIN grps g ON g.id = n.grp")
def dependency_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.dependencies(spark, sf_dir)
    return graph.parents_of(d["edges"], d["nodes"], d["hosts"], d["groups"])


@query(f"WITH {DEP} SELECT DISTINCT g.id, g.display_name FROM up JOIN nodes c ON c.id = up.f JOIN hosts h ON h.id = c.host_id JOIN nodes n ON n.id = up.t JOIN grps g ON g.id = n.grp WHERE h.name LIKE '%1%'")
def redundancy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.dependencies(spark, sf_dir)
    return graph.redundancy_groups_of(d["hosts"].filter("name like '%1%'"), d["edges"], d["nodes"], d["groups"])


@query(f"""WITH {DEP} SELECT 'node_host' AS "check", id, host_id AS missing FROM nodes WHERE host_id NOT IN (SELECT id FROM hosts) UNION ALL SELECT 'node_group', id, grp FROM nodes WHERE grp NOT IN (SELECT id FROM grps)
UNION ALL SELECT 'edge_to', id, t FROM up WHERE t NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'edge_state', id, 'none' FROM up WHERE id LIKE 'g%'""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.dependencies(spark, sf_dir)
    return graph.dangling(d["nodes"], d["edges"], d["hosts"], d["services"], d["groups"], d["edge_states"])


@query(f"WITH {DEP} SELECT id FROM nodes WHERE (host_id IS NOT NULL) = (grp IS NOT NULL)")
def invalid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.invalid_nodes(A.dependencies(spark, sf_dir)["nodes"]).select("id")


@query("""SELECT 'order ' || o_orderkey::varchar AS notification, c_name AS "user", n_name AS usergroup FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 3 <> 0 LEFT JOIN nation ON o_orderkey % 3 <> 1 AND n_nationkey = o_custkey % 25""")
def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    to = o["services"].select(F.col("id").alias("notification_id"), F.when(F.col("id") % 3 != 0, F.col("host_id")).alias("user_id"), F.when(F.col("id") % 3 != 1, F.col("host_id") % 25).alias("usergroup_id"))
    return graph.recipients(o["services"], to, o["hosts"], o["hostgroups"])


# counts


BOUNDS = "b AS (SELECT min(event_id) AS low, (min(event_id) + max(event_id)) // 2 AS mid, max(event_id) AS high FROM events)"


def _bounds(events: DataFrame) -> tuple[int, int, int]:
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    return low, (low + high) // 2, high


@query(f"WITH {BOUNDS} SELECT CASE WHEN event_id <= mid THEN 1 ELSE 0 END AS migrated, count(*) AS n FROM events, b GROUP BY 1")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    low, mid, high = _bounds(events)
    return audit.migration_counts(events, "event_id", mid, low, high)


@query("SELECT count(*) AS n FROM events JOIN customer ON c_custkey = user_id")
def joined_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    return audit.joined_count(events, A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "event_id", _bounds(events)[2])


@query("SELECT c_nationkey AS environment_id, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1 HAVING count(*) > 1")
def responsible_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.responsible_instances(A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("environment_id"), (F.col("c_acctbal") > 5000).alias("responsible")))


@query("SELECT count(*) AS n FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def count_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.count_prefix(A.table(spark, sf_dir, "customer"), "c_name", "Customer#0000001")


@query("SELECT date_trunc('second', ts) AS second, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def change_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.change_counters(A.table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"))


@query("SELECT date_trunc('second', ts) AS second, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)")
def stream_change_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second is put out once the newest event is ten seconds past its end; the last ones are still open when the source is read."""
    stream = A.event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    out = _streamed(audit.stream_change_counters(stream), A.scratch(spark, "counters"))
    return out.select(F.col("second").cast("timestamp_ntz").alias("second"), "kind", "n")


@query("SELECT event_id, value FROM events WHERE cast(event_id AS varchar) LIKE '1%5'")
def text_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").filter(S.text_like("event_id", "1%5")).select("event_id", "value")


@query("SELECT coalesce(min(o_orderkey) FILTER (o_orderdate >= timestamp '1996-01-01'), 9223372036854775807) AS from_id, coalesce(max(o_orderkey) FILTER (o_orderdate <= timestamp '1997-01-01'), 0) AS to_id FROM orders")
def id_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    return scans.id_range(o, "o_orderkey", ["o_orderdate"], ["o_orderdate"], F.expr("timestamp_ntz'1996-01-01'"), F.expr("timestamp_ntz'1997-01-01'"))


@query("SELECT * FROM (SELECT event_id, event_type FROM events WHERE event_id > 123 ORDER BY event_id LIMIT 200)")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.keyset_page(A.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 123, 200)


@query(f"WITH {BOUNDS} SELECT event_id, user_id, CASE WHEN event_id <= mid THEN 1 ELSE 2 END AS run FROM events, b")
def read_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    low, mid, high = _bounds(A.table(spark, sf_dir, "events"))
    runs = [scans.read_legacy(spark, path, "event_id", low, mid), scans.read_legacy(spark, path, "event_id", low, high, mid)]
    return runs[0].select("event_id", "user_id", F.lit(1).alias("run")).unionByName(runs[1].select("event_id", "user_id", F.lit(2).alias("run")))


@query("SELECT source, max(epoch_us(ts) // 1000) AS last_ms FROM (SELECT user_id::varchar AS source, ts FROM events) GROUP BY 1 HAVING max(epoch_us(ts) // 1000) + 65000 < 1706500000000")
def silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.stateful import silent_sources as silent

    return silent(A.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), "ms"), 1706500000000)


# scalar functions


@query(f"""WITH {EV} SELECT event_id, {sid("'env'", 'event_type', 'user_id')} AS id, CASE WHEN user_id % 2 = 1 THEN {sid("'env'", "host_id || '!' || service_id")} END AS service_id,
CASE event_id % 5 WHEN 1 THEN 'comment' WHEN 4 THEN 'ack' ELSE (event_id % 5)::varchar END AS entry_type, CASE event_id % 3 WHEN 0 THEN 'soft' WHEN 1 THEN 'hard' ELSE '2' END AS state_type,
CASE event_id % 9 WHEN 0 THEN CASE WHEN user_id % 3 = 0 THEN 'recovery' ELSE 'problem' END WHEN 1 THEN 'acknowledgement' WHEN 2 THEN 'flapping_start' WHEN 3 THEN 'flapping_end' WHEN 5 THEN 'downtime_start' WHEN 6 THEN 'downtime_end' WHEN 7 THEN 'downtime_removed' WHEN 8 THEN 'custom' END AS reason,
CASE WHEN event_id % 7 = 6 THEN 99 ELSE least(event_id % 7, CASE WHEN object_type = 'host' THEN 1 ELSE 3 END) END AS clamped, CASE WHEN event_id % 10 = 0 AND event_id % 4 = 0 THEN NULL ELSE (event_id % 10) * 1000 + (event_id % 4) * 1000 // 1000 END AS at_ms,
CASE WHEN event_id % 6 - 2 < 0 THEN 0 ELSE (event_id % 6 - 2) * 1000 END AS capped, host_id || '!' || coalesce(service_id, '') || '-' || event_id::varchar AS name, CASE WHEN user_id % 2 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'crit' ELSE 'warning' END END AS severity,
CASE WHEN event_id % 4 = 0 THEN 0 ELSE ms // 1000 END AS unix, coalesce(['downtime_start', 'downtime_end', 'downtime_removed', 'custom', 'acknowledgement', 'problem', 'recovery', 'flapping_start', 'flapping_end'][event_id % 10 + 1], '512') AS notification FROM ev""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    e = F.col("event_id")
    return ev.select(
        "event_id", S.sha1_id(F.lit("env"), "event_type", "user_id").alias("id"), S.service_id(F.lit("env"), "host_id", "service_id").alias("service_id"), S.entry_type(e % 5).alias("entry_type"), S.state_type(e % 3).alias("state_type"),
        S.notification_reason(e % 9, F.col("user_id") % 3).alias("reason"), S.clamp_state(F.when(e % 7 == 6, 99).otherwise(e % 7), "object_type").alias("clamped"), S.seconds_to_millis(e % 10, (e % 4) * 1000).alias("at_ms"),
        S.capped_seconds(e % 6 - 2).cast("bigint").alias("capped"), S.synthetic_name("host_id", "service_id", e).alias("name"), F.when(F.col("user_id") % 2 == 1, S.severity("object_type", F.when(e % 2 == 0, 2).otherwise(1))).alias("severity"),
        S.unix_or_zero(F.when(e % 4 != 0, F.timestamp_millis("ms"))).alias("unix"), S.notification_type(F.pow(F.lit(2), e % 10).cast("int")).alias("notification"),
    )


@query("SELECT DISTINCT lower(p_type) AS name, count(*) OVER (PARTITION BY lower(p_type)) AS n FROM part")
def name_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part").select(S.name_ci(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type"))).alias("name"))
    return part.groupBy("name").agg(F.count("*").alias("n")).select(F.lower(F.collate("name", "UTF8_BINARY")).alias("name"), "n")


@query("""WITH a AS (SELECT event_id, event_id % 6 AS f, printf('0a%02x%02x%02x', event_id // 65536 % 256, event_id // 256 % 256, event_id % 256) AS d, printf('20010db80000000000000000%04x%04x', event_id // 65536 % 65536, event_id % 65536) AS x FROM events)
SELECT event_id, CASE WHEN f IN (2, 4) THEN d END AS v4, CASE WHEN f IN (2, 4) THEN '00000000000000000000ffff' || d WHEN f = 1 THEN x END AS v6 FROM a""")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.addresses import ipv4_bytes, ipv6_bytes

    e = F.col("event_id")
    byte = lambda n: F.expr(f"event_id div {n} % 256").cast("string")
    v4 = F.concat_ws(".", F.lit("10"), byte(65536), byte(256), byte(1))
    v6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.expr("event_id div 65536 % 65536"))), F.lit(":"), F.lower(F.hex(e % 65536)))
    form = {1: v6, 2: v4, 3: F.concat(F.lit("no address "), e.cast("string")), 4: F.concat(F.lit("::ffff:"), v4), 5: F.concat(v6, F.lit("%eth0"))}
    ip = F.coalesce(*[F.when(e % 6 == k, c) for k, c in form.items()])  # null for the rest
    ev = A.table(spark, sf_dir, "events").withColumn("ip", ip)
    return ev.select("event_id", F.lower(F.hex(ipv4_bytes("ip"))).alias("v4"), F.lower(F.hex(ipv6_bytes("ip"))).alias("v6"))


# backfills


@query("SELECT o_orderkey AS id, o_orderstatus IN ('F', 'O') AS is_acknowledged, o_orderstatus = 'F' AS is_sticky_acknowledgement FROM orders")
def split_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import legacy_etl

    flag = F.when(F.col("o_orderstatus") == "F", "sticky").when(F.col("o_orderstatus") == "O", "y").otherwise("n")
    return legacy_etl.split_acknowledged(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), flag.alias("is_acknowledged")))


@query(f"WITH {EV}, {DT} SELECT downtime_id, CASE WHEN downtime_id % 3 <> 0 THEN 5 WHEN has_been_cancelled THEN 77 ELSE end_time - start_time END AS duration FROM dt")
def fill_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import legacy_etl

    d = A.downtimes(A.events(spark, sf_dir)).select("downtime_id", F.col("has_been_cancelled").alias("is_flexible"), F.lit(77).cast("bigint").alias("flexible_duration"), F.col("start_time").alias("scheduled_start_time"), F.col("end_time").alias("scheduled_end_time"), F.when(F.col("downtime_id") % 3 == 0, 0).otherwise(5).cast("bigint").alias("duration"))
    return legacy_etl.fill_durations(d).select("downtime_id", "duration")


@query("SELECT o_orderkey::varchar AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::varchar ELSE 'kept' END AS host_id FROM orders")
def fill_host_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import legacy_etl

    services = A.objects(spark, sf_dir)["services"].select(F.col("id").cast("string").alias("id"), F.col("host_id").cast("string").alias("host_id"))
    st = services.select(F.lit("").alias("id"), F.col("id").alias("service_id"), F.when(F.col("id").cast("bigint") % 2 == 0, "0000").otherwise("kept").alias("host_id"))
    return legacy_etl.state_ids(legacy_etl.fill_host_ids(st, services), "service_id").select("id", "host_id")


# legacy conversion: history rows of each kind, with the ids that are made of them

ENV_ = "'env'"
LEGACY = f"{EV}, o AS (SELECT *, host_id AS name1, coalesce(service_id, '') AS name2, host_id || CASE WHEN service_id IS NULL THEN '' ELSE '!' || service_id END AS obj, 'n' || event_id::varchar AS name FROM ev)"


def _converted(kind: str, table: str = "history", *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans import legacy_etl

        ev = A.events(spark, sf_dir)
        rows = A.legacy(ev)[kind]
        convert = legacy_etl.CONVERTERS[kind][1]
        if kind == "notification":
            contacts = ev.select(F.col("event_id").alias("notification_id"), F.explode(F.array(F.lit("ann"), F.lit("bob"))).alias("contact"))
            return convert(A.ENV, rows, contacts)[table].select(*columns)
        return convert(A.ENV, rows)[table].select(*columns)

    return run


def _legacy_query(name: str, kind: str, table: str, columns: tuple[str, ...], sql: str) -> None:
    QUERIES[name] = _converted(kind, table, *columns)
    ORACLE_SQL[name] = f"WITH {LEGACY} {sql}"


_REMOVED = "CASE WHEN event_id % 3 <> 0 THEN (ms // 1000 + 5) * 1000 END"
_COMMENT, _ACK = "FROM o WHERE event_type = 'signup' AND event_id % 2 = 0 AND event_id % 7 <> 0", "FROM o WHERE event_type = 'signup' AND event_id % 2 = 1 AND event_id % 7 <> 0"
_legacy_query("convert_comments", "comment", "history", ("id", "event_type", "event_time", "comment_history_id"), f"""SELECT {sid(ENV_, "'comment_add'", 'name')} AS id, 'comment_add' AS event_type, ms AS event_time, {sid(ENV_, 'name')} AS comment_history_id {_COMMENT}
UNION ALL SELECT {sid(ENV_, "'comment_remove'", 'name')}, 'comment_remove', {_REMOVED}, {sid(ENV_, 'name')} {_COMMENT} AND event_id % 3 <> 0""")
_legacy_query("convert_comments_detail", "comment", "comment_history", ("comment_id", "entry_time", "remove_time", "has_been_removed", "entry_type"), f"SELECT {sid(ENV_, 'name')} AS comment_id, ms AS entry_time, {_REMOVED} AS remove_time, event_id % 3 <> 0 AS has_been_removed, 'comment' AS entry_type {_COMMENT}")
_legacy_query("convert_acks", "acknowledgement", "acknowledgement_history", ("id", "object_type", "set_time", "clear_time"), f"SELECT {sid(ENV_, 'obj', 'ms')} AS id, object_type, ms AS set_time, {_REMOVED} AS clear_time {_ACK}")
_legacy_query("convert_acks_history", "acknowledgement", "history", ("id", "event_type", "event_time", "acknowledgement_history_id"), f"""SELECT {sid(ENV_, "'ack_set'", 'obj', 'ms')} AS id, 'ack_set' AS event_type, ms AS event_time, {sid(ENV_, 'obj', 'ms')} AS acknowledgement_history_id {_ACK}
UNION ALL SELECT {sid(ENV_, "'ack_clear'", 'obj', 'ms')}, 'ack_clear', {_REMOVED}, {sid(ENV_, 'obj', 'ms')} {_ACK} AND event_id % 3 <> 0""")
_DOWN = "FROM o WHERE event_type = 'view' AND event_id % 5 <> 0 AND event_id % 7 <> 0"
_ENDED = f"CASE WHEN event_id % 4 = 0 THEN {_REMOVED} ELSE coalesce({_REMOVED}, (ms // 1000 + CASE WHEN event_id % 2 = 0 THEN 60 ELSE 90 END) * 1000) END"
_legacy_query("convert_downtimes", "downtime", "sla_history_downtime", ("downtime_id", "downtime_start", "downtime_end"), f"SELECT {sid(ENV_, 'name')} AS downtime_id, ms AS downtime_start, {_ENDED} AS downtime_end {_DOWN}")
_legacy_query("convert_downtimes_detail", "downtime", "downtime_history", ("downtime_id", "start_time", "end_time", "scheduled_end_time", "has_been_cancelled", "cancel_time"), f"""SELECT {sid(ENV_, 'name')} AS downtime_id, ms AS start_time, coalesce({_REMOVED}, (ms // 1000 + CASE WHEN event_id % 2 = 0 THEN 60 ELSE 90 END) * 1000) AS end_time,
(ms // 1000 + CASE WHEN event_id % 2 = 0 THEN 60 ELSE 90 END) * 1000 AS scheduled_end_time, event_id % 4 = 0 AS has_been_cancelled, CASE WHEN event_id % 4 = 0 THEN {_REMOVED} END AS cancel_time {_DOWN}""")
_legacy_query("convert_downtimes_history", "downtime", "history", ("id", "event_type", "event_time", "downtime_history_id"), f"""SELECT {sid(ENV_, "'downtime_start'", 'name')} AS id, 'downtime_start' AS event_type, ms AS event_time, {sid(ENV_, 'name')} AS downtime_history_id {_DOWN}
UNION ALL SELECT {sid(ENV_, "'downtime_end'", 'name')}, 'downtime_end', {_ENDED}, {sid(ENV_, 'name')} {_DOWN} AND event_id % 3 <> 0""")
_FLAP = "(SELECT *, lead(event_type) OVER w AS nt, lead(ms) OVER w AS nms, lead(value) OVER w AS nv FROM o WHERE event_type IN ('click', 'view') AND event_id % 7 <> 0 WINDOW w AS (PARTITION BY obj ORDER BY event_id)) WHERE event_type = 'click'"
_legacy_query("convert_flapping", "flapping", "flapping_history", ("id", "start_time", "end_time", "percent_state_change_start", "percent_state_change_end"), f"""SELECT {sid(ENV_, 'obj', 'ms')} AS id, ms AS start_time, CASE WHEN nt = 'view' THEN nms END AS end_time, value AS percent_state_change_start, CASE WHEN nt = 'view' THEN nv END AS percent_state_change_end FROM {_FLAP}""")
_legacy_query("convert_flapping_history", "flapping", "history", ("id", "event_type", "event_time", "flapping_history_id"), f"""SELECT {sid(ENV_, "'flapping_start'", 'obj', 'ms')} AS id, 'flapping_start' AS event_type, ms AS event_time, {sid(ENV_, 'obj', 'ms')} AS flapping_history_id FROM {_FLAP}
UNION ALL SELECT {sid(ENV_, "'flapping_end'", 'obj', 'ms')}, 'flapping_end', nms, {sid(ENV_, 'obj', 'ms')} FROM {_FLAP} AND nt = 'view'""")
#: Notifications: the state of every row counts for the next ones' previous state; rows without a time or a known reason are left out.
_NOTE = """(SELECT *, CASE event_id % 9 WHEN 0 THEN CASE WHEN s = 0 THEN 'recovery' ELSE 'problem' END WHEN 1 THEN 'acknowledgement' WHEN 2 THEN 'flapping_start' WHEN 3 THEN 'flapping_end' WHEN 5 THEN 'downtime_start' WHEN 6 THEN 'downtime_end' WHEN 7 THEN 'downtime_removed' WHEN 8 THEN 'custom' END AS type,
coalesce(last_value(CASE WHEN b <> s THEN b END IGNORE NULLS) OVER (PARTITION BY obj ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 99) AS prev FROM (SELECT *, (event_id // 2 + user_id) % 4 AS s, lag((event_id // 2 + user_id) % 4) OVER (PARTITION BY obj ORDER BY event_id) AS b FROM o WHERE event_type = 'error')) WHERE type IS NOT NULL AND event_id % 7 <> 0"""
_NOTE_ID = sid(ENV_, "event_id", "type", "ms")
_legacy_query("convert_notifications", "notification", "notification_history", ("id", "type", "send_time", "state", "previous_hard_state", "text"), f"SELECT {_NOTE_ID} AS id, type, ms AS send_time, s AS state, prev AS previous_hard_state, 'out' || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'long' ELSE '' END AS text FROM {_NOTE}")
_legacy_query("convert_notifications_history", "notification", "history", ("id", "event_type", "event_time", "notification_history_id"), f"""SELECT {sid(ENV_, "'notification'", 'event_id', 'type', 'ms')} AS id, 'notification' AS event_type, ms AS event_time, {_NOTE_ID} AS notification_history_id FROM {_NOTE}""")
_legacy_query("convert_notifications_users", "notification", "user_notification_history", ("id", "notification_history_id", "user_id"), f"""SELECT sha1(unhex({_NOTE_ID}) || unhex({sid(ENV_, 'c')})) AS id, {_NOTE_ID} AS notification_history_id, {sid(ENV_, 'c')} AS user_id FROM (SELECT * FROM {_NOTE}), (VALUES ('ann'), ('bob')) v(c)""")
_STATE = """(SELECT *, CASE WHEN event_type = 'click' THEN least(event_id % 3, CASE WHEN object_type = 'host' THEN 1 ELSE 3 END) ELSE s END AS hard, CASE WHEN event_type = 'click' THEN 'soft' ELSE 'hard' END AS kind,
coalesce(last_value(CASE WHEN b <> event_id % 3 THEN b END IGNORE NULLS) OVER (PARTITION BY obj ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 99) AS prev
FROM (SELECT *, lag(event_id % 3) OVER (PARTITION BY obj ORDER BY event_id) AS b, CASE WHEN event_type = 'error' THEN CASE WHEN object_type = 'host' THEN 1 ELSE 3 END WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS s FROM o WHERE event_type <> 'view')) WHERE event_id % 7 <> 0"""
_STATE_ID = sid(ENV_, "name1 || '!' || name2", "ms")
_legacy_query("convert_states", "state", "state_history", ("id", "event_time", "soft_state", "hard_state", "previous_hard_state", "state_type"), f"SELECT {_STATE_ID} AS id, ms AS event_time, s AS soft_state, hard AS hard_state, prev AS previous_hard_state, kind AS state_type FROM {_STATE}")
_legacy_query("convert_states_history", "state", "history", ("id", "event_type", "event_time", "state_history_id"), f"""SELECT {sid(ENV_, "'state_change'", "name1 || '!' || name2", 'ms')} AS id, 'state_change' AS event_type, ms AS event_time, {_STATE_ID} AS state_history_id FROM {_STATE}""")
_legacy_query("convert_states_sla", "state", "sla_history_state", ("id", "event_time", "hard_state", "previous_hard_state"), f"SELECT {_STATE_ID} AS id, ms AS event_time, hard AS hard_state, prev AS previous_hard_state FROM {_STATE} AND kind = 'hard'")


#: Events for each bucket of the migrated tables.
MIGRATED = 250_000


def _migrated(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[dict, object]:
    """The tables after two runs: of the first half of the legacy rows, and of all, going on after the first run's marks."""
    from .plans import legacy_etl
    from .sources.schemas import SCHEMAS, UPSERTS

    base = A.scratch(spark, "migration")
    ev = A.events(spark, sf_dir)
    sources = {k: rows for k, rows in A.legacy(ev).items() if not kinds or k in kinds}
    mid = _bounds(ev)[1]
    contacts = ev.select(F.col("event_id").alias("notification_id"), F.explode(F.array(F.lit("ann"), F.lit("bob"))).alias("contact"))
    buckets = max(2, ceil(ev.count() / MIGRATED))  # a bucket is work for one task, however many rows there are
    tables = {t: sinks.BucketedTable(spark, f"{base}/{t}", SCHEMAS[t], key, buckets) for t, (key, _) in UPSERTS.items()}
    progress = sinks.Progress(sinks.BucketedTable(spark, f"{base}/progress", SCHEMAS["migration_progress"]))
    half = {kind: rows.filter(F.col(legacy_etl.CONVERTERS[kind][0]) <= mid) for kind, rows in sources.items()}
    for part in (half, sources):
        legacy_etl.migrate_history(A.ENV, part, tables, progress, contacts)
    return tables, progress


_ALL = ("convert_comments", "convert_acks_history", "convert_downtimes_history", "convert_flapping_history", "convert_notifications_history", "convert_states_history")


def _part(name: str) -> str:
    return "(" + ORACLE_SQL[name].removeprefix(f"WITH {LEGACY} ") + ")"


@query(f"WITH {LEGACY} " + " UNION ALL ".join(f"SELECT id, event_type AS what, event_time AS at, NULL AS previous_hard_state FROM {_part(q)}" for q in _ALL)
       + f" UNION ALL SELECT id, 'sent', send_time, previous_hard_state FROM {_part('convert_notifications')} UNION ALL SELECT id, 'state', event_time, previous_hard_state FROM {_part('convert_states')} UNION ALL SELECT id, 'flapping', end_time, NULL FROM {_part('convert_flapping')}")
def migrate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table, and what depends on earlier rows: it comes out of two runs as out of one."""
    tables, _ = _migrated(spark, sf_dir)
    no = F.lit(None).cast("int").alias("previous_hard_state")
    sent = tables["notification_history"].read().select("id", F.lit("sent").alias("what"), F.col("send_time").alias("at"), "previous_hard_state")
    states = tables["state_history"].read().select("id", F.lit("state").alias("what"), F.col("event_time").alias("at"), "previous_hard_state")
    flapping = tables["flapping_history"].read().select("id", F.lit("flapping").alias("what"), F.col("end_time").alias("at"), no)
    return tables["history"].read().select("id", F.col("event_type").alias("what"), F.col("event_time").alias("at"), no).unionByName(sent).unionByName(states).unionByName(flapping)


@query("SELECT 'flapping' AS kind, max(event_id) AS last_id FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'state', max(event_id) FROM events WHERE event_type <> 'view'")
def migration_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = _migrated(spark, sf_dir, "flapping", "state")[1]
    return progress.table.read().select(F.col("history_type").alias("kind"), "last_id")


# streams over the events table


def _history_tables(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, sinks.BucketedTable]:
    """The tables that a stream of a kind's events has filled; soft and hard states of all kinds."""
    from .streaming.history import history_tables, start_history_stream

    base = A.scratch(spark, "history-stream")
    tables = history_tables(spark, base, kind, 4)
    stream = A.history_events(A.as_events(A.event_stream(spark, sf_dir)))[kind]
    if kind == "state":
        stream = stream.selectExpr("*", "if(event_id % 3 = 0, 'soft', 'hard') as state_type", "cast(event_id % 4 as int) as hard_state", "cast((event_id + 1) % 4 as int) as previous_hard_state")
    start_history_stream(stream, kind, tables, f"{base}/checkpoint", ["ms"]).awaitTermination()
    return tables


def _history_stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    tables = _history_tables(spark, sf_dir, kind)
    table, key, reference = history.KINDS[kind]
    detail = tables[table].read().select(F.col(key).alias(reference), F.lit(True).alias("has_detail"))
    return tables["history"].read().join(detail, reference, "left").select("id", "event_type", "event_time", reference, "has_detail")


@query(f"WITH {HIST} SELECT id, event_type, event_time, ref AS comment_history_id FROM h WHERE kind = 'comment'")
def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_stream(spark, sf_dir, "comment").drop("has_detail")


for _kind in history.KINDS:
    QUERIES[f"history_stream_{_kind}"] = lambda spark, sf_dir, kind=_kind: _history_stream(spark, sf_dir, kind)
    ORACLE_SQL[f"history_stream_{_kind}"] = f"WITH {HIST} SELECT id, event_type, event_time, ref AS {history.KINDS[_kind][2]}, true AS has_detail FROM h WHERE kind = '{_kind}'"


@query(f"WITH {EV} SELECT event_id::varchar AS id, ms AS event_time, (event_id % 4)::int AS hard_state, ((event_id + 1) % 4)::int AS previous_hard_state FROM ev WHERE event_type = 'error' AND event_id % 2 = 1 AND event_id % 3 <> 0")
def history_stream_sla_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability rows that the stream writes besides: hard states alone."""
    return _history_tables(spark, sf_dir, "state")["sla_history_state"].read().select("id", "event_time", "hard_state", "previous_hard_state")


@query(f"WITH {EV} SELECT event_id::varchar AS downtime_id, ms AS downtime_start, CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 1 THEN ms + 1 ELSE ms + cast(floor(value * 1000) AS bigint) END AS downtime_end FROM ev WHERE event_type = 'view'")
def history_stream_sla_downtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_tables(spark, sf_dir, "downtime")["sla_history_downtime"].read().select("downtime_id", "downtime_start", "downtime_end")


@query(f"WITH {EV}, u AS (SELECT event_id, unnest([user_id, user_id + 1, user_id + 2]) AS u FROM ev WHERE event_type = 'error' AND event_id % 2 = 0) SELECT {sid('event_id')} AS notification_history_id, {sid('u')} AS user_id FROM u")
def history_stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_tables(spark, sf_dir, "notification")["user_notification_history"].read().select("notification_history_id", "user_id")


@query(f"WITH {CHANGES} SELECT id, event_type, n FROM ch WHERE k = 1 AND runtime_type = 'upsert'")
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    from .streaming import changes

    base = A.scratch(spark, "change-stream")
    store = changes.change_store(spark, f"{base}/objects")
    schema = StructType.fromDDL("id string, event_type string, n bigint")
    stream = A.changes(A.as_events(A.event_stream(spark, sf_dir)))
    changes.start_change_stream(stream, store, {"objects": schema}, f"{base}/checkpoint").awaitTermination()
    return changes.objects_of(store, "objects", schema)


@query("""WITH l AS (SELECT user_id::varchar AS id, max_by(props, (epoch_us(ts) // 1000, event_id)) AS props FROM events GROUP BY 1)
SELECT id, 'v' || id AS name, 'v' || id || '.' || k AS flatname, json_extract_string(props, '$.' || k) AS flatvalue FROM (SELECT *, unnest(json_keys(props)) AS k FROM l)""")
def customvar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one variable for each user: the stream writes the variables and their flat rows."""
    from .sources.schemas import SCHEMAS
    from .sources.sinks import BucketedTable
    from .streaming import changes

    base = A.scratch(spark, "customvar-stream")
    tables = [BucketedTable(spark, f"{base}/{t}", SCHEMAS[t], key) for t, key in (("customvar", "id"), ("customvar_flat", "customvar_id"))]
    ev = A.as_events(A.event_stream(spark, sf_dir))
    own = F.struct(F.lit(A.ENV).alias("environment_id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("name"), F.col("props").alias("value"))
    stream = ev.select(
        F.concat(F.col("ms").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("stream_id"), F.lit("customvar").alias("redis_key"), F.lit("upsert").alias("runtime_type"), F.col("user_id").cast("string").alias("id"), F.to_json(own).alias("payload"),
    )
    changes.start_change_stream(stream, changes.change_store(spark, f"{base}/objects"), {}, f"{base}/checkpoint", ("customvar", *tables)).awaitTermination()
    return tables[0].read().join(tables[1].read().withColumnRenamed("id", "flat_id").withColumnRenamed("customvar_id", "id"), "id").select("id", "name", "flatname", "flatvalue")


@query(f"WITH {NEXT} SELECT id FROM nu WHERE next_update < 1706600000")
def overdue_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes: in the first one all objects are overdue, later ones unmark some again; the table is the state between them."""
    from .streaming import changes

    table = sinks.BucketedTable(spark, f"{A.scratch(spark, 'overdue')}/overdue", "id bigint", "id")
    nu, od = _overdue(spark, sf_dir)
    table.write(od)
    for now in (NOW + 10**7, NOW - 3600, NOW):
        changes.overdue_pass(nu, table, int(now * 1000)).unpersist()
    return table.read()


@query(f"WITH {EV}, b AS (SELECT (min(ms) + max(ms)) // 2 AS mid FROM ev) SELECT event_id AS id, props || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS message FROM ev, b WHERE event_id % 3 <> 0 AND ms >= mid")
def output_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import changes

    e = F.col("event_id")
    ev = A.events(spark, sf_dir).select(e.alias("id"), F.col("ms").alias("last_update"), F.when(e % 3 != 0, F.col("props")).alias("output"), F.when(e % 2 == 0, "more").alias("long_output"))
    mid = ev.agg(F.expr("(min(last_update) + max(last_update)) div 2")).first()[0]
    sent: list[DataFrame] = []
    changes.output_pass(ev, mid, sent.append)
    return sent[0].select("id", "message")


def _streamed(df: DataFrame, base: str, rows: int | None = None) -> DataFrame:
    """What a stream puts out until its source is read. Streams with timers never end by themselves: these stop once they have read so many rows."""
    import time

    writer = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    if rows is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        q = writer.start()
        try:
            while q.isActive and sum(p["numInputRows"] for p in q.recentProgress) < rows:
                time.sleep(0.2)
            if q.exception():
                raise q.exception()
        finally:
            q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


@query("SELECT event_id, user_id FROM events")
def drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers feed the same events."""
    from .streaming.history import drop_repeats as once

    stream = A.event_stream(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(once(stream.union(stream), "ts"), A.scratch(spark, "repeats")).select("event_id", "user_id")


def _fed(df: DataFrame, base: str, parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """What a stream over files in base/in puts out: each part is written there once so many rows are out of what came before."""
    import time

    from .streaming import stateful

    spark = df.sparkSession
    q = stateful.start_stateful(df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"), spark)
    out = spark.read.schema(df.schema)
    try:
        for part, rows in parts:
            part.coalesce(1).write.mode("append").parquet(f"{base}/in")
            while q.isActive and (sum(p["numInputRows"] for p in q.recentProgress) == 0 or out.parquet(f"{base}/out").count() < rows):
                time.sleep(0.3)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return out.parquet(f"{base}/out")


@query("""WITH m AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events)
SELECT user_id::varchar AS lane, ms, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 = 0, ms, event_id) - 1 AS release FROM m""")
def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane is one object's messages. They are held for two seconds and released in order; every seventh comes when its lane's
    others are out, so it is released after them, out of order."""
    from .streaming import stateful

    ev = A.events(spark, sf_dir)
    messages = ev.select(F.concat(F.col("ms").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("stream_id"), F.col("props").alias("payload"), "user_id", (F.col("event_id") % 7 == 0).alias("late"))
    messages = messages.orderBy(F.xxhash64("stream_id"))  # in no order
    base = A.scratch(spark, "reorder")
    messages.limit(0).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{base}/in")
    n, late = messages.agg(F.count("*"), F.count_if("late")).first()
    out = _fed(stateful.reorder(stream, "user_id", 2000), base, [(messages.filter("not late"), n - late), (messages.filter("late"), n)])
    return out.select("lane", "ms", "seq", "release")


@query("""WITH s AS (SELECT DISTINCT user_id FROM events) SELECT user_id::varchar AS source, event, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM s, (VALUES ('active'), ('lost')) v(event)""")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source beats, falls silent and is lost; a third of them beat again later, are active once more, and are lost again."""
    from .streaming import stateful

    beats = A.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), "user_id")
    base = A.scratch(spark, "heartbeats")
    beats.limit(0).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(beats.schema).parquet(f"{base}/in")
    again = beats.filter("user_id % 3 = 0")
    n, m = (df.select("user_id").distinct().count() for df in (beats, again))
    out = _fed(stateful.heartbeats(stream, silence_ms=1500), base, [(beats, 2 * n), (again, 2 * n + 2 * m)])
    return out.groupBy("source", "event").agg(F.count("*").alias("n"))


# legacy joins


@query("SELECT o_orderkey AS id, o_custkey AS object_id, 1 AS objecttype_id, c_name AS name1, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS name2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 4 <> 0")
def legacy_with_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import legacy_etl

    facts = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("object_id"))
    c = F.col("c_custkey")
    objects = A.table(spark, sf_dir, "customer").filter(c % 4 != 0).select(c.alias("object_id"), F.lit(1).alias("objecttype_id"), F.col("c_name").alias("name1"), F.when(c % 2 == 0, F.col("c_mktsegment")).alias("name2"))
    return legacy_etl.with_objects(facts, objects)


@query("SELECT o_orderkey AS downtimehistory_id, c_name || '!' || '-' || o_orderkey::varchar AS name, CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'h!s-' || s_suppkey::varchar END END AS triggered_by FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey")
def legacy_with_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import legacy_etl

    no = F.lit(None).cast("string")
    o = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    down = o.select(F.col("o_orderkey").alias("downtimehistory_id"), no.alias("name"), F.col("o_orderkey").alias("triggered_by_id"), F.col("c_name").alias("name1"), no.alias("name2"))
    s = F.col("s_suppkey")
    scheduled = A.table(spark, sf_dir, "supplier").select(s.alias("scheduleddowntime_id"), F.when(s % 2 == 0, F.col("s_name")).alias("name"), F.lit("h").alias("name1"), F.lit("s").alias("name2"))
    return legacy_etl.with_triggers(down, scheduled).select("downtimehistory_id", "name", "triggered_by")


@query("SELECT DISTINCT o_orderkey AS notification_id, n_name AS contact FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = l_suppkey % 25")
def contact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import legacy_etl

    notifications = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notification_id"))
    contacts = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notification_id"), (F.col("l_suppkey") % 25).alias("contact_object_id"))
    objects = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("object_id"), F.col("n_name").alias("name1"))
    return legacy_etl.contact_names(notifications, contacts, objects)


@query("WITH m AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events) SELECT event_id AS arrival, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id % 5, event_id) AS place FROM m")
def reorder_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    from .streaming import stateful

    ev = A.events(spark, sf_dir)
    messages = ev.select(F.concat(F.col("ms").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("stream_id"), F.col("event_id").alias("arrival"), "user_id")
    ordered = stateful.reorder_batch(messages).withColumn("at", S.stream_id("stream_id"))
    w = Window.partitionBy("user_id").orderBy("at.ms", "at.seq", "arrival")
    return ordered.select("arrival", F.col("at.ms").alias("ms"), F.row_number().over(w).cast("bigint").alias("place"))
