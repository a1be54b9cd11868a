"""Converting a legacy monitoring history into the present model, kind by kind.

Converters take the legacy rows of a kind, joined to their objects (objecttype_id, name1, name2), and return the tables that
they fill. Object type 1 is a host, 2 a service; name2 is empty for hosts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.sequence import carry, pair_start_end, previous_hard_state
from ..operators.upserts import fold_upserts
from ..sources.scans import tasks_for
from ..sources.schemas import UPSERTS, schema
from ..sources.sinks import BucketedTable, Progress, insert_ignore, upsert

FLAPPING_START, FLAPPING_END = 1000, 1001
#: Contacts of notifications that a task takes.
CONTACTS = 500_000
#: What names an object among legacy rows, once they are read.
OBJECT = ["object_name", "objecttype_id"]
#: The state column whose runs a kind's rows carry from one increment to the next.
CARRIED = {"notification": "state", "state": "last_hard_state"}


def with_objects(facts: DataFrame, objects: DataFrame, on: str = "object_id") -> DataFrame:
    """Facts whose object still exists, with objecttype_id, name1 and name2 (empty, not null)."""
    own = objects.select(on, "objecttype_id", "name1", F.coalesce("name2", F.lit("")).alias("name2"))
    return facts.join(own, on)


def with_triggers(downtimes: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Downtimes with the name of the one that triggered them; a name that is missing is made of object and id."""
    own = scheduled.select(F.col("scheduleddowntime_id").alias("triggered_by_id"), F.coalesce("name", S.synthetic_name("name1", "name2", "scheduleddowntime_id")).alias("triggered_by"))
    named = downtimes.withColumn("name", F.coalesce("name", S.synthetic_name("name1", "name2", "downtimehistory_id")))
    return named.join(own, "triggered_by_id", "left").drop("triggered_by_id")


def contact_names(notifications: DataFrame, contacts: DataFrame, objects: DataFrame) -> DataFrame:
    """(notification_id, contact), distinct: contacts: notification_id and contact_object_id."""
    # dealt by notification, as pairs are too many for a map-side distinct; that partitioning serves the join and the distinct
    n = tasks_for(contacts.sparkSession, contacts.count(), CONTACTS)
    names = objects.select(F.col("object_id").alias("contact_object_id"), F.col("name1").alias("contact"))
    # (a semi join would be moved below the dealing, to partitions of its own)
    known = notifications.select("notification_id").repartition(n, "notification_id").distinct()
    own = contacts.join(names, "contact_object_id").select("notification_id", "contact").repartition(n, "notification_id")
    return own.join(known.hint("merge"), "notification_id").select("notification_id", "contact").distinct()


def _meta(env: str, df: DataFrame) -> DataFrame:
    return df.withColumns({
        "environment_id": S.sha1_id(F.lit(env)), "endpoint_id": F.lit(None).cast("string"), "object_type": F.when(F.col("objecttype_id") == 1, "host").otherwise("service"),
        "host_id": S.sha1_id(F.lit(env), "name1"), "service_id": S.service_id(F.lit(env), "name1", "name2"), "object_name": F.concat("name1", F.when(F.col("name2") != "", F.concat(F.lit("!"), F.col("name2"))).otherwise("")),
    })


def _fit(df: DataFrame, table: str) -> DataFrame:
    """df in the shape of a table; columns that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields])


def _event(df: DataFrame, kind: str, event_id: Column, reference: str, key: Column | str, time: Column | str) -> DataFrame:
    return _fit(df.select("environment_id", "endpoint_id", "object_type", "host_id", "service_id", event_id.alias("id"), F.lit(kind).alias("event_type"), S.as_col(time).alias("event_time"), S.as_col(key).alias(reference)), "history")


def convert_comments(env: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Entry type 1: comments; rows without an entry time are left out, a removal is an event only if it took place."""
    own = _meta(env, rows.filter((F.col("entry_type") == 1) & F.col("entry_time").isNotNull()))
    removed = S.seconds_to_millis("deletion_time", "deletion_time_usec")
    own = own.withColumns({
        "comment_id": S.sha1_id(F.lit(env), "name"), "expire_time": S.seconds_to_millis("expiration_time"), "remove_time": removed, "has_been_removed": removed.isNotNull(), "author": F.col("author_name"),
        "comment": F.col("comment_data"), "is_persistent": F.col("is_persistent") != 0, "is_sticky": F.lit(False), "entry_time": S.seconds_to_millis("entry_time", "entry_time_usec"), "entry_type": F.lit("comment"),
    })
    added = _event(own, "comment_add", S.sha1_id(F.lit(env), F.lit("comment_add"), "name"), "comment_history_id", "comment_id", "entry_time")
    gone = _event(own.filter("remove_time is not null"), "comment_remove", S.sha1_id(F.lit(env), F.lit("comment_remove"), "name"), "comment_history_id", "comment_id", "remove_time")
    return {"comment_history": _fit(own, "comment_history"), "history": added.unionByName(gone)}


def convert_acks(env: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Entry type 4 of the same source: acknowledgements."""
    own = _meta(env, rows.filter((F.col("entry_type") == 4) & F.col("entry_time").isNotNull()))
    set_time = S.seconds_to_millis("entry_time", "entry_time_usec")
    own = own.withColumns({
        "id": S.sha1_id(F.lit(env), "object_name", set_time), "set_time": set_time, "clear_time": S.seconds_to_millis("deletion_time", "deletion_time_usec"),
        "expire_time": S.seconds_to_millis("expiration_time"), "author": F.col("author_name"), "comment": F.col("comment_data"), "is_persistent": F.col("is_persistent") != 0,
    })
    event = lambda kind, df, time: _event(df, kind, S.sha1_id(F.lit(env), F.lit(kind), "object_name", "set_time"), "acknowledgement_history_id", "id", time)
    return {"acknowledgement_history": _fit(own, "acknowledgement_history"), "history": event("ack_set", own, "set_time").unionByName(event("ack_clear", own.filter("clear_time is not null"), "clear_time"))}


def convert_downtimes(env: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Downtimes that were started. The end is an event only if it is known; the availability row always is written."""
    own = _meta(env, rows.filter(F.col("scheduled_start_time").isNotNull() & (F.col("was_started") != 0)))
    start, end = S.seconds_to_millis("actual_start_time", "actual_start_time_usec"), S.seconds_to_millis("actual_end_time", "actual_end_time_usec")
    planned_start = S.seconds_to_millis("scheduled_start_time")
    planned_end = F.coalesce(S.seconds_to_millis("scheduled_end_time"), planned_start + F.col("duration") * 1000)
    own = own.withColumns({"actual_end": end, "cancelled": F.col("was_cancelled") != 0, "start": F.coalesce(start, planned_start), "planned_start": planned_start, "planned_end": planned_end})
    own = own.withColumns({
        "downtime_id": S.sha1_id(F.lit(env), "name"), "triggered_by_id": F.when(F.col("triggered_by") != "", S.sha1_id(F.lit(env), "triggered_by")), "entry_time": S.seconds_to_millis("entry_time"),
        "author": F.col("author_name"), "comment": F.col("comment_data"), "is_flexible": F.col("is_fixed") == 0, "flexible_duration": S.capped_seconds("duration").try_cast("bigint"),
        "scheduled_start_time": F.col("planned_start"), "scheduled_end_time": F.col("planned_end"), "start_time": F.col("start"), "end_time": F.coalesce("actual_end", "planned_end"), "has_been_cancelled": F.col("cancelled"),
        "trigger_time": F.coalesce(S.seconds_to_millis("trigger_time"), "start"), "cancel_time": F.when(F.col("cancelled"), F.col("actual_end")),
    })
    ended = S.downtime_event_time(F.lit("downtime_end"), "start_time", "end_time", "cancel_time", "has_been_cancelled")
    event = lambda kind, df, time: _event(df, kind, S.sha1_id(F.lit(env), F.lit(kind), "name"), "downtime_history_id", "downtime_id", time)
    sla = own.withColumns({"downtime_start": F.col("start_time"), "downtime_end": S.sla_downtime_end("end_time", "cancel_time", "has_been_cancelled")})
    events = event("downtime_start", own, "start_time").unionByName(event("downtime_end", own.filter("actual_end is not null"), ended))
    return {"downtime_history": _fit(own, "downtime_history"), "history": events, "sla_history_downtime": _fit(sla, "sla_history_downtime")}


def convert_flapping(env: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Starts insert a row, ends complete the row of the start just before them; an end without one is left out."""
    named = _meta(env, rows.filter(F.col("event_time").isNotNull())).withColumn("at", S.seconds_to_millis("event_time", "event_time_usec"))
    own = pair_start_end(named, OBJECT, ["flappinghistory_id"], F.col("event_type") != FLAPPING_END, "at").filter("start_time is not null")
    ends = F.col("event_type") == FLAPPING_END
    own = own.withColumns({
        "id": S.sha1_id(F.lit(env), "object_name", "start_time"), "end_time": F.when(ends, F.col("at")), "percent_state_change_start": F.when(~ends, F.col("percent_state_change")),
        "percent_state_change_end": F.when(ends, F.col("percent_state_change")), "flapping_threshold_low": F.col("low_threshold"), "flapping_threshold_high": F.col("high_threshold"),
    })
    detail = fold_upserts(own.select("flappinghistory_id", *schema("flapping_history").names), "id", ["flappinghistory_id"], UPSERTS["flapping_history"][1])
    event = lambda kind, df, time: _event(df, kind, S.sha1_id(F.lit(env), F.lit(kind), "object_name", "start_time"), "flapping_history_id", "id", time)
    events = event("flapping_start", own.filter(~ends), "start_time").unionByName(event("flapping_end", own.filter(ends), "end_time"))
    return {"flapping_history": _fit(detail, "flapping_history"), "history": events}


def convert_notifications(env: str, rows: DataFrame, contacts: DataFrame, carried: DataFrame | None = None) -> dict[str, DataFrame]:
    """Notifications with a time and a known reason; contacts: (notification_id, contact). States are not clamped here."""
    named = previous_hard_state(_meta(env, rows), OBJECT, ["notification_id"], "state", carried=carried)
    own = named.withColumn("type", S.notification_reason("notification_reason", "state")).filter(F.col("end_time").isNotNull() & F.col("type").isNotNull())
    own = own.withColumn("send_time", S.seconds_to_millis("end_time", "end_time_usec"))
    own = own.withColumns({
        "id": S.sha1_id(F.lit(env), "notification_id", "type", "send_time"), "text": S.message("output", "long_output", "\n\n"), "users_notified": F.col("contacts_notified"), "legacy_id": F.col("notification_id"),
        "notification_id": S.sha1_id(F.lit(env), "notification_id"),
    })
    events = _event(own, "notification", S.sha1_id(F.lit(env), F.lit("notification"), "legacy_id", "type", "send_time"), "notification_history_id", "id", "send_time")
    users = own.select("environment_id", F.col("id").alias("notification_history_id"), F.col("legacy_id").alias("notification_id")).join(contacts, "notification_id").withColumn("user_id", S.sha1_id(F.lit(env), "contact"))
    users = users.withColumn("id", S.user_notification_id("notification_history_id", "user_id")).dropDuplicates(["id"])
    return {"notification_history": _fit(own, "notification_history"), "user_notification_history": _fit(users, "user_notification_history"), "history": events}


def convert_states(env: str, rows: DataFrame, carried: DataFrame | None = None) -> dict[str, DataFrame]:
    """State changes. Ids are made of host!service for both kinds of objects, so a host's name ends in !."""
    named = previous_hard_state(_meta(env, rows), OBJECT, ["statehistory_id"], "last_hard_state", carried=carried).filter(F.col("state_time").isNotNull())
    at = S.seconds_to_millis("state_time", "state_time_usec")
    own = named.withColumns({"kind": S.state_type("state_type"), "event_time": at, "full_name": F.concat("name1", F.lit("!"), "name2")} | {c: S.clamp_state(c, "object_type") for c in ("state", "last_state", "last_hard_state")})
    own = own.withColumns({
        "id": S.sha1_id(F.lit(env), "full_name", "event_time"), "hard_state": S.hard_state("kind", "state", "last_hard_state"), "soft_state": F.col("state"), "previous_soft_state": F.col("last_state"),
        "check_attempt": F.col("current_check_attempt"), "max_check_attempts": F.col("max_check_attempts"), "state_type": F.col("kind"),
    })
    events = _event(own, "state_change", S.sha1_id(F.lit(env), F.lit("state_change"), "full_name", "event_time"), "state_history_id", "id", "event_time")
    return {"state_history": _fit(own, "state_history"), "history": events, "sla_history_state": _fit(own.filter("kind = 'hard'"), "sla_history_state")}


#: Order in which kinds are migrated, with the key of their legacy rows.
CONVERTERS: dict[str, tuple[str, Callable[..., dict[str, DataFrame]]]] = {
    "comment": ("commenthistory_id", convert_comments),
    "acknowledgement": ("commenthistory_id", convert_acks),
    "downtime": ("downtimehistory_id", convert_downtimes),
    "flapping": ("flappinghistory_id", convert_flapping),
    "notification": ("notification_id", convert_notifications),
    "state": ("statehistory_id", convert_states),
}


def resumed(env: str, kind: str, rows: DataFrame, last_id: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of a kind beyond a mark, and what they need of those before it: the states that objects ended with (second
    value); of flapping, an object's last row, which may be the start that the next one ends, is among the rows again."""
    key = CONVERTERS[kind][0]
    if last_id is None:
        return rows, None
    fresh, done = rows.filter(F.col(key) > last_id), rows.filter(F.col(key) <= last_id)
    if kind in CARRIED:
        state = CARRIED[kind]
        own = _meta(env, done).select(*OBJECT, key, state)
        return fresh, carry(own, OBJECT, [key], state)
    if kind == "flapping":
        names = ["name1", "name2", "objecttype_id"]
        last = done.filter(F.col("event_time").isNotNull()).groupBy(*names).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in names]), key).alias("x"))
        fresh = last.select(*names, "x.*").select(*rows.columns).unionByName(fresh)
    return fresh, None


def migrate_history(env: str, sources: dict[str, DataFrame], tables: dict[str, BucketedTable], progress: Progress | None = None, contacts: DataFrame | None = None, from_ts: int = 0, to_ts: int = 2**62) -> None:
    """Convert all kinds and add what is new to the tables; a run that is repeated changes nothing.

    With progress, a kind goes on after the last row that an earlier run has converted. Detail tables come before history and
    availability rows; a kind's mark is saved when all its tables are written. Tables with a key get rows added, others are
    written anew.
    """
    for kind in CONVERTERS:
        if kind not in sources:
            continue
        rows, carried = resumed(env, kind, sources[kind], progress.last_id(env, kind, from_ts, to_ts) if progress else None)
        rows = rows.persist()
        try:
            _migrate_kind(env, kind, rows, carried, tables, progress, contacts, from_ts, to_ts)
        finally:
            rows.unpersist()


def _migrate_kind(env: str, kind: str, rows: DataFrame, carried: DataFrame | None, tables: dict[str, BucketedTable], progress: Progress | None, contacts: DataFrame | None, from_ts: int, to_ts: int) -> None:
    key, convert = CONVERTERS[kind]
    last = rows.agg(F.max(key)).first()[0]
    if last is None:
        return
    more = {"carried": carried} if kind in CARRIED else {}
    made = convert(env, rows, contacts, **more) if kind == "notification" else convert(env, rows, **more)
    for name in sorted(made, key=lambda t: (t == "history", t.startswith("sla_"))):
        table, id_column = tables[name], UPSERTS[name][0]
        new = made[name].persist(StorageLevel.DISK_ONLY)  # converted once, not for finding the buckets and again for writing them
        try:
            if name == "flapping_history":
                table.merge(new.withColumn("__at", F.coalesce("end_time", "start_time")), lambda old, new, c=id_column: upsert(old, new, c, ["__at"], UPSERTS["flapping_history"][1]))
            elif table.key:
                table.append_new(new)
            else:
                table.merge(new, lambda old, new, c=id_column: insert_ignore(old, new, c))
        finally:
            new.unpersist()
    if progress is not None:
        progress.save(env, kind, from_ts, to_ts, last)


# backfills of stored rows


def split_acknowledged(states: DataFrame, column: str = "is_acknowledged") -> DataFrame:
    """The three-valued flag (n, y, sticky) as is_acknowledged and is_sticky_acknowledgement."""
    c = F.col(column)
    return states.withColumns({"is_sticky_acknowledgement": c == "sticky", "is_acknowledged": c.isin("y", "sticky")})


def fill_durations(downtimes: DataFrame) -> DataFrame:
    """Durations of 0 from the flexible duration or the planned times."""
    full = S.downtime_duration("is_flexible", "flexible_duration", "scheduled_start_time", "scheduled_end_time")
    return downtimes.withColumn("duration", F.when(F.col("duration") == 0, full).otherwise(F.col("duration")))


def fill_host_ids(states: DataFrame, services: DataFrame) -> DataFrame:
    """host_id of service states that hold only zeros, from their service."""
    own = services.select(F.col("id").alias("service_id"), F.col("host_id").alias("__host"))
    blank = F.col("host_id").rlike("^0*$")
    return states.join(own, "service_id", "left").withColumn("host_id", F.when(blank, F.coalesce("__host", "host_id")).otherwise(F.col("host_id"))).select(*states.columns)


def state_ids(states: DataFrame, object_key: str) -> DataFrame:
    """States named by their object."""
    return states.withColumn("id", F.col(object_key))
