"""History events: detail tables per kind, the unified table, users notified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.schemas import UPSERTS
from .upserts import fold_upserts

META = ["environment_id", "endpoint_id", "object_type", "host_id", "service_id", "event_type"]
REFERENCES = ["acknowledgement_history_id", "comment_history_id", "downtime_history_id", "flapping_history_id", "notification_history_id", "state_history_id"]

#: For each kind: its detail table, the key in the event, and the reference in `history`.
KINDS: dict[str, tuple[str, str, str]] = {
    "acknowledgement": ("acknowledgement_history", "id", "acknowledgement_history_id"),
    "comment": ("comment_history", "comment_id", "comment_history_id"),
    "downtime": ("downtime_history", "downtime_id", "downtime_history_id"),
    "flapping": ("flapping_history", "id", "flapping_history_id"),
    "notification": ("notification_history", "id", "notification_history_id"),
    "state": ("state_history", "id", "state_history_id"),
}


def event_time(kind: str) -> Column:
    """When an event of this kind took place, from its own columns."""
    return {
        "acknowledgement": lambda: S.ack_event_time("event_type", "set_time", "clear_time"),
        "comment": lambda: S.comment_event_time("event_type", "entry_time", "remove_time", "expire_time"),
        "downtime": lambda: S.downtime_event_time("event_type", "start_time", "end_time", "cancel_time", "has_been_cancelled"),
        "flapping": lambda: S.flapping_event_time("event_type", "start_time", "end_time"),
        "notification": lambda: F.col("send_time"),
        "state": lambda: F.col("event_time"),
    }[kind]()


def history_rows(kind: str, events: DataFrame) -> DataFrame:
    """One row of the unified table for each event of a kind; just the kind's own reference is set."""
    _, key, reference = KINDS[kind]
    refs = [F.col(key).cast("string").alias(r) if r == reference else F.lit(None).cast("string").alias(r) for r in REFERENCES]
    return events.select(F.col("event_id").cast("string").alias("id"), *[F.col(c) for c in META], event_time(kind).alias("event_time"), *refs)


def unify_history(events: dict[str, DataFrame]) -> DataFrame:
    """The unified table of events by kind."""
    out = None
    for kind, df in events.items():
        rows = history_rows(kind, df)
        out = rows if out is None else out.unionByName(rows)
    return out


def detail_rows(kind: str, events: DataFrame, order: list[str]) -> DataFrame:
    """The rows of a kind's detail table: one for each key, later events overwriting what they may."""
    table, key, _ = KINDS[kind]
    mutable = [c for c in UPSERTS[table][1] if c in events.columns]
    return fold_upserts(events.drop("event_id", "event_type"), key, order, mutable)


def user_rows(notifications: DataFrame, users: str = "users_notified_ids") -> DataFrame:
    """Users of each notification, from a JSON array of ids; without the array there are none, a broken one is an error."""
    each = notifications.select("environment_id", F.col("id").alias("notification_history_id"), F.explode(F.from_json(users, "array<string>", {"mode": "FAILFAST"})).alias("user_id"))
    return each.select(S.user_notification_id("notification_history_id", "user_id").alias("id"), "environment_id", "notification_history_id", "user_id").dropDuplicates(["id"])


def in_history_order(history: DataFrame) -> DataFrame:
    """history by time, then by kind of event, then by id."""
    return history.orderBy("event_time", S.history_ordinal("event_type"), "id")


def history_window(history: DataFrame, details: DataFrame, hosts: DataFrame, reference: str, detail_key: str, low: int, high: int, name: str | None = None) -> DataFrame:
    """Events strictly between two times with their details and host names; for one host if a name is given."""
    own = hosts.select(F.col("id").alias("host_id"), F.col("name").alias("host_name"))
    own = own.filter(F.col("host_name") == name) if name else own
    part = history.filter((F.col("event_time") > low) & (F.col("event_time") < high) & F.col(reference).isNotNull())
    columns = [c for c in details.columns if c not in history.columns or c == detail_key]
    return part.join(details.select(*[F.col(c).alias(reference) if c == detail_key else F.col(c) for c in columns]), reference).join(own, "host_id")


def with_notified_users(notifications: DataFrame, user_rows: DataFrame, users: DataFrame) -> DataFrame:
    """notifications (with notification_history_id) with user_id and user_name of each user notified; null where there is none.

    user_rows: notification_history_id and user_id; users: id and name.
    """
    named = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return notifications.join(user_rows.select("notification_history_id", "user_id"), "notification_history_id", "left").join(named, "user_id", "left")


def same_history(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two writers' histories differ, leaving out who wrote them; empty if they agree."""
    left, right = (df.drop("endpoint_id") for df in (a, b))
    return left.exceptAll(right.select(*left.columns)).withColumn("side", F.lit("a")).unionByName(right.select(*left.columns).exceptAll(left).withColumn("side", F.lit("b")))


def earliest_event_second(history: DataFrame) -> DataFrame:
    """One row: when the history begins, in seconds; a legacy migration ends there."""
    return history.agg(F.floor(F.min("event_time") / 1000).cast("bigint").alias("cut_over"))
