"""Tables of the monitoring model, retention categories and upsert rules. Ids are lower-case hex strings, times BIGINT ms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

_META = "environment_id string, endpoint_id string, object_type string, host_id string, service_id string"

SCHEMAS = {
    "state_history": f"id string, {_META}, event_time bigint, state_type string, soft_state int, hard_state int, previous_soft_state int, previous_hard_state int, check_attempt int, max_check_attempts int, output string, long_output string, check_source string, scheduling_source string",
    "sla_history_state": f"id string, {_META}, event_time bigint, hard_state int, previous_hard_state int",
    "downtime_history": f"downtime_id string, {_META}, triggered_by_id string, parent_id string, entry_time bigint, author string, cancelled_by string, comment string, is_flexible boolean, flexible_duration bigint, scheduled_start_time bigint, scheduled_end_time bigint, start_time bigint, end_time bigint, has_been_cancelled boolean, trigger_time bigint, cancel_time bigint",
    "sla_history_downtime": f"downtime_id string, {_META}, downtime_start bigint, downtime_end bigint",
    "comment_history": f"comment_id string, {_META}, entry_time bigint, author string, removed_by string, comment string, entry_type string, is_persistent boolean, is_sticky boolean, expire_time bigint, remove_time bigint, has_been_removed boolean",
    "acknowledgement_history": f"id string, {_META}, set_time bigint, clear_time bigint, author string, cleared_by string, comment string, expire_time bigint, is_sticky boolean, is_persistent boolean",
    "flapping_history": f"id string, {_META}, start_time bigint, end_time bigint, percent_state_change_start double, percent_state_change_end double, flapping_threshold_low double, flapping_threshold_high double",
    "notification_history": f"id string, {_META}, notification_id string, type string, send_time bigint, state int, previous_hard_state int, author string, text string, users_notified int",
    "user_notification_history": "id string, environment_id string, notification_history_id string, user_id string",
    "history": f"id string, {_META}, event_type string, event_time bigint, acknowledgement_history_id string, comment_history_id string, downtime_history_id string, flapping_history_id string, notification_history_id string, state_history_id string",
    "host_state": "id string, environment_id string, host_id string, properties_checksum string, state_type string, soft_state int, hard_state int, previous_hard_state int, output string, long_output string, in_downtime boolean, is_acknowledged boolean, is_sticky_acknowledgement boolean, is_flapping boolean, is_overdue boolean, next_update bigint, last_update bigint",
    "host": "id string, environment_id string, name string, name_ci string, display_name string, address string, address6 string, is_volatile boolean, properties_checksum string",
    "customvar": "id string, environment_id string, name_checksum string, name string, value string",
    "customvar_flat": "id string, environment_id string, customvar_id string, flatname_checksum string, flatname string, flatvalue string",
    "dependency_node": "id string, environment_id string, host_id string, service_id string, redundancy_group_id string",
    "dependency_edge": "id string, environment_id string, from_node_id string, to_node_id string, dependency_edge_state_id string, display_name string",
    "change": "stream_id string, redis_key string, runtime_type string, id string, payload string",
    "migration_progress": "environment_id string, history_type string, from_ts bigint, to_ts bigint, last_id bigint",
}
SCHEMAS["service_state"] = SCHEMAS["host_state"].replace("host_id string", "host_id string, service_id string")
SCHEMAS["service"] = SCHEMAS["host"].replace("name_ci string", "name_ci string, host_id string")


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


@dataclass(frozen=True)
class Category:
    """What retention deletes by, and the column of `history` that refers to the table, if one does."""

    table: str
    key: str
    time: str
    history_column: str | None = None


RETENTION = {
    "acknowledgement": Category("acknowledgement_history", "id", "clear_time", "acknowledgement_history_id"),
    "comment": Category("comment_history", "comment_id", "remove_time", "comment_history_id"),
    "downtime": Category("downtime_history", "downtime_id", "end_time", "downtime_history_id"),
    "flapping": Category("flapping_history", "id", "end_time", "flapping_history_id"),
    "notification": Category("notification_history", "id", "send_time", "notification_history_id"),
    "state": Category("state_history", "id", "event_time", "state_history_id"),
    "sla_downtime": Category("sla_history_downtime", "downtime_id", "downtime_end"),
    "sla_state": Category("sla_history_state", "id", "event_time"),
}

#: (key, columns that a later row of the same key overwrites); all other columns keep the first row's values.
UPSERTS = {
    "acknowledgement_history": ("id", ["clear_time", "cleared_by"]),
    "comment_history": ("comment_id", ["removed_by", "remove_time", "has_been_removed"]),
    "downtime_history": ("downtime_id", ["cancelled_by", "has_been_cancelled", "cancel_time"]),
    "flapping_history": ("id", ["end_time", "percent_state_change_end", "flapping_threshold_low", "flapping_threshold_high"]),
    "sla_history_downtime": ("downtime_id", ["downtime_end"]),
    "state_history": ("id", []),
    "notification_history": ("id", []),
    "sla_history_state": ("id", []),
    "history": ("id", []),
    "user_notification_history": ("id", ["environment_id", "notification_history_id", "user_id"]),
}
