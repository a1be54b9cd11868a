"""Column functions of the monitoring model. Times are BIGINT milliseconds; a missing time is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of history events at one time, states, legacy codes.
HISTORY_ORDER = ["state_change", "ack_clear", "downtime_end", "flapping_end", "comment_remove", "comment_add", "flapping_start", "downtime_start", "ack_set", "notification"]
PENDING = 99
ENTRY_TYPES = {"1": "comment", "4": "ack"}
STATE_TYPES = {"0": "soft", "1": "hard"}
NOTIFICATION_TYPES = {
    "1": "downtime_start", "2": "downtime_end", "4": "downtime_removed", "8": "custom", "16": "acknowledgement",
    "32": "problem", "64": "recovery", "128": "flapping_start", "256": "flapping_end",
}
NOTIFICATION_REASONS = {1: "acknowledgement", 2: "flapping_start", 3: "flapping_end", 5: "downtime_start", 6: "downtime_end", 7: "downtime_removed", 8: "custom"}
STATE_BITS = {"ok": 1, "warning": 2, "critical": 4, "unknown": 8, "up": 16, "down": 32}


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def millis(ts: Column | str) -> Column:
    """Milliseconds of a TIMESTAMP_NTZ, whatever the session's time zone."""
    seconds = (as_col(ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds * 1000).cast("bigint")


def sha1_id(*parts: Column | str) -> Column:
    """Content id: lower-case hex SHA-1 of the parts, each prefixed by its length; a null part is empty."""
    pieces = []
    for p in parts:
        text = F.coalesce(as_col(p).cast("string"), F.lit(""))
        pieces += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.sha1(F.concat(*pieces))


def service_id(env: Column | str, host: Column | str, service: Column | str) -> Column:
    """Id of a service (its name is host!service); null for hosts, whose service part is empty or null."""
    name = F.concat(as_col(host), F.lit("!"), as_col(service))
    return F.when(F.coalesce(as_col(service), F.lit("")) != "", sha1_id(env, name))


def user_notification_id(notification: Column | str, user: Column | str) -> Column:
    """Hex SHA-1 of the two ids' bytes, one after the other; ids are hex."""
    return F.sha1(F.concat(F.unhex(as_col(notification)), F.unhex(as_col(user))))


def strict_unhex(c: Column | str) -> Column:
    """Bytes of a hex string; an odd length or a bad digit is an error, null stays null."""
    c = as_col(c)
    good = (F.length(c) % 2 == 0) & F.unhex(c).isNotNull()
    return F.when(c.isNull(), None).when(good, F.unhex(c)).otherwise(F.raise_error(F.concat(F.lit("bad hex id: "), c)).cast("binary"))


def assert_range(c: Column | str, low: int, high: int) -> Column:
    """c, or an error if it lies outside low..high."""
    c = as_col(c)
    return F.when(c.isNull() | c.between(low, high), c).otherwise(F.raise_error(F.concat(F.lit("out of range: "), c.cast("string"))).cast("bigint"))


def seconds_to_millis(sec: Column | str, usec: Column | str | int = 0) -> Column:
    """Seconds and microseconds as milliseconds; 0 and 0 is null."""
    sec, usec = as_col(sec).cast("bigint"), F.lit(usec) if isinstance(usec, int) else as_col(usec)
    usec = F.coalesce(usec, F.lit(0)).cast("bigint")
    return F.when((sec == 0) & (usec == 0), None).otherwise(sec * 1000 + F.floor(usec / 1000)).cast("bigint")


def unix_or_zero(ts: Column | str) -> Column:
    return F.coalesce(F.unix_timestamp(as_col(ts)), F.lit(0)).cast("bigint")


def first_real_date(*columns: Column | str) -> Column:
    """The first column that is not null and not before 1970-01-03, which stands for a zero date."""
    return F.coalesce(*[F.when(as_col(c) >= F.lit("1970-01-03").cast("timestamp_ntz"), as_col(c)) for c in columns])


def _mapped(c: Column | str, names: dict[str, str]) -> Column:
    text = as_col(c).cast("string")
    return reduce(lambda w, kv: w.when(text == kv[0], kv[1]), list(names.items())[1:], F.when(text == next(iter(names)), next(iter(names.values())))).otherwise(text)


def entry_type(c: Column | str) -> Column:
    return _mapped(c, ENTRY_TYPES)


def state_type(c: Column | str) -> Column:
    return _mapped(c, STATE_TYPES)


def notification_type(c: Column | str) -> Column:
    return _mapped(c, NOTIFICATION_TYPES)


def notification_reason(reason: Column | str, state: Column | str) -> Column:
    """Type of a legacy notification; null for reasons that do not exist."""
    reason = as_col(reason)
    first = F.when(reason == 0, F.when(as_col(state) == 0, "recovery").otherwise("problem"))
    return reduce(lambda w, kv: w.when(reason == kv[0], kv[1]), NOTIFICATION_REASONS.items(), first)


def clamp_state(state: Column | str, object_type: Column | str) -> Column:
    """States beyond an object's largest (host 1, service 3) become it; pending stays."""
    bound = F.when(as_col(object_type) == "host", 1).otherwise(3)
    return F.when(as_col(state) == PENDING, as_col(state)).otherwise(F.least(as_col(state), bound))


def hard_state(kind: Column | str, state: Column | str, last_hard: Column | str) -> Column:
    return F.when(as_col(kind) == "hard", as_col(state)).otherwise(as_col(last_hard))


def severity(object_type: Column | str, state: Column | str) -> Column:
    """ok, warning, crit, err; null for states that have none."""
    s = as_col(state)
    service = F.when(s == 0, "ok").when(s == 1, "warning").when(s == 2, "crit").when(s == 3, "err")
    return F.when(as_col(object_type) == "service", service).otherwise(F.when(s == 0, "ok").when(s == 1, "crit"))


def muted(in_downtime: Column, acknowledged: Column, flapping: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(as_col(c), F.lit(False)) for c in (in_downtime, acknowledged, flapping)])


#: Texts of muting.
MUTED = {"due": "Checkable is muted due to", "downtime": " currently active downtime", "and_ack": ", and an acknowledgement", "ack": " an acknowledgement", "and_flapping": ", and flapping as well", "flapping": " flapping state", "end": "."}
NOT_MUTED = "Checkable is not muted (no active downtime, no acknowledgement, and not flapping)"


def muted_reason(in_downtime: Column, acknowledged: Column, flapping: Column) -> Column:
    d, a, f = (F.coalesce(as_col(c), F.lit(False)) for c in (in_downtime, acknowledged, flapping))
    parts = [
        F.lit(MUTED["due"]),
        F.when(d, MUTED["downtime"]).otherwise(""),
        F.when(a & d, MUTED["and_ack"]).when(a, MUTED["ack"]).otherwise(""),
        F.when(f & (d | a), MUTED["and_flapping"]).when(f, MUTED["flapping"]).otherwise(""),
        F.lit(MUTED["end"]),
    ]
    return F.when(d | a | f, F.concat(*parts)).otherwise(NOT_MUTED)


def close_flag(sev: Column | str, is_muted: Column) -> Column:
    return (as_col(sev) == "ok") & ~as_col(is_muted)


def notify_flag(sev: Column | str, is_muted: Column, hard: Column | str, previous: Column | str) -> Column:
    """True where the hard state has not changed and the incident is not closed; so also for ok while muted."""
    return ~close_flag(sev, is_muted) & as_col(hard).eqNullSafe(as_col(previous))


def message(output: Column | str, long_output: Column | str, between: str = "\n") -> Column:
    out = F.coalesce(as_col(output), F.lit(""))
    return F.when(as_col(long_output).isNull(), out).otherwise(F.concat(out, F.lit(between), as_col(long_output)))


def encoded(c: Column | str) -> Column:
    return F.replace(F.url_encode(as_col(c)), F.lit("+"), F.lit("%20"))


def event_name(host: Column | str, service: Column | str) -> Column:
    return F.when(as_col(service).isNull(), as_col(host)).otherwise(F.concat(as_col(host), F.lit(": "), as_col(service)))


def event_url(base: str, host: Column | str, service: Column | str) -> Column:
    """Link to an object's page; names are percent-encoded."""
    of_host = F.concat(F.lit(f"{base.rstrip('/')}/host?name="), encoded(host))
    of_service = F.concat(F.lit(f"{base.rstrip('/')}/service?name="), encoded(service), F.lit("&host.name="), encoded(host))
    return F.when(as_col(service).isNull(), of_host).otherwise(of_service)


def event_tags(host: Column | str, service: Column | str, environment: Column | str | None = None) -> Column:
    """host, for services also service, and the environment if one is given."""
    h = F.create_map(F.lit("host"), as_col(host), *([] if environment is None else [F.lit("environment"), as_col(environment)]))
    return F.when(as_col(service).isNull(), h).otherwise(F.map_concat(h, F.create_map(F.lit("service"), as_col(service))))


#: Texts of events.
CANCELLED, EXPIRED = "Downtime was cancelled", "Downtime expired"
CLEARED, ACKNOWLEDGED = "Acknowledgement was cleared", "Checkable was acknowledged"
STARTED = "Checkable started flapping (Current flapping value %.2f%% > high threshold %.2f%%)"
STOPPED = "Checkable stopped flapping (Current flapping value %.2f%% < low threshold %.2f%%)"


def _by(text: str, verb: str, who: Column) -> Column:
    return F.when(who.isNull(), F.lit(text)).otherwise(F.concat(F.lit(f"{text} ({verb} by "), who, F.lit(")")))


def downtime_message(event_type: Column | str, comment: Column | str, cancelled: Column | str, cancelled_by: Column | str) -> Column:
    """The comment of a start; of an end, whether (and by whom) it was cancelled. Other events are an error."""
    kind = as_col(event_type)
    ended = F.when(F.coalesce(as_col(cancelled), F.lit(False)), _by(CANCELLED, "cancelled", as_col(cancelled_by))).otherwise(EXPIRED)
    wrong = F.raise_error(F.concat(F.lit("unexpected event type "), F.coalesce(kind, F.lit("null")))).cast("string")
    return F.when(kind == "downtime_start", as_col(comment)).when(kind == "downtime_end", ended).otherwise(wrong)


def flapping_message(start: Column | str, end: Column | str, low: Column | str, high: Column | str) -> Column:
    """Of the share of changes at the end, if there is one, else of that at the start; without either it is an error."""
    start, end = as_col(start), as_col(end)
    wrong = F.raise_error(F.lit("flapping without a share of changes")).cast("string")
    return F.when(end.isNotNull(), F.format_string(STOPPED, end, as_col(low))).when(start.isNotNull(), F.format_string(STARTED, start, as_col(high))).otherwise(wrong)


def acknowledgement_message(set_time: Column | str, clear_time: Column | str, comment: Column | str, cleared_by: Column | str) -> Column:
    """That (and by whom) it was cleared, if it was, else its comment; without either time it is an error."""
    wrong = F.raise_error(F.lit("acknowledgement without a time")).cast("string")
    return F.when(as_col(clear_time).isNotNull(), _by(CLEARED, "cleared", as_col(cleared_by))).when(as_col(set_time).isNotNull(), F.coalesce(as_col(comment), F.lit(ACKNOWLEDGED))).otherwise(wrong)


def stream_id(c: Column | str) -> Column:
    """(ms, seq) of a stream position "ms-seq"; any other form is an error."""
    c = as_col(c)
    good = c.rlike("^[0-9]+-[0-9]+$") & F.split(c, "-")[0].try_cast("bigint").isNotNull() & F.split(c, "-")[1].try_cast("bigint").isNotNull()
    part = lambda i: F.when(good, F.split(c, "-")[i].try_cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("bad stream id: "), c)).cast("bigint"))
    return F.when(c.isNotNull(), F.struct(part(0).alias("ms"), part(1).alias("seq")))


def synthetic_name(host: Column | str, service: Column | str, object_id: Column | str) -> Column:
    return F.concat(as_col(host), F.lit("!"), F.coalesce(as_col(service), F.lit("")), F.lit("-"), as_col(object_id).cast("string"))


def name_ci(c: Column | str) -> Column:
    return F.collate(as_col(c), "UTF8_LCASE")


def downtime_duration(is_flexible: Column | str, flexible: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.when(as_col(is_flexible), as_col(flexible)).otherwise(as_col(end) - as_col(start))


def capped_seconds(c: Column | str) -> Column:
    """Seconds as milliseconds; 0 where that is negative or beyond 64 unsigned bits."""
    wide = as_col(c).cast("decimal(38,0)")
    fits = (wide >= 0) & (wide < F.lit(18446744073709551).cast("decimal(38,0)"))
    return F.when(fits, wide * 1000).otherwise(F.lit(0)).cast("decimal(20,0)")


def history_ordinal(c: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, HISTORY_ORDER)), as_col(c))


def text_like(c: Column | str, pattern: str) -> Column:
    return as_col(c).cast("string").like(pattern)


def has_bit(c: Column | str, bit: int) -> Column:
    return as_col(c).bitwiseAND(F.lit(bit)) != 0


# event times (unknown kinds and missing times give null)


def downtime_event_time(kind: Column | str, start: Column | str, end: Column | str, cancel: Column | str, cancelled: Column | str) -> Column:
    ended = F.when(as_col(cancelled), as_col(cancel)).when(~as_col(cancelled), as_col(end))
    return F.when(as_col(kind) == "downtime_start", as_col(start)).when(as_col(kind) == "downtime_end", ended)


def sla_downtime_end(end: Column | str, cancel: Column | str, cancelled: Column | str) -> Column:
    return F.when(F.coalesce(as_col(cancelled), F.lit(False)), as_col(cancel)).otherwise(as_col(end))


def comment_event_time(kind: Column | str, entry: Column | str, remove: Column | str, expire: Column | str) -> Column:
    return F.when(as_col(kind) == "comment_add", as_col(entry)).when(as_col(kind) == "comment_remove", F.coalesce(as_col(remove), as_col(expire)))


def flapping_event_time(kind: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.when(as_col(kind) == "flapping_start", as_col(start)).when(as_col(kind) == "flapping_end", as_col(end))


def ack_event_time(kind: Column | str, set_time: Column | str, clear: Column | str) -> Column:
    return F.when(as_col(kind) == "ack_set", as_col(set_time)).when(as_col(kind) == "ack_clear", as_col(clear))


# predicates


def ignorable(hard: Column | str, previous: Column | str) -> Column:
    """Pending states, and the first ok after pending, are nothing to notify of."""
    return (as_col(hard) == PENDING) | ((as_col(hard) == 0) & (as_col(previous) == PENDING))


def counts_as_hard(kind: Column | str, volatile: Column | str) -> Column:
    return (as_col(kind) == "hard") | F.coalesce(as_col(volatile), F.lit(False))
