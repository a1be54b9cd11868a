"""Availability: the percentage of an interval in which an object had no problem outside downtimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import PENDING, sla_downtime_end
from ..sources.scans import tasks_for

DAY_MS = 86_400_000
#: Rows of the timeline that a task takes.
ROWS = 250_000
#: Order of events at one time: an interval ends before all of them and begins after them.
TO, STATE, DOWN_START, DOWN_END, FROM = range(5)


def object_key() -> Column:
    """An object as one value that can be joined on: hosts have no service."""
    return F.struct(F.col("host_id"), F.coalesce("service_id", F.lit("")).alias("s"), F.col("service_id").isNull().alias("is_host"))


def sla_state_rows(states: DataFrame) -> DataFrame:
    """Hard states of a state history, as the availability tables hold them."""
    return states.filter(F.col("state_type") == "hard").drop("state_type")


def sla_downtime_rows(downtimes: DataFrame) -> DataFrame:
    """Downtimes with the end that counts: when they were cancelled, if they were."""
    end = sla_downtime_end("end_time", "cancel_time", "has_been_cancelled")
    return downtimes.withColumn("downtime_start", F.col("start_time")).withColumn("downtime_end", end).drop("start_time", "end_time", "cancel_time", "has_been_cancelled")


def invalid_downtimes(downtimes: DataFrame) -> DataFrame:
    """Downtimes that end before they start, or lack either time; sla_ok_percent leaves them out."""
    return downtimes.filter("downtime_start is null or downtime_end is null or downtime_end < downtime_start")


def _marked(asked: DataFrame, states: DataFrame, downtimes: DataFrame | None, current: DataFrame | None, block_ms: int) -> DataFrame:
    """Two marks of each interval, obj, start, end, kind (FROM or TO) with what the timeline of their object is there:

    state (hard), downs (open downtimes), t0 (time of the last event before, or where all begins), out and bad (sums of segments up to t0 that count as
    unknown and as problem), pending (whether the next event shows that what came before it was unknown).

    A scan by blocks of time. Each block of an object is summed up first: its last state, its downtimes begun less those ended, its
    last time, its first event. Such sums put together from the left (from the right for the next event) give what a block begins
    with; then blocks are walked by themselves, and their sums of segments put together. So a task has the events of one block, and
    of an object one row per block, however long its history, and an interval or downtime is two rows, however long it is.
    """
    least, most, n_asked = asked.agg(F.min("start"), F.max("end"), F.count("*")).first()
    low, high = (F.lit(x or 0).cast("bigint") for x in (least, most))
    # so many tasks that each has about ROWS rows; every step is dealt by its own keys to as many
    n = tasks_for(asked.sparkSession, 2 * n_asked + states.count() + (0 if downtimes is None else 2 * downtimes.count()), ROWS)
    no = F.lit(None).cast("int")

    def rows(df: DataFrame, t: Column, prio: int, sid: Column, hard: Column = no, prev: Column = no, down: int = 0, marked: bool = False) -> DataFrame:
        ends = [F.col(c) if marked else F.lit(None).cast("bigint").alias(c) for c in ("start", "end")]
        clipped = F.least(F.greatest(t, low), high)  # nothing counts outside, and differences stay small
        return df.select("obj", t.cast("bigint").alias("at"), F.lit(prio).alias("prio"), sid.alias("sid"), clipped.cast("bigint").alias("t"), hard.cast("int").alias("hard"), prev.cast("int").alias("prev"), F.lit(down).alias("down"), *ends)

    blank = F.lit("")
    every = rows(states.filter("event_time is not null"), F.col("event_time"), STATE, F.col("sid"), F.col("hard_state"), F.col("previous_hard_state"))
    if downtimes is not None:
        down = downtimes.select(object_key().alias("obj"), F.col("downtime_start").cast("bigint").alias("t1"), F.col("downtime_end").cast("bigint").alias("t2")).filter((F.col("t2") >= F.col("t1")) & (F.col("t1") < high) & (F.col("t2") >= low))
        down = down.withColumns({"t1": F.greatest("t1", low), "t2": F.least("t2", high)})
        every = every.unionByName(rows(down, F.col("t1"), DOWN_START, blank, down=1)).unionByName(rows(down, F.col("t2"), DOWN_END, blank, down=-1))
    marks = rows(asked, F.col("start"), FROM, blank, marked=True).unionByName(rows(asked, F.col("end"), TO, blank, marked=True))
    every = every.unionByName(marks).withColumn("b", F.expr(f"(at - pmod(at, {block_ms}L)) div {block_ms}L")).repartition(n, "obj", "b")
    fact, is_state = F.col("start").isNull(), F.col("prio") == STATE
    place, pending = F.struct("at", "prio", "sid"), F.coalesce(F.col("prev") == PENDING, F.lit(False))
    blocks = every.groupBy("obj", "b").agg(
        F.max_by("hard", F.when(F.col("hard").isNotNull(), place)).alias("last"), F.min_by("prev", F.when(is_state, place)).alias("prev"), F.min_by(pending, F.when(fact, place)).alias("next"), F.sum("down").alias("downs"), F.max(F.when(fact, F.col("t"))).alias("t0")
    ).repartition(n, "obj")
    forth, back = Window.partitionBy("obj").orderBy("b"), Window.partitionBy("obj").orderBy(F.desc("b"))
    before, after = forth.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.select(
        "obj", "b", F.last("last", ignorenulls=True).over(before).alias("state"), F.coalesce(F.sum("downs").over(before), F.lit(0)).alias("downs"), F.last("t0", ignorenulls=True).over(before).alias("t0"),
        F.last("next", ignorenulls=True).over(after).alias("next"), F.first("prev", ignorenulls=True).over(Window.partitionBy("obj").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("earliest"),
    )
    now = F.lit(None).cast("int")
    if current is not None:
        begun = begun.join(current.select(object_key().alias("obj"), F.col("hard_state").cast("int").alias("now")), "obj", "left")
        now = F.col("now")
    begun = begun.select("obj", "b", F.coalesce("state", "earliest", now, F.lit(0)).alias("in_state"), F.col("downs").alias("in_downs"), F.coalesce("t0", low).alias("in_t0"), F.col("next").alias("in_next")).repartition(n, "obj", "b")
    inside = Window.partitionBy("obj", "b").orderBy("at", "prio", "sid", "start", "end")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy("obj", "b").orderBy(*[F.desc(c) for c in ("at", "prio", "sid", "start", "end")]).rowsBetween(Window.unboundedPreceding, -1)
    walked = every.join(begun, ["obj", "b"]).select(
        "*", F.coalesce(F.last("hard", ignorenulls=True).over(past), F.col("in_state")).alias("state"), (F.coalesce(F.sum("down").over(past), F.lit(0)) + F.col("in_downs")).alias("downs"),
        F.coalesce(F.last(F.when(fact, F.col("t")), ignorenulls=True).over(past), F.col("in_t0")).alias("t0"), F.coalesce(F.last(F.when(fact, pending), ignorenulls=True).over(coming), F.col("in_next"), F.lit(False)).alias("pending"),
    )
    walked = walked.withColumn("seg", F.when(fact, F.col("t") - F.col("t0")).otherwise(0))
    sums = {"out": F.when(pending, F.col("seg")).otherwise(0), "bad": F.when(~pending & _problem(), F.col("seg")).otherwise(0)}
    walked = walked.withColumns({c: F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c, x in sums.items()})
    # marks add nothing, so sums up to the last row of a block are the block's
    totals = walked.groupBy("obj", "b").agg(F.max("out").alias("out"), F.max("bad").alias("bad")).repartition(n, "obj")
    totals = totals.select("obj", "b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"in_{c}") for c in sums]).repartition(n, "obj", "b")
    out = walked.filter(~fact).join(totals, ["obj", "b"])
    return out.select("obj", "start", "end", F.col("prio").alias("kind"), "state", "downs", "t0", "pending", *[(F.col(c) + F.col(f"in_{c}")).alias(c) for c in sums]).repartition(n, "obj", "start", "end")


def _problem() -> Column:
    return (F.col("state") > F.when(F.col("obj.is_host"), 0).otherwise(1)) & (F.col("state") != PENDING) & (F.col("downs") == 0)


def _asked(intervals: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.lit("end time must be greater than start time")).cast("bigint")
    return intervals.select(object_key().alias("obj"), F.col("start").cast("bigint"), F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(wrong).cast("bigint").alias("end")).distinct()


def _states(states: DataFrame) -> DataFrame:
    return states.select(object_key().alias("obj"), F.col("id").cast("string").alias("sid"), F.col("event_time").cast("bigint"), "hard_state", "previous_hard_state")


def _named(*more: Column | str) -> list[Column | str]:
    return [F.col("obj.host_id").alias("host_id"), F.when(~F.col("obj.is_host"), F.col("obj.s")).alias("service_id"), "start", "end", *more]


def initial_states(states: DataFrame, intervals: DataFrame, current: DataFrame | None = None, block_ms: int = DAY_MS) -> DataFrame:
    """(host_id, service_id, start, end, initial): the hard state at or before start, else the one before the first event after it,
    else the current one, else 0. Tables as for `sla_ok_percent`."""
    marks = _marked(_asked(intervals), _states(states), None, current, block_ms)
    return marks.filter(F.col("kind") == FROM).select(*_named(F.col("state").alias("initial")))


def sla_ok_percent(states: DataFrame, downtimes: DataFrame, intervals: DataFrame, current: DataFrame | None = None, block_ms: int = DAY_MS) -> DataFrame:
    """(host_id, service_id, start, end, ok_percent DECIMAL(7,4)) for every distinct interval; all objects and intervals in one job.

    states: host_id, service_id, id, event_time, hard_state, previous_hard_state; downtimes: host_id, service_id,
    downtime_start, downtime_end; intervals: host_id, service_id, start, end, with end > start or an error; current:
    host_id, service_id, hard_state. An interval is the difference of two places on its object's timeline (see `_marked`), so
    neither long nor many intervals multiply events, and an object's events are walked in blocks of block_ms, side by side.
    An interval all of which is unknown has no percentage (null). `invalid_downtimes` are left out.
    """
    marks = _marked(_asked(intervals), _states(states), downtimes, current, block_ms)
    fields = ("state", "downs", "t0", "pending", "out", "bad")
    both = marks.groupBy("obj", "start", "end").agg(*[F.max(F.when(F.col("kind") == k, F.struct(*fields))).alias(name) for k, name in ((FROM, "a"), (TO, "z"))])

    def problem(side: str) -> Column:
        return (F.col(f"{side}.state") > F.when(F.col("obj.is_host"), 0).otherwise(1)) & (F.col(f"{side}.state") != PENDING) & (F.col(f"{side}.downs") == 0)

    events = F.coalesce(F.col("z.t0") > F.col("start"), F.lit(False))  # some stand inside the interval
    # of the first segment, what lies before the interval goes; the last one ends with it, and nothing shows that it was unknown
    early = F.col("start") - F.col("a.t0")
    out = F.when(events, F.col("z.out") - F.col("a.out") - F.when(F.col("a.pending"), early).otherwise(0)).otherwise(0)
    bad = F.when(events, F.col("z.bad") - F.col("a.bad") - F.when(~F.col("a.pending") & problem("a"), early).otherwise(0) + F.when(problem("z"), F.col("end") - F.col("z.t0")).otherwise(0)).otherwise(F.when(problem("a"), F.col("end") - F.col("start")).otherwise(0))
    total = (F.col("end") - F.col("start") - out).cast("decimal(20,0)")
    percent = (F.lit(100).cast("decimal(3,0)") * (total - bad.cast("decimal(20,0)")) / F.nullif(total, F.lit(0).cast("decimal(20,0)"))).cast("decimal(7,4)")
    return both.select(*_named(percent.alias("ok_percent")))


def backfill_sla_states(sla: DataFrame, history: DataFrame) -> DataFrame:
    """sla with the hard states of a state history that it lacks."""
    from ..sources.sinks import insert_ignore

    return insert_ignore(sla, sla_state_rows(history).select(*sla.columns), "id")


def backfill_sla_downtimes(sla: DataFrame, history: DataFrame) -> DataFrame:
    from ..sources.sinks import insert_ignore

    return insert_ignore(sla, sla_downtime_rows(history).select(*sla.columns), "downtime_id")
