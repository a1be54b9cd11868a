import random
import time

import pytest
from pyspark.errors import PySparkException

from pulsegrid.operators import sla

#: Published vectors (name, interval, states as (time, state, previous), downtimes, current, percent).
VECTORS = [
    ("empty", (1000, 2000), [], [], None, 100),
    ("several changes", (1000, 2000), [(1000, 2, 99), (1100, 0, 2), (1300, 2, 0), (1400, 0, 2), (1600, 2, 0), (1700, 0, 2), (1900, 2, 0)], [], None, 60),
    ("odd numbers", (1000, 2000), [(1000, 2, 99), (1023, 0, 2), (1100, 2, 0), (1242, 0, 2), (1300, 2, 0), (1307, 0, 2), (1400, 2, 0), (1666, 0, 2)], [], None, 56.2),
    ("one third", (1000, 1300), [(1000, 2, 99), (1100, 0, 2)], [], None, 66.6667),
    ("one seventh", (1000, 1700), [(1000, 2, 99), (1600, 0, 2)], [], None, 14.2857),
    ("downtimes over problems", (1000, 2000), [(1200, 2, 0), (1500, 0, 2)], [(1100, 1300), (1400, 1600)], None, 90),
    ("critical before", (1000, 2000), [(0, 2, 99)], [], None, 0),
    ("critical before, downtime", (1000, 2000), [(800, 2, 99)], [(600, 1800)], None, 80),
    ("critical before, overlapping downtimes", (1000, 2000), [(800, 2, 99)], [(600, 1000), (800, 1200), (1000, 1400), (1600, 2000), (1800, 2200)], None, 80),
    ("previous state", (1000, 2000), [(1200, 0, 2)], [], None, 80),
    ("current state", (1000, 2000), [], [], 2, 0),
    ("state before over later", (1000, 2000), [(800, 2, 99), (1200, 0, 0)], [], None, 80),
    ("state before over current", (1000, 2000), [(800, 2, 99)], [], 0, 0),
    ("later over current", (1000, 2000), [(1200, 0, 2)], [], 2, 80),
    ("unknown at first", (1000, 2000), [(1500, 2, 99), (1700, 0, 2)], [], 0, 60),
    ("unknown in between", (1000, 2000), [(1000, 0, 2), (1100, 2, 0), (1600, 0, 99), (1800, 2, 0)], [], 0, 60),
    ("boundary inside unknown", (1000, 2000), [(1500, 2, 99)], [(1200, 1300)], 0, 500 / 800 * 0 + 37.5),
    ("first event after the end", (1000, 2000), [(2500, 0, 2)], [], 0, 0),
    ("warning only", (1000, 2000), [(1000, 1, 99)], [], None, {"host": 0, "service": 100}),
    ("downtime ends at the start", (1000, 2000), [(900, 2, 99)], [(500, 1000)], None, 0),
    ("change and downtime at once", (1000, 2000), [(500, 0, 99), (1500, 2, 0)], [(1500, 2000)], None, 100),
]


def run(spark, vectors, bucket_ms):
    states, downs, current, asked = [], [], [], []
    for i, (_, (start, end), st, dt, now, _) in enumerate(vectors):
        for service in (None, f"s{i}"):
            states += [(f"h{i}", service, str(j), *x) for j, x in enumerate(st)]
            downs += [(f"h{i}", service, *x) for x in dt]
            current += [(f"h{i}", service, now)] if now is not None else []
            asked.append((f"h{i}", service, start, end))
    key = "host_id string, service_id string, "
    return sla.sla_ok_percent(
        spark.createDataFrame(states, key + "id string, event_time bigint, hard_state int, previous_hard_state int"),
        spark.createDataFrame(downs, key + "downtime_start bigint, downtime_end bigint"),
        spark.createDataFrame(asked, key + "start bigint, end bigint"),
        spark.createDataFrame(current, key + "hard_state int"),
        bucket_ms,
    )


@pytest.mark.parametrize("bucket_ms", [sla.DAY_MS, 300])
def test_vectors(spark, bucket_ms):
    got = {(r.host_id, r.service_id): float(r.ok_percent) for r in run(spark, VECTORS, bucket_ms).collect()}
    assert len(got) == 2 * len(VECTORS)
    for i, v in enumerate(VECTORS):
        for service in (None, f"s{i}"):
            want = v[5] if not isinstance(v[5], dict) else v[5]["host" if service is None else "service"]
            assert got[f"h{i}", service] == pytest.approx(want, abs=5e-5), (v[0], service)


@pytest.mark.parametrize("interval", [(1000, 1000), (2000, 1000)])
def test_invalid_interval(spark, interval):
    with pytest.raises(PySparkException, match="end time must be greater than start time"):
        run(spark, [("bad", interval, [], [], None, 0)], sla.DAY_MS).collect()


def test_invalid_downtimes(spark):
    df = spark.createDataFrame([("h", None, 5, 4), ("h", None, 4, 5)], "host_id string, service_id string, downtime_start bigint, downtime_end bigint")
    assert sla.invalid_downtimes(df).count() == 1
    assert sla.invalid_downtimes(df.unionByName(spark.createDataFrame([("h", None, 5, None), ("h", None, None, 5)], df.schema))).count() == 3


def test_open_ended_downtimes(spark):
    """From the beginning of time to the end of it: two rows each."""
    ends = [(-(2**62), 2**62), (1200, 2**62), (-(2**62), 1300), (2000, 2**62)]
    vectors = [(f"open {i}", (1000, 2000), [(800, 2, 99)], [d], None, want) for i, (d, want) in enumerate(zip(ends, (100, 80, 30, 0), strict=True))]
    got = {r.host_id: float(r.ok_percent) for r in run(spark, vectors, 300).collect()}
    assert got == {f"h{i}": v[5] for i, v in enumerate(vectors)}


def test_many_states_of_one_object(spark):
    """200 000 states of one object: time grows with them, not with their square."""
    n = 200_000
    key = "host_id string, service_id string, "
    states = spark.range(n).selectExpr("'h' as host_id", "cast(null as string) as service_id", "cast(id as string) as id", "1000 + id * 10 as event_time", "cast(case when id % 4 = 0 then 2 else 0 end as int) as hard_state", "cast(case when id % 4 = 1 then 2 else 0 end as int) as previous_hard_state")
    asked = spark.createDataFrame([("h", None, 1000, 1000 + n * 10), ("h", None, 0, 500)], key + "start bigint, end bigint")
    begun = time.time()
    got = {r.start: float(r.ok_percent) for r in sla.sla_ok_percent(states, spark.createDataFrame([], key + "downtime_start bigint, downtime_end bigint"), asked).collect()}
    assert got == {1000: 75.0, 0: 100.0} and time.time() - begun < 60


def walked(start, end, states, downtimes, current, is_host):
    """One interval by a plain walk over its events."""
    order = sorted(states, key=lambda x: (x[1], x[0]))
    before, after = [x for x in order if x[1] <= start], [x for x in order if x[1] > start]
    state = before[-1][2] if before else after[0][3] if after else current if current is not None else 0
    events = [(t, 1, i, h, p) for i, t, h, p in order if start < t < end]
    for a, b in downtimes:
        if a < end and b >= start:
            events.append((max(a, start), 2, "", None, None))
            if b < end:
                events.append((b, 3, "", None, None))
    bad = out = downs = 0
    last = start
    for t, kind, _, hard, prev in [*sorted(events, key=lambda e: e[:3]), (end, 4, "", None, None)]:
        if prev == 99:
            out += t - last
        elif state > (0 if is_host else 1) and state != 99 and downs == 0:
            bad += t - last
        state = hard if hard is not None else state
        downs += {2: 1, 3: -1}.get(kind, 0)
        last = t
    total = end - start - out
    return None if total == 0 else round(100 * (total - bad) / total, 4)


@pytest.mark.parametrize("block_ms", [sla.DAY_MS, 37, 5])
def test_random_timelines(spark, block_ms):
    """Objects with ties, open and nested downtimes, unknown stretches and many intervals, walked in blocks of any width."""
    rng = random.Random(block_ms)
    key = "host_id string, service_id string, "
    states, downs, asked, current, want = [], [], [], [], {}
    for i in range(24):
        host, service = f"h{i}", None if i % 2 else f"s{i}"
        st = [(f"{j:02}", rng.randrange(100), rng.choice([0, 1, 2, 3, 99]), rng.choice([0, 1, 2, 99])) for j in range(rng.choice([0, 1, 6, 20]))]
        dt = [(a, a + rng.randrange(40)) for a in (rng.randrange(-20, 110) for _ in range(rng.choice([0, 1, 5])))]
        now = rng.choice([None, 0, 2])
        states += [(host, service, *x) for x in st]
        downs += [(host, service, *x) for x in dt]
        current += [(host, service, now)] if now is not None else []
        for _ in range(6):
            a = rng.randrange(-5, 100)
            b = a + rng.choice([1, 7, 30, 90])
            asked.append((host, service, a, b))
            want[host, service, a, b] = walked(a, b, st, dt, now, service is None)
    got = sla.sla_ok_percent(
        spark.createDataFrame(states, key + "id string, event_time bigint, hard_state int, previous_hard_state int"), spark.createDataFrame(downs, key + "downtime_start bigint, downtime_end bigint"),
        spark.createDataFrame(asked, key + "start bigint, end bigint"), spark.createDataFrame(current, key + "hard_state int"), block_ms,
    )
    got = {(r.host_id, r.service_id, r.start, r.end): None if r.ok_percent is None else float(r.ok_percent) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, abs=1e-4)), k


def test_long_intervals_and_hot_objects(spark):
    """Ten years of one object: an interval is two rows, and no task walks more than a block's."""
    day, years = sla.DAY_MS, 3650
    key = ["'h' as host_id", "cast(null as string) as service_id"]
    states = spark.range(years).selectExpr(*key, "cast(id as string) as id", f"id * {day} as event_time", "cast(case when id % 10 = 0 then 2 else 0 end as int) as hard_state", "cast(case when id % 10 = 1 then 2 else 0 end as int) as previous_hard_state")
    down = spark.range(1).selectExpr(*key, "cast(0 as bigint) as downtime_start", f"cast({day * years // 2} as bigint) as downtime_end")
    asked = spark.range(1).selectExpr(*key, "cast(0 as bigint) as start", f"cast({day * years} as bigint) as end")
    marks = sla._marked(sla._asked(asked), sla._states(states), down, None, day)
    assert marks.count() == 2
    assert [float(r.ok_percent) for r in sla.sla_ok_percent(states, down, asked).collect()] == [pytest.approx(95.0, abs=0.02)]
    plan = sla.sla_ok_percent(states, down, asked)._jdf.queryExecution().executedPlan().toString()
    # windows over an object alone run over its blocks, those over events by object and block
    assert all("b#" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_availability_deals_by_rows(spark, sf, monkeypatch):
    """As many tasks as the rows ask for, whatever the session's partitions, with the same result."""
    from pulsegrid import queries

    want = sorted(map(str, queries.sla_ok_percent(spark, sf).collect()))
    monkeypatch.setattr(sla, "ROWS", 100)
    got = queries.sla_ok_percent(spark, sf)
    assert got.rdd.getNumPartitions() > 4 and sorted(map(str, got.collect())) == want
