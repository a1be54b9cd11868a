import glob
import ipaddress
import os
import random
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.functions import scalars as S
from pulsegrid.functions.addresses import ipv4_bytes, ipv6_bytes
from pulsegrid.operators import customvars, enrich, graph, history, incidents, overdue, retention, sequence, snapshot, upserts
from pulsegrid.sources import scans, sinks
from pulsegrid.sources.schemas import SCHEMAS, schema


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("actual", "desired", "want"),
    [([], [], []), ([], [("1", "c1")], [("1", "create")]), ([("1", "c1")], [("1", "c2")], [("1", "update")]), ([("1", "c1")], [], [("1", "delete")]), ([("1", "c1")], [("1", "c1")], [])],
)
def test_snapshot_diff(spark, actual, desired, want):
    a, d = (spark.createDataFrame(x, "id string, checksum string") for x in (actual, desired))
    assert [tuple(r) for r in snapshot.snapshot_diff(d, a, checksum="checksum").collect()] == want
    diff = snapshot.snapshot_diff(d, a, checksum="checksum")
    assert sorted(map(tuple, snapshot.apply_diff(a, d, diff).collect())) == desired


def test_snapshot_diff_without_checksum_never_updates(spark):
    a, d = (spark.createDataFrame([("1", c)], "id string, checksum string") for c in ("a", "b"))
    assert snapshot.snapshot_diff(d, a).count() == 0
    assert snapshot.snapshot_diff(d, a, compare=["checksum"]).count() == 1


def test_snapshot_diff_rejects_duplicates(spark):
    d = spark.createDataFrame([("1", "a"), ("1", "b")], "id string, checksum string")
    with pytest.raises(PySparkException, match="has a key twice"):
        snapshot.snapshot_diff(d, d.limit(0), checksum="checksum").collect()


def test_snapshot_diff_random(spark):
    rng = random.Random(1)
    a, d = ({i: rng.choice("xy") for i in range(300) if rng.random() < 0.7} for _ in range(2))
    frames = [spark.createDataFrame(list(x.items()), "id int, checksum string") for x in (d, a)]
    got = dict(map(tuple, snapshot.snapshot_diff(*frames, checksum="checksum").collect()))
    assert got == {i: "create" if i not in a else "delete" if i not in d else "update" for i in {*a, *d} if a.get(i) != d.get(i)}


def test_read_snapshot(spark):
    ok = spark.createDataFrame([("172A", '{"data":1337}')], "field string, value string")
    assert tuple(scans.read_snapshot(ok, "data int").first()) == ("172a", 1337)
    for bad in (("172", '{"data":1}'), ("17zz", '{"data":1}'), ("172a", '{"data":')):
        with pytest.raises((PySparkException, Py4JJavaError)):
            scans.read_snapshot(spark.createDataFrame([bad], "field string, value string"), "data int").collect()


def test_attach_checksums(spark):
    e, c = spark.createDataFrame([("01",)], "id string"), spark.createDataFrame([("01", "02")], "id string, properties_checksum string")
    assert scans.attach_checksums(e, c).first().properties_checksum == "02"
    with pytest.raises(PySparkException, match="no checksum"):
        scans.attach_checksums(e, c.limit(0)).collect()


def test_event_times(spark):
    n = lambda v, t="bigint": F.lit(v).cast(t)
    d = lambda kind, flag, end=1337733, cancel=42240: one(spark, S.downtime_event_time(F.lit(kind), n(23320), n(end), n(cancel), n(flag, "boolean")))
    assert [d("downtime_start", None), d("downtime_end", True), d("downtime_end", False), d("downtime_end", None), d("downtime_end", True, cancel=None), d("other", True)] == [23320, 42240, 1337733, None, None, None]
    s = lambda flag, cancel=42240: one(spark, S.sla_downtime_end(n(1337733), n(cancel), n(flag, "boolean")))
    assert [s(None), s(False), s(True), s(True, None)] == [1337733, 1337733, 42240, None]
    assert one(spark, S.flapping_event_time(F.lit("flapping_end"), n(12345), n(67890))) == 67890
    assert one(spark, S.comment_event_time(F.lit("comment_remove"), n(1), n(None), n(3))) == 3
    assert one(spark, S.ack_event_time(F.lit("ack_clear"), n(1), n(None))) is None


def test_addresses(spark):
    v4 = {"192.0.2.0": b"\xc0\0\2\0", "::ffff:192.0.2.0": b"\xc0\0\2\0", "2001:db8::": None, "invalid": None, "fe80::1%eth0": None, None: None}
    mapped = b"\0" * 10 + b"\xff\xff\xc0\0\2\0"
    v6 = {"192.0.2.0": mapped, "::ffff:192.0.2.0": mapped, "2001:db8::": b"\x20\x01\x0d\xb8" + b"\0" * 12, "invalid": None, "fe80::1%eth0": None, None: None}
    rows = spark.createDataFrame([(k,) for k in v4], "t string").select("t", ipv4_bytes("t").alias("a"), ipv6_bytes("t").alias("b")).collect()
    assert {r.t: r.a and bytes(r.a) for r in rows} == v4
    assert {r.t: r.b and bytes(r.b) for r in rows} == v6


def test_addresses_native(spark):
    """Against Python's parser, without Python in the plan."""
    rng = random.Random(3)
    group = lambda: rng.choice(["0", "00a", "ffff", "1", "12345", "g", "", "ABCD"])
    texts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "1::", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1.2.3.4::", "::FFFF:c0a8:1", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "", " ::1", "::1 ", "1::2::3", "::1.2.3.4:5", "0:0:0:0:0:ffff:9.8.7.6", "2001:DB8::a", "fe80::1%1"]
    texts += [rng.choice([":", "::"]).join(group() for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts += [":".join(rng.choice(["0", "1f", "ffff"]) for _ in range(rng.randrange(5, 9))) for _ in range(50)]

    def want(text):
        try:
            ip = None if "%" in text else ipaddress.ip_address(text)
        except ValueError:
            return None, None
        if ip is None:
            return None, None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return (ip.packed, b"\0" * 10 + b"\xff\xff" + ip.packed) if ip.version == 4 else (None, ip.packed)

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ipv4_bytes("t").alias("a"), ipv6_bytes("t").alias("b"))
    for r in df.collect():
        assert (r.a and bytes(r.a), r.b and bytes(r.b)) == want(r.t), r.t
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("depth", [40, 900])
def test_flatten_depth(spark, depth):
    text = '{"a":[' * (depth // 2) + "1e20" + "]}" * (depth // 2)
    rows = customvars.flatten_json(spark.createDataFrame([("n", text)], "name string, json string"), "name", "json").collect()
    assert [(r.flatname, r.flatvalue) for r in rows] == [("n" + ".a[0]" * (depth // 2), "1e20")]


def test_carry(spark):
    """By an aggregation what the window plan has in an object's last row."""
    rng = random.Random(6)
    rows = [(k, i, rng.choice([0, 1, 2])) for k in range(40) for i in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(rows, "k int, i int, state int")
    want = {}
    for r in sorted(sequence.previous_hard_state(df, ["k"], ["i"], "state").collect(), key=lambda r: (r.k, r.i)):
        want[r.k] = (r.state, r.previous_hard_state)
    assert {r.k: (r.last_state, r.before_last) for r in sequence.carry(df, ["k"], ["i"], "state").collect()} == want


def test_legacy_by_jdbc(spark, tmp_path):
    """Through a database: ids with a wide gap are dealt evenly, and reading goes on after a mark."""
    url = "jdbc:derby:memory:legacy;create=true"
    ids = F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 10_000_000)
    spark.range(1000).select(ids.alias("history_id"), F.concat(F.lit("row "), F.col("id")).alias("text")).write.jdbc(url, "legacy_history")
    read = lambda low, high, last=None, parts=8: scans.read_legacy(spark, "legacy_history", "history_id", low, high, last, parts, url=url)
    df = read(0, 10**12)
    parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 1000 and len(parts) == 8 and max(parts) < 200  # equal widths would put 900 in one
    assert {r.history_id for r in read(0, 10**12, 897).collect()} == {898, 899, *(i * 10_000_000 for i in range(900, 1000))}
    assert sorted(r.history_id for r in read(5, 9).collect()) == [5, 6, 7, 8, 9]
    assert read(2000, 3000).count() == 0 and read(0, 10**12, parts=1).count() == 1000


def shuffled_rows(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_digest_tree(spark, tmp_path):
    """2^20 rows a side, one in 1000 changed, some created and deleted: a twentieth of the rows is shuffled at most."""
    n = 2**20
    side = lambda low, high, s: spark.range(low, high, 1, 4).select("id", F.sha1(F.concat_ws(":", "id", F.when(F.col("id") % 1000 == 7, s).otherwise(0))).alias("checksum"))
    side(0, n, 1).write.parquet(f"{tmp_path}/desired")
    side(20, n + 20, 2).write.parquet(f"{tmp_path}/actual")
    desired, actual = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("desired", "actual"))
    before = shuffled_rows(spark)
    got = {r.op: r["count"] for r in snapshot.digest_tree_diff(desired, actual).groupBy("op").count().collect()}
    assert shuffled_rows(spark) - before < 2 * n / 20
    assert got == {"create": 20, "delete": 20, "update": len([i for i in range(20, n) if i % 1000 == 7])}
    assert snapshot.digest_tree_diff(desired, desired).count() == 0
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = [df.filter("id < 3000") for df in (desired, actual)]
    named = [df.select(F.concat(F.lit("k"), F.col("id")).alias("id"), "checksum") for df in few]
    for (a, b), most in ((few, 3), (named, 100_000), (named, 3), ((few[0].limit(0), few[1]), 9), ((few[0].limit(0), few[1].limit(0)), 9)):
        assert rows(snapshot.digest_tree_diff(a, b, most=most)) == rows(snapshot.snapshot_diff(a, b, checksum="checksum"))


#: A variable's JSON and its flat rows.
CUSTOMVARS = [
    ("[]", {"n": None}), ("{}", {"n": None}), ("[[]]", {"n[0]": None}), ('{"some-key":{}}', {"n.some-key": None}), ('["foo",23,"bar"]', {"n[0]": "foo", "n[1]": "23", "n[2]": "bar"}), ("-1", {"n": "-1"}),
    ("13.37", {"n": "13.37"}), ("true", {"n": "true"}), ("false", {"n": "false"}), ("null", {"n": "null"}), ('"text"', {"n": "text"}), ("12345678901234567890123", {"n": "12345678901234567890123"}),
    ('{"top":"x","array":["answer?",42],"dict":{"k":4711}}', {"n.top": "x", "n.array[0]": "answer?", "n.array[1]": "42", "n.dict.k": "4711"}),
    ("1e20", {"n": "1e20"}), ("[1E5,1e-7,100.0,-0.0]", {"n[0]": "1E5", "n[1]": "1e-7", "n[2]": "100.0", "n[3]": "-0.0"}), ('{"a":1,"a":"\\ud83d\\ude42"}', {"n.a": "🙂"}), ('"{}"', {"n": "{}"}),
    ('[[1,2,3],{"contains-a-map":"yes","really?":true},-42]', {"n[0][0]": "1", "n[0][1]": "2", "n[0][2]": "3", "n[1].contains-a-map": "yes", "n[1].really?": "true", "n[2]": "-42"}),
]


def test_flatten(spark):
    df = spark.createDataFrame([(i, "n", v) for i, (v, _) in enumerate(CUSTOMVARS)], "i int, name string, json string")
    got = {}
    for r in customvars.flatten_json(df, "name", "json", 4).collect():
        got.setdefault(r.i, {})[r.flatname] = r.flatvalue
    assert got == {i: want for i, (_, want) in enumerate(CUSTOMVARS)}
    with pytest.raises(PySparkException, match="nested too deeply"):
        customvars.flatten_json(df, "name", "json", 1).collect()
    for bad in ('{"a":', "NaN", "{} {}", ""):
        with pytest.raises(PySparkException):
            customvars.flatten_json(spark.createDataFrame([("n", bad)], "name string, json string"), "name", "json").collect()
    odd = spark.createDataFrame([("n", None, 1), (None, "[1]", 2), ("n", "[" + ",".join(map(str, range(30_000))) + "]", 3)], "name string, json string, flatname int")
    out = customvars.flatten_json(odd, "name", "json")
    assert out.columns == ["name", "json", "flatname", "flatvalue"] and out.count() == 30_000


def test_flatten_scans_once(spark, tmp_path):
    spark.createDataFrame([("n", "[[1]]")], "name string, json string").write.parquet(f"file://{tmp_path}/v")
    plan = customvars.flatten_json(spark.read.parquet(f"file://{tmp_path}/v"), "name", "json")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_stream_ids(spark):
    good = {"0-0": (0, 0), "1761658169701-0": (1761658169701, 0), "1761658169701-23": (1761658169701, 23)}
    for text, want in good.items():
        assert tuple(one(spark, S.stream_id(F.lit(text)))) == want
    for text in ("23-42-23", "-23", "23-", "-", "oops", "0x23-0x42", "9" * 89 + "-0"):
        with pytest.raises(PySparkException, match="bad stream id"):
            spark.range(1).select(S.stream_id(F.lit(text)).alias("x")).collect()


def test_sequences_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12), i, rng.randrange(3), rng.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, i int, state int, start boolean")
    first = sequence.previous_hard_state(df.filter("i < 300"), ["k"], ["i"], "state")
    rest = sequence.previous_hard_state(df.filter("i >= 300"), ["k"], ["i"], "state", carried=sequence.carry(first, ["k"], ["i"], "state"))
    for done in (sequence.previous_hard_state(df, ["k"], ["i"], "state"), first.unionByName(rest)):
        seen = {}
        for r in sorted(done.collect(), key=lambda r: r.i):
            current, before = seen.get(r.k, (None, 99))
            if current is not None and current != r.state:
                before = current
            seen[r.k] = (r.state, before)
            assert r.previous_hard_state == before
    last = {}
    for r in sorted(sequence.pair_start_end(df, ["k"], ["i"], F.col("start"), "i").collect(), key=lambda r: r.i):
        assert r.start_time == (r.i if r.start else last.get(r.k))
        last[r.k] = r.i if r.start else None


def test_fold_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x", "m"), ("a", 2, "y", None), ("b", 1, None, "q")], "id string, at int, fixed string, changing string")
    got = {r.id: (r.fixed, r.changing) for r in upserts.fold_upserts(df, "id", ["at"], ["changing"]).collect()}
    assert got == {"a": ("x", None), "b": (None, "q")}


def test_sinks(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1")], "id string, fixed string, changing string")
    new = spark.createDataFrame([("b", "y", None, 2), ("c", "y", "3", 1), ("c", "z", "4", 2)], "id string, fixed string, changing string, at int")
    assert sorted(map(tuple, sinks.upsert(old, new, "id", ["at"], ["changing"]).collect())) == [("a", "x", "1"), ("b", "x", None), ("c", "y", "4")]
    kept = sinks.insert_ignore(old, new.select("id", "fixed", "changing", "at"), "id", "at").select("id", "fixed")
    assert sorted(map(tuple, kept.collect())) == [("a", "x"), ("b", "x"), ("c", "y")]


def test_progress(spark, tmp_path):
    t = sinks.BucketedTable(spark, f"file://{tmp_path}/t", "id bigint")
    assert t.read().count() == 0
    for n in range(3):
        t.write(t.read().unionByName(spark.range(n, n + 1)))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2]
    p = sinks.Progress(sinks.BucketedTable(spark, f"file://{tmp_path}/p", SCHEMAS["migration_progress"]))
    p.save("e", "state", 0, 1, 5)
    p.save("e", "state", 0, 1, 9)
    assert p.last_id("e", "state", 0, 1) == 9 and p.last_id("e", "other", 0, 1) is None


def test_buckets(spark, tmp_path, monkeypatch):
    """A batch writes the buckets of its keys alone, a retry leaves the same table, and emptied buckets are empty."""
    t = sinks.BucketedTable(spark, f"file://{tmp_path}/t", "id bigint, n bigint", "id", 8)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/t/data/*/*.parquet")}
    rows = lambda *pairs: spark.createDataFrame(list(pairs), t.schema)
    t.write(rows(*[(i, 0) for i in range(100)]))
    held = lambda: {r.id: r.n for r in t.read().collect()}
    assert held() == dict.fromkeys(range(100), 0)
    old_files = files()
    one = t.merge(rows((7, 1)), lambda old, new: old.join(new, "id", "left_anti").unionByName(new))
    assert len(one) == 1 and held() == dict.fromkeys(range(100), 0) | {7: 1}
    assert len(old_files.keys() - files().keys()) == 1  # of 8
    for _ in range(2):  # the second time as a retry
        assert len(t.append_new(rows((7, 2), (200, 2), (200, 2)), 2)) <= 2
        assert held() == dict.fromkeys(range(100), 0) | {7: 1, 200: 2}
    before = held()
    gone = {r.id for r in t.read(one).collect()}
    assert t.merge(rows((7, 0)), lambda old, new: old.limit(0), 3) == one
    assert set(held()) == set(before) - gone and t.read(one).count() == 0
    # batch 3 is tried again, whatever it would make of the table now
    t.merge(rows((7, 5)), lambda old, new: new, 3)
    assert set(held()) == set(before) - gone
    monkeypatch.setattr(sinks, "MAX_ADDS", 3)
    for i in range(4, 9):  # additions are put together now and then
        t.append_new(rows((7, i), (1000 + i, i)), i)
    assert set(range(1004, 1009)) < set(held()) and held()[7] == 4
    assert t.read([]).count() == 0 and t.append_new(rows()) == []


def test_retention_by_day(spark, tmp_path):
    """Old days leave without being read; one day is written anew; other environments and rows without a time stay."""
    day = retention.DAY_MS
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a'b").otherwise("z").alias("environment_id"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 50 != 0, (F.col("id") * (day / 100)).cast("long")).alias("event_time"))
    retention.save_by_day(df, "by_day", "event_time", path=f"file://{tmp_path}/by_day")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    stamps = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/by_day/*/*/*.parquet")}
    before = stamps()
    for cutoff in (int(4.5 * day), int(4.5 * day), 6 * day, 8 * day - 1):
        left = retention.drop_old_days(spark, "by_day", "event_time", "a'b", cutoff)
        assert sorted(map(tuple, left.select(*df.columns).collect()), key=str) == sorted(map(tuple, df.filter(~retention.expired("a'b", "event_time", cutoff)).collect()), key=str)
    assert len(before.keys() - stamps().keys()) == 1 and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    # a run that broke off after the day was written beside the table
    spark.table("by_day").filter("environment_id = 'z' and day = 9").write.option("path", f"file://{tmp_path}/by_day__boundary").mode("overwrite").saveAsTable("by_day__boundary")
    spark.sql("ALTER TABLE by_day DROP PARTITION (environment_id = 'z', day = 9)")
    assert retention.drop_old_days(spark, "by_day", "event_time", "none", 0).filter("environment_id = 'z' and day = 9").count() == 50
    assert not spark.catalog.tableExists("by_day__boundary")
    spark.sql("DROP TABLE by_day")


def test_first_rows(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (2, None, 1), (1, "c", 4)], "id int, x string, `at.ms` int")
    assert sorted(map(tuple, sinks.first_rows(df, ["id"]).collect())) == [(1, "a", 5), (2, None, 1)]
    assert sorted(map(tuple, sinks.first_rows(df, ["id"], "at.ms").collect())) == [(1, "c", 4), (2, None, 1)]


def test_overdue(spark):
    nu = spark.createDataFrame([("a", 9), ("b", 10), ("c", 1)], "id string, next_update bigint")
    od = spark.createDataFrame([("c",), ("gone",), ("b",)], "id string")
    assert sorted(map(tuple, overdue.overdue_diff(nu, od, 10.9).collect())) == [("a", "mark"), ("b", "unmark"), ("gone", "unmark")]


def test_retention(spark):
    now = datetime(2024, 1, 31)
    cut = retention.plan(now, 7, 30, {"acknowledgement": 0, "comment": 1})
    assert "acknowledgement" not in cut and cut["comment"] - cut["state"] == 6 * 86_400_000
    for bad in ({"nothing": 1}, {"sla_state": 1}):
        with pytest.raises(ValueError, match="no history category"):
            retention.plan(now, 7, 30, bad)
    c = cut["state"]
    st = spark.createDataFrame([("e", "old", c - 1), ("e", "new", c), ("e", "open", None), ("f", "other", c - 1)], "environment_id string, id string, event_time bigint")
    h = spark.createDataFrame([("1", "old"), ("2", "new"), ("3", None)], "id string, state_history_id string")
    out = retention.apply_retention({"state_history": st, "history": h}, "e", now, 7, 30)
    assert {r.id for r in out["state_history"].collect()} == {"new", "open", "other"}
    assert {r.id for r in out["history"].collect()} == {"2", "3"}
    assert retention.orphans(h, out["state_history"], "state_history_id", "id").count() == 1


def test_scalars(spark):
    assert one(spark, S.seconds_to_millis(F.lit(0), F.lit(0))) is None
    assert one(spark, S.seconds_to_millis(F.lit(1), F.lit(2999))) == 1002
    assert one(spark, S.notification_reason(F.lit(4), F.lit(0))) is None
    assert [one(spark, S.clamp_state(F.lit(s), F.lit(t))) for s, t in ((2, "host"), (7, "service"), (99, "host"))] == [1, 3, 99]
    assert one(spark, S.capped_seconds(F.lit(-1))) == 0
    yes, no = F.lit(True), F.lit(None).cast("boolean")
    assert one(spark, S.muted_reason(yes, yes, yes)) == "Checkable is muted due to currently active downtime, and an acknowledgement, and flapping as well."
    assert one(spark, S.notify_flag(F.lit("ok"), S.muted(yes, no, no), F.lit(0), F.lit(0))) is True
    assert one(spark, S.notify_flag(F.lit("ok"), S.muted(no, no, no), F.lit(0), F.lit(0))) is False
    assert one(spark, S.event_url("/m", F.lit("a b"), F.lit("c&d"))) == "/m/service?name=c%26d&host.name=a%20b"
    flapping = lambda a, b: one(spark, S.flapping_message(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(1.0), F.lit(10.0)))
    assert flapping(12.5, None) == "Checkable started flapping (Current flapping value 12.50% > high threshold 10.00%)"
    assert flapping(12.5, 0.25) == "Checkable stopped flapping (Current flapping value 0.25% < low threshold 1.00%)"
    text = lambda v: F.lit(v).cast("string")
    downtime = lambda kind, off, by: one(spark, S.downtime_message(text(kind), F.lit("why"), F.lit(off).cast("boolean"), text(by)))
    assert [downtime("downtime_start", None, None), downtime("downtime_end", True, "me"), downtime("downtime_end", True, None), downtime("downtime_end", None, "me")] == ["why", "Downtime was cancelled (cancelled by me)", "Downtime was cancelled", "Downtime expired"]
    ack = lambda s, c, comment, by: one(spark, S.acknowledgement_message(F.lit(s).cast("bigint"), F.lit(c).cast("bigint"), text(comment), text(by)))
    assert [ack(1, 2, "c", "me"), ack(1, 2, "c", None), ack(1, None, "c", None), ack(1, None, None, None)] == ["Acknowledgement was cleared (cleared by me)", "Acknowledgement was cleared", "c", "Checkable was acknowledged"]
    for bad in (lambda: flapping(None, None), lambda: downtime("other", True, None), lambda: ack(None, None, None, None)):
        with pytest.raises(PySparkException):
            bad()
    assert one(spark, S.event_tags(text("h"), text("s"), text("e"))) == {"host": "h", "service": "s", "environment": "e"}
    assert one(spark, S.unix_or_zero(F.expr("timestamp'1970-01-01 00:00:07'"))) == 7 and one(spark, S.unix_or_zero(F.lit(None).cast("timestamp"))) == 0
    assert [one(spark, S.notification_type(F.lit(x))) for x in (1, 256, 3)] == ["downtime_start", "flapping_end", "3"]
    assert one(spark, S.first_real_date(F.expr("timestamp_ntz'1970-01-01'"), F.expr("timestamp_ntz'2020-01-01'"))) == datetime(2020, 1, 1)
    assert one(spark, S.has_bit(F.lit(36), S.STATE_BITS["critical"])) and not one(spark, S.has_bit(F.lit(33), S.STATE_BITS["critical"]))
    with pytest.raises(PySparkException, match="out of range"):
        spark.range(1).select(S.assert_range(F.lit(70000), 0, 65535)).collect()
    a, b = one(spark, S.sha1_id(F.lit("a"), F.lit("bc"))), one(spark, S.sha1_id(F.lit("ab"), F.lit("c")))
    assert a != b and len(a) == 40


def test_incidents(spark):
    inc = spark.createDataFrame([("a", "crit", False, "host"), ("b", "crit", True, "host"), ("z", "ok", False, "service")], "object_id string, severity string, muted boolean, object_type string")
    st = spark.createDataFrame([("a", "crit", False), ("b", "crit", False), ("c", "err", False)], "object_id string, severity string, muted boolean")
    assert sorted((r.object_id, r.reason) for r in incidents.incident_diff(inc, st).collect()) == [("b", "changed"), ("c", "new")]
    assert incidents.incident_diff(inc.limit(0), st).count() == 0
    assert incidents.incident_diff(inc.limit(0), st, require_incidents=False).count() == 3
    gone = incidents.obsolete_incidents(inc, st.filter("object_id = 'a'"), st.limit(0), "host")
    assert [r.object_id for r in gone.collect()] == ["b"]


def test_enrich_rejects_unknown_relations(spark):
    with pytest.raises(ValueError, match="unknown relations"):
        enrich.enrich_events(*[None] * 7, relations=("host", "nothing"))


def test_recipients_sort_nulls_first(spark):
    n = spark.createDataFrame([(1, "n")], "id int, name string")
    r = spark.createDataFrame([(1, 1, None), (1, None, 1), (1, 1, 1)], "notification_id int, user_id int, usergroup_id int")
    u = spark.createDataFrame([(1, "u")], "id int, name string")
    assert [tuple(x) for x in graph.recipients(n, r, u, u).collect()] == [("n", None, "u"), ("n", "u", None), ("n", "u", "u")]


def test_two_writers_agree(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, endpoint_id string")
    b = spark.createDataFrame([("1", "q"), ("3", "q")], "id string, endpoint_id string")
    assert sorted(map(tuple, history.same_history(a, b).collect())) == [("2", "a"), ("3", "b")]


def test_schemas(spark):
    assert all(isinstance(schema(t), StructType) for t in SCHEMAS)
