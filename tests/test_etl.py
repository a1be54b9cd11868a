from pulsegrid.plans import legacy_etl as etl
from pulsegrid.sources.schemas import SCHEMAS, UPSERTS
from pulsegrid.sources.sinks import Progress, BucketedTable

OBJECT = "objecttype_id int, name1 string, name2 string"


def frames(spark):
    comments = spark.createDataFrame(
        [(1, 100, 5000, 1, "me", "hi", 1, 0, 200, 0, "h!s-1", 2, "h", "s"), (2, 100, 0, 1, "me", "hi", 0, 300, 0, 0, "h!-2", 1, "h", ""), (3, None, 0, 1, "me", "hi", 0, 0, 0, 0, "x", 1, "h", ""), (4, 150, 0, 4, "me", "ack", 0, 0, 160, 0, "y", 2, "h", "s")],
        f"commenthistory_id bigint, entry_time bigint, entry_time_usec int, entry_type int, author_name string, comment_data string, is_persistent int, expiration_time bigint, deletion_time bigint, deletion_time_usec int, name string, {OBJECT}",
    )
    downtimes = spark.createDataFrame(
        [(1, 10, "me", "d", 1, 60, 100, 0, 1, 0, 0, 0, 0, 0, 0, "d1", "", 1, "h", ""), (2, 10, "me", "d", 0, 60, 100, 200, 1, 110, 0, 150, 0, 1, 0, "d2", "d1", 2, "h", "s"), (3, 10, "me", "d", 0, 60, 100, 200, 0, 0, 0, 0, 0, 0, 0, "d3", "", 1, "h", "")],
        f"downtimehistory_id bigint, entry_time bigint, author_name string, comment_data string, is_fixed int, duration bigint, scheduled_start_time bigint, scheduled_end_time bigint, was_started int, actual_start_time bigint, actual_start_time_usec int, actual_end_time bigint, actual_end_time_usec int, was_cancelled int, trigger_time bigint, name string, triggered_by string, {OBJECT}",
    )
    flapping = spark.createDataFrame(
        [(1, 10, 0, 1001, 1.0, 5.0, 9.0, 1, "h", ""), (2, 20, 0, 1000, 2.0, 5.0, 9.0, 1, "h", ""), (3, 30, 0, 1001, 3.0, 4.0, 8.0, 1, "h", ""), (4, 40, 0, 1000, 4.0, 5.0, 9.0, 2, "h", "s")],
        f"flappinghistory_id bigint, event_time bigint, event_time_usec int, event_type int, percent_state_change double, low_threshold double, high_threshold double, {OBJECT}",
    )
    notifications = spark.createDataFrame(
        [(1, 0, 10, 0, 2, "out", "long", 2, 2, "h", "s"), (2, 4, 11, 0, 0, "out", None, 0, 2, "h", "s"), (3, 0, 12, 0, 0, "out", None, 0, 2, "h", "s"), (4, 0, None, 0, 0, "out", None, 0, 2, "h", "s")],
        f"notification_id bigint, notification_reason int, end_time bigint, end_time_usec int, state int, output string, long_output string, contacts_notified int, {OBJECT}",
    )
    states = spark.createDataFrame(
        [(1, 10, 0, 5, 1, 1, 3, 0, 0, "o", None, None, 1, "h", ""), (2, 20, 0, 2, 0, 1, 3, 0, 0, "o", None, None, 2, "h", "s"), (3, 30, 0, 2, 1, 1, 3, 2, 2, "o", None, None, 2, "h", "s"), (4, None, 0, 0, 1, 1, 3, 2, 2, "o", None, None, 2, "h", "s")],
        f"statehistory_id bigint, state_time bigint, state_time_usec int, state int, state_type int, current_check_attempt int, max_check_attempts int, last_state int, last_hard_state int, output string, long_output string, check_source string, {OBJECT}",
    )
    return {"comment": comments, "acknowledgement": comments, "downtime": downtimes, "flapping": flapping, "notification": notifications, "state": states}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_comments_and_acks(spark):
    made = etl.convert_comments("e", frames(spark)["comment"])
    assert rows(made["comment_history"], "object_type", "entry_time", "remove_time", "expire_time", "has_been_removed", "is_sticky") == [("host", 100000, None, 300000, False, False), ("service", 100005, 200000, None, True, False)]
    assert rows(made["history"], "event_type", "event_time") == [("comment_add", 100000), ("comment_add", 100005), ("comment_remove", 200000)]
    acks = etl.convert_acks("e", frames(spark)["comment"])
    assert rows(acks["history"], "event_type", "event_time") == [("ack_clear", 160000), ("ack_set", 150000)]


def test_downtimes(spark):
    made = etl.convert_downtimes("e", frames(spark)["downtime"])
    assert rows(made["downtime_history"], "start_time", "end_time", "scheduled_end_time", "trigger_time", "cancel_time", "flexible_duration") == [(100000, 160000, 160000, 100000, None, 60000), (110000, 150000, 200000, 110000, 150000, 60000)]
    assert rows(made["history"], "event_type", "event_time") == [("downtime_end", 150000), ("downtime_start", 100000), ("downtime_start", 110000)]
    assert rows(made["sla_history_downtime"], "downtime_start", "downtime_end") == [(100000, 160000), (110000, 150000)]


def test_flapping(spark):
    made = etl.convert_flapping("e", frames(spark)["flapping"])
    assert rows(made["flapping_history"], "start_time", "end_time", "percent_state_change_start", "percent_state_change_end", "flapping_threshold_low") == [(20000, 30000, 2.0, 3.0, 4.0), (40000, None, 4.0, None, 5.0)]
    assert rows(made["history"], "event_type", "event_time") == [("flapping_end", 30000), ("flapping_start", 20000), ("flapping_start", 40000)]


def test_notifications(spark):
    contacts = spark.createDataFrame([(1, "ann"), (1, "bob"), (9, "eve")], "notification_id bigint, contact string")
    made = etl.convert_notifications("e", frames(spark)["notification"], contacts)
    assert rows(made["notification_history"], "type", "send_time", "previous_hard_state", "text") == [("problem", 10000, 99, "out\n\nlong"), ("recovery", 12000, 2, "out")]
    assert made["user_notification_history"].count() == 2


def test_states(spark):
    made = etl.convert_states("e", frames(spark)["state"])
    assert rows(made["state_history"], "object_type", "soft_state", "hard_state", "previous_hard_state") == [("host", 1, 1, 99), ("service", 2, 0, 99), ("service", 2, 2, 0)]
    assert made["sla_history_state"].count() == 2


def test_migrate_twice_changes_nothing(spark, tmp_path):
    names = ["comment_history", "acknowledgement_history", "downtime_history", "sla_history_downtime", "flapping_history", "notification_history", "user_notification_history", "state_history", "sla_history_state", "history"]
    tables = {n: BucketedTable(spark, f"file://{tmp_path}/{n}", SCHEMAS[n]) for n in names}
    progress = Progress(BucketedTable(spark, f"file://{tmp_path}/progress", SCHEMAS["migration_progress"]))
    contacts = spark.createDataFrame([(1, "ann")], "notification_id bigint, contact string")
    etl.migrate_history("e", frames(spark), tables, progress, contacts, 0, 10)
    first = {n: sorted(map(str, t.read().collect())) for n, t in tables.items()}
    etl.migrate_history("e", frames(spark), tables, progress, contacts, 0, 10)
    assert first == {n: sorted(map(str, t.read().collect())) for n, t in tables.items()}
    assert len(first["history"]) == 3 + 2 + 3 + 3 + 2 + 3 and progress.last_id("e", "state", 0, 10) == 4


def test_migration_goes_on_after_its_mark(spark, tmp_path):
    """Two runs leave what one leaves, and the second reads no row that the first has done, but what it carries on."""
    contacts = spark.createDataFrame([(1, "ann")], "notification_id bigint, contact string")
    left = []
    for name, steps in (("one", [99]), ("two", [2, 99])):
        tables = {n: BucketedTable(spark, f"file://{tmp_path}/{name}/{n}", SCHEMAS[n], key, 2) for n, (key, _) in UPSERTS.items()}
        progress = Progress(BucketedTable(spark, f"file://{tmp_path}/{name}/progress", SCHEMAS["migration_progress"]))
        for upto in steps:
            part = {k: rows.filter(f"{etl.CONVERTERS[k][0]} <= {upto}") for k, rows in frames(spark).items() if k in ("flapping", "state")}
            etl.migrate_history("e", part, tables, progress, contacts)
        left.append({n: sorted(map(str, t.read().collect())) for n, t in tables.items()})
    assert left[0] == left[1] and left[0]["state_history"] and left[0]["flapping_history"]
    fresh, _ = etl.resumed("e", "state", frames(spark)["state"], 2)
    assert sorted(r.statehistory_id for r in fresh.collect()) == [3, 4]


def test_joins(spark):
    objects = spark.createDataFrame([(1, 1, "h", None)], f"object_id int, {OBJECT}")
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "object_id int, fact string")
    assert rows(etl.with_objects(facts, objects), "fact", "name2") == [("a", "")]
    down = spark.createDataFrame([(7, None, 3, "h", "s")], "downtimehistory_id int, name string, triggered_by_id int, name1 string, name2 string")
    scheduled = spark.createDataFrame([(3, None, "h", "s")], "scheduleddowntime_id int, name string, name1 string, name2 string")
    assert rows(etl.with_triggers(down, scheduled.select("scheduleddowntime_id", "name", "name1", "name2")), "name", "triggered_by") == [("h!s-7", "h!s-3")]


def test_contact_names_deals_by_rows(spark, monkeypatch):
    """As many tasks as the rows ask for, whatever the session's partitions, and no distinct before the dealing."""
    monkeypatch.setattr(etl, "CONTACTS", 10)
    notifications = spark.createDataFrame([(i,) for i in [*range(100), 7]], "notification_id bigint")
    contacts = spark.createDataFrame([(i % 120, i % 3) for i in range(300)], "notification_id bigint, contact_object_id bigint")
    objects = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "object_id bigint, name1 string")
    got = etl.contact_names(notifications, contacts, objects)
    assert rows(got, "notification_id", "contact") == sorted({(i % 120, "aba"[i % 3]) for i in range(300) if i % 120 < 100}, key=str)
    assert got.rdd.getNumPartitions() == 30


def test_migration_buckets_grow_with_the_events(spark, sf, monkeypatch):
    from pulsegrid import queries

    monkeypatch.setattr(queries, "MIGRATED", 300)
    tables, _ = queries._migrated(spark, sf, "state")
    assert tables["state_history"].buckets == 4 and tables["state_history"].read().select("id").distinct().count() == tables["state_history"].read().count() > 0
    assert len({r[0] for r in spark.read.parquet(f"{tables['state_history'].path}/data").select("__bucket").distinct().collect()}) == 4
