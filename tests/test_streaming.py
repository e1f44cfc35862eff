import datetime as dt

from pyspark.sql import functions as F

from sendscope.operators import checks
from sendscope.sources import read_alerts
from sendscope.streaming import (dedup_redeliveries, error_rate_stream, orphan_conversations_stream,
                                 run_error_alert_sweep, run_error_rate_alerts)

LOG_SCHEMA = "timestamp timestamp_ntz, insertId string, resource_type string, message string"
ERR = "It is not a JSON type and cannot be deserialized: Comprar"


def _t(s):
    return dt.datetime.fromisoformat(s)


def _write_batches(spark, base, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/b{i:03d}")


def _stream(spark, base, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(base))


def test_hourly_error_stream_with_late_and_closing_rows(spark, tmp_path):
    src = str(tmp_path / "src")
    b1 = [(_t("2024-03-20 10:01:00"), "a", "gce_instance", ERR), (_t("2024-03-20 10:20:00"), "b", "gce_instance", ERR),
          (_t("2024-03-20 10:40:00"), "c", "gce_instance", ERR), (_t("2024-03-20 11:05:00"), "d", "gce_instance", ERR),
          (_t("2024-03-20 11:06:00"), "e", "gce_instance", "fine")]
    b2 = [(_t("2024-03-20 12:30:00"), "f", "gce_instance", ERR)]  # moves the watermark past 11:00
    b3 = [(_t("2024-03-20 12:31:00"), "h", "gce_instance", "fine")]  # next batch emits 10:00 and 11:00
    # Late: Spark drops a row once its window closed under the previous batch's watermark.
    b4 = [(_t("2024-03-20 10:30:00"), "g", "gce_instance", ERR)]
    _write_batches(spark, src, [b1, b2, b3, b4], LOG_SCHEMA)
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    run_error_rate_alerts(_stream(spark, src, LOG_SCHEMA), 0, sink_path=sink, checkpoint=ck)
    got = sorted((str(r.window_start), r.n_errors) for r in spark.read.parquet(sink).collect())
    assert got == [("2024-03-20 10:00:00", 3), ("2024-03-20 11:00:00", 1)]  # late row dropped, 12:00 open
    # the batch form agrees on closed windows (without the late row)
    batch = checks.error_rate_hourly(spark.createDataFrame(b1 + b2, LOG_SCHEMA), 0)
    assert sorted((str(r.window_start), r.n_errors) for r in batch.collect())[:2] == got
    # a rerun resumes from the checkpoint and adds nothing
    run_error_rate_alerts(_stream(spark, src, LOG_SCHEMA), 0, sink_path=sink, checkpoint=ck)
    assert spark.read.parquet(sink).count() == 2


def test_error_rate_stream_is_a_plain_transformation(spark):
    df = spark.createDataFrame([(_t("2024-03-20 10:01:00"), "a", "gce_instance", ERR)], LOG_SCHEMA)
    assert [r.n_errors for r in error_rate_stream(df, 0).collect()] == [1]


def test_stateless_error_sweep(spark, tmp_path):
    src = str(tmp_path / "src")
    _write_batches(spark, src, [[(_t("2024-03-20 10:01:00"), "a", "gce_instance", ERR),
                                 (_t("2024-03-20 10:02:00"), "b", "gce_instance", "ok")]], LOG_SCHEMA)
    sink = str(tmp_path / "sink")
    run_error_alert_sweep(_stream(spark, src, LOG_SCHEMA), sink_path=sink, checkpoint=str(tmp_path / "ck"))
    assert [r.insertId for r in spark.read.parquet(sink).collect()] == ["a"]


def test_dedup_redeliveries(spark, tmp_path):
    schema = "message_id string, publish_time timestamp_ntz"
    src = str(tmp_path / "src")
    _write_batches(spark, src, [[("m1", _t("2024-03-20 10:00:00")), ("m2", _t("2024-03-20 10:00:05"))],
                                [("m1", _t("2024-03-20 10:00:09"))]], schema)
    q = (dedup_redeliveries(_stream(spark, src, schema)).writeStream.format("memory")
         .queryName("dedup_out").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.message_id for r in spark.sql("SELECT * FROM dedup_out").collect()) == ["m1", "m2"]


def test_orphan_conversations_stream(spark, tmp_path):
    conv_schema = "session_id string, message_id string, text string, publish_time timestamp_ntz"
    camp_schema = "session_id string, publish_time timestamp_ntz"
    cs, ks = str(tmp_path / "conv"), str(tmp_path / "camp")
    _write_batches(spark, cs, [[("s1", "c1", "Buy now", _t("2024-03-20 10:00:00")),
                                ("s9", "c2", "Buy now", _t("2024-03-20 10:05:00"))],
                               [("s5", "c3", "x", _t("2024-03-23 10:00:00"))]], conv_schema)
    _write_batches(spark, ks, [[("s1", _t("2024-03-20 09:00:00"))],
                               [("s5", _t("2024-03-23 09:59:00"))]], camp_schema)
    out = orphan_conversations_stream(_stream(spark, cs, conv_schema), _stream(spark, ks, camp_schema))
    q = (out.writeStream.format("memory").queryName("orphans_out").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [r.message_id for r in spark.sql("SELECT * FROM orphans_out").collect()]
    assert got == ["c2"]
    assert F is not None


def test_hourly_windows_independent_of_session_time_zone(spark):
    rows = [(_t("2024-03-20 10:01:00"), "a", "gce_instance", ERR), (_t("2024-03-20 10:59:00"), "b", "gce_instance", ERR),
            (_t("2024-03-20 11:00:00"), "c", "gce_instance", ERR)]
    df = spark.createDataFrame(rows, LOG_SCHEMA)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # +05:30
        got = sorted((str(r.window_start), r.n_errors) for r in error_rate_stream(df, 0).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [("2024-03-20 10:00:00", 2), ("2024-03-20 11:00:00", 1)]


def test_orphan_conversations_live(spark, tmp_path):
    from sendscope.streaming import orphan_conversations_live
    conv_schema = "session_id string, message_id string, text string, publish_time timestamp_ntz"
    src = str(tmp_path / "conv")
    _write_batches(spark, src, [[("s1", "c1", "Buy now", _t("2024-03-20 10:00:00")),
                                 ("s9", "c2", "Buy now", _t("2024-03-20 10:05:00")),
                                 ("s9", "c3", "hello", _t("2024-03-20 10:06:00"))],
                                [("s8", "c4", "Buy now", _t("2024-03-20 11:00:00"))]], conv_schema)
    camp = spark.createDataFrame([("s1",), ("s1",)], "session_id string")
    q = (orphan_conversations_live(_stream(spark, src, conv_schema), camp, ["Buy now"]).writeStream
         .format("memory").queryName("live_orphans").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.message_id for r in spark.sql("SELECT * FROM live_orphans").collect()) == ["c2", "c4"]


def test_stream_alerts_into_the_alerts_table(spark, tmp_path):
    from sendscope.streaming import error_rate_alerts, stream_alerts_to_table
    src = str(tmp_path / "src")
    b1 = [(_t("2024-03-20 10:01:00"), "a", "gce_instance", ERR), (_t("2024-03-20 10:20:00"), "b", "gce_instance", ERR)]
    b2 = [(_t("2024-03-20 12:30:00"), "f", "gce_instance", ERR)]
    b3 = [(_t("2024-03-20 12:31:00"), "h", "gce_instance", "fine")]
    _write_batches(spark, src, [b1, b2, b3], LOG_SCHEMA)
    table, ck = str(tmp_path / "alerts"), str(tmp_path / "ck")
    stream_alerts_to_table(error_rate_alerts(error_rate_stream(_stream(spark, src, LOG_SCHEMA), 1)),
                           table, ck, "errors")
    rows = spark.read.parquet(table).collect()
    assert [(r.check_name, r.n_rows, str(r.first_seen)) for r in rows] == [("error_rate", 2, "2024-03-20 10:00:00")]
    assert rows[0].run_id.startswith("errors-")


def test_early_alerts_in_update_mode(spark, tmp_path):
    from sendscope.streaming import error_rate_alerts, stream_alerts_to_table
    src = str(tmp_path / "src")
    b1 = [(_t("2024-03-20 10:01:00"), "a", "gce_instance", ERR), (_t("2024-03-20 10:20:00"), "b", "gce_instance", ERR)]
    _write_batches(spark, src, [b1], LOG_SCHEMA)  # the 10:00 window is still open afterwards
    table = str(tmp_path / "alerts")
    stream_alerts_to_table(error_rate_alerts(error_rate_stream(_stream(spark, src, LOG_SCHEMA), 1)),
                           table, str(tmp_path / "ck"), "early", output_mode="update")
    rows = read_alerts(spark, table).collect()
    assert [(str(r.first_seen), r.n_rows) for r in rows] == [("2024-03-20 10:00:00", 2)]


def _split_events(spark, base, n_files=4):
    """The sf0.001 tables with ``events`` as a folder of shuffled part files,
    every fifth event delivered twice."""
    import os
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    twice = events.where("pmod(xxhash64(event_id), 5) = 0")
    events.unionByName(twice).repartition(n_files, F.rand(7)).write.parquet(os.path.join(base, "events.parquet"))
    for t in ("conversations",):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(os.path.join(base, f"{t}.parquet"))
    return events


def test_replays_of_shuffled_files_lose_nothing(spark, tmp_path):
    from sendscope.plans import QUERIES
    events = _split_events(spark, str(tmp_path))
    got = QUERIES["stream_dedup_campaigns"](spark, str(tmp_path))
    want = QUERIES["stream_dedup_campaigns"](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == events.count()
    from sendscope.plans import params
    from sendscope.sources.adapter import logs_from_events
    logs = logs_from_events(spark.read.parquet(f"{tmp_path}/events.parquet"))
    got = QUERIES["stream_error_rate"](spark, str(tmp_path)).collect()
    want = checks.error_rate_hourly(logs, params.ERROR_RATE_THRESHOLD).collect()
    assert want and sorted((str(r.window_start), r.n_errors) for r in got) == sorted((str(r.window_start), r.n_errors) for r in want)
    assert QUERIES["stream_orphan_conversations"](spark, str(tmp_path)).count() == \
        QUERIES["stream_orphan_conversations"](spark, "/root/testdata/sf0.001").count()


def test_growing_window_keeps_one_row_in_update_mode(spark, tmp_path):
    from sendscope.streaming import error_rate_alerts, stream_alerts_to_table
    src, table = str(tmp_path / "src"), str(tmp_path / "alerts")
    rows = [(_t(f"2024-03-20 10:0{i}:00"), str(i), "gce_instance", ERR) for i in range(4)]
    _write_batches(spark, src, [rows[:2], rows[2:]], LOG_SCHEMA)
    stream_alerts_to_table(error_rate_alerts(error_rate_stream(_stream(spark, src, LOG_SCHEMA), 1)),
                           table, str(tmp_path / "ck"), "early", output_mode="update")
    assert [r.n_rows for r in read_alerts(spark, table).collect()] == [4]


def test_orphan_sweep_sees_campaigns_that_come_later(spark, tmp_path):
    from sendscope.streaming import swept_orphans, sweep_orphan_conversations
    schema = "session_id string, message_id string, text string, publish_time timestamp_ntz"
    src, out, ck = (str(tmp_path / x) for x in ("conv", "out", "ck"))
    camps = [("s1",), ("s1",)]

    def sweep():
        sweep_orphan_conversations(_stream(spark, src, schema), lambda: spark.createDataFrame(camps, "session_id string"),
                                   ["Buy now"], out, ck)

    _write_batches(spark, src, [[("s1", "c1", "Buy now", _t("2024-03-20 10:00:00")), (None, "c0", "Buy now", None),
                                 ("s9", "c2", "Buy now", _t("2024-03-20 10:05:00")), ("s9", "c3", "hello", None)]], schema)
    sweep()
    assert sorted(r.message_id for r in swept_orphans(spark, out).collect()) == ["c0", "c2"]
    camps.append(("s8",))
    spark.createDataFrame([("s8", "c4", "Buy now", _t("2024-03-20 11:00:00"))], schema).coalesce(1).write.parquet(f"{src}/later")
    sweep()
    assert sorted(r.message_id for r in swept_orphans(spark, out).collect()) == ["c0", "c2"]


def _orphan_files(seed):
    """Conversations and campaigns in shuffled files, with repeats and nulls."""
    import random
    r = random.Random(seed)
    conv = [(f"s{r.randint(0, 30)}" if r.random() < 0.95 else None, f"c{k}", r.choice(["Buy now", "Buy now", "x", None]),
             _t("2024-03-20 10:00:00") + dt.timedelta(minutes=r.randint(0, 900))) for k in range(80)]
    conv += conv[:5]
    camp = [(f"s{r.randint(0, 40)}" if r.random() < 0.9 else None, _t("2024-03-19 10:00:00")) for _ in range(40)]
    r.shuffle(conv)
    r.shuffle(camp)
    return conv, camp


CONV_SCHEMA = "session_id string, message_id string, text string, publish_time timestamp_ntz"
CAMP_SCHEMA = "session_id string, publish_time timestamp_ntz"


def _batch_orphans(spark, conv, camp):
    c, k = spark.createDataFrame(conv, CONV_SCHEMA), spark.createDataFrame(camp, CAMP_SCHEMA)
    left = c.where("text = 'Buy now'").join(k, "session_id", "left_anti")
    return sorted(((r.session_id, r.message_id, r.publish_time) for r in left.collect()), key=repr)


def test_orphans_are_withdrawn_whatever_the_order_of_files(spark, tmp_path):
    from sendscope.streaming import sweep_orphan_changes
    conv, camp = _orphan_files(1)
    cs, ks = str(tmp_path / "conv"), str(tmp_path / "camp")
    _write_batches(spark, cs, [conv[:20]], CONV_SCHEMA)
    _write_batches(spark, ks, [[]], CAMP_SCHEMA)

    def sweep():
        return sweep_orphan_changes(_stream(spark, cs, CONV_SCHEMA), _stream(spark, ks, CAMP_SCHEMA), ["Buy now"],
                                    str(tmp_path / "state"), str(tmp_path / "ck"), buckets=5)

    def now(state):
        return sorted(((r.session_id, r.message_id, r.publish_time) for r in state.orphans().collect()), key=repr)

    assert now(sweep()) == _batch_orphans(spark, conv[:20], [])
    steps = [(20, 40, 0, 0), (40, 40, 0, 15), (40, 60, 15, 25), (60, 85, 25, 40)]
    for i, (a, b, c, d) in enumerate(steps):  # either side first, alone or together
        _write_batches(spark, f"{cs}/n{i}", [conv[a:b]] if b > a else [], CONV_SCHEMA)
        _write_batches(spark, f"{ks}/n{i}", [camp[c:d]] if d > c else [], CAMP_SCHEMA)
        state = sweep()
        assert now(state) == _batch_orphans(spark, conv[:b], camp[:d])
        if i == 1:  # a compacted state gives the same changes from here on
            last = state.changes().agg(F.max("batch")).first()[0]
            state.compact(last + 1)
            state.compact(last + 1)
    log = state.changes().groupBy("session_id", "message_id", "publish_time").agg(F.sum("change").alias("n"))
    assert {r.n for r in log.collect()} <= {0, 1, 2}
    assert state.changes().where("change < 0").count() > 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from sendscope.streaming import OrphanState
    conv, camp = _orphan_files(2)
    side = "side string, session_id string, message_id string, cta string, publish_time timestamp_ntz"
    c = [("conversation", s, m, "Buy now", t) for s, m, x, t in conv if x == "Buy now"]
    k = [("campaign", s, None, None, None) for s, _ in camp]
    state = OrphanState(spark, str(tmp_path / "state"), buckets=3)
    batches = [c[:20], k[:10] + c[20:30], k[10:], c[30:]]
    for i, rows in enumerate(batches):
        state.apply(spark.createDataFrame(rows, side), i)
        state.apply(spark.createDataFrame(rows, side), i)
    got = sorted(((r.session_id, r.message_id, r.publish_time) for r in state.orphans().collect()), key=repr)
    assert got == _batch_orphans(spark, conv, camp)
    # only the buckets of the batch's sessions are read
    plan = state._read("sessions", "session_id string", 9, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_many_growing_windows_stay_in_few_files(spark, tmp_path):
    from sendscope.sources.writers import compact_alerts
    from sendscope.streaming import alerts_batch_writer
    table = str(tmp_path / "alerts")
    write = alerts_batch_writer(table, "grow", by_alert=True)
    for version in (0, 1, 2, 2):  # the last batch is replayed
        write(spark.range(10000).where(F.col("id") % (version + 1) == 0).select(
            F.lit("error_rate").alias("check_name"), F.concat(F.lit("w"), "id").alias("entity"), F.lit("critical").alias("severity"),
            (F.col("id") + version).alias("n_rows"), F.lit(_t("2024-03-20 10:00:00")).alias("first_seen")), version)
    write_other = alerts_batch_writer(table, "plain")
    write_other(read_alerts(spark, table).limit(1), 0)

    def now():
        rows = read_alerts(spark, table).where("run_id not like 'plain%'").collect()
        return sorted((int(r.entity[1:]), r.n_rows) for r in rows)

    want = [(i, i + (2 if i % 3 == 0 else 1 if i % 2 == 0 else 0)) for i in range(10000)]
    assert now() == want
    assert len(spark.read.parquet(table).inputFiles()) < 60
    compact_alerts(spark, table, "grow", "2024-03-20", 2)
    compact_alerts(spark, table, "grow", "2024-03-20", 2)
    assert now() == want
    folder = spark.read.parquet(f"{table}/run_date=2024-03-20/run_id=grow~000000000002")
    assert folder.count() == 10000 and len(folder.inputFiles()) == 1
    assert read_alerts(spark, table).where("run_id = 'plain-0'").count() == 1


def test_kept_and_late_rows_add_up(spark, tmp_path):
    from sendscope.streaming.late import LateSplit
    schema = spark.createDataFrame([], "timestamp timestamp_ntz, id int").schema
    split = LateSplit(spark, str(tmp_path / "split"), schema, "timestamp", "1 hour")
    batches = [[(_t("2024-03-20 10:00:00"), 1), (_t("2024-03-20 08:00:00"), 2), (None, 3)],
               [(_t("2024-03-20 08:59:59"), 4), (_t("2024-03-20 09:00:00"), 5), (_t("2024-03-20 12:00:00"), 6)], [],
               [(_t("2024-03-20 10:59:00"), 7), (_t("2024-03-20 11:00:00"), 8)]]
    for i, rows in enumerate(batches):
        for _ in range(2):  # each batch is replayed
            split.apply(spark.createDataFrame(rows, schema), i)
    assert sorted(r.id for r in split.kept().collect()) == [1, 2, 5, 6, 8]
    assert sorted(r.id for r in split.late().collect()) == [3, 4, 7]
    counts = {r.batch: (r.n_kept, r.n_late) for r in split.counts().collect()}
    assert counts == {0: (2, 1), 1: (2, 1), 2: (0, 0), 3: (1, 1)}
