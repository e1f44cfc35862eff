import datetime as dt
import json
from collections import Counter

from pyspark.sql import functions as F

from sendscope.sources import (export_csv, read_campaigns_json, read_logs_csv, read_processed,
                               write_processed)
from sendscope.sources.adapter import load_tables


def test_json_ids_stay_strings(spark, tmp_path):
    # Two long ids that differ only in the last digit must not collapse (no inference).
    rows = [{"session_id": "0012345678901234567", "message_id": "0012345678901234567",
             "publish_time": "2024-03-19T10:00:00"},
            {"session_id": "0012345678901234568", "message_id": "0012345678901234568",
             "publish_time": "2024-03-19T10:00:01"}]
    p = tmp_path / "camp.json"
    p.write_text(json.dumps(rows))
    df = read_campaigns_json(spark, str(p))
    got = sorted(r.session_id for r in df.collect())
    assert got == ["0012345678901234567", "0012345678901234568"]
    assert dict(df.dtypes)["publish_time"] == "timestamp_ntz"


def test_logs_csv_quotes_newlines_and_dotted_names(spark, tmp_path):
    p = tmp_path / "logs.csv"
    p.write_text('timestamp,insertId,resource.type,jsonPayload.message\n'
                 '2024-03-20 10:00:00,a1,gce_instance,"It is not a JSON type and cannot be '
                 'deserialized: Comprar ""Fone"", X9\nsegunda linha"\n'
                 '2024-03-20 10:01:00,a2,gce_instance,"{""k"": 1}"\n')
    df = read_logs_csv(spark, str(p))
    assert df.columns == ["timestamp", "insertId", "resource_type", "message"]
    rows = {r.insertId: r.message for r in df.collect()}
    assert rows["a1"].endswith('Comprar "Fone", X9\nsegunda linha')
    assert rows["a2"] == '{"k": 1}'


def test_processed_round_trip_partitioned(spark, tmp_path):
    camp = load_tables(spark, "/root/testdata/sf0.001")["campaigns"]
    out = str(tmp_path / "camp")
    write_processed(camp, out, sort_cols=["session_id", "message_id"])
    back = read_processed(spark, out)
    assert back.count() == camp.count()
    assert "publish_date" in back.columns
    # partition pruning: a date filter becomes a partition filter
    plan = back.where(F.col("publish_date") == "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "publish_date" in plan


def test_csv_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "quoted", comma\nnewline')], "id string, text string")
    out = str(tmp_path / "csv")
    export_csv(df, out)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert back.collect()[0].text == 'x "quoted", comma\nnewline'


def test_adapter_row_counts(spark):
    t = load_tables(spark, "/root/testdata/sf0.01")
    assert t["campaigns"].count() == 10_000
    assert t["conversations"].count() == 536
    assert t["logs"].count() == 10_000


def test_sorted_export_is_globally_ordered(spark):
    from sendscope.operators.prepare import sorted_for_export
    conv = load_tables(spark, "/root/testdata/sf0.01")["conversations"]
    parts = sorted_for_export(conv, ["session_id", "publish_time", "message_id"], 4) \
        .select("session_id", "publish_time", "message_id", F.spark_partition_id().alias("p")).collect()
    keys = [(r.p, r.session_id, r.publish_time, r.message_id) for r in parts]
    # rows come out partition by partition, each sorted, partitions in key order
    assert [k[1:] for k in keys] == sorted(k[1:] for k in keys)


def test_alert_runs_are_idempotent_per_day(spark, tmp_path):
    from sendscope.sources import write_alerts
    a = spark.createDataFrame([("version", "t / 1", "attention", 3, None)],
                              "check_name string, entity string, severity string, n_rows long, first_seen timestamp_ntz")
    out = str(tmp_path / "alerts")
    write_alerts(a, out, "2024-03-21")
    write_alerts(a, out, "2024-03-21")  # retry of the same day
    write_alerts(a.unionByName(a), out, "2024-03-22")
    got = {str(r.run_date): r["count"] for r in read_processed(spark, out).groupBy("run_date").count().collect()}
    assert got == {"2024-03-21": 1, "2024-03-22": 2}
    # a stream writing into the same table leaves the batch partitions alone
    from sendscope.streaming import alerts_batch_writer
    write = alerts_batch_writer(out, "errors")
    s = spark.createDataFrame([("error_rate", "x", "critical", 4, dt.datetime(2024, 3, 21, 10))],
                              "check_name string, entity string, severity string, n_rows long, "
                              "first_seen timestamp_ntz")
    write(s, 7)
    write(s, 7)  # the same micro-batch replayed after a failure
    got = {(str(r.run_date), r.run_id): r["count"]
           for r in read_processed(spark, out).groupBy("run_date", "run_id").count().collect()}
    assert got == {("2024-03-21", "checks"): 1, ("2024-03-22", "checks"): 2, ("2024-03-21", "errors-7"): 1}


def test_a_run_without_alerts_clears_its_partition(spark, tmp_path):
    from sendscope.sources import read_alerts, write_alerts
    from sendscope.sources.writers import ALERTS
    out = str(tmp_path / "alerts")
    none = spark.createDataFrame([], ALERTS)
    write_alerts(none, out, "2024-03-20")
    assert read_alerts(spark, out).collect() == []
    one = spark.createDataFrame([("version", "x", "attention", 1, None)], ALERTS)
    for day in ("2024-03-20", "2024-03-21"):
        write_alerts(one, out, day)
    write_alerts(none, out, "2024-03-20")
    assert [str(r.run_date) for r in read_alerts(spark, out).collect()] == ["2024-03-21"]


def _odd_objects(seed, n):
    import random
    r = random.Random(seed)
    texts = ['a "q" \\\\ }{', "}]},{", 'x\\', "line\nfeed", "é}", "", None, '{"k": 1}', '"', "[1,{2}]", '\\"}']
    return [{"session_id": f"s{i}", "message_id": r.choice(texts), "template": r.choice(texts), "attributes": r.choice(texts) or "" * r.randint(0, 50),
             "data": {"deep": [{"x": "}"}]} if i % 7 == 0 else r.choice(texts), "publish_time": "2024-03-20T10:00:00.123456"} for i in range(n)]


def test_array_files_in_small_ranges_equal_the_whole_file_reader(spark, tmp_path):
    import json

    from sendscope.sources.readers import read_campaigns_array, read_campaigns_json
    base = tmp_path / "a"
    base.mkdir()
    for i, (n, indent) in enumerate([(60, None), (40, 2), (1, 4), (0, None), (25, None)]):
        (base / f"f{i}.json").write_text(json.dumps(_odd_objects(i, n), indent=indent, ensure_ascii=i % 2 == 0), encoding="utf-8")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for size in ("97", "1000", "10000000"):  # ranges of a few bytes: records span several
            for k in keys:
                spark.conf.set(k, size)
            got = read_campaigns_array(spark, str(base))
            want = read_campaigns_json(spark, str(base))
            cols = [c for c in want.columns if c != "data"]
            rows = sorted(map(repr, got.select(cols).collect()))
            assert rows == sorted(map(repr, want.select(cols).collect())) and len(rows) == 126
            if size == "97":
                assert spark.read.option("lineSep", "}").text(str(base)).rdd.getNumPartitions() > 20
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_array_export_sorts_nothing_and_deals_rows_over_more_files(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from sendscope.sources import writers
    plans, text = [], DataFrameWriter.text

    def noted(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return text(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", noted)
    rows = [(f"s{i % 90}", None if i % 7 == 0 else f'a "q" }}{{ {i % 40}') for i in range(500)] + [("copy", "x")] * 300 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "session_id string, message_id string").repartition(5, "session_id")

    def arrays(name):
        files = [json.loads(f.read_text()) for f in sorted((tmp_path / name).rglob("*.txt"))]
        assert all(files)
        return files

    for name, files, size in [("one", 1, 1 << 30), ("three", 3, 1 << 30), ("more", 2, 5000)]:
        monkeypatch.setattr(writers, "ARRAY_BYTES", size, raising=False)
        writers.export_json_array(df, str(tmp_path / name), files)
        found = arrays(name)
        assert len(found) == files if size > 5000 else len(found) > 4
        assert sorted(repr((r["session_id"], r["message_id"])) for f in found for r in f) == sorted(map(repr, rows))
    writers.export_json_array(df.limit(0), str(tmp_path / "none"), 2)
    from sendscope.sources.readers import read_campaigns_array
    assert read_campaigns_array(spark, str(tmp_path / "none")).collect() == []
    assert len(plans) == 4 and not any(word in plan for plan in plans for word in ("Sort", "Window"))


def test_array_export_of_changing_rows_is_refused(spark, tmp_path):
    import random

    import pytest

    from sendscope.sources.writers import export_json_array
    drawn = F.udf(lambda: str(random.SystemRandom().random())).asNondeterministic()
    with pytest.raises(ValueError):
        export_json_array(spark.range(2000).select(drawn().alias("session_id")), str(tmp_path / "a"), 3)


def test_fragments_of_a_range_are_summed_up_by_several_tasks(spark, tmp_path, monkeypatch):
    from sendscope.sources import split
    from sendscope.sources.readers import read_campaigns_array, read_campaigns_json
    path = str(tmp_path / "a.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_odd_objects(3, 3000), f)
    for name, value in [("BLOCK_BITS", 6), ("TASK_ROWS", 500), ("TASK_BYTES", 20_000)]:
        monkeypatch.setattr(split, name, value)
    rows = split._fragments(spark, path, "}").withColumn("one", F.lit(1))
    assert rows.select("file", "start").distinct().count() == 1
    tasks = split._tasks(rows.withColumn("size", F.octet_length("value")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # this small a table would be one task's
    try:
        got = split._running(rows, "one", "before", tasks).select("before", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    held = Counter(r.task for r in got)
    assert len(got) > 3000 and max(held.values()) < len(got) / 3
    assert sorted(r.before for r in got) == list(range(len(got)))
    cols = ["session_id", "message_id", "template", "attributes", "publish_time"]
    want = read_campaigns_json(spark, path).select(cols)
    assert sorted(map(repr, read_campaigns_array(spark, path).select(cols).collect())) == sorted(map(repr, want.collect()))


def test_csv_in_small_ranges_equals_the_whole_file_reader(spark, tmp_path):
    import csv

    from sendscope.sources.readers import read_logs_csv, read_logs_csv_split
    base = tmp_path / "c"
    base.mkdir()
    cells = ['a,b', 'say "hi"', "two\nlines", '"', "\n\n", "é", '{"k": 1}', "x" * 300, '","']
    for i in range(3):
        with open(base / f"f{i}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["timestamp", "insertId", "resource.type", "jsonPayload.message"])
            out.writerows([f"2024-03-20 10:00:{k % 60:02d}.000001", f"l{i}-{k}", "gce_instance", cells[k % len(cells)]] for k in range(50 * i))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for size in ("61", "5000"):
            for k in keys:
                spark.conf.set(k, size)
            got = sorted(map(repr, read_logs_csv_split(spark, str(base)).collect()))
            assert got == sorted(map(repr, read_logs_csv(spark, str(base)).collect())) and len(got) == 150
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_sorted_export_lookups_open_few_files(spark, tmp_path):
    from sendscope.sources import sorted_export
    path = str(tmp_path / "export")
    df = spark.range(5000).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("s"), F.col("id") % 700)).alias("session_id"),
                                  F.col("id").cast("string").alias("message_id"))
    df = df.unionByName(spark.range(2000).select(F.lit("hot").alias("session_id"), F.col("id").cast("string").alias("message_id")))
    sorted_export.write_sorted(df, path, ["session_id", "message_id"], 8)
    manifest = sorted_export.read_manifest(spark, path).collect()
    assert len(manifest) > 5 and sum(r.n_rows for r in manifest) == 7000
    assert all(a.last_key <= b.first_key or a.last_key.session_id is None for a, b in zip(manifest, manifest[1:]))
    for s in ("s5", "s699", "hot", "none"):
        got = sorted_export.lookup(spark, path, s)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.where(F.col("session_id") == s).collect()))
        if s.startswith("s"):
            assert len(got.inputFiles()) <= 2
    order = sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    rows = sorted_export.rows_between(spark, path, 1234, 1300).collect()
    assert [(r.session_id, r.message_id) for r in rows] == order[1233:1300] and [r.position for r in rows] == list(range(1234, 1301))
    assert sorted_export.rows_between(spark, path, 9000, 9100).collect() == []
    assert sorted((r.position, r.message_id) for r in sorted_export.with_positions(spark, path).collect()) == [(i + 1, r[1]) for i, r in enumerate(order)]
    sorted_export.write_sorted(df.limit(0), path + "0", ["session_id"], 2)
    assert sorted_export.lookup(spark, path + "0", "s1").collect() == []
