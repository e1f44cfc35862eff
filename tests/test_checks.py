import datetime as dt

import pytest
from pyspark.sql import functions as F

from sendscope.operators import checks


def _camp(spark, rows):
    return spark.createDataFrame(rows, "session_id string, template string, version string, publish_time string") \
        .withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz"))


def test_template_date_suffixes(spark):
    camp = _camp(spark, [
        ("s1", "x_1903", "sendtype-835", "2024-03-19 09:00:00"),  # matches dispatch
        ("s2", "x_1003", "sendtype-835", "2024-03-19 09:00:00"),  # 10 March ≠ 19 March
        ("s3", "x_at", "sendtype-835", "2024-03-19 09:00:00"),    # no suffix
        ("s4", "x_3145", "sendtype-835", "2024-03-19 09:00:00"),  # impossible date
        ("s5", "x_2902", "sendtype-835", "2024-02-29 09:00:00"),  # leap day, 2024
        ("s6", "x_2902", "sendtype-835", "2023-03-01 09:00:00"),  # 29 Feb 2023 does not exist
        ("s7", None, None, "2024-03-19 09:00:00"),
        ("s8", "x_1003\n", "sendtype-835", "2024-03-19 09:00:00"),  # no suffix at the very end
    ])
    out = {r.session_id: (r.issue, r.suffix_date) for r in checks.check_template_date(camp).collect()}
    assert out == {"s2": ("date_mismatch", dt.date(2024, 3, 10)), "s4": ("invalid_suffix", None),
                   "s6": ("invalid_suffix", None)}
    as_of = {r.session_id for r in checks.check_template_date(camp, as_of="2024-03-19").collect()}
    assert as_of == {"s2", "s4", "s5", "s6"}  # D1: the SQL's fixed-date form


def test_version_check_default_and_strict(spark):
    vs = ["1", "v2", None, "SENDTYPE-1", "sendtype-835", "sendtype-abc"]
    camp = _camp(spark, [(f"s{i}", "t", v, f"2024-03-19 0{i}:00:00") for i, v in enumerate(vs)])
    loose = {r.version for r in checks.check_version(camp).collect()}
    assert loose == {"1", "v2", None, "SENDTYPE-1"}  # M11: LIKE is case-sensitive, NULL kept
    strict = {r.version for r in checks.check_version(camp, strict=True).collect()}
    assert strict == loose | {"sendtype-abc"}  # D2
    first = checks.latest_first(checks.check_version(camp)).collect()[0]
    assert first.version == "SENDTYPE-1"  # latest first dispatch first


def _conv(spark, rows):
    return spark.createDataFrame(rows, "session_id string, text string, publish_time string") \
        .withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz"))


def test_orphan_sessions_counts_messages_and_sessions(spark):
    conv = _conv(spark, [
        ("o1", "Comprar Fone X9", "2024-03-20 10:00:00"),
        ("o1", "Comprar Fone X9", "2024-03-20 10:05:00"),  # same CTA twice in one orphan session
        ("o2", "Comprar Fone X9", "2024-03-20 11:00:00"),
        ("k1", "Comprar Fone X9", "2024-03-20 12:00:00"),  # has a campaign
        ("o3", "Comprar Fone X9", "2024-03-21 00:00:00"),  # outside the day
        ("o4", "Falar com atendente agora", "2024-03-20 12:00:00"),
    ])
    camp = spark.createDataFrame([("k1",), ("k1",)], "session_id string")
    out = {r.cta: (r.orphan_messages, r.orphan_sessions)
           for r in checks.check_orphan_sessions(conv, camp, ["Comprar Fone X9"], "2024-03-21", 0).collect()}
    assert out == {"Comprar Fone X9": (3, 2)}  # M15
    rx = checks.check_orphan_sessions(conv, camp, [("(?i)falar\\s+com\\s+atendente", "regex")], "2024-03-21", 0)
    assert [(r.cta, r.orphan_messages) for r in rx.collect()] == [("(?i)falar\\s+com\\s+atendente", 1)]
    assert checks.check_orphan_sessions(conv, camp, ["Comprar Fone X9"], "2024-03-21", 3).count() == 0


def test_orphan_plan_is_anti_join(spark):
    conv = _conv(spark, [("o1", "x", "2024-03-20 10:00:00")])
    camp = spark.createDataFrame([("k1",)], "session_id string")
    plan = checks.check_orphan_sessions(conv, camp, ["x"], "2024-03-21", 0)._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_error_rate_and_alerts(spark):
    logs = spark.createDataFrame(
        [("2024-03-20 10:01:00", "gce_instance", "x cannot be deserialized: Comprar"),
         ("2024-03-20 10:20:00", "gce_instance", "x cannot be deserialized: Comprar"),
         ("2024-03-20 10:40:00", "gce_instance", "x cannot be deserialized: Lu"),
         ("2024-03-20 11:10:00", "gce_instance", "x cannot be deserialized: Lu"),
         ("2024-03-20 10:50:00", "k8s", "x cannot be deserialized: Lu")],
        "timestamp string, resource_type string, message string") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    er = checks.error_rate_hourly(logs, 2).collect()
    assert [(str(r.window_start), r.n_errors) for r in er] == [("2024-03-20 10:00:00", 3)]
    al = checks.alerts(error_rate=checks.error_rate_hourly(logs, 2)).collect()
    assert al[0].severity == "critical" and al[0].n_rows == 3


@pytest.mark.parametrize("match", ["exact", "regex"])
def test_cta_blocks_do_not_change_the_result(spark, match):
    conv = _conv(spark, [("o1", "c1", "2024-03-20 10:00:00"), ("o2", "c1", "2024-03-20 11:00:00"),
                         ("o3", "c4", "2024-03-20 10:00:00"), ("k1", "c2", "2024-03-20 10:00:00"),
                         ("o4", "", "2024-03-20 10:00:00"), ("o5", None, "2024-03-20 10:00:00")])
    camp = spark.createDataFrame([("k1",)], "session_id string")
    rows = [(f"c{i}", match) for i in range(5)] + [("c1", match), (None, match)]
    ctas = spark.createDataFrame(rows, "cta string, match string")
    one = checks.check_orphan_sessions(conv, camp, ctas, "2024-03-21", 0)
    many = checks.check_orphan_sessions(conv, camp, ctas, "2024-03-21", 0, block=2)
    assert sorted(one.collect()) == sorted(many.collect())
    assert {r.cta: r.orphan_messages for r in many.collect()} == {"c1": 2, "c4": 1}
    assert checks.check_orphan_sessions(conv, camp, ctas.limit(0), "2024-03-21", 0).collect() == []
    with pytest.raises(ValueError):
        checks.check_orphan_sessions(conv, camp, [("c1", "prefix")], "2024-03-21", 0)


def test_daily_checks_job_is_idempotent(spark, tmp_path):
    from sendscope.plans.monitoring import run_daily_checks
    from sendscope.sources.adapter import load_tables
    t = load_tables(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "alerts")
    first = run_daily_checks(t["campaigns"], t["conversations"], t["logs"], ["Buy now", "Talk to an agent"],
                             "2024-01-21", path, orphan_threshold=5, error_threshold=2)
    n = first.count()
    again = run_daily_checks(t["campaigns"], t["conversations"], t["logs"], ["Buy now", "Talk to an agent"],
                             "2024-01-21", path, orphan_threshold=5, error_threshold=2)
    assert again.count() == n > 0
    kinds = {r.check_name for r in again.collect()}
    assert {"orphan_sessions", "error_rate", "version"} <= kinds


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9999), st.dates(dt.date(2023, 1, 1), dt.date(2025, 12, 31))),
                min_size=1, max_size=30))
def test_template_date_property(spark, cases):
    rows = [(f"s{i}", f"crm_x_{n:04d}", f"{d.isoformat()} 12:00:00") for i, (n, d) in enumerate(cases)]
    camp = _camp(spark, [(s, t, "sendtype-800", ts) for s, t, ts in rows])
    got = {r.session_id: (r.issue, r.suffix_date) for r in checks.check_template_date(camp).collect()}
    want = {}
    for i, (n, d) in enumerate(cases):
        try:
            parsed = dt.datetime.strptime(f"{d.year}{n:04d}", "%Y%d%m").date()
        except ValueError:
            parsed = None
        if parsed is None:
            want[f"s{i}"] = ("invalid_suffix", None)
        elif parsed != d:
            want[f"s{i}"] = ("date_mismatch", parsed)
    assert got == want
