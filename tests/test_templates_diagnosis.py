import datetime as dt

from pyspark.sql import functions as F

from sendscope import schemas
from sendscope.functions.params import param_frame
from sendscope.operators import diagnosis, templates


def _camp(spark):
    rows = [("s1", "crm_promo_1003", "2024-03-19 10:00:00"),
            ("s2", "crm_promo_1303", "2024-03-19 11:00:00"),
            ("s3", "crm_promo_at", "2024-03-19 12:00:00"),
            ("s4", "crm_other", "2024-03-20 12:00:00")]
    return spark.createDataFrame(rows, "session_id string, template string, publish_time string") \
        .withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz")) \
        .withColumn("message_id", F.col("session_id"))


def _expected(spark):
    return param_frame(spark, [
        ("promo", "crm_promo_1903", "Falar com atendente", dt.date(2024, 3, 19), 835),
        ("launch", "crm_phone_launch26", "Comprar Fone X9", dt.date(2024, 3, 20), 838),
    ], schemas.EXPECTED_CAMPAIGNS)


def test_missing_and_similar_templates(spark):
    camp, exp = _camp(spark), _expected(spark)
    assert {r.campaign for r in templates.missing_templates(exp, camp).collect()} == {"promo", "launch"}
    sim = [(r.similar_template, r.distance, r.rank) for r in
           templates.similar_templates(exp, camp, 4, 3).where("campaign = 'promo'").orderBy("rank").collect()]
    assert sim == [("crm_promo_1003", 1, 1), ("crm_promo_1303", 1, 2),
                   ("crm_promo_at", 4, 3)]


def test_similar_templates_plan_has_no_cartesian_product(spark):
    plan = templates.similar_templates(_expected(spark), _camp(spark))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_template_join_counts_equals_materialised_join(spark):
    camp = _camp(spark)
    conv = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "session_id string") \
        .withColumn("text", F.lit("t")).withColumn("publish_time", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("message_id", F.lit("c"))
    tpls = ["crm_promo_1003", "crm_promo_1303", "crm_promo_at"]
    got = {r.template: r.n_rows for r in templates.template_join_counts(camp, conv, tpls).collect()}
    detail = templates.similar_template_detail(camp, conv, tpls)
    assert got == {"crm_promo_1003": 2, "crm_promo_1303": 1}
    assert detail.count() == sum(got.values())


def test_campaign_diagnosis_case_study(spark):
    camp = _camp(spark)
    conv = spark.createDataFrame([("x", "hi", "2024-03-20 10:00:00")], "session_id string, text string, publish_time string") \
        .withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz"))
    logs = spark.createDataFrame(
        [("2024-03-20 10:00:00", "It is not a JSON type and cannot be deserialized: Comprar Fone X9 e"),
         ("2024-03-19 10:00:00", "It is not a JSON type and cannot be deserialized: Falar com atendente")],
        "timestamp string, message string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    d = {r.campaign: r for r in diagnosis.campaign_diagnosis(_expected(spark), camp, conv, logs).collect()}
    assert d["promo"].hypotheses == ["wrong_name", "payload_error", "api_failure_possible", "incomplete_data"]
    assert d["launch"].hypotheses == ["not_registered", "payload_error"]
    assert d["promo"].best_similar == "crm_promo_1003"


def test_candidates_equal_brute_force_on_the_base(spark):
    from sendscope.sources.adapter import load_tables
    camp = load_tables(spark, "/root/testdata/sf0.01")["campaigns"]
    names = [("a", "crm_click_3101"), ("b", "crm_galaxy26"), ("c", "crm_click_2001"), ("d", "crm"),
             ("e", "crm_error_at"), ("f", "xy"), ("a", "crm_view_0101"), ("g", None)]
    exp = spark.createDataFrame([(c, t, "x", dt.date(2024, 1, 1), 1) for c, t in names],
                                schemas.EXPECTED_CAMPAIGNS)
    base = [r.template for r in camp.select("template").distinct().collect()]
    for k in (1, 2, 4):
        got = sorted(tuple(r) for r in templates.template_candidates(exp, camp, k).collect())
        assert got == sorted((c, n, t, _lev(n, t)) for c, n in names if n for t in base if 1 <= _lev(n, t) <= k), k
    plan = templates.template_candidates(exp, camp, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # a campaign reported with two templates keeps their neighbours apart
    top = templates.similar_templates(exp, camp, 4, 1).where("campaign = 'a'").collect()
    assert {r.expected_template for r in top} == {"crm_click_3101", "crm_view_0101"}


def test_a_common_beginning_is_left_out_of_the_segments(spark):
    base = spark.createDataFrame([(f"crm_promo_of_the_year_{i:05d}",) for i in range(300)], "template string")
    exp = spark.createDataFrame([(f"crm_promo_of_the_year_{i:05d}",) for i in range(0, 90000, 4500)], "expected_template string")
    cuts = templates._cut_points(exp, base, 1).collect()
    held = [r.template for r in base.collect()]
    assert len(cuts) == 40
    for r in cuts:  # few of the 300 templates hold a segment, but of the first name, whose digits are common too
        segment = r.expected_template[r["_p"]: r["_p"] + r["_w"]]
        assert r.expected_template.endswith("00000") or sum(segment in t for t in held) <= 100


def test_unbounded_expected_diagnosis_matches(spark):
    camp = _camp(spark)
    conv = spark.createDataFrame([("x", "hi", "2024-03-20 10:00:00")], "session_id string, text string, publish_time string") \
        .withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz"))
    logs = spark.createDataFrame(
        [("2024-03-20 10:00:00", "It is not a JSON type and cannot be deserialized: Comprar Fone X9 e")],
        "timestamp string, message string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    a = diagnosis.campaign_diagnosis(_expected(spark), camp, conv, logs).drop("hypotheses")
    b = diagnosis.campaign_diagnosis(_expected(spark), camp, conv, logs, max_rows=0).drop("hypotheses")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_template_list_as_table(spark):
    camp = _camp(spark)
    conv = spark.createDataFrame([("s1",), ("s2",)], "session_id string") \
        .withColumn("text", F.lit("t")).withColumn("publish_time", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("message_id", F.lit("c"))
    tbl = spark.createDataFrame([("crm_promo_1003",), ("crm_promo_1303",)], "template string")
    a = {r.template: r.n_rows for r in templates.template_join_counts(camp, conv, tbl).collect()}
    b = {r.template: r.n_rows for r in templates.template_join_counts(camp, conv, ["crm_promo_1003", "crm_promo_1303"]).collect()}
    assert a == b == {"crm_promo_1003": 1, "crm_promo_1303": 1}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab_1", min_size=1, max_size=9), min_size=1, max_size=15, unique=True),
       st.lists(st.text(alphabet="ab_1", min_size=1, max_size=9), min_size=1, max_size=4, unique=True),
       st.integers(min_value=1, max_value=3), st.sampled_from(["", "crm_promo_"]))
def test_segment_blocking_property(spark, base_names, expected_names, k, prefix):
    base_names, expected_names = [prefix + n for n in base_names], [prefix + n for n in expected_names]
    camp = spark.createDataFrame([(t,) for t in base_names], "template string")
    exp = spark.createDataFrame([(f"c{i}", t, "x", dt.date(2024, 1, 1), 1) for i, t in enumerate(expected_names)],
                                schemas.EXPECTED_CAMPAIGNS)
    got = sorted((r.campaign, r.similar_template, r.distance)
                 for r in templates.template_candidates(exp, camp, k).collect())
    want = sorted((f"c{i}", t, _lev(e, t)) for i, e in enumerate(expected_names) for t in base_names
                  if 1 <= _lev(e, t) <= k)
    assert got == want
