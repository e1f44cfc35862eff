import datetime as dt
import random

from pyspark.sql import functions as F

from sendscope.operators import checks, daily

CTAS = [("Buy now", "exact"), ("(?i)agent$", "regex")]


def test_daily_runs_equal_the_full_recomputation(spark, tmp_path):
    r = random.Random(5)
    t0 = dt.datetime(2024, 3, 1)
    camp = spark.createDataFrame([(r.choice([f"s{r.randint(0, 40)}", None]), r.choice(["a", "b", None]), r.choice(["1", None, "sendtype-1"]),
                                   t0 + dt.timedelta(hours=r.randint(0, 119))) for _ in range(200)],
                                 "session_id string, template string, version string, publish_time timestamp_ntz")
    conv = spark.createDataFrame([(r.choice([f"s{r.randint(0, 90)}", None]), r.choice(["Buy now", "an AGENT", "x", None]),
                                   t0 + dt.timedelta(hours=r.randint(0, 119))) for _ in range(200)],
                                 "session_id string, text string, publish_time timestamp_ntz")
    path, days = str(tmp_path / "daily"), [dt.date(2024, 3, d) for d in range(1, 6)]
    daily.store_days(camp, conv, CTAS, path, days[0], days[1])

    def upto(df, day):
        return df.where(F.to_date("publish_time") <= F.lit(day))

    for day in days[1:]:  # the second day is run again
        daily.store_days(camp, conv, CTAS, path, day)
        got = sorted(map(tuple, daily.merged_versions(spark, path).collect()), key=repr)
        assert got == sorted(map(tuple, checks.check_version(upto(camp, day)).collect()), key=repr)
        as_of = day + dt.timedelta(days=1)
        got = sorted(map(tuple, daily.merged_orphans(spark, path, as_of, 0).collect()))
        assert got == sorted(map(tuple, checks.check_orphan_sessions(conv, upto(camp, day), CTAS, as_of, 0).collect())) and got
    # a day that is empty by now is cleared, also of campaigns
    daily.store_days(camp.limit(0), conv.limit(0), CTAS, path, days[4])
    rest = sorted(map(tuple, daily.merged_versions(spark, path).collect()), key=repr)
    assert rest == sorted(map(tuple, checks.check_version(upto(camp, days[3])).collect()), key=repr)
    assert daily.merged_orphans(spark, path, dt.date(2024, 3, 6), 0).collect() == []


def test_a_daily_run_reads_its_day_only(spark, tmp_path):
    path = str(tmp_path / "camp")
    (spark.range(100).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("t").alias("template"), F.lit("1").alias("version"),
                             F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(id % 10 as int))").alias("publish_time"))
     .withColumn("publish_date", F.to_date("publish_time")).write.partitionBy("publish_date").parquet(path))
    some = daily._of_days(spark.read.parquet(path), dt.date(2024, 3, 4), dt.date(2024, 3, 4))
    assert some.count() == 10 and all("publish_date=2024-03-04" in f for f in some.inputFiles()) or \
        "PartitionFilters: [isnotnull(publish_date" in some._jdf.queryExecution().executedPlan().toString()
