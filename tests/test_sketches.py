import datetime as dt

from pyspark.sql import functions as F

from sendscope.operators import sketches


def test_periods_from_stored_days(spark, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.range(30000).select((F.col("id") % 7001).cast("string").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("b"),
                                   F.lit(None).cast("string").alias("none"),
                                   F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(id % 10 as int))").alias("t"))
    df = df.unionByName(df.limit(3).withColumn("t", F.lit(None).cast("timestamp_ntz")))
    sketches.write_sketches(df, "t", path)
    sketches.write_sketches(df.where("t < '2024-03-03'"), "t", path)  # days written again replace themselves
    stored = sketches.read_sketches(spark, path)
    for first, last in ((None, None), (dt.date(2024, 3, 2), dt.date(2024, 3, 4)), (dt.date(2024, 3, 9), None)):
        rows = df
        if first:
            rows = rows.where(F.to_date("t") >= F.lit(first))
        if last:
            rows = rows.where(F.to_date("t") <= F.lit(last))
        got = {r.column_name: r for r in sketches.distinct_counts(stored, first, last).collect()}
        for c in ("a", "b", "none", "t"):
            exact, values, n = rows.agg(F.countDistinct(c), F.count(c), F.count("*")).first()
            assert (got[c].n_rows, got[c].non_null) == (n, values)
            assert abs(got[c].n_distinct - exact) <= sketches.ERROR_BOUND * exact
    assert sketches.distinct_counts(stored, dt.date(2025, 1, 1)).collect() == []
    sketches.write_sketches(df.limit(0), "t", str(tmp_path / "none"))
