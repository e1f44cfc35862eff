import math

from pyspark.sql import functions as F

from sendscope.operators import profile


def _df(spark):
    return spark.createDataFrame(
        [(1, None, "a", None, float("nan"), {"k": 1}),
         (2, "x", "a", None, float("nan"), {"k": 1}),
         (3, None, "a", None, float("nan"), {"k": 1})],
        "id int, one_plus_null string, const string, all_null string, nan double, m map<string,int>")


def test_constant_columns_null_counts_as_value(spark):
    rep = {r.column_name: r.reason for r in profile.constant_columns(_df(spark), "t").collect()}
    # M1: null + one value is kept; all-null dropped; NaN behaves like null; map compared as JSON
    assert "one_plus_null" not in rep and "id" not in rep
    assert rep == {"const": "single_value", "all_null": "all_null", "nan": "all_null", "m": "single_value"}


def test_constant_columns_zero_rows_drops_all(spark):
    empty = _df(spark).where(F.lit(False))
    assert profile.constant_columns(empty, "t").count() == len(empty.columns)


def test_drop_constant_columns(spark):
    kept, removed = profile.drop_constant_columns(_df(spark))
    assert kept.columns == ["id", "one_plus_null"]
    assert removed == ["const", "all_null", "nan", "m"]


def test_profile_columns_verdicts(spark):
    p = {r.column_name: r for r in profile.profile_columns(_df(spark), "t").collect()}
    assert p["id"].verdict == "varying" and p["id"].n_distinct == 3
    assert p["one_plus_null"].verdict == "varying" and p["one_plus_null"].n_distinct == 1  # M2
    assert p["const"].verdict == "constant"
    assert p["all_null"].verdict == "all_null" and p["all_null"].non_null == 0


def test_profile_table_and_distincts(spark):
    df = _df(spark)
    r = profile.profile_table(df, "t").collect()[0]
    assert (r.n_rows, r.n_columns) == (3, 6)
    vals = {r.one_plus_null for r in profile.distinct_values(df, "one_plus_null").collect()}
    assert vals == {None, "x"}  # unique() keeps null


def test_constant_columns_matches_nunique_definition(spark):
    # Property: min/max/count rule == pandas nunique(dropna=False) <= 1 on the driver fixture.
    from sendscope.sources.adapter import load_tables
    for name, df in load_tables(spark, "/root/testdata/sf0.001").items():
        pdf = df.toPandas()
        expect = {c for c in pdf.columns if pdf[c].nunique(dropna=False) <= 1}
        got = {r.column_name for r in profile.constant_columns(df, name).collect()}
        assert got == expect, name
        assert not math.isnan(len(got))


def test_approx_profile_keeps_exact_verdicts(spark):
    exact = {r.column_name: r.verdict for r in profile.profile_columns(_df(spark), "t").collect()}
    approx = {r.column_name: r.verdict for r in profile.profile_columns(_df(spark), "t", exact=False).collect()}
    assert exact == approx


def test_scale_conf_bounds():
    from sendscope.session import scale_conf
    small, huge = scale_conf(1 << 30), scale_conf(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(huge["spark.sql.shuffle.partitions"]) * (256 << 20) == 100 << 40  # no cap: partitions keep their size
