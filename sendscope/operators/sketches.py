"""Distinct counts of any period from stored daily sketches (P4 at scale).

An exact distinct count reads every row of the period again. Here each day's
rows are read once: for every column a HyperLogLog sketch, with the day's row
and value counts, goes to a table of one row a day and column. Sketches merge,
so any period is a union of its days' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .profile import _comparable

#: log2 of a sketch's buckets. The estimate's relative standard error is about
#: 1.04 / sqrt(2**LG_BUCKETS), 0.0081.
LG_BUCKETS = 14
#: Five standard errors: an estimate outside of it has odds below one in a million.
ERROR_BOUND = 5 * 1.04 / 2 ** (LG_BUCKETS / 2)

SKETCHES = (StructType().add("ordinal", "integer").add("column_name", "string").add("n_rows", "long")
            .add("non_null", "long").add("sketch", "binary").add("day", "date"))


def daily_sketches(df: DataFrame, time_col: str) -> DataFrame:
    """``day``, ``ordinal``, ``column_name``, ``n_rows``, ``non_null`` and
    ``sketch`` of every day and column of ``df``; rows without a time are a day
    of their own (null). One pass; a task sends one sketch a day and column."""
    names = [c for c in df.columns if c != "publish_date"]
    day = F.to_date(F.col(time_col)).alias("day")
    per_col = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                        F.count(_comparable(df, c)).alias("non_null"),
                        F.hll_sketch_agg(_comparable(df, c).cast("string"), F.lit(LG_BUCKETS)).alias("sketch")) for i, c in enumerate(names)]
    return (df.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), F.array(*per_col).alias("_c"))
            .select("day", "n_rows", F.inline("_c")).select(*SKETCHES.fieldNames()))


def write_sketches(df: DataFrame, time_col: str, path: str) -> None:
    """Store the sketches of the days that ``df`` holds; a day written again
    replaces its earlier rows, other days stay."""
    (daily_sketches(df, time_col).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(path)


def distinct_counts(sketches: DataFrame, first_day=None, last_day=None) -> DataFrame:
    """``ordinal``, ``column_name``, ``n_rows``, ``non_null`` and the estimated
    ``n_distinct`` of each column over a period (both days included; None: no
    bound, days without a time only then). Reads a row a day and column."""
    rows = sketches
    if first_day is not None:
        rows = rows.where(F.col("day") >= F.lit(first_day))
    if last_day is not None:
        rows = rows.where(F.col("day") <= F.lit(last_day))
    return (rows.groupBy("ordinal", "column_name")
            .agg(F.sum("n_rows").alias("n_rows"), F.sum("non_null").alias("non_null"),
                 F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct")))
