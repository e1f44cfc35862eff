"""Profiling operators.

Statistics come from aggregate passes that read only their columns; results are small DataFrames
(one row per table or per column), never driver-side prints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDERABLE = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType,
              T.BooleanType, T.BinaryType)


def _comparable(df: DataFrame, name: str) -> Column:
    """Column in a form that min/max accept; NaN counts as null (pandas rule)."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(dtype))
    if isinstance(dtype, _ORDERABLE):
        return c
    return F.to_json(c) if isinstance(dtype, (T.MapType, T.StructType, T.ArrayType)) else c.cast("string")


def _multi(df: DataFrame, name: str) -> Column:
    """Aggregate: the column has two values or more. Strings and the like are
    told apart by two 64-bit hashes, whose least and greatest values fit a hash
    aggregate's buffer; min/max of strings would take a sort-based one."""
    c = _comparable(df, name)
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        keys = [F.when(c.isNotNull(), h) for h in (F.xxhash64(c), F.xxhash64(F.lit(1), c))]
    else:
        keys = [c]
    some = F.lit(False)
    for k in keys:
        some = some | F.coalesce(F.min(k) != F.max(k), F.lit(False))
    return some


def profile_table(df: DataFrame, table_name: str) -> DataFrame:
    """One row ``(table_name, n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(table_name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def _column_counts(df: DataFrame, ordinal: int, name: str) -> DataFrame:
    """Exact statistics of one column: a pass that reads this column only. The
    values are counted per task before the exchange, so a value that a third of
    all rows have is one row a task."""
    values = df.select(_comparable(df, name).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("n_distinct")).select(
            "n_rows", F.lit(ordinal).alias("ordinal"), F.lit(name).alias("column_name"),
            F.lit(df.schema[name].dataType.simpleString()).alias("data_type"), "non_null", "n_distinct")


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: ordinal, name, type, n_rows, non_null, n_distinct, varies.

    ``n_distinct`` ignores nulls like ``nunique()``. A column varies iff it has
    two distinct values, or one value and some nulls (null counts as a value).
    Exact mode takes one pass a column, each reading that column alone, so no
    row is copied once per column. ``exact=False``, the caller's choice, uses
    HyperLogLog sketches in one pass over all columns; "varies" stays exact.
    """
    names = df.columns
    if exact:
        out = reduce(DataFrame.unionByName, [_column_counts(df, i, name) for i, name in enumerate(names)])
        out = out.withColumn("multi", F.col("n_distinct") > 1)
    else:
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, name in enumerate(names):
            c = _comparable(df, name)
            aggs.append(F.struct(F.count(c).alias("non_null"), F.approx_count_distinct(c).alias("n_distinct"),
                                 _multi(df, name).alias("multi")).alias(f"_c{i}"))
        per_col = F.array(*[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("column_name"),
                F.lit(df.schema[name].dataType.simpleString()).alias("data_type"),
                F.col(f"_c{i}.non_null").alias("non_null"),
                F.col(f"_c{i}.n_distinct").cast("long").alias("n_distinct"),
                F.col(f"_c{i}.multi").alias("multi"),
            ) for i, name in enumerate(names)
        ])
        out = df.agg(*aggs).select(F.col("_n").alias("n_rows"), F.explode(per_col).alias("s")).select("n_rows", "s.*")
    partly_null = (out.non_null > 0) & (out.non_null < out.n_rows)
    return out.withColumn("varies", out.multi | partly_null).drop("multi")


def profile_columns(df: DataFrame, table_name: str, exact: bool = True) -> DataFrame:
    """Per-column profile with a verdict.

    verdict = ``all_null`` (no value), ``constant`` (one value, no null) or
    ``varying``. A column with one value plus nulls is varying (M1).
    """
    s = column_stats(df, exact)
    verdict = (F.when(s.non_null == 0, F.lit("all_null"))
               .when(~s.varies, F.lit("constant"))
               .otherwise(F.lit("varying")))
    return s.select(F.lit(table_name).alias("table_name"), "ordinal", "column_name", "data_type",
                    "n_rows", "non_null", F.col("n_distinct"), verdict.alias("verdict"))


def _constant_stats(df: DataFrame) -> DataFrame:
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, name in enumerate(names):
        aggs.append(F.struct(F.count(_comparable(df, name)).alias("nn"), _multi(df, name).alias("ne")).alias(f"_c{i}"))
    stats = df.agg(*aggs)
    per_col = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"),
                                 F.col(f"_c{i}.nn").alias("nn"), F.col(f"_c{i}.ne").alias("ne"))
                        for i, n in enumerate(names)])
    out = stats.select(F.col("_n").alias("n"), F.explode(per_col).alias("s")).select("n", "s.*")
    return out.withColumn("keep", out.ne | ((out.nn > 0) & (out.nn < out.n)))


def constant_columns(df: DataFrame, table_name: str) -> DataFrame:
    """P8 report: columns with at most one distinct value, null counted as a value.

    One hash-aggregate pass (a count and least and greatest values or hashes
    per column) — no distinct counts.
    ``reason`` is ``all_null`` or ``single_value``. A zero-row table reports
    every column (``all_null``).
    """
    s = _constant_stats(df)
    return s.where(~s.keep).select(
        F.lit(table_name).alias("table_name"), "ordinal", "column_name",
        F.when(s.nn == 0, F.lit("all_null")).otherwise(F.lit("single_value")).alias("reason"))


def drop_constant_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Return ``(df without constant columns, removed column names)``.

    The kept schema depends on the data, so this runs one aggregate job; its
    result has one row per column and is the only thing brought to the driver.
    """
    s = _constant_stats(df).select("column_name", "keep").collect()
    keep = {r.column_name for r in s if r.keep}
    kept = [c for c in df.columns if c in keep]
    removed = [c for c in df.columns if c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in kept]), removed


def distinct_dates(df: DataFrame, table_name: str, time_col: str = "publish_time") -> DataFrame:
    """P5: distinct calendar dates of the time column."""
    return df.select(F.lit(table_name).alias("table_name"),
                     F.to_date(F.col(time_col)).alias("publish_date")).distinct()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column; null is kept as a value (``unique()``)."""
    return df.select(col).distinct()


def distinct_strings_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values rendered as strings (null last)."""
    return (df.select(F.col(col).cast("string").alias(col)).distinct()
              .orderBy(F.col(col).asc_nulls_last()))
