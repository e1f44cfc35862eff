"""A globally sorted export with a manifest (O2).

The rows lie sorted over the export's files, file after file. The manifest has
a row for each file: its first and last key, its rows, and how many rows lie
in the files before it. A lookup by key opens only the files whose range holds
the key, and a range of positions only those that hold these positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prepare import sorted_for_export


def _manifest_path(path: str) -> str:
    return path.rstrip("/") + ".manifest"


def write_sorted(df: DataFrame, path: str, keys: list[str], num_partitions: int | None = None) -> None:
    """Write ``df`` sorted by ``keys`` (nulls first) and then its manifest, from
    the written files' keys alone. Without the manifest an export is not complete."""
    sorted_for_export(df, keys, num_partitions).write.mode("overwrite").parquet(path)
    key = F.struct(*keys)
    files = (df.sparkSession.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), key.alias("k"))
             .groupBy("file").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count(F.lit(1)).alias("n_rows")))
    # one row a file; equal keys may end one file and begin the next
    before = Window.orderBy("first_key", "last_key", "file").rowsBetween(Window.unboundedPreceding, -1)
    (files.withColumn("rows_before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
     .write.mode("overwrite").parquet(_manifest_path(path)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_manifest_path(path)).orderBy("rows_before", "n_rows")


def _opened(spark: SparkSession, path: str, wanted: Column) -> tuple[DataFrame | None, list]:
    """The files that ``wanted`` chooses, read; and their manifest rows (as many as files)."""
    chosen = read_manifest(spark, path).where(wanted).collect()
    return (spark.read.parquet(*[r.file for r in chosen]) if chosen else None), chosen


def lookup(spark: SparkSession, path: str, value) -> DataFrame:
    """The rows whose first key column equals ``value``; only files whose range
    holds it are opened."""
    name = read_manifest(spark, path).schema["first_key"].dataType.fieldNames()[0]
    v = F.lit(value)
    # nulls come before every value, so a range that begins with null holds all up to its last key
    below = F.coalesce(F.col("first_key")[name] <= v, F.lit(True))
    rows, _ = _opened(spark, path, below & (F.col("last_key")[name] >= v))
    if rows is None:
        return spark.read.parquet(path).where(F.lit(False))
    return rows.where(F.col(name) == v)


def with_positions(spark: SparkSession, path: str) -> DataFrame:
    """The export with ``position``, each row's place in the whole order from 1,
    from the manifest and the row's place in its file: nothing is sorted again."""
    rows = spark.read.parquet(path)
    cols = rows.columns
    placed = rows.select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    manifest = read_manifest(spark, path).select(F.col("file").alias("_file"), "rows_before")
    return placed.join(manifest, "_file").select(*cols, (F.col("rows_before") + F.col("_row") + 1).alias("position"))


def rows_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows at positions ``first`` to ``last`` (from 1, both included), in
    order of position; only the files that hold them are opened."""
    rows, chosen = _opened(spark, path, (F.col("rows_before") < last) & (F.col("rows_before") + F.col("n_rows") >= first))
    cols = spark.read.parquet(path).columns
    if rows is None:
        return spark.read.parquet(path).select(*cols, F.lit(0).cast("long").alias("position")).where(F.lit(False))
    offsets = F.create_map(*[F.lit(x) for r in chosen for x in (r.file, r.rows_before)])
    position = offsets[F.col("_metadata.file_path")] + F.col("_metadata.row_index") + 1
    return rows.select(*cols, position.alias("position")).where(F.col("position").between(first, last)).orderBy("position")
