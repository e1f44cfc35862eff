"""Sinks (S5): processed tables as date-partitioned Parquet; CSV only at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def write_processed(df: DataFrame, path: str, time_col: str | None = "publish_time",
                    sort_cols: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a processed table partitioned by ``publish_date``.

    Rows are range-partitioned on (date, sort keys) so each output file holds
    a contiguous, sorted slice (O2): readers prune by date and row-group stats.
    A skewed date is cut across several files by the secondary sort keys.
    """
    out = df
    part_cols = []
    if time_col:
        out = out.withColumn("publish_date", F.to_date(F.col(time_col)))
        part_cols = ["publish_date"]
    keys = part_cols + list(sort_cols or [])
    if keys:  # partition count left to AQE, which sizes it from the data
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    if part_cols:
        writer = writer.partitionBy(*part_cols)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export for spreadsheet users: quotes escaped by doubling, header kept,
    timestamps with microseconds so a re-read is lossless."""
    (df.write.mode(mode)
       .option("header", True)
       .option("escape", '"')
       .option("quoteAll", False)
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
       .csv(path))


JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines export with full microsecond timestamps (readable by S1/S2)."""
    (df.write.mode(mode)
       .option("timestampNTZFormat", JSON_TIME_FORMAT)
       .option("ignoreNullFields", False)
       .json(path))


#: Bytes of an array file, beyond which the rows are dealt over more files.
ARRAY_BYTES = 1 << 30


def export_json_array(df: DataFrame, path: str, files: int = 1, mode: str = "overwrite") -> None:
    """Files of one JSON array each: ``files``, or doubled as often as it takes
    for a file to hold about ``ARRAY_BYTES`` or less.

    A task writes a file's rows as they come, sorting and holding none: the
    number of rows of each file is known beforehand, so the first row opens the
    array and the last one closes it in whatever order they come. ``df`` is read
    twice for it; one that gives other rows the second time is an error.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cells = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)),
                      {"timestampNTZFormat": JSON_TIME_FORMAT, "ignoreNullFields": "false"})
    most = files << 10
    rows = df.select(cells.alias("value")).withColumn("k", F.pmod(F.xxhash64("value"), F.lit(most)))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("size")).checkpoint(eager=True)
    n_rows, total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    while files < most and total > files * ARRAY_BYTES:
        files *= 2
    file = (F.col("k") % files).cast("int").alias("k")
    counts = sizes.groupBy(file).agg(F.sum("n").alias("n"))
    dealt = rows.select("value", file).repartitionById(files, "k")  # a task a file
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its task
    before = F.when(F.col("place") == 0, F.lit("[")).otherwise(F.lit(","))
    after = F.when(F.col("place") == F.col("n") - 1, F.lit("]")).otherwise(F.lit(""))
    written = Observation()
    (dealt.join(F.broadcast(counts), "k").withColumn("place", place)
          .observe(written, F.count(F.lit(1)).alias("n"), F.max(F.col("place") >= F.col("n")).alias("more"))
          .select(F.concat(before, "value", after).alias("value")).write.mode(mode).text(path))
    if written.get["n"] != n_rows or written.get["more"]:
        raise ValueError("the rows of the export changed while it was written")


def write_alerts(alerts: DataFrame, path: str, run_date, run_id: str = "checks") -> None:
    """Write one run of the checks into the alerts table.

    The table is partitioned by (``run_date``, ``run_id``). A run overwrites the
    folder of its own partition and leaves other days and other writers
    (streams) untouched, so scheduled runs are idempotent; a run that finds
    nothing clears what an earlier one left. Read it with :func:`read_alerts`.
    """
    alerts.select(*ALERTS.fieldNames()).write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/run_date={run_date}/run_id={run_id}")


#: Columns of the alerts table; the partition columns come after them.
ALERTS = (StructType().add("check_name", "string").add("entity", "string").add("severity", "string")
          .add("n_rows", "long").add("first_seen", "timestamp_ntz"))


_VERSION = r"^(.*)~([0-9]{12})$"


def version_run_id(name: str, version: int) -> str:
    """The run_id of rows that replace earlier versions of the same alerts."""
    return f"{name}~{version:012d}"


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts table with run_date and run_id, empty if no run found any.

    Of a stream that reports its alerts anew as they grow, the latest version of
    each alert counts.
    """
    schema = StructType(list(ALERTS.fields)).add("run_date", "date").add("run_id", "string")
    rows = spark.read.schema(schema).parquet(path)
    stream = F.regexp_extract("run_id", _VERSION, 1)
    key = ["run_date", "check_name", "entity", "first_seen"]
    latest = (rows.where(stream != "").groupBy(*key, stream.alias("_stream"))
              .agg(F.max_by(F.struct("severity", "n_rows", "run_id"), "run_id").alias("_last")).select(*key, "_last.*"))
    return rows.where(stream == "").unionByName(latest.select(*rows.columns))


def compact_alerts(spark: SparkSession, path: str, name: str, run_date, version: int) -> None:
    """Write the latest versions that the stream ``name`` has of a day's alerts
    as one folder, of ``version`` (not below any that is there). Earlier folders
    then say nothing new and may be removed."""
    ensure_checkpoint_dir(spark)
    run_id = version_run_id(name, version)
    rows = read_alerts(spark, path).where((F.col("run_date") == F.lit(run_date)) & F.col("run_id").startswith(f"{name}~"))
    target = f"{path.rstrip('/')}/run_date={run_date}/run_id={run_id}"
    # read in full before the folder, which may hold some of the rows, is replaced
    kept = rows.select(*ALERTS.fieldNames()).checkpoint(eager=True)
    kept.coalesce(1).write.mode("overwrite").parquet(target)
