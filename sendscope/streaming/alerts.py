"""Log-based alerts as Structured Streaming queries.

T1 counts deserialisation errors per event-time hour and emits a window once
the watermark has passed it (append mode), keeping only windows above the
threshold. T2 is the stateless form: every error line is an alert at once.
T3 is either of them run with ``availableNow`` as a periodic sweep; the
checkpoint makes each sweep resume where the last one stopped, and the file
sink commits exactly once per batch, so a lost executor or a restarted job
neither drops nor duplicates alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import version_run_id
from ..functions.payload import ERROR_SIGNATURE


def event_time(col: str = "timestamp", tz: str = "UTC") -> Column:
    """Event time as TIMESTAMP (watermarks reject TIMESTAMP_NTZ): the wall-clock
    value is read as UTC, whatever the session zone ``tz``, so hourly windows
    line up with the wall-clock hours of the data."""
    return F.from_utc_timestamp(F.col(col).cast("timestamp"), tz)


def wall_clock(col: Column, tz: str = "UTC") -> Column:
    """Inverse of :func:`event_time`: back to a TIMESTAMP_NTZ wall clock."""
    return F.to_utc_timestamp(col, tz).cast("timestamp_ntz")


def _errors(logs: DataFrame, signature: str, resource_type: str | None) -> DataFrame:
    cond = F.col("message").contains(signature)
    if resource_type is not None:
        cond = cond & (F.col("resource_type") == resource_type)
    return logs.where(cond)


def error_rate_stream(logs: DataFrame, threshold: int, signature: str = ERROR_SIGNATURE,
                      resource_type: str | None = "gce_instance", watermark: str = "10 minutes",
                      window: str = "1 hour") -> DataFrame:
    """Hourly error windows above ``threshold`` (streaming or batch input).

    Output: ``window_start``, ``window_end`` (TIMESTAMP_NTZ like the input),
    ``n_errors``. State per open window is one counter, evicted when the
    watermark passes the window end.
    """
    tz = logs.sparkSession.conf.get("spark.sql.session.timeZone")
    errs = _errors(logs, signature, resource_type).withColumn("_et", event_time("timestamp", tz))
    agg = (errs.withWatermark("_et", watermark)
               .groupBy(F.window("_et", window).alias("w"))
               .agg(F.count(F.lit(1)).alias("n_errors")))
    return (agg.where(F.col("n_errors") > threshold)
               .select(wall_clock(F.col("w.start"), tz).alias("window_start"),
                       wall_clock(F.col("w.end"), tz).alias("window_end"), "n_errors"))


def error_alert_stream(logs: DataFrame, signature: str = ERROR_SIGNATURE,
                       resource_type: str | None = "gce_instance") -> DataFrame:
    """One alert row per error line, the moment it arrives (no state)."""
    return _errors(logs, signature, resource_type).select(
        F.lit("error_event").alias("check_name"), F.lit(signature).alias("entity"),
        F.lit("critical").alias("severity"), F.lit(1).cast("long").alias("n_rows"),
        F.col("timestamp").alias("first_seen"), "insertId", "message")


def run_error_rate_alerts(logs_stream: DataFrame, threshold: int, sink_path: str, checkpoint: str,
                          available_now: bool = True, processing_time: str | None = None,
                          **kwargs) -> None:
    """Run T1 into a Parquet alerts table; blocks until the sweep is done when
    ``available_now`` (T3), otherwise returns after starting the query."""
    writer = (error_rate_stream(logs_stream, threshold, **kwargs).writeStream
              .format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=processing_time or "1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def sweep_error_counts(logs_stream: DataFrame, counts_path: str, checkpoint: str, signature: str = ERROR_SIGNATURE,
                       resource_type: str | None = "gce_instance", window: str = "1 hour") -> None:
    """T1 without a watermark: each micro-batch writes its windows' partial
    counts to a folder of its own, which a replayed batch overwrites. Whatever
    the order in which rows arrive, none is late and none is lost; a sweep
    resumes from the checkpoint. :func:`error_windows` adds the counts up.
    """
    tz = logs_stream.sparkSession.conf.get("spark.sql.session.timeZone")

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(F.window(event_time("timestamp", tz), window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
              .select(wall_clock(F.col("w.start"), tz).alias("window_start"), wall_clock(F.col("w.end"), tz).alias("window_end"), "n")
              .write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}"))

    (_errors(logs_stream, signature, resource_type).writeStream.foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def error_windows(spark: SparkSession, counts_path: str, threshold: int) -> DataFrame:
    """Windows above ``threshold`` from the partial counts, open ones included."""
    counts = spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, n long").parquet(counts_path)
    return (counts.groupBy("window_start", "window_end").agg(F.sum("n").alias("n_errors"))
            .where(F.col("n_errors") > threshold))


def run_error_alert_sweep(logs_stream: DataFrame, sink_path: str, checkpoint: str, **kwargs):
    """T2+T3: append every new error line to the alerts table, then stop."""
    q = (error_alert_stream(logs_stream, **kwargs).writeStream
         .format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


ALERT_COLUMNS = ["check_name", "entity", "severity", "n_rows", "first_seen"]


def alerts_batch_writer(table_path: str, name: str, by_alert: bool = False):
    """``foreachBatch`` function appending a micro-batch of alerts to the
    alerts table (same layout as ``sources.write_alerts``).

    Each batch goes to partitions (run_date = date of the alert, run_id =
    ``<name>-<batchId>``) with dynamic overwrite, so a batch that Spark replays
    after a failure replaces its own rows instead of duplicating them. With
    ``by_alert`` the rows are versions: an alert (check, entity, first_seen) that
    is reported again counts from then on in place of its earlier rows, which
    ``sources.read_alerts`` leaves out. Files are as many as batches and dates,
    not as alerts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(*ALERT_COLUMNS)
              .withColumn("run_date", F.to_date("first_seen"))
              .withColumn("run_id", F.lit(version_run_id(name, batch_id) if by_alert else f"{name}-{batch_id}"))
              .write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic")
              .partitionBy("run_date", "run_id")
              .parquet(table_path))
    return write


def stream_alerts_to_table(alerts_stream: DataFrame, table_path: str, checkpoint: str, name: str,
                           available_now: bool = True, processing_time: str | None = None,
                           output_mode: str = "append"):
    """Route a streaming alerts DataFrame (``error_rate_stream`` renamed to the
    alert columns, or ``error_alert_stream``) into the shared alerts table.

    ``output_mode="update"`` gives early alerts for windowed counts: a window
    is reported in the micro-batch where its count crosses the threshold,
    without waiting for the watermark to close it; when it grows, its row is replaced.
    """
    writer = (alerts_stream.writeStream.outputMode(output_mode)
              .foreachBatch(alerts_batch_writer(table_path, name, by_alert=output_mode == "update"))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=processing_time or "1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def error_rate_alerts(rate: DataFrame, signature: str = ERROR_SIGNATURE) -> DataFrame:
    """T1 output in the alerts table's columns (critical, one row per window)."""
    return rate.select(F.lit("error_rate").alias("check_name"), F.lit(signature).alias("entity"),
                       F.lit("critical").alias("severity"), F.col("n_errors").alias("n_rows"),
                       F.col("window_start").alias("first_seen"))
