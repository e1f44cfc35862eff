"""Live streams whose late rows are kept aside and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..sources.staging import path_exists


def read_log_stream(spark: SparkSession, path: str, resource_type: str | None = "gce_instance",
                    files_per_trigger: int | None = None) -> DataFrame:
    """A folder of log files (Parquet, in the columns of the log base) as a
    stream, one resource type of them (None: all)."""
    reader = spark.readStream.schema(schemas.LOGS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    logs = reader.parquet(path)
    return logs if resource_type is None else logs.where(F.col("resource_type") == resource_type)


class LateSplit:
    """A stream written to two tables below ``path``: ``kept``, and ``late`` for
    the rows behind the watermark.

    The watermark of a micro-batch is the latest time of all batches before it
    less ``delay``; rows without a time are late. Each batch writes folders of
    its own, which a replayed batch overwrites, and a row with its counts and
    latest time, so kept and late rows always add up to the input.
    """

    COUNTS = "n_kept long, n_late long, latest timestamp_ntz, batch long"

    def __init__(self, spark: SparkSession, path: str, schema: StructType, time_col: str, delay: str = "1 hour"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.time_col, self.delay = time_col, delay

    def counts(self) -> DataFrame:
        """``batch``, ``n_kept``, ``n_late`` and ``latest`` of every batch."""
        return self.spark.read.schema(self.COUNTS).parquet(f"{self.path}/counts")

    def watermark(self, batch_id: int):
        """The time behind which rows of a batch are late; None for the first."""
        if not path_exists(self.spark, f"{self.path}/counts"):
            return None
        before = self.counts().where(F.col("batch") < batch_id)
        return before.agg((F.max("latest") - F.expr(f"INTERVAL {self.delay}")).alias("w")).first().w

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        mark, time = self.watermark(batch_id), F.col(self.time_col)
        late = time.isNull() if mark is None else F.coalesce(time < F.lit(mark), F.lit(True))
        for name, rows in (("kept", batch.where(~late)), ("late", batch.where(late))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        (batch.agg(F.count_if(~late).alias("n_kept"), F.count_if(late).alias("n_late"), F.max(time).alias("latest"))
         .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}"))

    def sweep(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that is there now, then stop."""
        (stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    def _table(self, name: str) -> DataFrame:
        with_batch = StructType(list(self.schema.fields)).add("batch", "long")
        return self.spark.read.schema(with_batch).parquet(f"{self.path}/{name}")

    def kept(self) -> DataFrame:
        return self._table("kept")

    def late(self) -> DataFrame:
        return self._table("late")
