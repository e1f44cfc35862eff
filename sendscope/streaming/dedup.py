"""T4: drop re-delivered messages (the retry hypothesis) within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .alerts import event_time


def dedup_redeliveries(stream: DataFrame, key: str = "message_id", time_col: str = "publish_time",
                       watermark: str = "1 hour") -> DataFrame:
    """Keep the first delivery of each ``key``; state expires with the watermark,
    and rows behind it are dropped. That suits a live feed; a replay whose files
    don't come in event-time order takes :func:`sweep_deliveries`."""
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    return (stream.withColumn("_et", event_time(time_col, tz))
                  .withWatermark("_et", watermark)
                  .dropDuplicatesWithinWatermark([key])
                  .drop("_et"))


def sweep_deliveries(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append every delivery to a table, one folder per micro-batch, which a
    replayed batch overwrites: no row is late, whatever the order of the files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def first_deliveries(spark: SparkSession, path: str, schema: StructType, key: str = "message_id",
                     time_col: str = "publish_time") -> DataFrame:
    """The earliest delivery of each ``key`` in a swept table (ties: the least
    row); the limit of one row per key is applied before the exchange."""
    rows = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    order = Window.partitionBy(key).orderBy(F.col(time_col).asc_nulls_last(), F.xxhash64(*schema.fieldNames()))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
