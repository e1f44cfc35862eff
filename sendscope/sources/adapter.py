"""Derive the three logical bases from the driver's tables, deterministically.

The driver ships ``events`` and ``conversations``; campaigns, conversations and
logs are projections of them (mapping documented in FIXTURES.md). Everything is
a per-row projection, so the adapter adds no shuffle and its cost grows
linearly with the inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def campaigns_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    k = _k()
    is_click = F.col("event_type") == "click"
    session_num = F.when((eid % 7 == 0) & (eid > 0), eid - 1).otherwise(eid)
    suffix = (F.when(k % 20 == 0, F.lit("at"))
              .when(k % 10 == 0, F.date_format(F.col("ts") - F.expr("INTERVAL 9 DAYS"), "ddMM"))
              .otherwise(F.date_format("ts", "ddMM")))
    version = (F.when(eid % 50 == 0, F.lit("1"))
               .when(eid % 50 == 1, F.lit(None).cast("string"))
               .otherwise(F.concat(F.lit("sendtype-"), _s(800 + k))))
    return events.select(
        F.concat(F.lit("s"), _s(session_num)).alias("session_id"),
        _s("event_id").alias("message_id"),
        F.concat(F.lit("crm_"), F.col("event_type"), F.lit("_"), suffix).alias("template"),
        F.when(is_click, F.lit("meta")).otherwise(F.lit("crm")).alias("source"),
        F.lit("wa").alias("channel_client_id"),
        F.col("ts").alias("publish_time"),
        F.when(is_click, F.concat(F.lit("clid"), _s(eid % 97))).alias("ctwa_clid"),
        version.alias("version"),
        F.col("props").alias("attributes"),
        F.lit(None).cast("string").alias("data"),
        F.lit("campaign-source-topic").alias("subscription_name"),
    )


def conversations_from_driver(conversations: DataFrame) -> DataFrame:
    cid, turn = F.col("conv_id"), F.col("turn")
    text = (F.when(turn == 0, F.when(cid % 3 == 0, F.lit("Talk to an agent")).otherwise(F.lit("Buy now")))
            .otherwise(F.col("text")))
    publish = (F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
               + F.make_dt_interval(F.lit(0), F.lit(0), (cid % 1440).cast("int"), turn))
    return conversations.select(
        F.concat(F.lit("s"), _s(cid)).alias("session_id"),
        F.concat(F.lit("c"), _s(cid), F.lit("-"), _s(turn)).alias("message_id"),
        text.alias("text"),
        F.col("role").alias("author"),
        F.lit("wa").alias("user_id"),
        F.lit(None).cast("string").alias("data"),
        F.lit(None).cast("string").alias("attributes"),
        F.lit("conversation-topic").alias("subscription_name"),
        F.lit("text").alias("media_type"),
        publish.alias("publish_time"),
    )


def logs_from_events(events: DataFrame) -> DataFrame:
    k = _k()
    is_error = F.col("event_type") == "error"
    message = (F.when(is_error & (k % 2 == 0),
                      F.concat(F.lit("It is not a JSON type and cannot be deserialized: "),
                               F.when(k % 4 == 0, F.lit("Buy now")).otherwise(F.lit("Talk to an agent"))))
               .when(is_error, F.concat(F.lit("upstream timeout "), F.col("props")))
               .otherwise(F.col("props")))
    return events.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("l"), _s("event_id")).alias("insertId"),
        F.lit("gce_instance").alias("resource_type"),
        message.alias("message"),
    )


def load_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """campaigns / conversations / logs for one scale-factor folder (lazy)."""
    events = read_driver_table(spark, sf_dir, "events")
    conv = read_driver_table(spark, sf_dir, "conversations")
    return {
        "campaigns": campaigns_from_events(events),
        "conversations": conversations_from_driver(conv),
        "logs": logs_from_events(events),
    }
