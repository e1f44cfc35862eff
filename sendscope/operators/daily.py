"""Daily checks from stored partial results.

A scheduled run reads its own day only and stores what the checks need of it:
irregular versions with their counts, the sessions that campaigns were sent to,
and the messages with a known CTA per session. The checks merge these small
tables, so their results equal a recomputation over all rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import path_exists
from .checks import DEFAULT_ORPHAN_THRESHOLD, check_version, cta_messages

VERSIONS = "template string, version string, n_dispatches long, first_dispatch timestamp_ntz, day date"
SESSIONS = "session_id string, day date"
MESSAGES = "session_id string, cta string, n long, first_seen timestamp_ntz, day date"


def _of_days(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The rows of some days: whole folders of a table partitioned by ``publish_date``."""
    ts = F.col("publish_time")
    some = df.where((ts >= F.lit(dt.datetime.combine(first, dt.time()))) &
                    (ts < F.lit(dt.datetime.combine(last + dt.timedelta(days=1), dt.time()))))
    if "publish_date" in df.columns:
        some = some.where(F.col("publish_date").between(F.lit(first), F.lit(last)))
    return some.withColumn("day", F.to_date("publish_time"))


def store_days(camp: DataFrame, conv: DataFrame, ctas: Iterable | DataFrame, path: str,
               first: dt.date, last: dt.date | None = None) -> None:
    """Store the partial results of the days ``first`` to ``last`` (default: one
    day). A day stored again replaces its earlier results; other days stay."""
    last = last or first
    sent = _of_days(camp, first, last)
    versions = check_version(sent, by=["day"])
    sessions = sent.where(F.col("session_id").isNotNull()).select("session_id", "day").distinct()
    messages = (cta_messages(_of_days(conv, first, last), ctas, ["day"]).groupBy("session_id", "cta", "day")
                .agg(F.count(F.lit(1)).alias("n"), F.min("publish_time").alias("first_seen")))
    for name, rows in (("versions", versions), ("sessions", sessions), ("messages", messages)):
        # an empty day clears what an earlier run of it has stored
        day = F.col("day")
        for gone in _stored_days(camp.sparkSession, f"{path}/{name}", first, last, rows):
            rows.limit(0).drop("day").write.mode("overwrite").parquet(f"{path}/{name}/day={gone}")
        (rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}"))


def _stored_days(spark: SparkSession, path: str, first: dt.date, last: dt.date, rows: DataFrame) -> list[dt.date]:
    """Days of the range that are stored but that ``rows`` has nothing of."""
    if first != last:
        return []  # a longer range is a first filling
    return [first] if path_exists(spark, f"{path}/day={first}") and rows.isEmpty() else []


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def merged_versions(spark: SparkSession, path: str) -> DataFrame:
    """C2 over all stored days."""
    return (_read(spark, path, "versions", VERSIONS).groupBy("template", "version")
            .agg(F.sum("n_dispatches").alias("n_dispatches"), F.min("first_dispatch").alias("first_dispatch")))


def merged_orphans(spark: SparkSession, path: str, as_of: dt.date, threshold: int = DEFAULT_ORPHAN_THRESHOLD) -> DataFrame:
    """C3 of the day before ``as_of``: that day's stored messages without those
    whose session any stored day knows."""
    asked = _read(spark, path, "messages", MESSAGES).where(F.col("day") == F.lit(as_of - dt.timedelta(days=1)))
    known = _read(spark, path, "sessions", SESSIONS).select("session_id").distinct()
    return (asked.join(known, "session_id", "left_anti").groupBy("cta")
            .agg(F.sum("n").cast("long").alias("orphan_messages"), F.count(F.lit(1)).alias("orphan_sessions"),
                 F.min("first_seen").alias("first_seen"))
            .where(F.col("orphan_messages") > threshold))
