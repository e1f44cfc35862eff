"""Readers for the raw bases (S1–S4) with fixed schemas — no type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .split import read_csv_split, read_json_array

# Accepts second or microsecond precision, with or without a zone suffix.
JSON_TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"


def read_campaigns_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Campaigns export (a JSON array per file, or JSON lines with multi_line=False)."""
    return (spark.read.schema(schemas.CAMPAIGNS)
            .option("multiLine", multi_line)
            .option("timestampNTZFormat", JSON_TIME_PATTERN)
            .json(path))


def read_conversations_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Conversations export."""
    return (spark.read.schema(schemas.CONVERSATIONS)
            .option("multiLine", multi_line)
            .option("timestampNTZFormat", JSON_TIME_PATTERN)
            .json(path))


def read_logs_csv(spark: SparkSession, path: str, time_format: str | None = None) -> DataFrame:
    """S3: raw infrastructure-log CSV.

    Cells hold JSON with doubled quotes, commas and newlines, so the quote
    escape must be ``"`` (RFC 4180) and records may span lines. The dotted
    column names of the flattened export are renamed on load.
    """
    raw = (spark.read.schema(schemas.LOGS_RAW)
           .option("header", True)
           .option("multiLine", True)
           .option("escape", '"')
           .option("mode", "PERMISSIVE")
           .option("timestampNTZFormat", time_format or "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
           .csv(path))
    return raw.select(*[F.col(f"`{c}`").alias(schemas.LOG_RENAMES.get(c, c)) for c in raw.columns])


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Re-read a processed table written by :func:`write_processed`."""
    return spark.read.parquet(path)


def read_campaigns_array(spark: SparkSession, path: str) -> DataFrame:
    """S1 from array files of any size: each is read by many tasks."""
    return read_json_array(spark, path, schemas.CAMPAIGNS, JSON_TIME_PATTERN)


def read_conversations_array(spark: SparkSession, path: str) -> DataFrame:
    """S2 from array files of any size."""
    return read_json_array(spark, path, schemas.CONVERSATIONS, JSON_TIME_PATTERN)


def read_logs_csv_split(spark: SparkSession, path: str, time_format: str | None = None) -> DataFrame:
    """S3 from files of any size: as :func:`read_logs_csv`, each file read by many tasks."""
    raw = read_csv_split(spark, path, schemas.LOGS_RAW, time_format or "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return raw.select(*[F.col(f"`{c}`").alias(schemas.LOG_RENAMES.get(c, c)) for c in raw.columns])
