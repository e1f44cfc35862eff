"""Staged processed bases (S4/S5): derive once, read many times.

The investigation writes its processed bases to files and every later step
reads them back. Here the derived campaigns / conversations / logs are written
once as Parquet, partitioned by date and sorted by key within each file, into
the shared folder named by ``spark.checkpoint.dir``; later queries read those
files, so date filters prune partitions, session lookups skip row groups, and
no query re-evaluates the derivation expressions.

The stage key hashes the paths, sizes and modification times of all input files
and the code that derives the bases, so a change of either is staged anew. A stage is complete only when every table has its
``_SUCCESS`` marker; an interrupted write is simply redone.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DateType, StructField, StructType

from .. import schemas
from . import adapter
from ..session import ensure_checkpoint_dir
from .adapter import load_tables

_LAYOUT = {
    "campaigns": ("publish_time", ["session_id", "publish_time", "message_id"]),
    "conversations": ("publish_time", ["session_id", "publish_time", "message_id"]),
    "logs": ("timestamp", ["timestamp", "insertId"]),
}
_INPUTS = ["events", "conversations"]
_SCHEMAS = {
    name: StructType([StructField(f.name, f.dataType, True) for f in schema.fields]
                     + [StructField("publish_date", DateType(), True)])
    for name, schema in (("campaigns", schemas.CAMPAIGNS), ("conversations", schemas.CONVERSATIONS),
                         ("logs", schemas.LOGS))
}


def _fs_info(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        st = files.next()
        found.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
    return "|".join(sorted(found))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage_key(spark: SparkSession, sf_dir: str) -> str:
    sig = "|".join(_fs_info(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in _INPUTS)
    code = "".join(inspect.getsource(m) for m in (adapter, sys.modules[__name__]))
    return hashlib.sha1(f"{code}|{sig}".encode()).hexdigest()[:16]


def _write(df: DataFrame, path: str, time_col: str, sort_cols: list[str]) -> None:
    # No explicit partition count: AQE sizes the range partitions from the
    # data, so small inputs do not turn into hundreds of tiny files.
    (df.withColumn("publish_date", F.to_date(F.col(time_col)))
       .repartitionByRange("publish_date", *sort_cols)
       .sortWithinPartitions("publish_date", *sort_cols)
       .write.mode("overwrite").partitionBy("publish_date").parquet(path))


# Read DataFrames per (application, stage key): the staged files are immutable,
# so their file listing is done once per application.
_READ_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}
# Queries submitted from several threads must not stage the same tables twice.
_STAGE_LOCK = threading.Lock()


def staged_tables(spark: SparkSession, sf_dir: str, keep_date: bool = False) -> dict[str, DataFrame]:
    """campaigns / conversations / logs read from their staged Parquet copies.

    ``keep_date=True`` keeps the ``publish_date`` partition column so date
    filters on it prune whole directories.
    """
    key = stage_key(spark, sf_dir)
    cache_key = (spark.sparkContext.applicationId, key)
    with _STAGE_LOCK:
        tables = _READ_CACHE.get(cache_key) or _stage(spark, sf_dir, key)
        _READ_CACHE[cache_key] = tables
    return {n: (df if keep_date else df.drop("publish_date")) for n, df in tables.items()}


def _stage(spark: SparkSession, sf_dir: str, key: str) -> dict[str, DataFrame]:
    """Write any missing staged table, then return readers for all three."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sendscope/bases/{key}"
    raw = None
    tables = {}
    for name, (time_col, sort_cols) in _LAYOUT.items():
        path = f"{base}/{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            raw = raw or load_tables(spark, sf_dir)
            _write(raw[name], path, time_col, sort_cols)
        tables[name] = spark.read.schema(_SCHEMAS[name]).parquet(path)
    return tables
