"""Parameter tables (expected campaigns, CTAs, keywords).

These are configuration, not data: a handful of rows. Operators turn them into
literal expressions (``isin`` → hash set, one ``rlike`` per pattern) a block at
a time, so the big table is scanned once and never joined against them; a list
longer than a block takes another scan. A side is broadcast only when
``limit(n + 1)``, a job that reads at most n+1 rows, proves its bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType

DEFAULT_MAX_PARAM_ROWS = 10_000

#: Literals tried in one scan; a longer list takes a scan a block.
DEFAULT_BLOCK = 1000


def blocks(df: DataFrame, size: int = DEFAULT_BLOCK) -> Iterator[list[Row]]:
    """The rows of a parameter table, however many, in blocks of at most ``size``."""
    rows = df.toLocalIterator()
    while some := list(islice(rows, size)):
        yield some


_KNOWN_ROWS = "_sendscope_known_rows"


def is_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_PARAM_ROWS) -> bool:
    """True when ``df`` provably holds at most ``max_rows`` rows.

    Tables built by :func:`param_frame` carry their row count; others are
    checked with one ``limit(max_rows + 1)`` job.
    """
    known = getattr(df, _KNOWN_ROWS, None)
    if known is not None:
        return known <= max_rows
    return df.select().limit(max_rows + 1).count() <= max_rows


def param_frame(spark: SparkSession, rows, schema: StructType) -> DataFrame:
    """A parameter table from Python rows (or pass a DataFrame through)."""
    if isinstance(rows, DataFrame):
        return rows
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    setattr(df, _KNOWN_ROWS, len(rows))
    return df

