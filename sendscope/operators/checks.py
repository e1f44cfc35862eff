"""Scheduled data-quality checks (C1–C4) and the alerts table.

Every check takes an explicit ``as_of`` date instead of CURRENT_DATE, so a
re-run of yesterday's job gives yesterday's answer.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ddmm_suffix, suffix_date
from ..functions.params import DEFAULT_BLOCK, blocks
from ..functions.payload import ERROR_SIGNATURE
from ..functions.regex import matches

# Version prefix, severities and the orphan threshold of the proposal.
VERSION_PREFIX = "sendtype-"
STRICT_VERSION = r"^sendtype-\d{3}\z"
ATTENTION = "attention"
CRITICAL = "critical"
DEFAULT_ORPHAN_THRESHOLD = 10


def _date(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def check_template_date(camp: DataFrame, as_of=None) -> DataFrame:
    """Templates whose ``DDMM`` suffix disagrees with the reference date.

    Default: compare with each row's dispatch date. With ``as_of`` the
    reference date is that literal (the scheduled-SQL form). Suffixes that
    are not a real date (``3102``) are reported as ``invalid_suffix``.
    """
    dispatch = F.to_date("publish_time")
    ref = F.lit(_date(as_of)) if as_of is not None else dispatch
    sfx = ddmm_suffix("template")
    parsed = suffix_date(sfx, ref)
    rows = camp.select("session_id", "template", dispatch.alias("dispatch_date"),
                       sfx.alias("suffix_ddmm"), parsed.alias("suffix_date"), ref.alias("reference_date"))
    bad = (F.col("suffix_ddmm") != "") & (F.col("suffix_date").isNull() |
                                         (F.col("suffix_date") != F.col("reference_date")))
    return rows.where(bad).withColumn(
        "issue", F.when(F.col("suffix_date").isNull(), F.lit("invalid_suffix")).otherwise(F.lit("date_mismatch")))


def check_version(camp: DataFrame, strict: bool = False, by: Iterable[str] = ()) -> DataFrame:
    """Dispatches whose ``version`` is outside ``sendtype-…`` (or NULL),
    grouped by (template, version); :func:`latest_first` sorts them for a report.

    ``strict=True`` requires exactly three digits, as the prose describes; ``by``
    names further columns to group by.
    """
    v = F.col("version")
    ok = v.rlike(STRICT_VERSION) if strict else v.startswith(VERSION_PREFIX)
    irregular = v.isNull() | ~ok
    return (camp.where(irregular)
                .groupBy("template", "version", *by)
                .agg(F.count(F.lit(1)).alias("n_dispatches"), F.min("publish_time").alias("first_dispatch")))


def latest_first(version: DataFrame) -> DataFrame:
    """C2's report order: latest first dispatch first."""
    return version.orderBy(F.col("first_dispatch").desc(), "template", F.col("version").asc_nulls_first())


def _cta_table(spark: SparkSession, ctas: Iterable | DataFrame) -> DataFrame:
    """Distinct ``(cta, match)`` rows without NULL CTAs; a plain string is an exact CTA."""
    if not isinstance(ctas, DataFrame):
        ctas = spark.createDataFrame([(c, "exact") if isinstance(c, str) else tuple(c) for c in ctas],
                                     "cta string, match string")
    return ctas.select("cta", "match").where(F.col("cta").isNotNull()).distinct()


def cta_messages_on_day(conv: DataFrame, ctas: Iterable | DataFrame, as_of,
                        block: int = DEFAULT_BLOCK) -> DataFrame:
    """Conversation messages of the day before ``as_of`` that carry a known
    CTA: ``(session_id, publish_time, cta)``, once for each CTA of a message.

    The day filter is a half-open range on the raw timestamp (row-group
    skipping) plus, on a ``publish_date``-partitioned table, a partition filter
    that skips every other day's files. Exact CTAs become one hash-set
    ``isin`` and regex CTAs one ``rlike`` each; a list of more than ``block``
    CTAs, exact and regex alike, takes one scan of the day a block. Another
    ``match`` than exact or regex is an error.
    """
    day_end = _date(as_of)
    day_start = day_end - dt.timedelta(days=1)
    ts = F.col("publish_time")
    day = conv.where((ts >= F.lit(dt.datetime.combine(day_start, dt.time()))) &
                     (ts < F.lit(dt.datetime.combine(day_end, dt.time()))))
    if "publish_date" in conv.columns:  # date-partitioned table: prune directories
        day = day.where(F.col("publish_date") == F.lit(day_start))
    return cta_messages(day, ctas, block=block)


def cta_messages(conv: DataFrame, ctas: Iterable | DataFrame, keep: Iterable[str] = (),
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Conversation messages that carry a known CTA: ``(session_id,
    publish_time, cta)`` and the columns ``keep``, once for each CTA of a message."""
    keep = ["session_id", "publish_time", *keep]
    found = []
    for some in blocks(_cta_table(conv.sparkSession, ctas).orderBy("cta", "match"), block):
        unknown = {r.match for r in some} - {"exact", "regex"}
        if unknown:
            raise ValueError(f"a CTA matches exact or regex, not {sorted(map(str, unknown))}")
        exact = [r.cta for r in some if r.match == "exact"]
        labels = [F.when(F.col("text").isin(exact), F.col("text"))] if exact else []
        labels += [F.when(matches("text", r.cta), F.lit(r.cta)) for r in some if r.match == "regex"]
        found.append(conv.select(*keep, F.explode(F.array(*labels)).alias("cta")).where(F.col("cta").isNotNull()))
    if not found:
        return conv.select(*keep, F.col("text").alias("cta")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)


def check_orphan_sessions(conv: DataFrame, camp: DataFrame, ctas: Iterable | DataFrame, as_of,
                          threshold: int = DEFAULT_ORPHAN_THRESHOLD,
                          block: int = DEFAULT_BLOCK) -> DataFrame:
    """Conversations of the day before ``as_of`` carrying a known CTA whose
    session has no campaign record, per CTA, above ``threshold`` messages.

    * the day's CTA messages come from :func:`cta_messages_on_day` (partition
      and row-group pruning, one hash-set test for exact CTAs);
    * they are pre-aggregated per (session, CTA) and the campaigns to their
      distinct sessions, both before the exchange, so a hot session is one row
      a task on each side of the anti join; it reads nothing but the session
      ids of the campaigns.

    ``orphan_messages`` is the scheduled SQL's COUNT(*) over conversation rows;
    ``orphan_sessions`` counts distinct sessions.
    """
    tagged = cta_messages_on_day(conv, ctas, as_of, block)
    per_session = tagged.groupBy("session_id", "cta").agg(
        F.count(F.lit(1)).alias("n"), F.min("publish_time").alias("first_seen"))
    orphans = per_session.join(camp.select("session_id").distinct(), "session_id", "left_anti")
    return (orphans.groupBy("cta")
                   .agg(F.sum("n").cast("long").alias("orphan_messages"),
                        F.count(F.lit(1)).alias("orphan_sessions"),
                        F.min("first_seen").alias("first_seen"))
                   .where(F.col("orphan_messages") > threshold))


def error_rate_hourly(logs: DataFrame, threshold: int, signature: str = ERROR_SIGNATURE,
                      resource_type: str | None = "gce_instance") -> DataFrame:
    """C4 (batch): hourly count of log lines with the error signature, above N."""
    cond = F.col("message").contains(signature)
    if resource_type is not None:
        cond = cond & (F.col("resource_type") == resource_type)
    return (logs.where(cond)
                .groupBy(F.window("timestamp", "1 hour").alias("w"))
                .agg(F.count(F.lit(1)).alias("n_errors"))
                .where(F.col("n_errors") > threshold)
                .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        "n_errors"))


ALERT_COLUMNS = ["check_name", "entity", "severity", "n_rows", "first_seen"]


def alerts(template_date: DataFrame | None = None, version: DataFrame | None = None,
           orphans: DataFrame | None = None, error_rate: DataFrame | None = None) -> DataFrame:
    """Normalise check outputs into one alerts table
    ``(check_name, entity, severity, n_rows, first_seen)``.

    Any row of C1/C2 is an ``attention`` alert; C3/C4 rows are already over
    their thresholds and are ``critical``.
    """
    parts = []
    if template_date is not None:
        parts.append(template_date.groupBy(F.col("template").alias("entity")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("dispatch_date").cast("timestamp_ntz").alias("first_seen"))
            .select(F.lit("template_date").alias("check_name"), "entity",
                    F.lit(ATTENTION).alias("severity"), "n_rows", "first_seen"))
    if version is not None:
        parts.append(version.select(
            F.lit("version").alias("check_name"),
            F.concat_ws(" / ", "template", F.coalesce("version", F.lit("NULL"))).alias("entity"),
            F.lit(ATTENTION).alias("severity"), F.col("n_dispatches").alias("n_rows"),
            F.col("first_dispatch").alias("first_seen")))
    if orphans is not None:
        parts.append(orphans.select(
            F.lit("orphan_sessions").alias("check_name"), F.col("cta").alias("entity"),
            F.lit(CRITICAL).alias("severity"), F.col("orphan_messages").alias("n_rows"), "first_seen"))
    if error_rate is not None:
        parts.append(error_rate.select(
            F.lit("error_rate").alias("check_name"), F.lit(ERROR_SIGNATURE).alias("entity"),
            F.lit(CRITICAL).alias("severity"), F.col("n_errors").alias("n_rows"),
            F.col("window_start").alias("first_seen")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
