"""Session and key audits.

Key-cardinality questions are answered from per-key counts, never from a
materialised join: a key holding a third of all rows is pre-aggregated to one
row per task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_messages(df: DataFrame, key: str = "session_id", item: str = "message_id") -> DataFrame:
    """A1+O1: keys with more than one distinct item, most items first (ties by key).

    ``count(distinct)`` plans as a partial aggregate on (key, item) before the
    first shuffle, so a hot key is spread over tasks by item.
    """
    return (df.groupBy(key).agg(F.count_distinct(item).alias("n_messages"))
              .where(F.col("n_messages") > 1)
              .orderBy(F.col("n_messages").desc(), F.col(key).asc()))


def top_sessions(df: DataFrame, k: int = 5, key: str = "session_id", item: str = "message_id") -> DataFrame:
    """O3: the ``k`` keys with most distinct items (``TakeOrderedAndProject``)."""
    return session_messages(df, key, item).limit(k)


def session_duplicate_share(df: DataFrame, key: str = "session_id") -> DataFrame:
    """A2+A8: keys with more than one row, all keys, and their share in percent.

    One grouped count followed by a global aggregate (no cross join of two
    one-row results). NULL keys are excluded from both counts; an empty input
    gives NULL percent instead of a division error.
    """
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tot = per_key.agg(F.count_if(F.col("n") > 1).alias("n_duplicated"),
                      F.count(F.lit(1)).alias("n_sessions"))
    pct = F.round(F.col("n_duplicated") * F.lit(100.0) / F.nullif(F.col("n_sessions"), F.lit(0)), 2)
    return tot.select("n_duplicated", "n_sessions", pct.cast("double").alias("pct_duplicated"))


def clicks_by_source(camp: DataFrame) -> DataFrame:
    """A3: distinct ad-click ids per dispatch source."""
    return camp.groupBy("source").agg(F.count_distinct("ctwa_clid").alias("n_distinct_clid"))


def click_fill_rate(camp: DataFrame) -> DataFrame:
    """A10: how often each source carries a click id (Meta yes, CRM no)."""
    agg = camp.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count("ctwa_clid").alias("n_with_clid"))
    return agg.withColumn("fill_rate", F.round(F.col("n_with_clid") / F.col("n_rows"), 4).cast("double"))


def _key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def join_fanout(left: DataFrame, right: DataFrame, key: str = "session_id",
                right_key: str | None = None) -> DataFrame:
    """What an inner join on ``key`` would produce, without producing it.

    ``join_rows = Σ n_left·n_right`` over matching keys; ``nm_keys`` counts
    keys repeated on both sides (the N:M duplication the dashboard risks).
    ``right_key`` names the key on the right when it differs.
    """
    l = _key_counts(left, key, "n_left").withColumnRenamed(key, "_k")
    r = _key_counts(right, right_key or key, "n_right").withColumnRenamed(right_key or key, "_k")
    m = l.join(r, "_k", "inner")
    return m.agg(
        F.count(F.lit(1)).alias("matching_keys"),
        F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).cast("long").alias("join_rows"),
        F.count_if((F.col("n_left") > 1) & (F.col("n_right") > 1)).alias("nm_keys"),
        F.count_if(F.col("n_left") > 1).alias("left_dup_keys"),
        F.count_if(F.col("n_right") > 1).alias("right_dup_keys"),
    )


def join_key_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate join keys with the row count an inner join would return.

    ``message_id`` (different id spaces on each side) must give 0; the real
    key gives > 0. Computed from per-key counts per candidate.
    """
    parts = [join_fanout(left, right, k).select(F.lit(k).alias("join_key"), "matching_keys", "join_rows")
             for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily_coverage(camp: DataFrame, conv: DataFrame, time_col: str = "publish_time") -> DataFrame:
    """Rows per date in both bases; ``missing_in`` names the empty side."""
    a = camp.groupBy(F.to_date(time_col).alias("publish_date")).agg(F.count(F.lit(1)).alias("n_campaign_rows"))
    b = conv.groupBy(F.to_date(time_col).alias("publish_date")).agg(F.count(F.lit(1)).alias("n_conversation_rows"))
    j = a.join(b, "publish_date", "full_outer")
    return j.select(
        "publish_date",
        F.coalesce("n_campaign_rows", F.lit(0)).alias("n_campaign_rows"),
        F.coalesce("n_conversation_rows", F.lit(0)).alias("n_conversation_rows"),
        F.when(F.col("n_conversation_rows").isNull(), F.lit("conversations"))
         .when(F.col("n_campaign_rows").isNull(), F.lit("campaigns")).alias("missing_in"))
