"""Preparation operators: column drops, the campaign×conversation join,
ordered reads and samples (R1–R3, J3, W1–W3, O2–O4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import latest_before, sequence_within_groups

# Columns the investigation discards as low-value.
CAMPAIGN_DROP_FIRST = ["attributes", "data", "subscription_name", "channel_client_id"]
CAMPAIGN_DROP_SECOND = ["source", "ctwa_clid", "version"]
CONVERSATION_DROP = ["author", "user_id", "data", "attributes", "subscription_name", "media_type"]


def clean_campaigns(camp: DataFrame) -> DataFrame:
    """R1+R3: campaigns without the seven low-value columns."""
    return camp.drop(*CAMPAIGN_DROP_FIRST, *CAMPAIGN_DROP_SECOND)


def clean_conversations(conv: DataFrame) -> DataFrame:
    """Conversations without the six low-value columns."""
    return conv.drop(*CONVERSATION_DROP)


def conversations_with_campaigns(camp: DataFrame, conv: DataFrame) -> DataFrame:
    """J3+R2: inner join on session_id, projected with explicit side names.

    This materialises the N:M pairs by design (it is the exported detail
    table). Both sides are pruned to the seven needed columns before the
    shuffle; AQE splits a hot session on the larger side (skew join).
    """
    c = camp.select(F.col("session_id"), F.col("publish_time").alias("publish_time_campanha"),
                    F.col("message_id").alias("message_id_campanha"), "template")
    v = conv.select(F.col("session_id"), "text", F.col("publish_time").alias("publish_time_conversa"),
                    F.col("message_id").alias("message_id_conversa"))
    return c.join(v, "session_id", "inner").select(
        "session_id", "publish_time_campanha", "message_id_campanha", "template", "text",
        "publish_time_conversa", "message_id_conversa")


def dispatch_for_conversation(camp: DataFrame, conv: DataFrame) -> DataFrame:
    """One row per conversation message with the campaign dispatch that
    preceded it: the latest dispatch of the same session at or before the
    message (ties: highest message_id). Unlike the session join it never
    multiplies rows, so it stays one-to-one even for a hot session.
    """
    c = conv.select("session_id", F.col("message_id").alias("message_id_conversa"), "text",
                    F.col("publish_time").alias("publish_time_conversa"))
    # only dispatches of sessions that have conversations can be linked
    # (semi-join reduction; AQE broadcasts the conversation sessions when few)
    k = (camp.select("session_id", "publish_time", "message_id", "template")
             .join(c.select("session_id").where(F.col("session_id").isNotNull()).distinct(),
                   "session_id", "left_semi"))
    out = latest_before(c, k, "session_id", "publish_time_conversa", "publish_time", "message_id",
                        ["message_id", "publish_time", "template"], prefix="campaign_")
    return out.select("session_id", "message_id_conversa", "text", "publish_time_conversa",
                      F.col("campaign_message_id").alias("message_id_campanha"),
                      F.col("campaign_publish_time").alias("publish_time_campanha"),
                      F.col("campaign_template").alias("template"))


def latest_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` per ``key`` (order_cols should
    end in a unique id so ties are broken deterministically).

    ``row_number() = 1`` gets a partial group limit before the exchange, so a
    task sends one row a key and a hot key is never gathered whole. NULLs in
    ``order_cols`` come last.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order_cols])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_per_session(camp: DataFrame) -> DataFrame:
    """The most recent record of each session (ties: highest message_id)."""
    return latest_per_key(camp, "session_id", ["publish_time", "message_id"])


def conversation_sequence(conv: DataFrame) -> DataFrame:
    """Position of each message in its session by (publish_time, message_id)."""
    return sequence_within_groups(conv, ["session_id"], ["publish_time", "message_id"],
                                  seq_col="seq", prev_prefix=None)


def session_repeat_gaps(camp: DataFrame) -> DataFrame:
    """For every repeated dispatch in a session, the gap to the previous one.

    Reports ``gap_us`` (microseconds) and whether the template repeated; it
    assigns no cause (cascade / retry / double firing stay hypotheses).
    """
    seq = sequence_within_groups(camp.select("session_id", "publish_time", "message_id", "template"),
                                 ["session_id"], ["publish_time", "message_id"],
                                 seq_col="seq", prev_prefix="prev_", carry_cols=["template"])
    return (seq.where(F.col("prev_message_id").isNotNull())
               .select("session_id", "seq", "message_id", "prev_message_id",
                       F.timestamp_diff("MICROSECOND", F.col("prev_publish_time"),
                                        F.col("publish_time")).alias("gap_us"),
                       F.coalesce(F.col("template") == F.col("prev_template"),
                                  F.lit(False)).alias("same_template")))


def logs_sample(logs: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` log rows in a deterministic order (top-k, not a sort)."""
    return logs.orderBy("timestamp", "insertId").limit(n)


def sorted_for_export(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """O2: globally ordered layout (range partitions, each sorted) for export."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
