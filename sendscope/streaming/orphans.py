"""T5: orphan conversations live — a stream-stream left outer join.

A conversation row is emitted with NULL campaign fields once the watermarks
prove no campaign row for its session can still arrive within ``max_lag``
before it (campaign dispatch precedes the conversation it opens).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import campaign_sessions_among
from ..sources.staging import path_exists
from .alerts import event_time, wall_clock


def orphan_conversations_stream(conv_stream: DataFrame, camp_stream: DataFrame,
                                max_lag: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    tz = conv_stream.sparkSession.conf.get("spark.sql.session.timeZone")
    conv = (conv_stream.select(F.col("session_id").alias("conv_session_id"), "text",
                               F.col("message_id").alias("conv_message_id"),
                               event_time("publish_time", tz).alias("conv_time"))
            .withWatermark("conv_time", watermark))
    camp = (camp_stream.select(F.col("session_id").alias("camp_session_id"),
                               event_time("publish_time", tz).alias("camp_time"))
            .withWatermark("camp_time", watermark))
    cond = (F.col("conv_session_id") == F.col("camp_session_id")) & \
        (F.col("camp_time") <= F.col("conv_time")) & \
        (F.col("camp_time") >= F.col("conv_time") - F.expr(f"INTERVAL {max_lag}"))
    joined = conv.join(camp, cond, "leftOuter")
    return joined.where(F.col("camp_session_id").isNull()).select(
        F.col("conv_session_id").alias("session_id"), F.col("conv_message_id").alias("message_id"),
        "text", wall_clock(F.col("conv_time"), tz).alias("publish_time"))


def orphan_conversations_live(conv_stream: DataFrame, camp: DataFrame, ctas: list[str]) -> DataFrame:
    """C3 live (stream-static): every arriving conversation message that
    carries a known CTA and whose session has no campaign record.

    The campaign side is a static table reduced to distinct sessions; the
    stream side needs no state, so each message is reported in the micro-batch
    it arrives in. Exact CTAs are a literal hash set on the stream.
    """
    known = camp.select("session_id").distinct()
    hits = conv_stream.where(F.col("text").isin(sorted(set(ctas))))
    return hits.join(known, "session_id", "left_anti").select(
        "session_id", "message_id", F.col("text").alias("cta"), "publish_time")


ORPHANS = "session_id string, message_id string, cta string, publish_time timestamp_ntz"


def sweep_orphan_conversations(conv_stream: DataFrame, campaigns: Callable[[], DataFrame], ctas: list[str],
                               path: str, checkpoint: str) -> None:
    """C3 live as a sweep: each micro-batch writes its CTA messages, reduces the
    campaigns, read anew so that late ones count, to their sessions and writes
    the messages that no campaign explains. A replayed batch overwrites its own folders.
    """
    known = sorted(set(ctas))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.where(F.col("text").isin(known)).select("session_id", "message_id", F.col("text").alias("cta"), "publish_time")
              .write.mode("overwrite").parquet(f"{path}/hits/batch={batch_id}"))
        hits = batch.sparkSession.read.schema(ORPHANS).parquet(f"{path}/hits/batch={batch_id}")
        cam = campaign_sessions_among(campaigns(), hits)
        (hits.join(cam, hits.session_id == cam.session_campanha, "left_anti")
             .write.mode("overwrite").parquet(f"{path}/orphans/batch={batch_id}"))

    (conv_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def swept_orphans(spark: SparkSession, path: str) -> DataFrame:
    """All orphan messages that the sweeps have written."""
    rows = spark.read.schema(ORPHANS).parquet(f"{path}/orphans")
    return rows.select("session_id", "message_id", "cta", "publish_time")


# --- T5 as a maintained anti join -------------------------------------------------
#
# Two tables hold the state: the messages with a known CTA and the sessions that
# have a campaign. Both are partitioned by a bucket of the session, one folder a
# micro-batch. A batch reads only the buckets that it holds sessions of, and
# writes the changes it makes to the set of orphans: +1 for a message without a
# campaign, -1 for a message whose campaign has come after it.

#: Buckets that the state is dealt to; fixed once a state has been written. A
#: state of terabytes takes hundreds.
STATE_BUCKETS = 16
CHANGES = ORPHANS + ", change int"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


class OrphanState:
    """The state and change log of the maintained anti join below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = STATE_BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> None:
        # a replayed batch overwrites its own folder; one file a bucket
        (rows.withColumn("bucket", _bucket(self.buckets)).repartition("bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/batch={batch_id}"))

    def _read(self, table: str, schema: str, batch_id: int, buckets: list[int]) -> DataFrame:
        """What earlier batches have written to some buckets: the last compacted
        state before the batch and the batches since."""
        empty = self.spark.createDataFrame([], schema)
        if not path_exists(self.spark, f"{self.path}/{table}"):
            return empty
        rows = self.spark.read.schema(f"{schema}, batch long, bucket int").parquet(f"{self.path}/{table}")
        since = self._compacted_before(batch_id)
        old = rows.where((F.col("batch") < batch_id) & (F.col("batch") >= since) & F.col("bucket").isin(buckets))
        if since:
            base = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/upto={since}/{table}")
            old = old.drop("batch", "bucket").unionByName(base.where(F.col("bucket").isin(buckets)).drop("bucket"))
        return old.select(*empty.columns)

    def _compacted_before(self, batch_id: int) -> int:
        """The first batch that the newest usable compacted state leaves out (0: none)."""
        marks = f"{self.path}/marks"
        if not path_exists(self.spark, marks):
            return 0
        done = self.spark.read.schema("upto long").parquet(marks).where(F.col("upto") <= batch_id)
        return done.agg(F.max("upto")).first()[0] or 0

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch of both sides into the state and the change log."""
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(_bucket(self.buckets)).distinct().collect()]  # at most ``buckets`` numbers
            sent = batch.where("side = 'campaign' AND session_id IS NOT NULL").select("session_id").distinct()
            hits = batch.where("side = 'conversation'").drop("side")
            known = self._read("sessions", "session_id string", batch_id, touched)
            new = sent.join(known, "session_id", "left_anti").persist()
            withdrawn = self._read("messages", ORPHANS, batch_id, touched).join(new, "session_id", "left_semi")
            # a campaign of this batch explains a message of this batch
            orphans = hits.join(known.unionByName(new), "session_id", "left_anti")
            changes = orphans.withColumn("change", F.lit(1)).unionByName(withdrawn.withColumn("change", F.lit(-1)))
            changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")
            self._write(hits, "messages", batch_id)
            self._write(new, "sessions", batch_id)
            new.unpersist()
        finally:
            batch.unpersist()

    def compact(self, before: int) -> None:
        """Merge the state of all batches below ``before`` into one folder a
        table. To be called between sweeps; a mark, written last, makes it count,
        so a compaction that is broken off is none."""
        if self._compacted_before(before) == before:
            return
        every = list(range(self.buckets))
        for table, schema in (("messages", ORPHANS), ("sessions", "session_id string")):
            (self._read(table, schema, before, every).withColumn("bucket", _bucket(self.buckets)).repartition("bucket")
                 .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/upto={before}/{table}"))
        self.spark.createDataFrame([(before,)], "upto long").coalesce(1).write.mode("append").parquet(f"{self.path}/marks")

    def changes(self) -> DataFrame:
        """The change log: every +1 and -1 with the batch that made it."""
        return (self.spark.read.schema(f"{CHANGES}, batch long").parquet(f"{self.path}/changes"))

    def messages(self) -> DataFrame:
        """Every message the sweeps were told to be an orphan, with its state
        now: ``orphan``, or ``withdrawn`` once its campaign came. Repeated
        messages each give a row."""
        key = ["session_id", "message_id", "cta", "publish_time"]
        per = self.changes().groupBy(*key).agg(F.sum(F.when(F.col("change") > 0, 1).otherwise(0)).alias("told"),
                                               F.sum("change").alias("left"))
        return (per.withColumn("state", F.when(F.col("left") > 0, F.lit("orphan")).otherwise(F.lit("withdrawn")))
                .withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("told").cast("int")))).select(*key, "state"))

    def orphans(self) -> DataFrame:
        """The messages that no campaign explains, as of the last sweep."""
        return self.messages().where("state = 'orphan'").drop("state")


def sweep_orphan_changes(conv_stream: DataFrame, camp_stream: DataFrame, ctas: list[str], path: str, checkpoint: str,
                         buckets: int = STATE_BUCKETS) -> OrphanState:
    """Both sides as one stream into an :class:`OrphanState`, then stop.

    After any order of files the orphans are those of the batch anti join of all
    rows so far: a campaign that comes after its conversations withdraws them. A
    null session is never explained. Another call resumes from the checkpoint.
    """
    state = OrphanState(conv_stream.sparkSession, path, buckets)
    hits = conv_stream.where(F.col("text").isin(sorted(set(ctas)))).select(
        F.lit("conversation").alias("side"), "session_id", "message_id", F.col("text").alias("cta"), "publish_time")
    sent = camp_stream.select(F.lit("campaign").alias("side"), "session_id", F.lit(None).cast("string").alias("message_id"),
                              F.lit(None).cast("string").alias("cta"), F.lit(None).cast("timestamp_ntz").alias("publish_time"))
    (hits.unionByName(sent).writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return state
