"""Per-campaign diagnosis (C10): the evidence table of the investigation.

For every reported campaign it gathers, in parallel Spark jobs over the whole
bases: does the template exist, are there near-miss names, does the CTA show
up in the logs (and inside deserialisation errors), was the template
dispatched on its date, are the sessions with the CTA linked to a campaign, and
do the conversations cover the dispatch date. Hypotheses may hold together; none is forced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import DEFAULT_MAX_PARAM_ROWS, is_bounded
from ..session import ensure_checkpoint_dir
from .payload import cta_contained, cta_log_evidence, cta_table
from .search import campaign_sessions_among
from .templates import distinct_templates, template_candidates

# Hypothesis labels, in reporting order.
HYPOTHESES = ["wrong_name", "not_registered", "payload_error", "api_failure_possible", "incomplete_data"]


def cta_session_links(ctas: Iterable[str] | DataFrame, conv: DataFrame, camp: DataFrame) -> DataFrame:
    """J6 for CTAs: sessions with a message that contains the CTA, split into
    those a campaign explains (``n_cta_linked``) and the others.

    The texts are scanned once: one row per (session, CTA) is checkpointed,
    the campaigns are reduced to those sessions.
    """
    ensure_checkpoint_dir(conv.sparkSession)
    per = (cta_contained(conv, "text", cta_table(conv.sparkSession, ctas), "session_id")
           .where(F.col("session_id").isNotNull()).distinct().checkpoint(eager=True))
    cam = campaign_sessions_among(camp, per)
    linked = F.col("session_campanha").isNotNull()
    return (per.join(cam, F.col("session_id") == F.col("session_campanha"), "left")
               .groupBy("cta").agg(F.count_if(linked).alias("n_cta_linked"), F.count_if(~linked).alias("n_cta_unlinked")))


def campaign_diagnosis(expected: DataFrame, camp: DataFrame, conv: DataFrame, logs: DataFrame,
                       max_distance: int = 4, max_rows: int = DEFAULT_MAX_PARAM_ROWS) -> DataFrame:
    small = is_bounded(expected, max_rows)
    exp = expected.select("campaign", "template", "cta", "dispatch_date", "send_type")
    exp = F.broadcast(exp) if small else exp

    exists = (distinct_templates(camp)
              .join(exp.select("template").distinct(), "template", "left_semi")
              .select("template", F.lit(True).alias("template_exists")))

    cand = template_candidates(expected, camp, max_distance)
    similar = cand.groupBy("campaign", F.col("expected_template").alias("template")).agg(
        F.count(F.lit(1)).alias("n_similar"),
        F.min_by(F.col("similar_template"), F.struct("distance", "similar_template")).alias("best_similar"),
        F.min("distance").alias("best_distance"))

    evidence = cta_log_evidence(expected.select("cta"), logs).select("cta", "n_log_hits", "n_error_hits")
    links = cta_session_links(expected.select("cta"), conv, camp)

    # dispatches and conversations on each dispatch date; literal dates prune
    # the folders of a publish_date-partitioned table
    dates = [r.dispatch_date for r in expected.select("dispatch_date").distinct().dropna().toLocalIterator()]

    def on_dates(df: DataFrame) -> DataFrame:
        day = F.col("publish_date") if "publish_date" in df.columns else F.to_date("publish_time")
        return df.withColumn("dispatch_date", day).where(day.isin(dates))

    conv_days = on_dates(conv).groupBy("dispatch_date").agg(F.count(F.lit(1)).alias("n_conversations_on_date"))
    sent = (on_dates(camp).groupBy("template", "dispatch_date")
            .agg(F.count(F.lit(1)).alias("n_dispatched_on_date")))

    d = (exp.join(exists, "template", "left")
            .join(similar, ["campaign", "template"], "left")
            .join(F.broadcast(evidence) if small else evidence, "cta", "left")
            .join(links, "cta", "left")
            .join(sent, ["template", "dispatch_date"], "left")
            .join(conv_days, "dispatch_date", "left")
            .select("campaign", "template", "cta", "dispatch_date", "send_type",
                    F.coalesce("template_exists", F.lit(False)).alias("template_exists"),
                    F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
                    "best_similar", "best_distance",
                    F.coalesce("n_log_hits", F.lit(0)).cast("long").alias("n_log_hits"),
                    F.coalesce("n_error_hits", F.lit(0)).cast("long").alias("n_error_hits"),
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                      for c in ("n_cta_linked", "n_cta_unlinked", "n_dispatched_on_date", "n_conversations_on_date")],
                    F.col("n_dispatched_on_date").isNotNull().alias("dispatched")))

    wrong_name = ~F.col("template_exists") & (F.col("n_similar") > 0)
    rules = {
        "wrong_name": wrong_name,
        "not_registered": ~F.col("template_exists") & (F.col("n_similar") == 0),
        "payload_error": F.col("n_error_hits") > 0,
        "api_failure_possible": (F.col("n_log_hits") > 0) & wrong_name,
        "incomplete_data": F.col("n_conversations_on_date") == 0,
    }
    hyps = F.array_compact(F.array(*[F.when(rules[h], F.lit(h)) for h in HYPOTHESES]))
    return (d.withColumn("hypotheses", hyps)
             .withColumn("hypotheses_text", F.array_join("hypotheses", ",")))
