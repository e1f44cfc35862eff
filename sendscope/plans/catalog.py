"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Each query derives the logical bases from the driver tables of ``sf_dir``
(whole tables, no subsets) and applies one operator of the library.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.params import param_frame
from ..operators import checks, daily, diagnosis, payload, prepare, profile, search, sessions, sketches, templates
from ..session import prefer_rocksdb_state, scratch_path
from ..sources.adapter import campaigns_from_events, conversations_from_driver, logs_from_events
from ..sources.readers import (read_campaigns_array, read_campaigns_json, read_conversations_array, read_logs_csv,
                               read_logs_csv_split, read_processed)
from ..sources import sorted_export
from ..sources.staging import staged_tables
from ..sources.writers import export_csv, export_json_array, export_json_lines, read_alerts, write_alerts, write_processed
from ..streaming.alerts import error_windows, run_error_alert_sweep, sweep_error_counts
from ..streaming.dedup import first_deliveries, sweep_deliveries
from ..streaming import late
from ..streaming.orphans import sweep_orphan_changes, swept_orphans, sweep_orphan_conversations
from . import params as P

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str, keep_date: bool = False):
    t = staged_tables(spark, sf_dir, keep_date)
    return t["campaigns"], t["conversations"], t["logs"]


def _expected(spark: SparkSession) -> DataFrame:
    return param_frame(spark, P.EXPECTED, schemas.EXPECTED_CAMPAIGNS)


# --- sources ---------------------------------------------------------------

@register("load_campaigns")
def load_campaigns(spark, sf_dir):
    return _t(spark, sf_dir)[0]


@register("load_conversations")
def load_conversations(spark, sf_dir):
    return _t(spark, sf_dir)[1]


@register("load_logs")
def load_logs(spark, sf_dir):
    return _t(spark, sf_dir)[2]


@register("roundtrip_campaigns_json")
def roundtrip_campaigns_json(spark, sf_dir):
    """S1+S5: the whole campaign base exported as JSON lines and read back with
    the fixed schema (ids stay strings, timestamps keep microseconds)."""
    camp = _t(spark, sf_dir)[0]
    path = scratch_path(spark, "campaigns_json")
    export_json_lines(camp, path)
    return read_campaigns_json(spark, path, multi_line=False)


@register("roundtrip_logs_csv")
def roundtrip_logs_csv(spark, sf_dir):
    """S3+S5: the whole log base exported as CSV under the raw export's dotted
    column names (JSON cells with quotes and commas) and read back."""
    logs = _t(spark, sf_dir)[2]
    raw = logs.select("timestamp", "insertId", F.col("resource_type").alias("resource.type"),
                      F.col("message").alias("jsonPayload.message"))
    path = scratch_path(spark, "logs_csv")
    export_csv(raw, path)
    return read_logs_csv(spark, path)


@register("roundtrip_processed")
def roundtrip_processed(spark, sf_dir):
    """S4+S5: the campaigns written as a processed table and read again."""
    camp = _t(spark, sf_dir)[0]
    path = scratch_path(spark, "processed")
    write_processed(camp, path, "publish_time", ["session_id", "message_id"])
    return read_processed(spark, path).select(*camp.columns)


@register("roundtrip_campaigns_array")
def roundtrip_campaigns_array(spark, sf_dir):
    """S1 in the form of one JSON array a file, each file read by many tasks."""
    path = scratch_path(spark, "campaigns_array")
    export_json_array(_t(spark, sf_dir)[0], path, 2)
    return read_campaigns_array(spark, path)


@register("roundtrip_conversations_array")
def roundtrip_conversations_array(spark, sf_dir):
    """S2 in the form of one JSON array (beyond 1 GB several)."""
    path = scratch_path(spark, "conversations_array")
    export_json_array(_t(spark, sf_dir)[1], path)
    return read_conversations_array(spark, path)


@register("roundtrip_logs_csv_split")
def roundtrip_logs_csv_split(spark, sf_dir):
    """S3 with records that span lines, each file read by many tasks; every
    hundredth message gets a line feed and quotes that the reader must keep."""
    logs = _t(spark, sf_dir)[2]
    more = F.when(F.col("insertId").endswith("00"), F.concat("message", F.lit('\n"quoted", '), "message")).otherwise(F.col("message"))
    raw = logs.select("timestamp", "insertId", F.col("resource_type").alias("resource.type"), more.alias("jsonPayload.message"))
    path = scratch_path(spark, "logs_csv_split")
    export_csv(raw, path)
    return read_logs_csv_split(spark, path)


# --- profiling ---------------------------------------------------------------

@register("profile_table")
def profile_table(spark, sf_dir):
    camp, conv, logs = _t(spark, sf_dir)
    return (profile.profile_table(camp, "campaigns")
            .unionByName(profile.profile_table(conv, "conversations"))
            .unionByName(profile.profile_table(logs, "logs")))


@register("profile_columns")
def profile_columns(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir)[0], "campaigns")


@register("profile_columns_at_scale")
def profile_columns_at_scale(spark, sf_dir):
    """P9 in its at-scale mode (HyperLogLog distinct counts, no Expand); the
    approximate count is left out here so the exact parts stay checkable."""
    return profile.profile_columns(_t(spark, sf_dir)[0], "campaigns", exact=False).drop("n_distinct")


@register("distinct_counts_period")
def distinct_counts_period(spark, sf_dir):
    """P4 from stored daily sketches: the exact distinct counts of a period, and
    whether the merged sketches' estimate is within its stated bound of them."""
    camp = _t(spark, sf_dir)[0]
    path = scratch_path(spark, "sketches")
    sketches.write_sketches(camp, "publish_time", path)
    first, last = P.PERIOD
    estimated = sketches.distinct_counts(sketches.read_sketches(spark, path), first, last)
    day = F.to_date("publish_time")
    exact = profile.column_stats(camp.where((day >= F.lit(first)) & (day <= F.lit(last))))
    off = F.abs(F.col("e.n_distinct") - F.col("x.n_distinct"))
    return (estimated.alias("e").join(exact.alias("x"), "column_name")
            .select("column_name", "e.n_rows", "e.non_null", "x.n_distinct",
                    (off <= sketches.ERROR_BOUND * F.col("x.n_distinct")).alias("within_bound")))


@register("profile_columns_conversations")
def profile_columns_conversations(spark, sf_dir):
    return profile.profile_columns(_t(spark, sf_dir)[1], "conversations")


@register("constant_columns")
def constant_columns(spark, sf_dir):
    camp, conv, logs = _t(spark, sf_dir)
    return (profile.constant_columns(camp, "campaigns")
            .unionByName(profile.constant_columns(conv, "conversations"))
            .unionByName(profile.constant_columns(logs, "logs")))


@register("drop_constant_columns")
def drop_constant_columns(spark, sf_dir):
    return profile.drop_constant_columns(_t(spark, sf_dir)[2])[0]


@register("distinct_dates")
def distinct_dates(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return profile.distinct_dates(camp, "campaigns").unionByName(profile.distinct_dates(conv, "conversations"))


@register("distinct_versions")
def distinct_versions(spark, sf_dir):
    return profile.distinct_values(_t(spark, sf_dir)[0], "version")


@register("distinct_templates")
def distinct_templates(spark, sf_dir):
    return profile.distinct_strings_sorted(_t(spark, sf_dir)[0], "template")


# --- preparation -----------------------------------------------------------

@register("clean_campaigns")
def clean_campaigns(spark, sf_dir):
    return prepare.clean_campaigns(_t(spark, sf_dir)[0])


@register("clean_conversations")
def clean_conversations(spark, sf_dir):
    return prepare.clean_conversations(_t(spark, sf_dir)[1])


@register("conversations_with_campaigns")
def conversations_with_campaigns(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return prepare.conversations_with_campaigns(camp, conv)


@register("dispatch_for_conversation")
def dispatch_for_conversation(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return prepare.dispatch_for_conversation(camp, conv)


@register("latest_per_session")
def latest_per_session(spark, sf_dir):
    return prepare.latest_per_session(_t(spark, sf_dir)[0])


@register("conversation_sequence")
def conversation_sequence(spark, sf_dir):
    return prepare.conversation_sequence(_t(spark, sf_dir)[1])


@register("session_repeat_gaps")
def session_repeat_gaps(spark, sf_dir):
    return prepare.session_repeat_gaps(_t(spark, sf_dir)[0])


@register("sorted_export_positions")
def sorted_export_positions(spark, sf_dir):
    """O2: the sorted export of the conversations, each row's place in it told
    by the manifest."""
    path = scratch_path(spark, "sorted_export")
    sorted_export.write_sorted(_t(spark, sf_dir)[1], path, ["session_id", "publish_time", "message_id"])
    return sorted_export.with_positions(spark, path).select("session_id", "publish_time", "message_id", "position")


@register("logs_sample")
def logs_sample(spark, sf_dir):
    return prepare.logs_sample(_t(spark, sf_dir)[2], P.LOGS_SAMPLE_ROWS)


# --- keyword search --------------------------------------------------------

@register("keyword_flag")
def keyword_flag(spark, sf_dir):
    conv = prepare.clean_conversations(_t(spark, sf_dir)[1])
    return search.keyword_flag(conv, P.CONVERSATION_PATTERN, P.CONVERSATION_FLAG)


@register("keyword_conversations")
def keyword_conversations(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return search.keyword_conversations(prepare.clean_conversations(conv), camp,
                                        P.CONVERSATION_PATTERN, P.CONVERSATION_FLAG)


@register("keyword_logs")
def keyword_logs(spark, sf_dir):
    return search.keyword_logs(_t(spark, sf_dir)[2], P.LOG_PATTERN, P.LOG_FLAG)


@register("keyword_hits_multi")
def keyword_hits_multi(spark, sf_dir):
    conv = _t(spark, sf_dir)[1]
    return search.keyword_hits(conv, P.KEYWORDS, keep_cols=["session_id", "message_id"])


@register("keyword_hits_many")
def keyword_hits_many(spark, sf_dir):
    """F4 with 5,000 patterns in one scan, by the literals that they require."""
    conv = _t(spark, sf_dir)[1]
    return search.keyword_hits(conv, P.MANY_KEYWORDS, keep_cols=["session_id", "message_id"])


@register("keyword_linkage")
def keyword_linkage(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return search.keyword_linkage(conv, camp, P.KEYWORDS)


# --- sessions and keys -----------------------------------------------------

@register("session_messages")
def session_messages(spark, sf_dir):
    return sessions.session_messages(_t(spark, sf_dir)[0])


@register("session_messages_conv")
def session_messages_conv(spark, sf_dir):
    return sessions.session_messages(_t(spark, sf_dir)[1])


@register("session_duplicate_share")
def session_duplicate_share(spark, sf_dir):
    return sessions.session_duplicate_share(_t(spark, sf_dir)[0])


@register("session_duplicate_share_conv")
def session_duplicate_share_conv(spark, sf_dir):
    return sessions.session_duplicate_share(_t(spark, sf_dir)[1])


@register("top_sessions")
def top_sessions(spark, sf_dir):
    return sessions.top_sessions(_t(spark, sf_dir)[0], P.TOP_SESSIONS)


@register("clicks_by_source")
def clicks_by_source(spark, sf_dir):
    return sessions.clicks_by_source(_t(spark, sf_dir)[0])


@register("click_fill_rate")
def click_fill_rate(spark, sf_dir):
    return sessions.click_fill_rate(_t(spark, sf_dir)[0])


@register("join_key_audit")
def join_key_audit(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return sessions.join_key_audit(camp, conv, P.JOIN_KEYS)


@register("join_fanout")
def join_fanout(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return sessions.join_fanout(camp, conv, "session_id")


@register("daily_coverage")
def daily_coverage(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return sessions.daily_coverage(camp, conv)


# --- templates ---------------------------------------------------------------

@register("missing_templates")
def missing_templates(spark, sf_dir):
    return templates.missing_templates(_expected(spark), _t(spark, sf_dir)[0])


@register("similar_templates")
def similar_templates(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return templates.similar_templates(_expected(spark), camp, P.MAX_EDIT_DISTANCE, P.TOP_SIMILAR, conv)


@register("similar_templates_many")
def similar_templates_many(spark, sf_dir):
    """C7 with 20,000 expected names that share their beginning: the nearest of each."""
    names = spark.createDataFrame([(n, n) for n in P.MANY_NAMES], "campaign string, template string")
    return templates.similar_templates(names, _t(spark, sf_dir)[0], P.MANY_EDITS, 1).drop("campaign", "rank")


@register("similar_template_counts")
def similar_template_counts(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return templates.template_join_counts(camp, conv, P.SIMILAR_LIST)


@register("similar_template_detail")
def similar_template_detail(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir)
    return templates.similar_template_detail(camp, conv, P.SIMILAR_LIST)


# --- checks and alerts -----------------------------------------------------

@register("check_template_date")
def check_template_date(spark, sf_dir):
    return checks.check_template_date(_t(spark, sf_dir)[0])


@register("check_version")
def check_version(spark, sf_dir):
    return checks.latest_first(checks.check_version(_t(spark, sf_dir)[0]))


@register("check_template_date_as_of")
def check_template_date_as_of(spark, sf_dir):
    """C1 in its scheduled form: suffixes against one literal date."""
    return checks.check_template_date(_t(spark, sf_dir)[0], P.AS_OF)


@register("check_version_strict")
def check_version_strict(spark, sf_dir):
    """C2 as the prose has it: exactly three digits."""
    return checks.check_version(_t(spark, sf_dir)[0], strict=True)


@register("check_orphan_sessions_regex")
def check_orphan_sessions_regex(spark, sf_dir):
    """C3 with regex CTAs beside exact ones."""
    camp, conv, _ = _t(spark, sf_dir, keep_date=True)
    return checks.check_orphan_sessions(conv, camp, P.CTAS_MIXED, P.AS_OF, 0)


@register("check_orphan_sessions")
def check_orphan_sessions(spark, sf_dir):
    camp, conv, _ = _t(spark, sf_dir, keep_date=True)
    return checks.check_orphan_sessions(conv, camp, P.CTAS, P.AS_OF, P.ORPHAN_THRESHOLD)


def _stored_checks(spark, sf_dir) -> str:
    """All days but the last stored at once, the last by a run of its own, twice."""
    camp, conv, _ = _t(spark, sf_dir, keep_date=True)
    path = scratch_path(spark, "daily")
    first, last = camp.agg(F.min("publish_date"), F.max("publish_date")).first()
    daily.store_days(camp, conv, P.CTAS, path, first, last - dt.timedelta(days=1))
    for _ in range(2):
        daily.store_days(camp, conv, P.CTAS, path, last)
    return path


@register("check_version_daily")
def check_version_daily(spark, sf_dir):
    """C2 merged from stored daily partial results."""
    return daily.merged_versions(spark, _stored_checks(spark, sf_dir))


@register("check_orphan_sessions_daily")
def check_orphan_sessions_daily(spark, sf_dir):
    """C3 merged from stored daily partial results."""
    return daily.merged_orphans(spark, _stored_checks(spark, sf_dir), P.AS_OF, P.ORPHAN_THRESHOLD)


@register("error_rate_hourly")
def error_rate_hourly(spark, sf_dir):
    return checks.error_rate_hourly(_t(spark, sf_dir)[2], P.ERROR_RATE_THRESHOLD)


@register("alerts")
def alerts(spark, sf_dir):
    camp, conv, logs = _t(spark, sf_dir, keep_date=True)
    return checks.alerts(
        template_date=checks.check_template_date(camp.drop("publish_date")),
        version=checks.check_version(camp),
        orphans=checks.check_orphan_sessions(conv, camp, P.CTAS, P.AS_OF, P.ORPHAN_THRESHOLD),
        error_rate=checks.error_rate_hourly(logs, P.ERROR_RATE_THRESHOLD))


@register("alerts_table")
def alerts_table(spark, sf_dir):
    """S7+C5: the alerts written to the table, the run repeated, and read back."""
    path = scratch_path(spark, "alerts_table")
    found = alerts(spark, sf_dir)
    for _ in range(2):
        write_alerts(found, path, P.AS_OF.isoformat())
    return read_alerts(spark, path)


# --- payload triage ----------------------------------------------------------

@register("error_payloads")
def error_payloads(spark, sf_dir):
    return payload.error_payloads(_t(spark, sf_dir)[2])


@register("non_json_payloads")
def non_json_payloads(spark, sf_dir):
    return payload.non_json_payloads(_t(spark, sf_dir)[2])


@register("non_json_payloads_parser")
def non_json_payloads_parser(spark, sf_dir):
    return payload.non_json_payloads(_t(spark, sf_dir)[2], method="parser")


@register("payload_schema_violations")
def payload_schema_violations(spark, sf_dir):
    return payload.payload_schema_violations(_t(spark, sf_dir)[2], P.REQUIRED_FIELDS)


@register("cta_log_evidence")
def cta_log_evidence(spark, sf_dir):
    return payload.cta_log_evidence([e[2] for e in P.EXPECTED], _t(spark, sf_dir)[2])


@register("cta_log_evidence_many")
def cta_log_evidence_many(spark, sf_dir):
    """J9 with 20,000 CTAs in one scan, by their rarest grams."""
    return payload.cta_log_evidence(P.MANY_CTAS, _t(spark, sf_dir)[2])


# --- diagnosis (flagship) ----------------------------------------------------

@register("campaign_diagnosis")
def campaign_diagnosis(spark, sf_dir):
    camp, conv, logs = _t(spark, sf_dir, keep_date=True)
    return diagnosis.campaign_diagnosis(_expected(spark), camp, conv, logs,
                                        P.MAX_EDIT_DISTANCE).drop("hypotheses")


flagship = campaign_diagnosis


# --- generic operators on the untouched driver tables -------------------------

def _driver(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("profile_columns_orders")
def profile_columns_orders(spark, sf_dir):
    return profile.profile_columns(_driver(spark, sf_dir, "orders"), "orders")


@register("constant_columns_lineitem")
def constant_columns_lineitem(spark, sf_dir):
    tagged = _driver(spark, sf_dir, "lineitem").select("*", F.lit("tpch").alias("origin"))
    return profile.constant_columns(tagged, "lineitem")


@register("orders_per_customer")
def orders_per_customer(spark, sf_dir):
    return sessions.session_messages(_driver(spark, sf_dir, "orders"), key="o_custkey", item="o_orderkey")


@register("user_duplicate_share_events")
def user_duplicate_share_events(spark, sf_dir):
    return sessions.session_duplicate_share(_driver(spark, sf_dir, "events"), key="user_id")


@register("join_fanout_orders_lineitem")
def join_fanout_orders_lineitem(spark, sf_dir):
    return sessions.join_fanout(_driver(spark, sf_dir, "orders"), _driver(spark, sf_dir, "lineitem"),
                                "o_orderkey", "l_orderkey")


@register("latest_event_per_user")
def latest_event_per_user(spark, sf_dir):
    return prepare.latest_per_key(_driver(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@register("keyword_hits_documents")
def keyword_hits_documents(spark, sf_dir):
    return search.keyword_hits(_driver(spark, sf_dir, "documents"), P.DOCUMENT_KEYWORDS,
                               keep_cols=["doc_id", "lang"])


# --- streaming ---------------------------------------------------------------

def _driver_stream(spark, sf_dir, table):
    """A table as a stream, be it one file or a folder of part files."""
    prefer_rocksdb_state(spark)
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    ref = spark.read.parquet(path)
    # a pattern: the stream source takes a file by it as well as a folder
    return spark.readStream.schema(ref.schema).option("maxFilesPerTrigger", 1).parquet(path[:-1] + "[t]")


def _event_stream(spark, sf_dir):
    return _driver_stream(spark, sf_dir, "events")


@register("stream_error_rate")
def stream_error_rate(spark, sf_dir):
    """T1 end to end: the events are replayed as a stream (availableNow), the
    error counts of each micro-batch go to a table in the shared checkpoint
    folder, and the windows above the threshold are returned."""
    base = scratch_path(spark, "stream_error_rate")
    sweep_error_counts(logs_from_events(_event_stream(spark, sf_dir)), f"{base}/counts", f"{base}/_checkpoint")
    return error_windows(spark, f"{base}/counts", P.ERROR_RATE_THRESHOLD)


@register("stream_error_events")
def stream_error_events(spark, sf_dir):
    """T2 as a periodic sweep (T3): each error line becomes an alert row; a
    second sweep finds nothing new and adds nothing."""
    base = scratch_path(spark, "stream_error_events")
    for _ in range(2):
        run_error_alert_sweep(logs_from_events(_event_stream(spark, sf_dir)), f"{base}/alerts", f"{base}/_checkpoint")
    return spark.read.parquet(f"{base}/alerts")


@register("stream_late_rows")
def stream_late_rows(spark, sf_dir):
    """S6 as a live feed: the later half of the logs comes first, then the rest,
    whose rows behind the watermark are kept aside. Every row, and whether it was late."""
    logs = _t(spark, sf_dir)[2].select(*schemas.LOGS.fieldNames())
    base = scratch_path(spark, "stream_late_rows")
    split = late.LateSplit(spark, f"{base}/split", schemas.LOGS, "timestamp", P.LATE_AFTER)
    for part in (F.col("timestamp") >= F.lit(P.LATE_CUT), F.col("timestamp") < F.lit(P.LATE_CUT)):
        logs.where(part).repartition(2).write.mode("append").parquet(f"{base}/logs")
        split.sweep(late.read_log_stream(spark, f"{base}/logs"), f"{base}/_checkpoint")
    tables = [t.select("insertId", "timestamp", F.lit(was).alias("late")) for t, was in ((split.kept(), False), (split.late(), True))]
    return tables[0].unionByName(tables[1])


@register("stream_dedup_campaigns")
def stream_dedup_campaigns(spark, sf_dir):
    """T4 end to end: campaign dispatches replayed as a stream, each message_id's
    first delivery returned."""
    base = scratch_path(spark, "stream_dedup_campaigns")
    stream = campaigns_from_events(_event_stream(spark, sf_dir)).select(*schemas.CAMPAIGNS.fieldNames())
    sweep_deliveries(stream, f"{base}/deliveries", f"{base}/_checkpoint")
    return first_deliveries(spark, f"{base}/deliveries", schemas.CAMPAIGNS)


@register("stream_orphan_conversations")
def stream_orphan_conversations(spark, sf_dir):
    """T5 end to end (C3 live): conversations replayed as a stream; the messages
    with a known CTA whose session has no campaign are returned."""
    conv = conversations_from_driver(_driver_stream(spark, sf_dir, "conversations"))
    base = scratch_path(spark, "stream_orphan_conversations")
    sweep_orphan_conversations(conv, lambda: _t(spark, sf_dir)[0], [c for c, m in P.CTAS if m == "exact"],
                               base, f"{base}/_checkpoint")
    return swept_orphans(spark, base)


@register("stream_orphan_changes")
def stream_orphan_changes(spark, sf_dir):
    """T5 with withdrawals: all conversations are swept first, from several
    files dealt at random, then the campaigns come in the same way and withdraw
    the orphans that they explain. Every CTA message with its state at the end."""
    camp, conv, _ = _t(spark, sf_dir)
    prefer_rocksdb_state(spark)
    base = scratch_path(spark, "stream_orphan_changes")
    camp.limit(0).write.parquet(f"{base}/campaigns")
    conv.repartition(2).write.parquet(f"{base}/conversations")

    def source(table):
        return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)

    def sweep():
        return sweep_orphan_changes(source(conv).parquet(f"{base}/conversations"), source(camp).parquet(f"{base}/campaigns"),
                                    [c for c, m in P.CTAS if m == "exact"], f"{base}/state", f"{base}/_checkpoint")

    sweep()
    camp.repartition(2).write.mode("append").parquet(f"{base}/campaigns")
    return sweep().messages()
