"""Fixed schemas of the logical tables (ids are always strings, never inferred)."""

from pyspark.sql import types as T

CAMPAIGNS = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("message_id", T.StringType()),
    T.StructField("template", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("channel_client_id", T.StringType()),
    T.StructField("publish_time", T.TimestampNTZType()),
    T.StructField("ctwa_clid", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("attributes", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("subscription_name", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("attributes", T.StringType()),
    T.StructField("subscription_name", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("publish_time", T.TimestampNTZType()),
])

# Raw log export: flattened JSON, so two column names contain dots.
LOGS_RAW = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("insertId", T.StringType()),
    T.StructField("resource.type", T.StringType()),
    T.StructField("jsonPayload.message", T.StringType()),
])

# Logical logs table after load: dotted names renamed.
LOGS = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("insertId", T.StringType()),
    T.StructField("resource_type", T.StringType()),
    T.StructField("message", T.StringType()),
])

LOG_RENAMES = {"resource.type": "resource_type", "jsonPayload.message": "message"}

EXPECTED_CAMPAIGNS = T.StructType([
    T.StructField("campaign", T.StringType(), False),
    T.StructField("template", T.StringType()),
    T.StructField("cta", T.StringType()),
    T.StructField("dispatch_date", T.DateType()),
    T.StructField("send_type", T.IntegerType()),
])

CTAS = T.StructType([
    T.StructField("cta", T.StringType(), False),
    T.StructField("match", T.StringType(), False),  # 'exact' | 'regex'
])

KEYWORDS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
])
