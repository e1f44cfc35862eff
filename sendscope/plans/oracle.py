"""DuckDB oracle SQL for every registered query.

Written independently of the Spark operators, in the literal form the
investigation used (materialised joins, LEFT JOIN … IS NULL, QUALIFY, one
statement per pattern), over the driver's pre-registered views.
"""

from __future__ import annotations

import datetime as dt

from . import params as P

# Logical bases derived from the driver views (same mapping as sources/adapter.py).
BASES = r"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
camp AS (
  SELECT 's' || CAST(CASE WHEN event_id % 7 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS session_id,
         CAST(event_id AS VARCHAR) AS message_id,
         'crm_' || event_type || '_' || CASE WHEN k % 20 = 0 THEN 'at'
                                             WHEN k % 10 = 0 THEN strftime(ts - INTERVAL 9 DAY, '%d%m')
                                             ELSE strftime(ts, '%d%m') END AS template,
         CASE WHEN event_type = 'click' THEN 'meta' ELSE 'crm' END AS source,
         'wa' AS channel_client_id,
         ts AS publish_time,
         CASE WHEN event_type = 'click' THEN 'clid' || CAST(event_id % 97 AS VARCHAR) END AS ctwa_clid,
         CASE WHEN event_id % 50 = 0 THEN '1' WHEN event_id % 50 = 1 THEN NULL
              ELSE 'sendtype-' || CAST(800 + k AS VARCHAR) END AS version,
         props AS attributes,
         CAST(NULL AS VARCHAR) AS data,
         'campaign-source-topic' AS subscription_name
  FROM ev),
conv AS (
  SELECT 's' || CAST(conv_id AS VARCHAR) AS session_id,
         'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id,
         CASE WHEN turn = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'Talk to an agent' ELSE 'Buy now' END
              ELSE text END AS text,
         role AS author, 'wa' AS user_id, CAST(NULL AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS attributes,
         'conversation-topic' AS subscription_name, 'text' AS media_type,
         TIMESTAMP '2024-01-20 00:00:00' + to_minutes(CAST(conv_id % 1440 AS INTEGER)) + to_seconds(turn) AS publish_time
  FROM conversations),
logs AS (
  SELECT ts AS "timestamp", 'l' || CAST(event_id AS VARCHAR) AS "insertId", 'gce_instance' AS resource_type,
         CASE WHEN event_type = 'error' AND k % 2 = 0
                THEN 'It is not a JSON type and cannot be deserialized: ' ||
                     CASE WHEN k % 4 = 0 THEN 'Buy now' ELSE 'Talk to an agent' END
              WHEN event_type = 'error' THEN 'upstream timeout ' || props
              ELSE props END AS message
  FROM ev)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _expected_values() -> str:
    rows = ", ".join(f"({_q(c)}, {_q(t)}, {_q(cta)}, DATE '{d.isoformat()}', {st})"
                     for c, t, cta, d, st in P.EXPECTED)
    return f"expected AS (SELECT * FROM (VALUES {rows}) v(campaign, template, cta, dispatch_date, send_type))"


def _with(*extra: str) -> str:
    return "WITH " + ",\n".join([BASES.strip(), *extra]) + "\n"


CAMP_COLS = [("session_id", "string"), ("message_id", "string"), ("template", "string"),
             ("source", "string"), ("channel_client_id", "string"), ("publish_time", "timestamp_ntz"),
             ("ctwa_clid", "string"), ("version", "string"), ("attributes", "string"),
             ("data", "string"), ("subscription_name", "string")]
CONV_COLS = ["session_id", "message_id", "text", "author", "user_id", "data", "attributes",
             "subscription_name", "media_type", "publish_time"]
LOG_COLS = ["timestamp", "insertId", "resource_type", "message"]


def _nunique_with_null(c: str) -> str:
    return f'COUNT(DISTINCT "{c}") + CASE WHEN COUNT("{c}") < COUNT(*) THEN 1 ELSE 0 END'


def _profile_columns(table: str = "campaigns", view: str = "camp", cols=None, with_bases: bool = True) -> str:
    parts = []
    for i, (c, t) in enumerate(cols or CAMP_COLS):
        parts.append(
            f"SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, "
            f'COUNT(*) AS n_rows, COUNT("{c}") AS non_null, COUNT(DISTINCT "{c}") AS n_distinct, '
            f"CASE WHEN COUNT(\"{c}\") = 0 THEN 'all_null' WHEN {_nunique_with_null(c)} <= 1 THEN 'constant' "
            f"ELSE 'varying' END AS verdict FROM {view}")
    return (_with() if with_bases else "") + "\nUNION ALL\n".join(parts)


def _constant_columns(tables=None, with_bases: bool = True) -> str:
    parts = []
    for table, view, cols in tables or [("campaigns", "camp", [c for c, _ in CAMP_COLS]),
                                        ("conversations", "conv", CONV_COLS), ("logs", "logs", LOG_COLS)]:
        for i, c in enumerate(cols):
            parts.append(
                f"SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS column_name, "
                f"CASE WHEN COUNT(\"{c}\") = 0 THEN 'all_null' ELSE 'single_value' END AS reason "
                f"FROM {view} HAVING {_nunique_with_null(c)} <= 1")
    return (_with() if with_bases else "") + "\nUNION ALL\n".join(parts)


def _repeat_share(view: str, key: str) -> str:
    """How many keys occur more than once, of all, from one count per key."""
    return f"""
SELECT COUNT(*) FILTER (WHERE times > 1) AS n_duplicated, COUNT(*) AS n_sessions,
       CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE times > 1) / NULLIF(COUNT(*), 0), 2) AS DOUBLE) AS pct_duplicated
FROM (SELECT {key}, COUNT(*) AS times FROM {view} WHERE {key} IS NOT NULL GROUP BY {key}) per_key"""


def _keyword_union(cols: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {cols}, {_q(n)} AS keyword FROM conv WHERE regexp_matches(text, {_q(p)})"
        for n, p in P.KEYWORDS)


def _in_list(values) -> str:
    return ", ".join(_q(v) for v in values)


CONV_SQL_PATTERN = _q(P.CONVERSATION_PATTERN)
LOG_SQL_PATTERN = _q(P.LOG_PATTERN)
SUFFIX = r"regexp_extract(template, '(\d{4})$', 1)"

CHECK_TEMPLATE_DATE = f"""
SELECT session_id, template, dispatch_date, suffix_ddmm, suffix_date, reference_date,
       CASE WHEN suffix_date IS NULL THEN 'invalid_suffix' ELSE 'date_mismatch' END AS issue
FROM (
  SELECT session_id, template, CAST(publish_time AS DATE) AS dispatch_date,
         {SUFFIX} AS suffix_ddmm,
         CAST(try_strptime(CAST(year(publish_time) AS VARCHAR) || {SUFFIX}, '%Y%d%m') AS DATE) AS suffix_date,
         CAST(publish_time AS DATE) AS reference_date
  FROM camp) x
WHERE suffix_ddmm <> '' AND (suffix_date IS NULL OR suffix_date <> reference_date)"""

CHECK_VERSION = """
SELECT template, version, COUNT(*) AS n_dispatches, MIN(publish_time) AS first_dispatch
FROM camp GROUP BY ALL
HAVING NOT COALESCE(starts_with(version, 'sendtype-'), false)"""

CHECK_ORPHANS = f"""
SELECT text AS cta, COUNT(*) AS orphan_messages, COUNT(DISTINCT session_id) AS orphan_sessions,
       MIN(publish_time) AS first_seen
FROM conv
WHERE text IN ({_in_list(c for c, m in P.CTAS if m == 'exact')})
  AND CAST(publish_time AS DATE) = DATE '{P.AS_OF - dt.timedelta(days=1)}'
  AND NOT EXISTS (SELECT 1 FROM camp WHERE camp.session_id = conv.session_id)
GROUP BY text
HAVING orphan_messages > {P.ORPHAN_THRESHOLD}"""

ERROR_RATE = f"""
SELECT date_trunc('hour', "timestamp") AS window_start,
       date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
       COUNT(*) AS n_errors
FROM logs
WHERE resource_type = 'gce_instance' AND regexp_matches(message, 'cannot be deserialized')
GROUP BY 1, 2
HAVING COUNT(*) > {P.ERROR_RATE_THRESHOLD}"""

ALL_CTAS = sorted({e[2] for e in P.EXPECTED})

ORACLE_SQL: dict[str, str] = {
    "load_campaigns": _with() + "SELECT * FROM camp",
    "load_conversations": _with() + "SELECT * FROM conv",
    "load_logs": _with() + "SELECT * FROM logs",
    "profile_table": _with() + f"""
SELECT 'campaigns' AS table_name, COUNT(*) AS n_rows, CAST({len(CAMP_COLS)} AS BIGINT) AS n_columns FROM camp
UNION ALL SELECT 'conversations', COUNT(*), {len(CONV_COLS)} FROM conv
UNION ALL SELECT 'logs', COUNT(*), {len(LOG_COLS)} FROM logs""",
    "profile_columns": _profile_columns(),
    "constant_columns": _constant_columns(),
    "drop_constant_columns": _with() + 'SELECT "timestamp", "insertId", message FROM logs',
    "distinct_dates": _with() + """
SELECT DISTINCT 'campaigns' AS table_name, CAST(publish_time AS DATE) AS publish_date FROM camp
UNION ALL
SELECT DISTINCT 'conversations', CAST(publish_time AS DATE) FROM conv""",
    "distinct_versions": _with() + "SELECT DISTINCT version FROM camp",
    "distinct_templates": _with() + "SELECT DISTINCT CAST(template AS VARCHAR) AS template FROM camp ORDER BY 1",
    "clean_campaigns": _with() + "SELECT session_id, message_id, template, publish_time FROM camp",
    "clean_conversations": _with() + "SELECT session_id, message_id, text, publish_time FROM conv",
    # output names: fixed values of the export
    "conversations_with_campaigns": _with() + """
SELECT camp.session_id, camp.publish_time AS publish_time_campanha, camp.message_id AS message_id_campanha, template, text,
       conv.publish_time AS publish_time_conversa, conv.message_id AS message_id_conversa
FROM camp JOIN conv ON camp.session_id = conv.session_id""",
    "latest_per_session": _with() + """
SELECT * FROM camp
QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY publish_time DESC, message_id DESC) = 1""",
    "conversation_sequence": _with() + """
SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY publish_time, message_id) AS seq FROM conv""",
    "session_repeat_gaps": _with() + """
SELECT session_id, seq, message_id, prev_message_id,
       date_diff('microsecond', prev_publish_time, publish_time) AS gap_us,
       COALESCE(template = prev_template, false) AS same_template
FROM (
  SELECT session_id, message_id, publish_time, template,
         ROW_NUMBER() OVER w AS seq, LAG(message_id) OVER w AS prev_message_id,
         LAG(publish_time) OVER w AS prev_publish_time, LAG(template) OVER w AS prev_template
  FROM camp WINDOW w AS (PARTITION BY session_id ORDER BY publish_time, message_id)) x
WHERE prev_message_id IS NOT NULL""",
    "logs_sample": _with() + f'SELECT * FROM logs ORDER BY "timestamp", "insertId" LIMIT {P.LOGS_SAMPLE_ROWS}',
    "keyword_flag": _with() + f"""
SELECT session_id, message_id, text, publish_time,
       CASE WHEN regexp_matches(text, {CONV_SQL_PATTERN}) THEN 'sim' ELSE 'não' END AS {P.CONVERSATION_FLAG}
FROM conv""",
    "keyword_conversations": _with() + f"""
SELECT session_id, message_id, text, publish_time, 'sim' AS {P.CONVERSATION_FLAG},
       CASE WHEN EXISTS (FROM camp WHERE camp.session_id = conv.session_id) THEN session_id END AS session_campanha
FROM conv WHERE regexp_matches(text, {CONV_SQL_PATTERN})""",
    "keyword_logs": _with() + f"""
SELECT *, 'sim' AS {P.LOG_FLAG} FROM logs WHERE regexp_matches(message, {LOG_SQL_PATTERN})""",
    "keyword_hits_multi": _with() + _keyword_union("session_id, message_id"),
    "keyword_linkage": _with(
        f"found AS ({_keyword_union('session_id, EXISTS (FROM camp WHERE camp.session_id = conv.session_id) AS linked')})",
        "asked AS (SELECT unnest([" + _in_list(n for n, _ in P.KEYWORDS) + "]) AS keyword)") + """
SELECT asked.keyword, COUNT(found.linked) AS n_hits, COUNT(*) FILTER (WHERE linked) AS n_linked,
       COUNT(*) FILTER (WHERE NOT linked) AS n_unlinked, COUNT(DISTINCT session_id) AS n_sessions
FROM asked LEFT JOIN found USING (keyword) GROUP BY asked.keyword""",
    "session_messages": _with() + """
SELECT session_id, COUNT(DISTINCT message_id) AS n_messages FROM camp GROUP BY session_id
HAVING COUNT(DISTINCT message_id) > 1 ORDER BY n_messages DESC""",
    "session_messages_conv": _with() + """
SELECT session_id, COUNT(DISTINCT message_id) AS n_messages FROM conv GROUP BY session_id
HAVING COUNT(DISTINCT message_id) > 1 ORDER BY n_messages DESC""",
    "session_duplicate_share": _with() + _repeat_share("camp", "session_id"),
    "session_duplicate_share_conv": _with() + _repeat_share("conv", "session_id"),
    "top_sessions": _with() + f"""
SELECT session_id, COUNT(DISTINCT message_id) AS n_messages FROM camp GROUP BY session_id
HAVING COUNT(DISTINCT message_id) > 1 ORDER BY n_messages DESC, session_id LIMIT {P.TOP_SESSIONS}""",
    "clicks_by_source": _with() + """
SELECT source, COUNT(DISTINCT ctwa_clid) AS n_distinct_clid FROM camp GROUP BY source""",
    "click_fill_rate": _with() + """
SELECT source, COUNT(*) AS n_rows, COUNT(ctwa_clid) AS n_with_clid,
       CAST(ROUND(COUNT(ctwa_clid) / COUNT(*), 4) AS DOUBLE) AS fill_rate
FROM camp GROUP BY source""",
    "join_key_audit": _with() + "\nUNION ALL\n".join(
        f"SELECT '{k}' AS join_key, COUNT(DISTINCT camp.{k}) AS matching_keys, COUNT(*) AS join_rows "
        f"FROM camp JOIN conv con ON con.{k} = camp.{k}" for k in P.JOIN_KEYS),
    "join_fanout": _with(
        "l AS (SELECT session_id, COUNT(*) AS n_left FROM camp WHERE session_id IS NOT NULL GROUP BY 1)",
        "r AS (SELECT session_id, COUNT(*) AS n_right FROM conv WHERE session_id IS NOT NULL GROUP BY 1)") + """
SELECT COUNT(*) AS matching_keys,
       (SELECT COUNT(*) FROM camp JOIN conv ON conv.session_id = camp.session_id) AS join_rows,
       COUNT(*) FILTER (WHERE n_left > 1 AND n_right > 1) AS nm_keys,
       COUNT(*) FILTER (WHERE n_left > 1) AS left_dup_keys,
       COUNT(*) FILTER (WHERE n_right > 1) AS right_dup_keys
FROM l JOIN r ON l.session_id = r.session_id""",
    "daily_coverage": _with(
        "a AS (SELECT CAST(publish_time AS DATE) AS d, COUNT(*) AS n FROM camp GROUP BY 1)",
        "b AS (SELECT CAST(publish_time AS DATE) AS d, COUNT(*) AS n FROM conv GROUP BY 1)") + """
SELECT COALESCE(a.d, b.d) AS publish_date, COALESCE(a.n, 0) AS n_campaign_rows,
       COALESCE(b.n, 0) AS n_conversation_rows,
       CASE WHEN b.n IS NULL THEN 'conversations' WHEN a.n IS NULL THEN 'campaigns' END AS missing_in
FROM a FULL OUTER JOIN b ON a.d = b.d""",
    "missing_templates": _with(_expected_values()) + """
SELECT campaign, template FROM expected e
WHERE NOT EXISTS (SELECT 1 FROM camp WHERE camp.template = e.template)""",
    "similar_templates": _with(
        _expected_values(),
        "t AS (SELECT DISTINCT template FROM camp WHERE template IS NOT NULL)",
        f"""c AS (SELECT e.campaign, e.template AS expected_template, t.template AS similar_template,
                  CAST(levenshtein(t.template, e.template) AS INTEGER) AS distance
           FROM expected e, t
           WHERE levenshtein(t.template, e.template) BETWEEN 1 AND {P.MAX_EDIT_DISTANCE})""") + f"""
SELECT top.*, COALESCE(j.n, 0) AS n_linked_rows
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY campaign ORDER BY distance, similar_template) AS INTEGER) AS rank
      FROM c QUALIFY rank <= {P.TOP_SIMILAR}) top
LEFT JOIN (SELECT camp.template, COUNT(*) AS n FROM camp JOIN conv ON conv.session_id = camp.session_id
           GROUP BY camp.template) j ON j.template = top.similar_template""",
    "similar_template_counts": _with() + f"""
SELECT camp.template, COUNT(*) AS n_rows
FROM camp JOIN conv ON conv.session_id = camp.session_id
WHERE camp.template IN ({_in_list(P.SIMILAR_LIST)})
GROUP BY camp.template""",
    "similar_template_detail": _with() + f"""
SELECT camp.session_id, camp.publish_time AS publish_time_campanha, camp.message_id AS message_id_campanha,
       camp.template, con.text, con.publish_time AS publish_time_conversa, con.message_id AS message_id_conversa
FROM camp JOIN conv con ON con.session_id = camp.session_id
WHERE camp.template IN ({_in_list(P.SIMILAR_LIST)})""",
    "check_template_date": _with() + CHECK_TEMPLATE_DATE,
    "check_version": _with() + CHECK_VERSION,
    "check_orphan_sessions": _with() + CHECK_ORPHANS,
    "error_rate_hourly": _with() + ERROR_RATE,
    "check_template_date_as_of": _with() + f"""
SELECT session_id, template, CAST(publish_time AS DATE) AS dispatch_date, right(template, 4) AS suffix_ddmm,
       CAST(try_strptime('{P.AS_OF.year}' || right(template, 4), '%Y%d%m') AS DATE) AS suffix_date,
       DATE '{P.AS_OF}' AS reference_date,
       CASE WHEN suffix_date IS NULL THEN 'invalid_suffix' ELSE 'date_mismatch' END AS issue
FROM camp
WHERE regexp_matches(template, '[0-9]{{4}}$') AND suffix_date IS DISTINCT FROM reference_date""",
    "check_version_strict": _with() + """
SELECT template, version, COUNT(*) AS n_dispatches, MIN(publish_time) AS first_dispatch
FROM camp GROUP BY ALL
HAVING NOT COALESCE(regexp_full_match(version, 'sendtype-[0-9]{3}'), false)""",
    "check_orphan_sessions_regex": _with(
        "cta AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(c)}, {_q(m)})" for c, m in P.CTAS_MIXED) + ") v(cta, how))") + f"""
SELECT cta, COUNT(*) AS orphan_messages, COUNT(DISTINCT session_id) AS orphan_sessions, MIN(publish_time) AS first_seen
FROM conv, cta
WHERE CASE how WHEN 'exact' THEN text = cta ELSE regexp_matches(text, cta) END
  AND CAST(publish_time AS DATE) = DATE '{P.AS_OF - dt.timedelta(days=1)}'
  AND session_id NOT IN (SELECT session_id FROM camp WHERE session_id IS NOT NULL)
GROUP BY cta""",
    "stream_error_events": _with() + """
SELECT 'error_event' AS check_name, 'cannot be deserialized' AS entity, 'critical' AS severity,
       CAST(1 AS BIGINT) AS n_rows, "timestamp" AS first_seen, "insertId", message
FROM logs WHERE resource_type = 'gce_instance' AND contains(message, 'cannot be deserialized')""",
    "alerts": _with(f"c1 AS ({CHECK_TEMPLATE_DATE})", f"c2 AS ({CHECK_VERSION})",
                    f"c3 AS ({CHECK_ORPHANS})", f"c4 AS ({ERROR_RATE})") + """
SELECT 'template_date' AS check_name, template AS entity, 'attention' AS severity, COUNT(*) AS n_rows,
       CAST(MIN(dispatch_date) AS TIMESTAMP) AS first_seen FROM c1 GROUP BY template
UNION ALL
SELECT 'version', template || ' / ' || COALESCE(version, 'NULL'), 'attention', n_dispatches, first_dispatch FROM c2
UNION ALL
SELECT 'orphan_sessions', cta, 'critical', orphan_messages, first_seen FROM c3
UNION ALL
SELECT 'error_rate', 'cannot be deserialized', 'critical', n_errors, window_start FROM c4""",
    "error_payloads": _with() + """
SELECT regexp_extract(message, '(?s)cannot be deserialized: (.*)', 1) AS payload, COUNT(*) AS n_errors,
       MIN("timestamp") AS first_seen, MAX("timestamp") AS last_seen
FROM logs WHERE message LIKE '%cannot be deserialized%' GROUP BY 1""",
    "non_json_payloads": _with() + r"""
SELECT "timestamp", "insertId", message FROM logs WHERE NOT regexp_matches(message, '^[ \t\n\r]*[{\[]')""",
    "payload_schema_violations": _with() + """
SELECT "timestamp", "insertId", message, 'k' AS missing_fields FROM logs
WHERE TRY_CAST(CASE WHEN json_valid(message) THEN json_extract_string(message, '$.k') END AS INTEGER) IS NULL""",
    "cta_log_evidence": _with("c AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(c)})" for c in ALL_CTAS)
                              + ") v(cta))") + """
SELECT c.cta, COUNT(l.message) AS n_log_hits,
       COUNT(l.message) FILTER (WHERE contains(l.message, 'cannot be deserialized')) AS n_error_hits,
       MIN(l."timestamp") AS first_seen
FROM c LEFT JOIN logs l ON contains(l.message, c.cta)
GROUP BY c.cta""",
    "campaign_diagnosis": _with(
        _expected_values(),
        "t AS (SELECT DISTINCT template FROM camp WHERE template IS NOT NULL)",
        f"""cand AS (SELECT e.campaign, t.template AS similar_template,
                     levenshtein(t.template, e.template) AS d
              FROM expected e, t WHERE levenshtein(t.template, e.template) BETWEEN 1 AND {P.MAX_EDIT_DISTANCE})""",
        "sim AS (SELECT campaign, COUNT(*) AS n_similar, MIN(d) AS best_distance FROM cand GROUP BY campaign)",
        """best AS (SELECT c.campaign, MIN(c.similar_template) AS best_similar
              FROM cand c JOIN sim s ON c.campaign = s.campaign AND c.d = s.best_distance GROUP BY c.campaign)""",
        """evid AS (SELECT e.cta, COUNT(l.message) AS n_log_hits,
                     COUNT(l.message) FILTER (WHERE contains(l.message, 'cannot be deserialized')) AS n_error_hits
              FROM (SELECT DISTINCT cta FROM expected) e LEFT JOIN logs l ON contains(l.message, e.cta)
              GROUP BY e.cta)""",
        """links AS (SELECT e.cta, COUNT(DISTINCT session_id) FILTER (WHERE EXISTS (FROM camp WHERE camp.session_id = conv.session_id)) AS linked,
                      COUNT(DISTINCT session_id) AS both_kinds
               FROM (SELECT DISTINCT cta FROM expected) e JOIN conv ON contains(conv.text, e.cta) GROUP BY e.cta)""",
        "sent AS (SELECT template, CAST(publish_time AS DATE) AS d, COUNT(*) AS n FROM camp GROUP BY ALL)",
        "cd AS (SELECT CAST(publish_time AS DATE) AS d, COUNT(*) AS n FROM conv GROUP BY 1)",
        """x AS (SELECT e.campaign, e.template, e.cta, e.dispatch_date, e.send_type,
                    EXISTS (SELECT 1 FROM t WHERE t.template = e.template) AS template_exists,
                    COALESCE(sim.n_similar, 0) AS n_similar, best.best_similar,
                    CAST(sim.best_distance AS INTEGER) AS best_distance,
                    COALESCE(evid.n_log_hits, 0) AS n_log_hits, COALESCE(evid.n_error_hits, 0) AS n_error_hits,
                    COALESCE(links.linked, 0) AS n_cta_linked,
                    COALESCE(links.both_kinds - links.linked, 0) AS n_cta_unlinked,
                    COALESCE(sent.n, 0) AS n_dispatched_on_date, sent.n IS NOT NULL AS dispatched,
                    COALESCE(cd.n, 0) AS n_conversations_on_date
             FROM expected e
             LEFT JOIN sim ON sim.campaign = e.campaign
             LEFT JOIN best ON best.campaign = e.campaign
             LEFT JOIN evid ON evid.cta = e.cta
             LEFT JOIN links ON links.cta = e.cta
             LEFT JOIN sent ON sent.template = e.template AND sent.d = e.dispatch_date
             LEFT JOIN cd ON cd.d = e.dispatch_date)""") + """
SELECT *, concat_ws(',',
         CASE WHEN NOT template_exists AND n_similar > 0 THEN 'wrong_name' END,
         CASE WHEN NOT template_exists AND n_similar = 0 THEN 'not_registered' END,
         CASE WHEN n_error_hits > 0 THEN 'payload_error' END,
         CASE WHEN n_log_hits > 0 AND NOT template_exists AND n_similar > 0 THEN 'api_failure_possible' END,
         CASE WHEN n_conversations_on_date = 0 THEN 'incomplete_data' END) AS hypotheses_text
FROM x""",
    "stream_error_rate": _with(
        """err AS (SELECT "timestamp" FROM logs
               WHERE resource_type = 'gce_instance' AND contains(message, 'cannot be deserialized'))""",
        """w AS (SELECT date_trunc('hour', "timestamp") AS window_start, COUNT(*) AS n_errors
             FROM err GROUP BY 1)""") + f"""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n_errors FROM w
WHERE n_errors > {P.ERROR_RATE_THRESHOLD}""",
}

ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

ORACLE_SQL.update({
    "profile_columns_orders": _profile_columns("orders", "orders", ORDERS_COLS, with_bases=False),
    "constant_columns_lineitem": _constant_columns(
        [("lineitem", "(SELECT *, 'tpch' AS origin FROM lineitem) tagged", [*LINEITEM_COLS, "origin"])], with_bases=False),
    "orders_per_customer": """
SELECT o_custkey, COUNT(DISTINCT o_orderkey) AS n_messages FROM orders GROUP BY o_custkey
HAVING COUNT(DISTINCT o_orderkey) > 1""",
    "user_duplicate_share_events": _repeat_share("events", "user_id"),
    "join_fanout_orders_lineitem": """
WITH l AS (SELECT o_orderkey AS k, COUNT(*) AS n_left FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1),
r AS (SELECT l_orderkey AS k, COUNT(*) AS n_right FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1)
SELECT COUNT(*) AS matching_keys,
       (SELECT COUNT(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS join_rows,
       COUNT(*) FILTER (WHERE n_left > 1 AND n_right > 1) AS nm_keys,
       COUNT(*) FILTER (WHERE n_left > 1) AS left_dup_keys,
       COUNT(*) FILTER (WHERE n_right > 1) AS right_dup_keys
FROM l JOIN r ON l.k = r.k""",
    "latest_event_per_user": """
SELECT * FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "keyword_hits_documents": "\nUNION ALL\n".join(
        f"SELECT doc_id, lang, {_q(n)} AS keyword FROM documents WHERE regexp_matches(text, {_q(p)})"
        for n, p in P.DOCUMENT_KEYWORDS),
})

ORACLE_SQL["stream_dedup_campaigns"] = _with() + """
SELECT * FROM camp QUALIFY ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY publish_time) = 1"""

ORACLE_SQL["stream_orphan_conversations"] = _with() + f"""
SELECT c.session_id, c.message_id, c.text AS cta, c.publish_time FROM conv c
WHERE c.text IN ({_in_list(c for c, m in P.CTAS if m == 'exact')})
  AND NOT EXISTS (SELECT 1 FROM camp WHERE camp.session_id = c.session_id)"""

ORACLE_SQL["non_json_payloads_parser"] = _with() + """
SELECT "timestamp", "insertId", message FROM logs WHERE message IS NOT NULL AND NOT json_valid(message)"""

ORACLE_SQL["roundtrip_campaigns_json"] = _with() + "SELECT * FROM camp"
ORACLE_SQL["roundtrip_logs_csv"] = _with() + "SELECT * FROM logs"

ORACLE_SQL["dispatch_for_conversation"] = _with() + """
SELECT session_id, message_id_conversa, text, publish_time_conversa, message_id_campanha,
       publish_time_campanha, template
FROM (
  SELECT c.session_id, c.message_id AS message_id_conversa, c.text, c.publish_time AS publish_time_conversa,
         k.message_id AS message_id_campanha, k.publish_time AS publish_time_campanha, k.template,
         ROW_NUMBER() OVER (PARTITION BY c.message_id
                            ORDER BY k.publish_time DESC NULLS LAST, k.message_id DESC NULLS LAST) AS rn
  FROM conv c LEFT JOIN camp k ON k.session_id = c.session_id AND k.publish_time <= c.publish_time) x
WHERE rn = 1"""

ORACLE_SQL["profile_columns_conversations"] = _profile_columns(
    "conversations", "conv",
    [(c, "timestamp_ntz" if c == "publish_time" else "string") for c in CONV_COLS])

ORACLE_SQL["profile_columns_at_scale"] = (
    "SELECT table_name, ordinal, column_name, data_type, n_rows, non_null, verdict FROM ("
    + _profile_columns() + ") p")

ORACLE_SQL["alerts_table"] = f"""
SELECT *, DATE '{P.AS_OF}' AS run_date, 'checks' AS run_id FROM ({ORACLE_SQL["alerts"]}) found"""

ORACLE_SQL["stream_orphan_changes"] = _with() + f"""
SELECT c.session_id, c.message_id, c.text AS cta, c.publish_time,
       CASE WHEN c.session_id IN (SELECT session_id FROM camp WHERE session_id IS NOT NULL)
            THEN 'withdrawn' ELSE 'orphan' END AS state
FROM conv c WHERE c.text IN ({_in_list(c for c, m in P.CTAS if m == 'exact')})"""

ORACLE_SQL["keyword_hits_many"] = _with() + f"""
SELECT c.session_id, c.message_id, h.head || '_' || t.tail AS keyword
FROM conv c, (SELECT unnest([{_in_list(P.HEADS)}]) AS head) h, (SELECT unnest([{_in_list(P.TAILS)}]) AS tail) t
WHERE contains(lower(c.text), h.head) AND contains(lower(c.text), t.tail)
  AND regexp_matches(c.text, '(?i)\\b' || h.head || '\\w*\\s+' || t.tail)"""

ORACLE_SQL["cta_log_evidence_many"] = _with(
    "lines AS (SELECT message, COUNT(*) AS n, MIN(timestamp) AS first_seen FROM logs GROUP BY message)",
    f"""c AS (SELECT '"k": ' || CAST(i AS VARCHAR) AS cta FROM range({len(P.MANY_CTAS)}) r(i))""") + """
SELECT c.cta, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_log_hits,
       CAST(COALESCE(SUM(CASE WHEN contains(message, 'cannot be deserialized') THEN n END), 0) AS BIGINT) AS n_error_hits,
       MIN(first_seen) AS first_seen
FROM c LEFT JOIN lines ON contains(message, c.cta) GROUP BY c.cta"""

ORACLE_SQL["roundtrip_campaigns_array"] = _with() + "SELECT * FROM camp"
ORACLE_SQL["roundtrip_conversations_array"] = _with() + "SELECT * FROM conv"
ORACLE_SQL["roundtrip_logs_csv_split"] = _with() + """
SELECT * REPLACE (CASE WHEN "insertId" LIKE '%00' THEN message || chr(10) || '"quoted", ' || message ELSE message END AS message)
FROM logs"""

ORACLE_SQL["distinct_counts_period"] = _with(
    f"p AS (SELECT * FROM camp WHERE CAST(publish_time AS DATE) BETWEEN DATE '{P.PERIOD[0]}' AND DATE '{P.PERIOD[1]}')") + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS n_distinct, true AS within_bound FROM p"
    for c, _ in CAMP_COLS)

ORACLE_SQL["sorted_export_positions"] = _with() + """
SELECT session_id, publish_time, message_id, ROW_NUMBER() OVER (ORDER BY session_id, publish_time, message_id) AS position FROM conv"""

for _name in ("check_version", "check_orphan_sessions"):
    ORACLE_SQL[f"{_name}_daily"] = ORACLE_SQL[_name]

# the watermark lies behind the latest row, so of the second half all rows are late but those of its last hour, if any
ORACLE_SQL["stream_late_rows"] = _with() + f"""
SELECT "insertId", "timestamp", "timestamp" < TIMESTAMP '{P.LATE_CUT}'
       AND "timestamp" < (SELECT max("timestamp") FROM logs) - INTERVAL 1 HOUR AS late
FROM logs"""

ORACLE_SQL["similar_templates_many"] = _with(
    "t AS (SELECT DISTINCT template FROM camp WHERE template IS NOT NULL)",
    "e AS (SELECT 'crm_' || kind || '_' || lpad(CAST(i AS VARCHAR), 4, '0') AS name "
    "FROM (SELECT unnest(['click', 'error']) AS kind) kinds, range(10000) r(i))") + f"""
SELECT e.name AS expected_template, t.template AS similar_template, CAST(levenshtein(t.template, e.name) AS INTEGER) AS distance
FROM e, t WHERE abs(length(t.template) - length(e.name)) <= {P.MANY_EDITS}
  AND levenshtein(t.template, e.name) BETWEEN 1 AND {P.MANY_EDITS}
QUALIFY ROW_NUMBER() OVER (PARTITION BY e.name ORDER BY distance, t.template) = 1"""

ORACLE_SQL["roundtrip_processed"] = _with() + "SELECT * FROM camp"
