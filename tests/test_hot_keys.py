"""Skew-safe operators stay exact when one session holds a third of the rows.

The bases are derived from the sf0.01 fixture (one session takes every third
message on both sides), written to Parquet, and each operator is compared
with plain SQL in DuckDB on the same files. Partition coalescing is off so
the hot session really is cut into several slices.
"""

import datetime as dt
import math

import duckdb
import pytest

from sendscope.operators import checks, prepare, search, sessions
from sendscope.sources.adapter import load_tables
from tools.literal_forms import hot_key_bases


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("hot")
    bases = hot_key_bases(load_tables(spark, "/root/testdata/sf0.01"))
    paths = {}
    for name in ("campaigns", "conversations"):
        paths[name] = str(base / name)
        bases[name].write.parquet(paths[name])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield {n: spark.read.parquet(p) for n, p in paths.items()}, paths
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _duck(paths, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW camp AS SELECT * FROM read_parquet('{paths['campaigns']}/*.parquet')")
    con.execute(f"CREATE VIEW conv AS SELECT * FROM read_parquet('{paths['conversations']}/*.parquet')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return cols, [dict(zip(cols, r)) for r in res.fetchall()]


def test_hot_session_exists_and_spans_slices(hot):
    from pyspark.sql import functions as F

    t, _ = hot
    n = t["campaigns"].where("session_id = 's_hot'").count()
    assert n > t["campaigns"].count() / 4
    slices = (t["campaigns"].repartitionByRange("session_id", "publish_time", "message_id")
              .withColumn("p", F.spark_partition_id()).where("session_id = 's_hot'")
              .select("p").distinct().count())
    assert slices > 1


def test_sequence_and_gaps_on_hot_session(hot, monkeypatch):
    from sendscope.operators import sequence
    monkeypatch.setattr(sequence, "CELL_ROWS", 50)
    t, paths = hot
    cols, expect = _duck(paths, """
        SELECT session_id, message_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY publish_time, message_id) AS seq
        FROM conv""")
    got = prepare.conversation_sequence(t["conversations"]).collect()
    assert _rows(got, cols) == _rows(expect, cols)
    cols, expect = _duck(paths, """
        SELECT session_id, seq, message_id, prev_message_id,
               date_diff('microsecond', prev_publish_time, publish_time) AS gap_us,
               COALESCE(template = prev_template, false) AS same_template
        FROM (SELECT session_id, message_id, publish_time, template,
                     ROW_NUMBER() OVER w AS seq, LAG(message_id) OVER w AS prev_message_id,
                     LAG(publish_time) OVER w AS prev_publish_time, LAG(template) OVER w AS prev_template
              FROM camp WINDOW w AS (PARTITION BY session_id ORDER BY publish_time, message_id)) x
        WHERE prev_message_id IS NOT NULL""")
    got = prepare.session_repeat_gaps(t["campaigns"]).collect()
    assert _rows(got, cols) == _rows(expect, cols)


def test_counts_and_latest_on_hot_session(hot):
    t, paths = hot
    cols, expect = _duck(paths, "SELECT COUNT(*) AS join_rows FROM camp JOIN conv USING (session_id)")
    got = sessions.join_fanout(t["campaigns"], t["conversations"]).select("join_rows").collect()
    assert _rows(got, cols) == _rows(expect, cols)
    cols, expect = _duck(paths, """
        SELECT * FROM camp QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id
                                                      ORDER BY publish_time DESC, message_id DESC) = 1""")
    got = prepare.latest_per_session(t["campaigns"]).collect()
    assert _rows(got, cols) == _rows(expect, cols)


def test_as_of_link_on_hot_session(hot, monkeypatch):
    from sendscope.operators import sequence
    monkeypatch.setattr(sequence, "CELL_ROWS", 50)
    t, paths = hot
    cols, expect = _duck(paths, """
        SELECT message_id_conversa, message_id_campanha FROM (
          SELECT c.message_id AS message_id_conversa, k.message_id AS message_id_campanha,
                 ROW_NUMBER() OVER (PARTITION BY c.message_id
                                    ORDER BY k.publish_time DESC NULLS LAST, k.message_id DESC NULLS LAST) AS rn
          FROM conv c LEFT JOIN camp k ON k.session_id = c.session_id AND k.publish_time <= c.publish_time) x
        WHERE rn = 1""")
    got = prepare.dispatch_for_conversation(t["campaigns"], t["conversations"]).collect()
    assert _rows(got, cols) == _rows(expect, cols)


def test_linkage_and_orphans_on_hot_session(hot):
    t, paths = hot
    cols, expect = _duck(paths, """
        SELECT c.message_id, k.session_campanha FROM conv c
        LEFT JOIN (SELECT DISTINCT session_id AS session_campanha FROM camp) k ON k.session_campanha = c.session_id
        WHERE regexp_matches(c.text, '(?i)buy\\s+now')""")
    got = search.keyword_conversations(t["conversations"], t["campaigns"], r"(?i)buy\s+now", "f").collect()
    assert _rows(got, cols) == _rows(expect, cols)
    cols, expect = _duck(paths, """
        SELECT c.text AS cta, COUNT(*) AS orphan_messages FROM conv c LEFT JOIN camp k ON c.session_id = k.session_id
        WHERE c.text IN ('Buy now', 'Talk to an agent') AND k.session_id IS NULL
          AND CAST(c.publish_time AS DATE) = DATE '2024-01-20' GROUP BY c.text""")
    got = checks.check_orphan_sessions(t["conversations"], t["campaigns"], ["Buy now", "Talk to an agent"],
                                       "2024-01-21", 0).collect()
    assert _rows(got, cols) == _rows(expect, cols)
