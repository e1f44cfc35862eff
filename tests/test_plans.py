"""Scale guards on the physical plans of every registered batch query:
no cartesian products, no nested-loop joins, no Python evaluation."""

import __spark_entry__ as E
from sendscope.plans import ORACLE_SQL, QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


def test_no_forbidden_operators_in_plans(spark):
    bad = {}
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue  # streaming queries are checked by their own tests
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in FORBIDDEN if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_filters_reach_the_scan(spark):
    from sendscope.operators.checks import cta_messages_on_day
    from sendscope.plans import params as P
    from sendscope.sources.staging import staged_tables
    conv = staged_tables(spark, "/root/testdata/sf0.001", keep_date=True)["conversations"]
    # the orphan check's scan (run once, into its checkpoint) prunes by date
    plan = cta_messages_on_day(conv, P.CTAS, P.AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publish_date" in plan
    plan = QUERIES["check_orphan_sessions"](spark, "/root/testdata/sf0.001") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    plan = QUERIES["keyword_conversations"](spark, "/root/testdata/sf0.001") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan and "DataFilters: [coalesce(RLIKE" in plan


def test_profiles_neither_sort_nor_expand(spark):
    for name in ("constant_columns", "constant_columns_lineitem", "profile_columns", "profile_columns_orders"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Expand" not in plan, name
