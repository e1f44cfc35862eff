import duckdb

import __spark_entry__ as E
from sendscope.plans import ORACLE_SQL, QUERIES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and "hypotheses_text" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) <= set(E.queries())


def test_every_query_matches_its_oracle_on_the_small_fixture(spark):
    from tools.check_oracles import TABLES, rows_of
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for name, fn in QUERIES.items():
        sdf = fn(spark, sf)
        res = con.execute(ORACLE_SQL[name])
        cols = [d[0] for d in res.description]
        if sorted(sdf.columns) != sorted(cols) or \
                rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) != rows_of(cols, res.fetchall()):
            bad.append(name)
    assert bad == []
