import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sendscope.operators import sequence
from sendscope.operators.sequence import sequence_within_groups


def test_sequence_matches_window_with_hot_group(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 200)}"  # one group holds a third of the rows
        rows.append((g, rnd.randint(0, 50), f"m{i:05d}"))
    rows.append((None, 1, "mnull"))
    rows += [("hot", None, "n1"), ("g7", None, "n2"), ("g7", None, "n3")]  # null order keys sort last
    df = spark.createDataFrame(rows, "grp string, t int, id string")
    got = sequence_within_groups(df, ["grp"], ["t", "id"], num_slices=16)
    plain = sequence_within_groups(df, ["grp"], ["t", "id"], mode="window")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    w = Window.partitionBy("grp").orderBy(F.col("t").asc_nulls_last(), F.col("id").asc_nulls_last())
    ref = df.withColumn("seq", F.row_number().over(w)).withColumn("prev_id", F.lag("id").over(w)) \
        .withColumn("prev_t", F.lag("t").over(w))
    a = sorted((r.id, r.seq, r.prev_id, r.prev_t) for r in got.collect())
    b = sorted((r.id, r.seq, r.prev_id, r.prev_t) for r in ref.collect())
    assert a == b
    # the hot group is dealt to several tasks, and every row is exchanged once
    order = F.struct("t", "id")
    cuts = sequence._cut_points(df, ["grp"], order, 16)
    per = sequence._with_cells(df, ["grp"], order, cuts).groupBy("grp", "_cell").count().collect()
    assert len([r for r in per if r.grp == "hot"]) > 10 and max(r["count"] for r in per if r.grp == "hot") < 300
    fresh = sequence_within_groups(df, ["grp"], ["t", "id"], num_slices=16)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number() windowspec") == 1, plan


def test_a_hot_group_of_equal_keys_and_clashing_names(spark):
    rows = [("hot", 1, i % 7, "x") for i in range(900)] + [(f"g{i}", 1, i, "y") for i in range(100)]
    df = spark.createDataFrame(rows, "grp string, t int, id int, n string")
    got = sequence_within_groups(df, ["grp"], ["t", "id"], num_slices=8, carry_cols=["n"])
    per = got.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("m")).collect()
    assert all(r.n == r.d == r.m for r in per)
    assert sequence_within_groups(df.limit(0), ["grp"], ["t", "id"], num_slices=8).collect() == []


def test_latest_before_matches_brute_force(spark, monkeypatch):
    from sendscope.operators.sequence import latest_before
    rnd = random.Random(11)
    left, right = [], []
    for i in range(600):
        k = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 30)}"
        left.append((k, rnd.choice([None] + list(range(40))), f"l{i:04d}"))
    for i in range(900):
        k = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        right.append((k, rnd.randint(0, 40), f"r{i:04d}"))
    left.append((None, 20, "lnull"))
    right.append((None, 1, "rnull"))  # NULL keys never match
    ldf = spark.createDataFrame(left, "k string, t int, lid string")
    rdf = spark.createDataFrame(right, "k string, rt int, rid string")
    monkeypatch.setattr(sequence, "CELL_ROWS", 20)  # force several cells
    results = {mode: {r.lid: r.right_rid for r in
                      latest_before(ldf, rdf, "k", "t", "rt", "rid", ["rid"], mode=mode).collect()}
               for mode in ("sliced", "window")}
    got = results["sliced"]
    assert results["window"] == got
    expect = {}
    for k, t, lid in left:
        cands = [(rt, rid) for rk, rt, rid in right
                 if k is not None and rk == k and t is not None and rt <= t]
        expect[lid] = max(cands)[1] if cands else None
    assert got == expect
