import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evirank.operators import ranking as rk
from evirank.operators.skew import hot_keys, lookup_join


@pytest.fixture
def scored(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(3000):  # one group holds most rows, scores tie heavily
        group = "hot" if i % 3 else rnd.choice(["a", "b", None])
        rows.append((group, i, rnd.choice([0.0, 0.25, 0.5, None, rnd.random()])))
    return spark.createDataFrame(rows, "group_id STRING, item_id LONG, score DOUBLE").repartition(7)


def test_distributed_rank_equals_the_window(scored):
    order = [F.col("score").desc_nulls_last(), F.col("item_id")]
    want = scored.withColumn("rank", F.row_number().over(W.partitionBy("group_id").orderBy(*order)))
    got = rk.rank_within_group(scored, "group_id", "score", "item_id")
    def key(r):
        return r["item_id"]
    assert [(r["item_id"], r["rank"]) for r in sorted(got.collect(), key=key)] == [
        (r["item_id"], r["rank"]) for r in sorted(want.collect(), key=key)]


def test_rank_does_not_depend_on_partitions(spark, scored):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = rk.rank_within_group(scored, "group_id", "score", "item_id").collect()
        return sorted((r["item_id"], r["rank"]) for r in out)

    try:
        assert run(3) == run(11)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_running_sums_and_totals_equal_the_window(scored):
    df = scored.withColumn("w", (F.col("item_id") % 5).cast("long"))
    order = [F.col("item_id").asc()]
    got = rk.running_totals(df, ["group_id"], order, {"cum": "w"}, totals={"all": "w"})
    w = W.partitionBy("group_id")
    run = w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({"cum": F.sum("w").over(run), "all": F.sum("w").over(w)})
    cols = ["item_id", "cum", "all"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(
        map(tuple, want.select(cols).collect()))


def test_average_rank_share_keeps_nulls_and_averages_ties(spark, by):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0), ("d", None)],
                               "k STRING, v DOUBLE")
    rows = by(rk.average_rank_share(df, "v", "share", [F.col("k")]), "k")
    assert rows["a"]["share"] == rows["b"]["share"] == pytest.approx(0.5)
    assert rows["c"]["share"] == 1.0 and rows["d"]["share"] is None


@pytest.mark.parametrize("values, want", [([1, 3, 5, 7], 4.0), ([2, 2, 9], 2.0), ([4], 4.0)])
def test_exact_median(spark, values, want):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None)],
                               "g STRING, v DOUBLE")
    assert rk.exact_median(df, ["g"], "v").first()["median"] == want


def test_median_of_nothing_has_no_row(spark):
    df = spark.createDataFrame([("g", None)], "g STRING, v DOUBLE")
    assert rk.exact_median(df, ["g"], "v").count() == 0


def test_filter_after_rank_keeps_gaps(spark):
    df = spark.createDataFrame([("g", i, 10.0 - i) for i in range(6)],
                               "group_id STRING, item_id LONG, score DOUBLE")
    ranked = rk.rank_within_group(df, "group_id", "score", "item_id")
    kept = rk.rank_filter_limit(ranked, [F.col("item_id") % 2 == 1], 2, "group_id")
    assert sorted(r["rank"] for r in kept.collect()) == [2, 4]


def test_a_fall_is_negative(spark, by):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k STRING, rank LONG")
    b = spark.createDataFrame([("x", 5), ("z", 1)], "k STRING, rank LONG")
    rows = by(rk.rank_movement(a, b, ["k"]), "k")
    assert rows["x"]["movement"] == -4 and rows["y"]["movement"] is None


def test_best_and_worst(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", None), ("d", 0.5)], "k STRING, m DOUBLE")
    rows = rk.best_and_worst(df, "m", "k", 1).collect()
    assert {(r["side"], r["k"]) for r in rows} == {("best", "b"), ("worst", "a")}


def test_hot_keys_are_spread_and_the_join_stays_exact(spark):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("none", 2)],
                                 "k STRING, i LONG")
    right = spark.createDataFrame([("hot", "H"), ("cold", "C")], "k STRING, v STRING")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, ["k"], "_n", min_rows=20).collect()
    assert [(r["k"], r["_copies"]) for r in hot] == [("hot", 10)]
    out = lookup_join(left, right, ["k"], [F.col("i")], counts, min_rows=20)
    assert out.count() == 202
    assert {(r["k"], r["v"]) for r in out.select("k", "v").distinct().collect()} == {
        ("hot", "H"), ("cold", "C"), ("none", None)}


def test_top_n_cuts_before_the_shuffle(scored):
    plan = rk.top_n(scored, "group_id", [F.col("item_id").asc()], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
