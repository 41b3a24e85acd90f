import pytest
from pyspark.sql import functions as F

from evirank.operators import joins, quality
from evirank.operators.evidence import LeakageError


@pytest.fixture
def df(spark):
    return spark.createDataFrame([("g", "a", 1.0), ("g", "a", None), ("h", "b", None)],
                                 "group_id STRING, item_id STRING, x DOUBLE")


def test_schema_checks_name_everything(df):
    with pytest.raises(quality.SchemaError, match=r"absent p \(1\); absent q \(1\)"):
        quality.assert_contract(df, present=["x", "p", "q"])
    report = quality.contract_report(df, key=["group_id", "item_id"], filled=["x", "item_id", "z"])
    assert {tuple(r) for r in report.collect()} == {
        ("repeated key", "group_id, item_id", 1), ("null", "x", 2), ("absent", "z", 1)}
    quality.assert_contract(df, filled=["item_id"], present=["x"])
    quality.assert_contract(df.limit(0), key=["item_id"], filled=["x"])


def test_leakage_and_stale_rules(df):
    assert quality.check_leakage(["label", "dim__a"])["violations"] == ["label"]
    with pytest.raises(LeakageError):
        quality.assert_no_leakage(["dim__a"])
    quality.assert_no_leakage(["dim__a"], check_stale=False)


def test_rules_are_live_against_the_sources(spark):
    ok = spark.createDataFrame([("clinical_precedence",)], "source STRING")
    quality.verify_rules_live(ok, ["maxClinicalStage"])
    with pytest.raises(LeakageError):
        quality.verify_rules_live(ok, ["hasPocket"])


def test_probe_can_fail(df):
    quality.leakage_probe(df)
    with pytest.raises(AssertionError):
        quality.leakage_probe(df, ())


def test_drop_audit_is_sequential_and_counts_zero(spark, by):
    df = spark.range(10)
    rows = by(quality.drop_audit(df, [("s", "odd", F.col("id") % 2 == 0),
                                      ("t", "small", F.col("id") > 3), ("u", "none", F.lit(True))],
                                 "id"), "step")
    assert [(r["dropped"], r["total"]) for r in rows.values()] == [(5, 10), (2, 5), (0, 3)]
    assert rows[0]["pct"] == 50.0 and rows[0]["example"] == "1" and rows[2]["example"] is None


def test_sparse_columns(df):
    got = {(r["group_id"], r["column"]) for r in quality.sparse_columns(df, ["x", "item_id"]).collect()}
    assert got == {("h", "x")}


def test_product_contract(df):
    quality.product_contract(df)
    with pytest.raises(quality.SchemaError):
        quality.product_contract(df.withColumn("label__n_drugs", F.lit(1)))


def test_join_helpers(spark, by):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k STRING, v DOUBLE")
    right = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("d", 0.0)], "k STRING, v DOUBLE")
    assert [r["k"] for r in joins.compare(left, right, ["k"], "v").collect()] == ["b"]
    row = joins.key_overlap(left, right, "k", 3).first()
    assert (row["n_left"], row["n_right"], row["n_shared"], row["enough"]) == (3, 3, 2, False)
    names = by(joins.resolve_name(left, right.where("k = 'a'").selectExpr("k", "'N' AS n"), "k", "n",
                                  "shown"), "k")
    assert [names[k]["shown"] for k in "abc"] == ["N", "b", "c"]
    padded = by(joins.pad_to_universe(left, right.withColumnRenamed("v", "w"), ["k"]), "k")
    assert set(padded) == set("abc") and padded["c"]["w"] is None
    assembled = joins.assemble(left.select("k"), [(right.withColumnRenamed("v", "w"), ["k"])])
    assert assembled.count() == 3
    wide = joins.union_all(left, right.withColumnRenamed("v", "w"), diagonal=True)
    assert wide.where("v IS NULL").count() == 3
    first = by(joins.keep_first(left.union(right), ["k"], ["v"]), "k")
    assert first["b"]["v"] == 2.0 and len(first) == 4


def test_partner_lookup_falls_back_to_the_id(spark, by):
    partners = spark.createDataFrame([("g", "a", "b"), ("g", "a", "z")],
                                     "group_id STRING, item_id STRING, partner_id STRING")
    items = spark.createDataFrame([("g", "a", "A"), ("g", "b", "B"), ("h", "z", None)],
                                  "group_id STRING, item_id STRING, symbol STRING")
    rows = by(joins.partner_lookup(partners, items, items, ["group_id"], "item_id", "partner_id",
                                   "symbol"), "partner_id")
    assert rows["b"]["is_candidate"] and rows["b"]["partner_symbol"] == "B"
    assert not rows["z"]["is_candidate"] and rows["z"]["partner_symbol"] == "z"


def test_drop_audit_shows_the_smallest_examples(spark, by):
    df = spark.range(20).withColumn("name", F.format_string("n%02d", "id"))
    steps = [("s", "odd", F.col("id") % 2 == 0), ("t", "small", F.col("id") > 3), ("u", "none", F.lit(True))]
    rows = by(quality.drop_audit(df, steps, "name"), "step")
    assert rows[0]["examples"] == ["n01", "n03", "n05", "n07", "n09"]
    assert rows[1]["examples"] == ["n00", "n02"] and rows[2]["examples"] == []
    bare = by(quality.drop_audit(df, steps), "step")
    assert bare[0]["dropped"] == 10 and bare[0]["examples"] == [] and bare[0]["example"] is None
    none = by(quality.drop_audit(df.where("id < 0"), steps, "name"), "step")
    assert [(r["dropped"], r["total"], r["pct"], r["examples"]) for r in none.values()] == [(0, 0, 0.0, [])] * 3


def test_observed_filter_counts_in_the_pass_that_filters(spark):
    df = spark.range(20).select(F.when(F.col("id") != 4, F.col("id")).alias("id"))
    steps = [("s", "odd or null", F.col("id") % 2 == 0), ("t", "small", F.col("id") > 3)]
    kept, seen = quality.observed_filter(df, steps)
    assert sorted(r["id"] for r in kept.collect()) == [6, 8, 10, 12, 14, 16, 18]
    found = quality.observed_drops(seen, steps)
    assert [(r["dropped"], r["total"]) for r in found] == [(11, 20), (2, 9)] and found[0]["pct"] == pytest.approx(55.0)


def test_nulls_survive_both_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (None, 0.0), (None, None)], "a DOUBLE, b DOUBLE")
    got = {r["column"]: tuple(r)[1:] for r in quality.null_round_trip(df, ["a", "b"], str(tmp_path / "x")).collect()}
    assert got == {"a": (2, 2, 2), "b": (2, 2, 2)}
