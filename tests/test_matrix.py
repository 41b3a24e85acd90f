import statistics

import pytest

from evirank.operators import matrix as mx

TISSUES = ["Leaf_Upper", "Leaf_Lower_Edge", "Root_Tip", "Root_Hair_Zone", "Stem", "Seed_Coat"]
CELLS = {"one": [0, 0.2, 40, 0, 0.4, 0], "flat": [7.5] * 6, "none": [0] * 6, "step": [1, 2, 3, 4, 5, 6]}


def plain_tau(values):
    return sum(1 - v / max(values) for v in values) / (len(values) - 1)


@pytest.fixture
def long(spark):
    return spark.createDataFrame(
        [(g, t, float(v)) for g, row in CELLS.items() for t, v in zip(TISSUES, row, strict=True)],
        "item_id STRING, tissue STRING, tpm DOUBLE")


def test_token_set_match(spark):
    queries = spark.createDataFrame([("tip root",), ("Leaf",), ("leaf lower",), ("bark",), ("stem seed",)],
                                    "query STRING")
    columns = spark.createDataFrame([(t,) for t in TISSUES], "tissue STRING")
    got = {}
    for r in mx.match_columns(queries, columns).collect():
        got.setdefault(r["query"], set()).add(r["tissue"])
    assert got == {"tip root": {"Root_Tip"}, "Leaf": set(TISSUES[:2]), "leaf lower": {"Leaf_Lower_Edge"},
                   "bark": {None}, "stem seed": {None}}


def test_tau(long, by):
    rows = by(mx.tissue_specificity(long, 6), "item_id")
    for name in ("one", "step"):
        assert rows[name][mx.SPECIFICITY] == pytest.approx(plain_tau(CELLS[name]))
    assert rows["flat"][mx.SPECIFICITY] == 0.0 and rows["none"][mx.SPECIFICITY] is None


def test_tau_counts_absent_cells_as_zero(long, by):
    rows = by(mx.tissue_specificity(long.where("item_id = 'flat' AND tissue LIKE 'Root%'"), 6), "item_id")
    assert rows["flat"][mx.SPECIFICITY] == pytest.approx(4 / 5)


def test_tau_needs_two_columns(long):
    with pytest.raises(ValueError):
        mx.tissue_specificity(long, 1)


def test_profile(long, by):
    rows = by(mx.matrix_profile(long), "item_id")
    for name, values in CELLS.items():
        assert rows[name][mx.MAX] == max(values)
        assert rows[name][mx.MEDIAN] == pytest.approx(statistics.median(values))
        assert rows[name][mx.DETECTED] == sum(v > 1 for v in values)


def test_features_pad_and_percentile_ignores_the_candidates(spark, long, by):
    matched = spark.createDataFrame([("g", "Root_Tip"), ("g", "Stem")], "group_id STRING, tissue STRING")
    def run(items):
        pairs = spark.createDataFrame([("g", i) for i in items], "group_id STRING, item_id STRING")
        return by(mx.expression_features(pairs, long, matched, 6, ["group_id"]), "item_id")
    every, single = run([*CELLS, "new"]), run(["step"])
    assert every["new"]["missing__expression"] == 1 and every["new"][mx.MAX] is None
    means = {name: (v[2] + v[4]) / 2 for name, v in CELLS.items()}
    for name, mean in means.items():
        assert every[name][mx.RELEVANT] == pytest.approx(mean)
        assert every[name]["dim__expression"] == sum(m <= mean for m in means.values()) / 4
    assert single["step"]["dim__expression"] == every["step"]["dim__expression"]


def test_detail_is_single_precision(spark, long):
    universe = spark.createDataFrame([("one",)], "item_id STRING")
    out = mx.item_tissue_detail(universe, long)
    assert out.count() == 6 and dict(out.dtypes)["median_tpm"] == "float"
