"""Tasks are sized by the rows, and the large tables are dealt once."""

from __future__ import annotations

import pytest

from evirank import catalog, session
from evirank.catalog import tables as t
from evirank.operators import graph as gr
from evirank.operators.matrix import MEDIAN, matrix_profile

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _loaded():
    catalog.load()


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("table", [t.evidence, t.clinical, t.matrix, t.memberships, t.edges])
def test_tasks_grow_with_rows(spark, monkeypatch, table):
    """Half the rows per task, twice the tasks: the memory of a task stays where it is."""
    rows = t.n_lines(spark, SF)
    before = {tuple(r) for r in table(spark, SF).collect()}
    for n in (40, 80):
        monkeypatch.setattr(session, "ROWS_PER_TASK", -(-rows // n))
        df = table(spark, SF)
        assert df.rdd.getNumPartitions() in (n - 1, n)
        assert {tuple(r) for r in df.collect()} == before


def test_evidence_is_dealt_once_after_its_join(spark):
    by_item = [e for e in exchanges(t.score_features(spark, SF)) if "item_id" in e]
    assert len(by_item) == 1


def test_labels_of_known_pairs(spark):
    pairs = t.score_features(spark, SF).select("group_id", "item_id")
    got, want = t.labels_of_pairs(spark, SF, pairs), t.labels(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_median_is_the_mean_of_the_middle_places(spark):
    cells = [("odd", "a", 3.0), ("odd", "b", 1.0), ("odd", "c", 9.0), ("even", "a", 4.0), ("even", "b", 1.0),
             ("even", "c", None), ("none", "a", None)]
    df = spark.createDataFrame(cells, "item_id STRING, tissue STRING, tpm DOUBLE")
    got = {r["item_id"]: r[MEDIAN] for r in matrix_profile(df).collect()}
    assert got == {"odd": 3.0, "even": 2.5, "none": None}


def test_collapse_edges_sized_by_rows(spark):
    df = spark.createDataFrame([("x", "y", 1), ("y", "x", 5), ("x", "x", 9), ("z", "x", 2)], "a STRING, b STRING, score INT")
    want = [("x", "y", 5), ("x", "z", 2)]
    assert sorted(tuple(r) for r in gr.collapse_edges(df).collect()) == want
    assert sorted(tuple(r) for r in gr.collapse_edges(df, rows=10**9).collect()) == want


def test_profile_sorts_its_cells_once(spark):
    """One window for both the place and the number of the cells; cells known to be unique are not grouped again."""
    cells = t.matrix(spark, SF)
    plans = [matrix_profile(cells, unique_cells=u) for u in (False, True)]
    shown = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert [s.count("Window [") for s in shown] == [1, 1]
    assert shown[1].count("HashAggregate") < shown[0].count("HashAggregate")
    one, other = ({r["item_id"]: tuple(r) for r in p.collect()} for p in plans)
    assert one.keys() == other.keys()
    assert all(one[k] == pytest.approx(other[k]) for k in one)
