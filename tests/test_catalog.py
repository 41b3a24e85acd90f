"""Registered queries against their oracle SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["top_ranked", "labels", "evaluate_ranking", "feature_table", "hierarchy_roots",
         "display_bundle", "name_resolution", "seed_distance"]


def plain(v):
    if isinstance(v, bool):
        return int(v)
    try:
        f = float(v)
        return round(f, 9)
    except (TypeError, ValueError):
        return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
