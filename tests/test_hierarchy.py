import pytest

from evirank.operators import hierarchy as hi


PARENT = {"bud": "twig", "leaf": "twig", "twig": "tree", "sprout": "seed", "root": "sprout"}
MEMBERS = [("i1", "bud"), ("i1", "root"), ("i1", "leaf"), ("i2", "twig"), ("i2", "tree"), ("i3", "sprout")]
ITEMS = ["i1", "i2", "i3", "i4"]


def top(node):
    return top(PARENT[node]) if node in PARENT else node


@pytest.fixture
def relations(spark):
    return spark.createDataFrame([(p, c) for c, p in PARENT.items()], "parent_id STRING, child_id STRING")


@pytest.fixture
def rooted(spark, relations):
    members = spark.createDataFrame(MEMBERS, "item_id STRING, pathway_id STRING")
    return hi.with_roots(members, hi.find_roots(relations))


def universe(spark):
    return spark.createDataFrame([(i,) for i in ITEMS], "item_id STRING")


def test_roots(relations, by):
    rows = by(hi.find_roots(relations), "node")
    assert {k: r["root"] for k, r in rows.items()} == {n: top(n) for n in {*PARENT, *PARENT.values()}}


def test_deep_chain(spark, by):
    n = 40
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)],
                                  "parent_id STRING, child_id STRING")
    rows = by(hi.find_roots(chain), "node")
    assert len(rows) == n + 1 and {r["root"] for r in rows.values()} == {"n000"}


def test_cycles_end_and_share_one_root(spark, by):
    df = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "x"), ("x", "y"), ("S", "S"), ("p", "q")],
                               "parent_id STRING, child_id STRING")
    rows = {k: r["root"] for k, r in by(hi.find_roots(df), "node").items()}
    assert rows == {"A": "A", "B": "A", "x": "A", "y": "A", "S": "S", "p": "p", "q": "p"}


def test_unknown_node_is_its_own_root(spark, relations):
    members = spark.createDataFrame([("i1", "moss")], "item_id STRING, pathway_id STRING")
    assert hi.with_roots(members, hi.find_roots(relations)).first()["root_id"] == "moss"


def test_root_counts(spark, rooted, by):
    rows = by(hi.root_features(universe(spark), rooted), "item_id")
    assert [rows[k]["path__n_pathways"] for k in ITEMS] == [2, 1, 1, None]
    assert [rows[k]["dim__pathways"] for k in ITEMS] == [0.4, 0.2, 0.2, None]
    assert [rows[k]["missing__pathways"] for k in ITEMS] == [0, 0, 0, 1]


def test_overlap(spark, rooted, by):
    seeds = spark.createDataFrame([("i2",)], "item_id STRING")
    rows = by(hi.root_overlap(universe(spark), rooted, seeds), "item_id")
    assert [rows[k]["path__overlap_with_known"] for k in ITEMS] == [0.5, 1.0, 0.0, None]
    empty = by(hi.root_overlap(universe(spark), rooted, seeds.where("false")), "item_id")
    assert all(r["path__overlap_with_known"] is None for r in empty.values()) and len(empty) == 4


def test_overlap_by_group(spark, rooted, by):
    pairs = spark.createDataFrame([("g", "i1"), ("g", "i3"), ("h", "i2"), ("i", "i2")],
                                  "group_id STRING, item_id STRING")
    seeds = spark.createDataFrame([("g", "i3"), ("h", "i1")], "group_id STRING, item_id STRING")
    rows = by(hi.root_overlap(pairs, rooted, seeds, ["group_id"]), "group_id", "item_id")
    got = {k: r["path__overlap_with_known"] for k, r in rows.items()}
    assert got == {("g", "i1"): 0.5, ("g", "i3"): 1.0, ("h", "i2"): 1.0, ("i", "i2"): None}


def test_detail_has_one_row_per_pair_and_a_name_or_the_id(spark, rooted, by):
    names = spark.createDataFrame([("tree", "Trees")], "node STRING, name STRING")
    detail = hi.membership_detail(rooted.union(rooted), names)
    rows = by(detail, "item_id", "pathway_id")
    assert {k: r["root_name"] for k, r in rows.items()} == {
        (i, p): "Trees" if top(p) == "tree" else "seed" for i, p in MEMBERS}
    groups = by(hi.root_groups(detail), "item_id", "root_id")
    assert (groups["i1", "tree"]["n_pathways"], groups["i1", "tree"]["position"]) == (2, 1)
    assert groups["i1", "seed"]["position"] == 2 and groups["i2", "tree"]["n_pathways"] == 2
