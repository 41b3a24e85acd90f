import itertools

import pytest
from pyspark.sql import functions as F

from evirank.operators import graph as gr


EDGES = [("k1", "k2", 30), ("k2", "k3", 70), ("k1", "k3", 20), ("k3", "k4", 50), ("m1", "m2", 80)]
NODES = ["k1", "k2", "k3", "k4", "m1", "m2"]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "a STRING, b STRING, score INT")


def brute_betweenness(pairs, sources):
    """All shortest paths by breadth-first enumeration (small graphs only)."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        level, paths = [[s]], {s: [[s]]}
        while level:
            nxt = [p + [v] for p in level for v in near[p[-1]]]
            fresh = {p[-1] for p in nxt} - set(paths)
            level = [p for p in nxt if p[-1] in fresh]
            for p in level:
                paths.setdefault(p[-1], []).append(p)
        for t, found in paths.items():
            for p in found:
                for v in p[1:-1]:
                    total[v] += 1.0 / len(found)
    n = len(near)
    return {v: x * n / len(sources) / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_degree_features_and_padding(spark, edges, by):
    universe = spark.createDataFrame([(n,) for n in [*NODES, "none"]], "node STRING")
    central = universe.where("node <> 'none'").withColumn("net__extra", F.length("node"))
    rows = by(gr.network_features(universe, edges, central, "node"), "node")
    for n in NODES:
        scores = [w for a, b, w in EDGES if n in (a, b)]
        r = rows[n]
        assert (r["net__degree"], r["net__weighted_degree"]) == (len(scores), sum(scores))
        assert r["net__mean_confidence"] == pytest.approx(sum(scores) / len(scores))
        assert r["missing__network"] == 0 and r["net__extra"] == 2
    assert rows["none"]["net__degree"] is None and rows["none"]["missing__network"] == 1


def test_collapse_drops_loops_and_keeps_the_max(spark):
    raw = spark.createDataFrame([("x", "y", 500), ("y", "x", 800), ("x", "x", 900), ("x", "z", 100)],
                                "raw_a STRING, raw_b STRING, score INT")
    lookup = spark.createDataFrame([("x", "X"), ("y", "Y"), ("z", "X")], "raw_id STRING, node STRING")
    rows = [tuple(r) for r in gr.translate_edges(raw, lookup, 400).select("a", "b", "score").collect()]
    assert rows == [("X", "Y", 800)]


@pytest.mark.parametrize("per_task", [500_000, 1])
def test_distances(spark, edges, by, per_task):
    graph = gr.prepare_graph(edges, per_task)
    seeds = spark.createDataFrame([("k1",), ("zz",)], "node STRING")
    rows = by(gr.seed_distances(graph, seeds), "node")
    assert {k: r["distance"] for k, r in rows.items()} == {"k1": 0, "k2": 1, "k3": 1, "k4": 2}
    none = spark.createDataFrame([("zz",)], "node STRING")
    assert gr.seed_distances(graph, none).count() == 0


def test_distances_of_more_groups_than_a_block_holds(spark, edges):
    """130 groups and one without a name: every group as if walked alone, no node twice."""
    graph = gr.prepare_graph(edges, 2)
    seeds = [(f"g{k:03d}", NODES[k % 6]) for k in range(130)] + [(None, "k4"), ("g000", "k4")]
    rows = gr.seed_distances(
        graph, spark.createDataFrame(seeds, "g STRING, node STRING"), ["g"], max_hops=5).collect()
    got = {(r["g"], r["node"]): r["distance"] for r in rows}
    near = {n: {x for e in EDGES for x in e[:2] if n in e[:2]} - {n} for n in NODES}
    want = {}
    for g in {g for g, _ in seeds}:
        level, hop, seen = {n for s, n in seeds if s == g}, 0, set()
        while level:
            want |= {(g, n): hop for n in level}
            seen |= level
            level, hop = {x for n in level for x in near[n]} - seen, hop + 1
    assert got == want
    assert len(rows) == len(want)


@pytest.mark.parametrize("per_task", [500_000, 2])
def test_betweenness_equals_enumeration(spark, by, per_task):
    pairs = [(a, b) for a, b in itertools.combinations("abcdefgh", 2) if (ord(a) * ord(b)) % 3 == 0]
    pairs += [("h", "i"), ("i", "j"), ("k", "l")]
    df = spark.createDataFrame([(a, b, 500) for a, b in pairs], "a STRING, b STRING, score INT")
    graph = gr.prepare_graph(df, per_task)
    nodes = sorted({x for p in pairs for x in p})
    rows = by(gr.betweenness(graph, k=len(nodes)), "node")
    want = brute_betweenness(pairs, nodes)
    assert {k: pytest.approx(v) for k, v in want.items()} == {
        k: r["betweenness"] for k, r in rows.items()}
    chosen = [r["node"] for r in gr.sampled_sources(graph.nodes, 4).collect()]
    sampled = by(gr.betweenness(graph, k=4), "node")
    want = brute_betweenness(pairs, chosen)
    assert {k: pytest.approx(v) for k, v in want.items()} == {
        k: r["betweenness"] for k, r in sampled.items()}


def test_middle_node_is_more_between(edges, by):
    rows = by(gr.betweenness(gr.prepare_graph(edges), k=10), "node")
    assert rows["k3"]["betweenness"] > rows["k2"]["betweenness"] == rows["k4"]["betweenness"] == 0.0


@pytest.mark.parametrize("per_task", [500_000, 1])
def test_pagerank_matches_power_iteration(edges, by, per_task):
    import numpy as np

    n = len(NODES)
    m = np.zeros((n, n))
    for a, b, w in EDGES:
        i, j = NODES.index(a), NODES.index(b)
        m[i, j] = m[j, i] = w
    m = m / m.sum(axis=1, keepdims=True)
    x = np.full(n, 1 / n)
    while True:
        new = 0.15 / n + 0.85 * x @ m
        done = np.abs(new - x).sum() < n * 1e-6
        x = new
        if done:
            break
    rows = by(gr.pagerank(gr.prepare_graph(edges, per_task)), "node")
    assert [rows[n]["pagerank"] for n in NODES] == pytest.approx(list(x))
    assert sum(r["pagerank"] for r in rows.values()) == pytest.approx(1.0)


def test_pagerank_says_when_it_does_not_converge(edges):
    with pytest.raises(RuntimeError):
        gr.pagerank(gr.prepare_graph(edges), max_iterations=1)


def test_centralities_do_not_depend_on_edge_order(spark, edges, by):
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score").orderBy("a")
    def run(e):
        rows = by(gr.centralities(gr.prepare_graph(e), k=3), "node")
        return {k: [round(v, 12) for v in (r["net__pagerank"], r["dim__network"],
                                          r["net__betweenness"])] for k, r in rows.items()}
    assert run(edges) == run(turned)


def test_top_partners_stay_inside_the_universe(spark, edges):
    universe = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("m1",)], "node STRING")
    rows = gr.top_partners(edges, universe, "node", 25, 1).collect()
    assert {(r["node"], r["partner_id"], r["score"]) for r in rows} == {
        ("k1", "k2", 30), ("k2", "k3", 70), ("k3", "k2", 70)}


def test_betweenness_steps_hold_one_row_per_node_and_block_of_sources(spark, by):
    from evirank.operators import brandes

    # a wheel with spokes: the hub has 75 edges, the sources fill two blocks
    pairs = [("hub", f"r{i:02d}") for i in range(75)] + [(f"r{i:02d}", f"r{(i + 1) % 75:02d}") for i in range(0, 75, 2)]
    df = spark.createDataFrame([(min(p), max(p), 500) for p in pairs], "a STRING, b STRING, score INT").distinct()
    graph = gr.prepare_graph(df)
    nodes = sorted({x for p in pairs for x in p})
    coded = brandes.code_graph(graph.nodes, graph.edges, 10)
    first = brandes.first_level(coded, graph.nodes.select("node"))
    second = brandes.next_level(coded, first, None)
    # as rows per source the second level has one for every edge and direction
    ends = 2 * df.count()
    keys = [tuple(r) for r in second.select("node", "block").collect()]
    assert len(keys) == len(set(keys)) <= 2 * len(nodes) < ends + len(nodes)
    # no partition holds the hub's edges alone, and every edge lies in one
    assert coded.edges.count() == df.count() and coded.edges.select("part").distinct().count() > 3
    rows = by(gr.betweenness(graph, k=len(nodes)), "node")
    want = brute_betweenness({(min(p), max(p)) for p in pairs}, nodes)
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r["betweenness"] for k, r in rows.items()}


def test_vectors_are_written_without_their_zeros():
    import numpy as np

    from evirank.operators import brandes

    x = np.zeros((3, brandes.WIDTH))
    x[0, 5], x[2, 0], x[2, 63] = 2.5, 1.0, 7.0
    packed = brandes._binary(x)
    assert [len(v.as_py()) for v in packed] == [16, 8, 24]
    assert (brandes._dense(packed) == x).all() and (brandes._dense(packed.slice(1)) == x[1:]).all()


def test_steps_leave_neither_shuffle_files_nor_old_tables(spark, edges):
    import glob
    import os
    import time

    from evirank import session

    def files():
        return set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data"))

    def left(cut):
        before = files()
        cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        time.sleep(1)  # files go in the background
        return len(files() - before)

    local = spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp"))
    assert left(session.stored) == left(session.cut_lineage) == 0
    assert spark.conf.get(session._FREED, None) is None
    spark.conf.set(session._FREED, "false")
    try:
        assert left(session.stored) > 0  # the session's own setting holds
    finally:
        spark.conf.unset(session._FREED)
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = set(os.listdir(folder))
    graph = gr.prepare_graph(edges)
    gr.betweenness(graph, k=10)
    # pairs, nodes, ids, packed edges, places and the summed betweenness; no levels
    assert len([t for t in set(os.listdir(folder)) - tables if t.startswith("table-")]) == 6


def test_local_columns_come_from_the_prepared_graph(edges, by):
    graph = gr.prepare_graph(edges)
    assert by(graph.features(), "node") == by(gr.node_features(edges), "node")
    graph.release()
    assert graph.nodes.count() == len(NODES)
