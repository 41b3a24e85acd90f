"""Undirected weighted graphs as edge tables.

``prepare_graph`` stores every edge once, and every node with its fanout. Distances
walk the edges both ways with a salt: a hub's edges sit under several ``(src, salt)``
keys and the hub's state is repeated per salt, so no step puts all edges of one hub
into one task. PageRank and betweenness walk edges packed per partition
(:mod:`brandes`). Iterations are cut by stored tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.columns import MISSING_PREFIX, NETWORK_PREFIX, dim
from evirank.operators import brandes
from evirank.operators.ranking import average_rank_share, running_totals, top_n
from evirank.session import ROWS_PER_TASK, cut_lineage, drop_stored, spread, stored

# Score bands and walk parameters.
MIN_SCORE = 400
PARTNER_MIN_SCORE = 700
PARTNERS_SHOWN = 15
STEPS_AT_ONCE = 1
DAMPING = 0.85
TOLERANCE = 1.0e-6
MAX_ITERATIONS = 100
BETWEENNESS_SOURCES = 500

EDGES_PER_TASK = 500_000
PACKED_PER_TASK = 1_500_000  # packed, an edge is 24 bytes in a task; fewer tasks hold a hub fewer times


@dataclass(frozen=True)
class Graph:
    """``pairs(a, b, score)`` once each, ``nodes(node, degree, strength, fanout)``.

    ``has_hubs`` tells whether any node has a fanout above one, ``ends`` the sum of the degrees.
    """

    pairs: DataFrame
    nodes: DataFrame
    has_hubs: bool
    ends: int

    @cached_property
    def edges(self) -> DataFrame:
        """``(src, dst, score, salt)`` both ways, placed by the step key and kept from the first use on."""
        both = symmetric(self.pairs)
        if not self.has_hubs:
            return _placed(both.withColumn("salt", F.lit(0)), self.ends)
        hubs = self.nodes.where(F.col("fanout") > 1).select(F.col("node").alias("src"), "fanout")
        return _placed(both.join(hubs, "src", "left").withColumn(
            "salt",
            F.when(F.col("fanout").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64("dst"), F.col("fanout")).cast("int")
            ),
        ).drop("fanout"), self.ends)

    @cached_property
    def coded(self) -> brandes.CodedGraph:
        """The edges packed per partition, from the first use on."""
        return brandes.code_graph(self.nodes, symmetric(self.pairs), PACKED_PER_TASK)

    def features(self) -> DataFrame:
        """As ``node_features`` of the pairs, from what the nodes hold already."""
        return self.nodes.select(
            "node", F.col("degree").alias(NETWORK_PREFIX + "degree"),
            F.col("strength").alias(NETWORK_PREFIX + "weighted_degree"),
            (F.col("strength") / F.col("degree")).alias(NETWORK_PREFIX + "mean_confidence"),
        )

    def release(self) -> None:
        """Drop the edges in all their forms; finished results do not need them."""
        if "edges" in self.__dict__:
            self.edges.unpersist()
        if "coded" in self.__dict__:
            drop_stored(self.coded.packed, self.coded.places)
        drop_stored(self.pairs)

    def spread(self, state: DataFrame, node: str = "node") -> DataFrame:
        """Repeat each state row once per salt of its node."""
        if not self.has_hubs:
            return state.withColumn("salt", F.lit(0))
        fanout = self.nodes.select(F.col("node").alias(node), "fanout")
        return state.join(fanout, node).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("fanout") - 1))
        ).drop("fanout")


def collapse_edges(
    edges: DataFrame, a: str = "a", b: str = "b", score: str = "score", rows: int | None = None
) -> DataFrame:
    """One row per unordered pair with the max score; self-loops dropped. ``rows``, if known, sizes the tasks."""
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(score).alias("score"))
    if rows is not None:
        pairs = spread(pairs, rows, "a", "b")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))


def translate_edges(
    raw: DataFrame, lookup: DataFrame, min_score: float = MIN_SCORE, left: str = "raw_a",
    right: str = "raw_b", score: str = "score", raw_id: str = "raw_id", node: str = "node",
    rows: int | None = None,
) -> DataFrame:
    """Threshold, translate both endpoints (inner), drop self-loops, collapse.

    The lookup may map one raw id to several nodes; each mapping counts.
    """
    # repeated raw pairs meet in the collapse, and only there
    kept = raw.where(F.col(score) >= min_score).select(left, right, score)
    pairs = lookup.select(F.col(raw_id).alias(left), F.col(node).alias("a")).distinct()
    pairs_b = lookup.select(F.col(raw_id).alias(right), F.col(node).alias("b")).distinct()
    both = kept.join(pairs, left).join(pairs_b, right)
    return collapse_edges(both, "a", "b", score, rows)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score")
    )


def node_features(edges: DataFrame) -> DataFrame:
    """Degree, weighted degree and mean edge score of every node."""
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias(NETWORK_PREFIX + "degree"),
        F.sum("score").cast("double").alias(NETWORK_PREFIX + "weighted_degree"),
        F.avg("score").alias(NETWORK_PREFIX + "mean_confidence"),
    )


def prepare_graph(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> Graph:
    pairs = stored(edges.select("a", "b", "score"))
    nodes = stored(
        symmetric(pairs).groupBy(F.col("src").alias("node")).agg(
            F.count(F.lit(1)).alias("degree"), F.sum("score").cast("double").alias("strength")
        ).withColumn("fanout", F.ceil(F.col("degree") / F.lit(edges_per_task)).cast("int"))
    )
    ends, fanout = nodes.agg(F.sum("degree"), F.max("fanout")).first()
    return Graph(pairs, nodes, (fanout or 0) > 1, ends or 0)


def _placed(edges: DataFrame, rows: int) -> DataFrame:
    """Edges hash-partitioned by the step key once, so that no iteration shuffles them again.

    The cached partitions are rebuilt from the stored pairs when an executor is lost.
    """
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_TASK))
    placed = edges.repartition(n, "src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    # only a filled cache tells the planner how it is partitioned
    placed.count()
    return placed


def pagerank(
    graph: Graph, damping: float = DAMPING, tolerance: float = TOLERANCE,
    max_iterations: int = MAX_ITERATIONS,
) -> DataFrame:
    """Weighted PageRank; stops when the L1 change is below ``n * tolerance``.

    Raises when ``max_iterations`` is reached first, unless ``tolerance`` is 0,
    which asks for exactly that many iterations. The change is looked at, and the
    lineage cut, every ``STEPS_AT_ONCE`` iterations.
    """
    n = graph.nodes.count()
    if n == 0:
        return graph.nodes.select("node", F.lit(0.0).alias("pagerank"))
    base = (1.0 - damping) / n
    ids = graph.coded.ids
    state = stored(graph.nodes.join(ids, "node").select(F.col("id").alias("node"), "strength"))
    ranks, kept, done = state.withColumn("pagerank", F.lit(1.0 / n)), [], 0
    while done < max_iterations:
        steps = min(STEPS_AT_ONCE, max_iterations - done)
        for _ in range(steps):
            unit = ranks.select("node", (F.col("pagerank") / F.col("strength")).alias("x"))
            inflow = brandes.weighted_sums(graph.coded, unit).withColumnRenamed("x", "_in")
            new = F.lit(base) + damping * F.coalesce(F.col("_in"), F.lit(0.0))
            ranks = ranks.select("node", "strength", "pagerank").join(inflow, "node", "left").select(
                "node", "strength", new.alias("pagerank"), F.abs(new - F.col("pagerank")).alias("_change"),
            )
        ranks, done = stored(ranks), done + steps
        drop_stored(*kept)
        kept = [ranks]
        if tolerance and ranks.agg(F.sum("_change")).first()[0] < n * tolerance:
            break
    else:
        if tolerance:
            raise RuntimeError(f"PageRank did not converge in {max_iterations} iterations")
    drop_stored(state)
    return ranks.withColumnRenamed("node", "id").join(ids, "id").select("node", "pagerank")


def seed_distances(
    graph: Graph, seeds: DataFrame, groups: list[str] | None = None, max_hops: int | None = None
) -> DataFrame:
    """Hops to the nearest seed of each group; unreachable nodes have no row.

    ``seeds`` holds ``groups + node``; all groups are walked together, one
    distributed frontier step per hop. A frontier row is a node and the groups of
    one block of 64 that reach it, as bits, so that a step moves no row per group.
    """
    groups = groups or []
    known = cut_lineage(
        seeds.select(*groups, "node").distinct().join(graph.nodes.select("node"), "node", "left_semi"))
    numbers = _numbered(known, groups)
    of_group = [known[g].eqNullSafe(numbers[g]) for g in groups]
    placed = known.join(numbers, reduce(lambda a, b: a & b, of_group, F.lit(True)))
    frontier = cut_lineage(placed.groupBy("node", "block").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    levels, none = [frontier], F.lit(0).cast("long")
    while max_hops is None or len(levels) <= max_hops:
        if frontier.isEmpty():
            break
        ahead = graph.spread(frontier).withColumnRenamed("node", "src").join(
            graph.edges.select("src", "dst", "salt"), ["src", "salt"]
        ).select(F.col("dst").alias("node"), "block", F.col("bits").alias("_new"), none.alias("_old"))
        # a neighbour of a level lies in it, in the one before, or in the next
        for level in levels[-2:]:
            ahead = ahead.unionByName(level.select("node", "block", none.alias("_new"), F.col("bits").alias("_old")))
        met = ahead.groupBy("node", "block").agg(F.bit_or("_new").alias("_new"), F.bit_or("_old").alias("_old"))
        frontier = cut_lineage(met.select(
            "node", "block", F.col("_new").bitwiseAND(F.bitwise_not("_old")).alias("bits")
        ).where(F.col("bits") != 0))
        levels.append(frontier)
    found = reduce(DataFrame.unionByName, [
        level.withColumn("distance", F.lit(hop).cast("long")) for hop, level in enumerate(levels)])
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return found.select("node", "block", "distance", F.explode(held).alias("bit")).join(
        numbers, ["block", "bit"]).select(*groups, "node", "distance")


def _numbered(known: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, block, bit``: the groups numbered in blocks of 64, small enough a table to be joined back."""
    if not groups:
        one = known.sparkSession.range(1)
        return one.select(F.lit(0).cast("long").alias("block"), F.lit(0).alias("bit"))
    order = [F.col(g).asc_nulls_first() for g in groups]
    place = F.col("_k") - 1
    return cut_lineage(running_totals(known.select(*groups).distinct(), [], order, rank="_k").select(
        *groups, F.floor(place / 64).alias("block"), F.pmod(place, F.lit(64)).cast("int").alias("bit")))


def sampled_sources(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k nodes with the smallest seeded hash: does not depend on row order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string")))
    return nodes.select("node", key.alias("_h")).orderBy("_h", "node").limit(k).select("node")


def betweenness(graph: Graph, k: int = BETWEENNESS_SOURCES, seed: int = 0) -> DataFrame:
    """Sampled, unweighted, normalised betweenness of every node.

    Brandes' method as tables of vectors over blocks of sources (:mod:`brandes`): path counts
    go forward level by level, dependencies come back by level. Scaled by
    ``n/k / ((n-1)(n-2))``, so ``k >= n`` is exact.
    """
    n = graph.nodes.count()
    sources = cut_lineage(sampled_sources(graph.nodes, k, seed))
    used = min(k, n)
    coded = graph.coded
    levels = [brandes.first_level(coded, sources)]
    while True:
        nxt = stored(brandes.next_level(coded, levels[-1], levels[-2] if len(levels) > 1 else None))
        if nxt.isEmpty():
            drop_stored(nxt)
            break
        levels.append(nxt)

    # delta(v) = sum over successors w of sigma(v)/sigma(w) * (1 + delta(w))
    deeper = brandes.deepest(levels[-1])
    parts = []
    for level in reversed(levels[1:-1]):
        deeper = stored(brandes.returned(coded, level, deeper))
        drop_stored(levels.pop())
        parts.append(deeper)
    scale = (n / used) / ((n - 1) * (n - 2)) if n > 2 else (n / used if used else 0.0)
    if not parts:
        return graph.nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = reduce(DataFrame.unionByName, [p.select("node", "delta") for p in parts]).groupBy(
        F.col("node").alias("id")).agg(F.sum("delta").alias("_d"))
    summed = stored(total.join(coded.ids, "id").drop("id"))
    drop_stored(*levels, *parts)
    return graph.nodes.select("node").join(summed, "node", "left").select(
        "node", (F.coalesce(F.col("_d"), F.lit(0.0)) * F.lit(scale)).alias("betweenness")
    )


def centralities(
    graph: Graph, k: int = BETWEENNESS_SOURCES, seed: int = 0, with_betweenness: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """PageRank, its percentile over the whole graph, and betweenness, per node.

    With ``digits`` PageRank is rounded before it is ranked: nodes that differ only by the order
    of summation tie.
    """
    graph.coded  # noqa: B018  packed once, before both walk it
    with ThreadPool(2) as pool:
        # many short jobs each: one fills the gaps of the other
        other = pool.apply_async(
            inheritable_thread_target(graph.nodes.sparkSession)(betweenness), (graph, k, seed)) if with_betweenness else None
        ranks = pagerank(graph)
        between = other.get() if with_betweenness else None
    if digits is not None:
        ranks = ranks.withColumn("pagerank", F.round("pagerank", digits))
    out = average_rank_share(ranks, "pagerank", dim("network"), [F.col("node")])
    out = out.withColumnRenamed("pagerank", NETWORK_PREFIX + "pagerank")
    if with_betweenness:
        out = out.join(
            between.withColumnRenamed("betweenness", NETWORK_PREFIX + "betweenness"), "node", "left"
        )
    return out


def network_features(
    universe: DataFrame, edges: DataFrame, central: DataFrame, item: str
) -> DataFrame:
    """One row per requested item; items outside the graph are null and flagged."""
    return network_of_items(universe, node_features(edges).join(central, "node", "left"), item)


def network_of_items(universe: DataFrame, network: DataFrame, item: str) -> DataFrame:
    """The columns of ``network(node, ...)`` for each requested item, null and flagged outside the graph."""
    local = network.withColumnRenamed("node", item)
    return universe.select(item).distinct().join(local, item, "left").withColumn(
        MISSING_PREFIX + "network",
        F.col(NETWORK_PREFIX + "degree").isNull().cast("byte"),
    )


def top_partners(
    edges: DataFrame, universe: DataFrame, item: str, min_score: float = PARTNER_MIN_SCORE,
    n: int = PARTNERS_SHOWN, partner: str = "partner_id",
) -> DataFrame:
    """The n strongest partners per item, both ends inside the universe."""
    inside = universe.select(F.col(item).alias("src")).distinct()
    both = symmetric(edges.where(F.col("score") >= min_score))
    kept = both.join(inside, "src", "left_semi").join(
        inside.withColumnRenamed("src", "dst"), "dst", "left_semi"
    )
    ranked = top_n(kept, "src", [F.col("score").desc(), F.col("dst").asc()], n, "position")
    return ranked.select(
        F.col("src").alias(item), F.col("dst").alias(partner), F.col("score"), "position"
    )
