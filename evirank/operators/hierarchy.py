"""Parent/child hierarchies: roots, root counts, overlaps and membership detail."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evirank.columns import ITEM, MISSING_PREFIX, PATHWAY_PREFIX, dim
from evirank.functions.numeric import saturate
from evirank.session import cut_lineage

ROOT_SATURATION = 5
N_ROOTS = PATHWAY_PREFIX + "n_pathways"


def find_roots(
    relations: DataFrame, parent: str = "parent_id", child: str = "child_id"
) -> DataFrame:
    """``node, root`` for every node that occurs in the relations.

    Pointer jumping: each round replaces a node's ancestor by that ancestor's
    own ancestor, so depth d takes log2(d) rounds. A child with several parents
    keeps the largest one (a table has no file order). Nodes on, or leading
    into, a cycle get the smallest id of that cycle.
    """
    parents = relations.groupBy(F.col(child).alias("node")).agg(F.max(parent).alias("anc"))
    tops = relations.select(F.col(parent).alias("node")).distinct().join(
        parents, "node", "left_anti"
    ).select("node", F.col("node").alias("root"))
    # anc: ancestor reached so far; low: smallest id among the ancestors passed;
    # done: anc is a root
    state = cut_lineage(
        parents.join(tops.select(F.col("node").alias("anc"), F.lit(True).alias("_top")),
                     "anc", "left")
        .select("node", "anc", F.col("anc").alias("low"),
                F.coalesce("_top", F.lit(False)).alias("done"))
    )
    n = state.count()
    rounds = math.ceil(math.log2(n + 1)) + 1 if n else 0
    for _ in range(rounds):
        still = state.where(~F.col("done"))
        if still.isEmpty():
            break
        ahead = state.select(
            F.col("node").alias("anc"), F.col("anc").alias("_next"), F.col("low").alias("_low"),
            F.col("done").alias("_done"),
        )
        stepped = still.join(ahead, "anc").select(
            "node", F.col("_next").alias("anc"), F.least("low", "_low").alias("low"),
            F.col("_done").alias("done"),
        )
        state = cut_lineage(state.where("done").unionByName(stepped))
    found = tops.unionByName(state.where("done").select("node", F.col("anc").alias("root")))
    # what is left leads into a cycle: the ancestor reached lies on it and has gone round it
    cyclic = state.where(~F.col("done")).select("node", "anc")
    low = state.select(F.col("node").alias("anc"), F.col("low").alias("root"))
    return found.unionByName(cyclic.join(low, "anc").select("node", "root"))


def with_roots(
    memberships: DataFrame, roots: DataFrame, node: str = "pathway_id"
) -> DataFrame:
    """Attach the root of each membership's node; an unknown node is its own root."""
    joined = memberships.join(
        roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left"
    )
    return joined.withColumn("root_id", F.coalesce("_root", node)).drop("_root")


def memberships_of(
    universe: DataFrame, memberships: DataFrame, roots: DataFrame, item: str = ITEM,
    node: str = "pathway_id",
) -> DataFrame:
    """Membership rows of the requested items with their roots; all rows kept."""
    kept = memberships.join(universe.select(item).distinct(), item, "left_semi")
    return with_roots(kept, roots, node)


def add_root_features(df: DataFrame, rooted: DataFrame, item: str = ITEM) -> DataFrame:
    """Append distinct roots per item, their saturating share and the missing flag."""
    counts = rooted.groupBy(item).agg(F.countDistinct("root_id").alias(N_ROOTS))
    return df.join(counts, item, "left").withColumns({
        dim("pathways"): saturate(F.col(N_ROOTS), ROOT_SATURATION),
        MISSING_PREFIX + "pathways": F.col(N_ROOTS).isNull().cast("byte"),
    })


def root_features(universe: DataFrame, rooted: DataFrame, item: str = ITEM) -> DataFrame:
    """The root features of the requested items, one row each."""
    return add_root_features(universe.select(item).distinct(), rooted, item)


def root_overlap(
    universe: DataFrame, rooted: DataFrame, seeds: DataFrame, groups: list[str] | None = None,
    item: str = ITEM, out: str = PATHWAY_PREFIX + "overlap_with_known",
) -> DataFrame:
    """Share of an item's roots that are also roots of the group's seeds.

    ``universe`` and ``seeds`` hold ``groups + item``. Null without memberships
    or when no seed has one.
    """
    groups = groups or []
    pairs = rooted.select(item, "root_id").distinct()
    seed_roots = seeds.select(*groups, item).distinct().join(pairs, item).select(
        *groups, "root_id"
    ).distinct()
    asked = universe.select(*groups, item).distinct()
    has_seeds = seed_roots.select(*groups).distinct().withColumn("_seeded", F.lit(True))
    if not groups:
        has_seeds = seed_roots.agg((F.count(F.lit(1)) > 0).alias("_seeded")).withColumn(
            "_one", F.lit(1)
        )
        asked = asked.withColumn("_one", F.lit(1))
    flagged = asked.join(has_seeds, groups or ["_one"], "left").drop("_one")
    hits = (
        asked.drop("_one").join(pairs, item)
        .join(seed_roots.withColumn("_hit", F.lit(1.0)), [*groups, "root_id"], "left")
        .groupBy(*groups, item)
        .agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("_share"))
    )
    return flagged.join(hits, [*groups, item], "left").select(
        *groups, item,
        F.when(F.coalesce("_seeded", F.lit(False)), F.col("_share")).alias(out),
    )


def membership_detail(
    rooted: DataFrame, names: DataFrame, item: str = ITEM, node: str = "pathway_id",
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per (item, node) with the root's name, falling back to its id.

    ``names`` holds ``node, name``. Duplicates keep the smallest of the extra
    columns taken together, so the choice is the same on every run.
    """
    extra = extra or []
    first = F.min(F.struct(F.col("root_id"), *[F.col(c) for c in extra])).alias("_first")
    unique = rooted.groupBy(item, node).agg(first).select(item, node, "_first.*")
    names_unique = names.groupBy(F.col("node").alias("root_id")).agg(
        F.min("name").alias("root_name")
    )
    named = unique.join(names_unique, "root_id", "left")
    return named.withColumn("root_name", F.coalesce("root_name", "root_id"))


def root_groups(detail: DataFrame, item: str = ITEM, node: str = "pathway_id") -> DataFrame:
    """Membership count per (item, root) and the root's place: biggest first, then by name."""
    sizes = detail.groupBy(item, "root_id", "root_name").agg(F.count(node).alias("n_pathways"))
    w = W.partitionBy(item).orderBy(F.desc("n_pathways"), "root_name", "root_id")
    # a window over one item's roots: at most the number of roots of the hierarchy
    return sizes.withColumn("position", F.row_number().over(w).cast("long"))
