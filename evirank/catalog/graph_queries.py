"""Graph and hierarchy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import label_queries  # noqa: F401  (registers the label blocks)
from evirank.catalog import tables as t
from evirank.operators import graph as gr
from evirank.operators import hierarchy as hi
from evirank.operators.ranking import average_rank_share


@query("edge_collapse", "SELECT * FROM edges")
def edge_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return t.edges(spark, sf)


@query("symmetric_edges", "SELECT * FROM both_ways")
def symmetric_edges(spark: SparkSession, sf: str) -> DataFrame:
    return gr.symmetric(t.edges(spark, sf))


@query("degree_features", """
SELECT node, degree AS net__degree, strength AS net__weighted_degree,
       round(mean_score, 6) AS net__mean_confidence FROM node_stats
""")
def degree_features(spark: SparkSession, sf: str) -> DataFrame:
    out = gr.node_features(t.edges(spark, sf))
    return out.withColumn("net__mean_confidence", F.round("net__mean_confidence", 6))


def pagerank_sql(steps: int = 70) -> str:
    """Unrolled steps; ``final`` holds the first one whose change is below the tolerance."""
    blocks = ["r0 AS (SELECT node, strength, 1.0 / (SELECT count(*) FROM node_stats) AS r "
              "FROM node_stats)"]
    for i in range(1, steps + 1):
        blocks.append(f"""r{i} AS MATERIALIZED (
SELECT n.node, n.strength, 0.15 / (SELECT count(*) FROM node_stats) + 0.85 * coalesce(x.inflow, 0) AS r
FROM node_stats n LEFT JOIN (
  SELECT dst AS node, sum(score * r / strength) AS inflow
  FROM both_ways JOIN r{i - 1} ON node = src GROUP BY 1) x USING (node))""")
    changes = " UNION ALL ".join(
        f"SELECT {i} AS step, sum(abs(x.r - y.r)) AS change FROM r{i} x JOIN r{i - 1} y USING (node)"
        for i in range(1, steps + 1))
    ranks = " UNION ALL ".join(f"SELECT {i} AS step, node, r FROM r{i}" for i in range(1, steps + 1))
    blocks.append(f"changed AS ({changes})")
    blocks.append(f"""final AS (SELECT node, r FROM ({ranks}) WHERE step = (
  SELECT min(step) FROM changed WHERE change < 1e-6 * (SELECT count(*) FROM node_stats)))""")
    return "WITH " + ",\n".join(blocks)


@query("pagerank", pagerank_sql() + " SELECT node, round(r, 10) AS pagerank FROM final")
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """To convergence at the operator's own tolerance."""
    graph = gr.prepare_graph(t.edges(spark, sf))
    ranks = gr.pagerank(graph)
    graph.release()
    return ranks.withColumn("pagerank", F.round("pagerank", 10))


@query("pagerank_percentile", pagerank_sql() + """
SELECT node, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)
                   / count(*) OVER (), 9) AS dim__network
FROM (SELECT node, round(r, 10) AS v FROM final)
""")
def pagerank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile over the whole graph of the converged PageRank."""
    graph = gr.prepare_graph(t.edges(spark, sf))
    ranks = gr.pagerank(graph)
    graph.release()
    rounded = ranks.select("node", F.round("pagerank", 10).alias("v"))
    out = average_rank_share(rounded, "v", "dim__network", [F.col("node")])
    return out.select("node", F.round("dim__network", 9).alias("dim__network"))


def betweenness_sql(k: int, levels: int) -> str:
    """Breadth-first levels forward, dependencies backward, unrolled."""
    blocks = [
        f"src AS (SELECT node AS source FROM node_stats ORDER BY md5('0|' || node), node LIMIT {k})",
        "l0 AS MATERIALIZED (SELECT source, source AS node, 1.0 AS sigma FROM src)",
        "seen0 AS MATERIALIZED (SELECT source, node FROM l0)",
    ]
    for i in range(1, levels + 1):
        blocks.append(f"""l{i} AS MATERIALIZED (
SELECT source, dst AS node, sum(sigma) AS sigma FROM l{i - 1} JOIN pairs ON l{i - 1}.node = pairs.src
WHERE NOT EXISTS (SELECT 1 FROM seen{i - 1} s WHERE s.source = l{i - 1}.source AND s.node = dst)
GROUP BY 1, 2)""")
        blocks.append(f"seen{i} AS MATERIALIZED (SELECT * FROM seen{i - 1} UNION ALL "
                      f"SELECT source, node FROM l{i})")
    blocks.append(f"d{levels} AS MATERIALIZED (SELECT *, 0.0 AS delta FROM l{levels})")
    for i in range(levels - 1, 0, -1):
        blocks.append(f"""d{i} AS MATERIALIZED (
SELECT a.source, a.node, a.sigma, a.sigma * coalesce(sum((1 + b.delta) / b.sigma), 0) AS delta
FROM l{i} a LEFT JOIN pairs ON pairs.src = a.node
LEFT JOIN d{i + 1} b ON b.source = a.source AND b.node = pairs.dst
GROUP BY 1, 2, 3)""")
    union = " UNION ALL ".join(f"SELECT node, delta FROM d{i}" for i in range(1, levels + 1))
    return ("WITH pairs AS (SELECT src, dst FROM both_ways), " + ",\n".join(blocks)
            + f", summed AS (SELECT node, sum(delta) AS d FROM ({union}) GROUP BY 1)")


@query("betweenness", betweenness_sql(gr.BETWEENNESS_SOURCES, 6) + f"""
SELECT node, round(coalesce(d, 0) * (n / least(n, {gr.BETWEENNESS_SOURCES}.0)) / ((n - 1) * (n - 2)), 9)
       AS betweenness
FROM node_stats LEFT JOIN summed USING (node), (SELECT count(*)::DOUBLE AS n FROM node_stats)
""")
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    """Betweenness over the operator's own number of sources."""
    graph = gr.prepare_graph(t.edges(spark, sf))
    out = gr.betweenness(graph)
    graph.release()
    return out.withColumn("betweenness", F.round("betweenness", 9))


cte("seeds", """
SELECT p_type AS group_id, 'P' || p_partkey AS node FROM part
WHERE p_size = 50
""")


def _distance_sql(levels: int) -> str:
    blocks = ["h0 AS MATERIALIZED (SELECT DISTINCT group_id, s.node, 0 AS distance FROM seeds s "
              "JOIN node_stats USING (node))"]
    for i in range(1, levels + 1):
        blocks.append(f"""h{i} AS MATERIALIZED (
SELECT * FROM h{i - 1} UNION ALL
SELECT DISTINCT group_id, dst, {i} FROM h{i - 1} JOIN both_ways ON src = node
WHERE distance = {i - 1} AND NOT EXISTS (
  SELECT 1 FROM h{i - 1} s WHERE s.group_id = h{i - 1}.group_id AND s.node = dst))""")
    return "WITH " + ", ".join(blocks)


@query("seed_distance", _distance_sql(8) + " SELECT group_id, node, distance FROM h8")
def seed_distance(spark: SparkSession, sf: str) -> DataFrame:
    seeds = t.read(spark, sf, "part", "p_partkey", "p_type", "p_size").where(
        F.col("p_size") == 50
    ).select(F.col("p_type").alias("group_id"), F.concat(F.lit("P"), "p_partkey").alias("node"))
    graph = gr.prepare_graph(t.edges(spark, sf))
    out = gr.seed_distances(graph, seeds, ["group_id"])
    graph.release()
    return out


cte("partners", """
SELECT node, partner_id, score, position FROM (
  SELECT src AS node, dst AS partner_id, score,
         row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS position
  FROM both_ways WHERE score >= 700) WHERE position <= 15
""")


@query("top_partners", "SELECT * FROM partners")
def top_partners(spark: SparkSession, sf: str) -> DataFrame:
    universe = t.node_lookup(spark, sf).select("node")
    return gr.top_partners(t.edges(spark, sf), universe, "node")


@query("hierarchy_roots", "SELECT DISTINCT node, root FROM roots")
def hierarchy_roots(spark: SparkSession, sf: str) -> DataFrame:
    return hi.find_roots(t.relations(spark, sf))


def rooted(spark: SparkSession, sf: str) -> DataFrame:
    return hi.with_roots(t.memberships(spark, sf), hi.find_roots(t.relations(spark, sf)))


@query("membership_roots", "SELECT * FROM rooted")
def membership_roots(spark: SparkSession, sf: str) -> DataFrame:
    return rooted(spark, sf)


cte("root_counts", """
SELECT item_id, n_roots AS path__n_pathways, least(1.0, n_roots / 5.0) AS dim__pathways,
       (n_roots IS NULL)::INT AS missing__pathways
FROM (SELECT p_partkey AS item_id FROM part)
LEFT JOIN (SELECT item_id, count(DISTINCT root_id) AS n_roots FROM rooted GROUP BY 1) USING (item_id)
""")


@query("root_counts", "SELECT * FROM root_counts")
def root_counts(spark: SparkSession, sf: str) -> DataFrame:
    universe = t.read(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("item_id"))
    return hi.root_features(universe, rooted(spark, sf))


@query("root_overlap", """
SELECT d.group_id, d.item_id,
       round(avg(CASE WHEN s.root_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9)
           AS path__overlap_with_known
FROM (SELECT DISTINCT group_id, item_id FROM dims) d
JOIN (SELECT DISTINCT item_id, root_id FROM rooted) r USING (item_id)
JOIN (SELECT DISTINCT group_id FROM pos) g USING (group_id)
LEFT JOIN (SELECT DISTINCT p.group_id, r.root_id FROM pos p
           JOIN (SELECT DISTINCT item_id, root_id FROM rooted) r USING (item_id)) s
  ON s.group_id = d.group_id AND s.root_id = r.root_id
GROUP BY 1, 2
""")
def root_overlap(spark: SparkSession, sf: str) -> DataFrame:
    from evirank.operators.evidence import drop_denied_sources
    from evirank.session import cut_lineage

    ev = cut_lineage(t.evidence(spark, sf))
    known = t.labels(spark, sf, ev).where(F.col("label") == 1)
    universe = drop_denied_sources(ev, t.RULES).select("group_id", "item_id")
    out = hi.root_overlap(universe, rooted(spark, sf), known, ["group_id"])
    return out.withColumn("path__overlap_with_known", F.round("path__overlap_with_known", 9))


cte("detail", """
SELECT item_id, pathway_id, root_id, min(evidence_code) AS evidence_code,
       coalesce(r_name, root_id) AS root_name
FROM rooted LEFT JOIN region ON root_id = 'R' || r_regionkey AND r_regionkey <> 3
GROUP BY 1, 2, 3, 5
""")


def detail(spark: SparkSession, sf: str) -> DataFrame:
    """Membership detail; one region has no name, so its id stands in."""
    names = t.read(spark, sf, "region").where(F.col("r_regionkey") != 3).select(
        F.concat(F.lit("R"), "r_regionkey").alias("node"), F.col("r_name").alias("name"))
    return hi.membership_detail(rooted(spark, sf), names, extra=["evidence_code"])


@query("membership_detail", "SELECT * FROM detail")
def membership_detail(spark: SparkSession, sf: str) -> DataFrame:
    return detail(spark, sf)


@query("root_groups", """
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_pathways DESC, root_name, root_id)
       AS position
FROM (SELECT item_id, root_id, root_name, count(*) AS n_pathways FROM detail GROUP BY 1, 2, 3)
""")
def root_groups(spark: SparkSession, sf: str) -> DataFrame:
    return hi.root_groups(detail(spark, sf))
