"""Evidence, matrix and row-wise queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import tables as t
from evirank.columns import dim
from evirank.operators import evidence as ev
from evirank.operators import joins, matrix, quality
from evirank.operators.ranking import exact_median
from evirank.plans.features import build_feature_table, evidence_features


@query("evidence_scan", """
SELECT c_mktsegment AS group_id, l_partkey AS item_id, o_orderpriority AS source,
       l_discount AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING'
""")
def evidence_scan(spark: SparkSession, sf: str) -> DataFrame:
    names = {"c_mktsegment": "group_id", "l_partkey": "item_id", "o_orderpriority": "source",
             "l_discount": "score"}
    return ev.candidates(t.associations(spark, sf), "BUILDING", names, "c_mktsegment")


@query("overall_scores", """
SELECT group_id, item_id, score AS assoc_overall__score FROM ev
WHERE group_id = 'MACHINERY' AND source = '5-LOW'
""")
def overall_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ev.overall_scores(t.evidence(spark, sf), "MACHINERY", "5-LOW", kind_col="source")


@query("metadata_semi_join", """
SELECT p_partkey AS item_id, p_name AS symbol, p_brand AS item_name, p_type AS biotype
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)
""")
def metadata_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.read(spark, sf, "lineitem", "l_partkey", "l_quantity").where(
        F.col("l_quantity") >= 50
    ).select(F.col("l_partkey").alias("item_id"))
    return joins.keep_known(t.item_info(spark, sf), wanted, ["item_id"])


@query("denylist_drop", "SELECT * FROM kept")
def denylist_drop(spark: SparkSession, sf: str) -> DataFrame:
    return ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)


@query("denied_sources", """
SELECT source, count(*) AS n_rows, count(DISTINCT item_id) AS n_items
FROM ev WHERE source = '5-LOW' GROUP BY 1
""")
def denied_sources(spark: SparkSession, sf: str) -> DataFrame:
    return ev.denied_sources(t.evidence(spark, sf), t.RULES)


@query("dimension_scores", """
SELECT group_id, item_id, dim__genetics, dim__functional, dim__literature,
       (dim__genetics IS NULL)::INT AS missing__genetics,
       (dim__functional IS NULL)::INT AS missing__functional,
       (dim__literature IS NULL)::INT AS missing__literature FROM dims
""")
def dimension_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ev.dimension_scores(ev.drop_denied_sources(t.evidence(spark, sf), t.RULES), t.DIMENSIONS)


@query("genetics_features", """
SELECT group_id, item_id, dim__genetics, (dim__genetics IS NULL)::INT AS missing__genetics
FROM dims
""")
def genetics_features(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    return ev.genetics_features(kept, t.DIMENSIONS)


@query("evidence_diversity", """
SELECT group_id, item_id, n_evidence_types, dim__evidence_diversity FROM dims
""")
def evidence_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return ev.evidence_diversity(ev.drop_denied_sources(t.evidence(spark, sf), t.RULES))


def _pivot_sql(sources: list[str], table: str) -> str:
    columns = [
        f"""max(CASE WHEN source = '{s}' THEN score END) AS "assoc_ds__{s}_score",
       sum(CASE WHEN source = '{s}' THEN evidence_count END)::BIGINT
           AS "assoc_ds__{s}_evidence_count\""""
        for s in sources
    ]
    return f"SELECT group_id, item_id, {', '.join(columns)} FROM {table} GROUP BY 1, 2"


@query("pivot_evidence", _pivot_sql(t.ALL_SOURCES, "ev"))
def pivot_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return ev.pivot_evidence(t.evidence(spark, sf), t.ALL_SOURCES)


@query("evidence_features", """
SELECT w.*, dim__genetics, dim__functional, dim__literature, n_evidence_types,
       dim__evidence_diversity, (dim__genetics IS NULL)::INT AS missing__genetics,
       (dim__functional IS NULL)::INT AS missing__functional,
       (dim__literature IS NULL)::INT AS missing__literature
FROM (""" + _pivot_sql(t.KEPT_SOURCES, "kept") + ") w JOIN dims USING (group_id, item_id)")
def fused_evidence_features(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_features(ev.drop_denied_sources(t.evidence(spark, sf), t.RULES), t.CONFIG)


@query("unpivot_matrix", """
SELECT item_id, tissue, round(tpm, 6) AS tpm FROM (
  SELECT item_id, unnest(['A', 'N', 'R']) AS tissue, unnest([a, n, r]) AS tpm FROM (
    SELECT l_partkey AS item_id, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a,
           avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n,
           avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r
    FROM lineitem GROUP BY 1))
""")
def unpivot_matrix(spark: SparkSession, sf: str) -> DataFrame:
    wide = t.read(spark, sf, "lineitem", "l_partkey", "l_returnflag", "l_quantity").groupBy(
        F.col("l_partkey").alias("item_id")
    ).agg(*[
        F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f)
        for f in ("A", "N", "R")
    ])
    long = ev.unpivot(wide, ["item_id"], ["A", "N", "R"], "tissue", "tpm")
    return long.withColumn("tpm", F.round("tpm", 6))


@query("row_mean_flags", """
SELECT f.*, dim__druggability, (dim__druggability IS NULL)::INT AS missing__druggability
FROM flags f JOIN drug USING (item_id)
""")
def row_mean_flags(spark: SparkSession, sf: str) -> DataFrame:
    return ev.flag_mean(t.flags(spark, sf), t.DRUGGABILITY)


@query("row_nonnull_count", "SELECT f.*, safety__n_flags FROM flags f JOIN drug USING (item_id)")
def row_nonnull_count(spark: SparkSession, sf: str) -> DataFrame:
    return ev.nonnull_count(t.flags(spark, sf), t.SAFETY)


cte("profile", """
SELECT item_id, max(tpm) AS max_tpm, round(median(tpm), 6) AS median_tpm,
       count(*) FILTER (tpm > 1.0) AS n_detected, avg(tpm) AS mean_tpm,
       CASE WHEN max(tpm) > 0 THEN (25.0 - sum(tpm) / max(tpm)) / 24.0 END AS tau
FROM matrix GROUP BY 1
""")


@query("matrix_profile", """
SELECT item_id, max_tpm AS expr__max_tpm, median_tpm AS expr__median_tpm,
       n_detected AS expr__n_tissues_detected, round(mean_tpm, 6) AS expr__mean_tpm FROM profile
""")
def matrix_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = matrix.matrix_profile(t.matrix(spark, sf))
    return out.withColumns({
        c: F.round(c, 6) for c in ("expr__mean_tpm", "expr__median_tpm")
    })


@query("tau_specificity", """
SELECT item_id, round(tau, 6) AS expr__tissue_specificity FROM profile
""")
def tau_specificity(spark: SparkSession, sf: str) -> DataFrame:
    out = matrix.tissue_specificity(t.matrix(spark, sf), t.N_TISSUES)
    return out.withColumn(matrix.SPECIFICITY, F.round(matrix.SPECIFICITY, 6))


@query("relevant_tissues", "SELECT group_id, query, tissue FROM matched")
def relevant_tissues(spark: SparkSession, sf: str) -> DataFrame:
    return t.matched(spark, sf)


_TEXT_QUERIES = ["ring small", "Brand#2, blue tissue", "hot-rod", "plate", "no such part", "tissue"]
_TEXT_VALUES = ", ".join(f"('{q}')" for q in _TEXT_QUERIES)


@query("token_set_match", f"""
WITH q AS (SELECT query, list_filter(string_split_regex(lower(query), '[^a-z0-9]+'),
                                     lambda x: x <> '' AND x <> 'tissue') AS tokens
           FROM (VALUES {_TEXT_VALUES}) AS v(query)),
c AS (SELECT DISTINCT p_name || '_' || p_brand || '_' || p_type AS tissue FROM part)
SELECT query, tissue FROM q LEFT JOIN c
  ON len(tokens) > 0
 AND list_has_all(string_split_regex(lower(tissue), '[^a-z0-9]+'), tokens)
""")
def token_set_match(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text queries against the descriptions of all parts."""
    asked = t.rows(spark, [(q,) for q in _TEXT_QUERIES], "query STRING")
    described = t.read(spark, sf, "part", "p_name", "p_brand", "p_type").select(
        F.concat_ws("_", "p_name", "p_brand", "p_type").alias("tissue"))
    return matrix.match_columns(asked, described)


cte("relevant", """
SELECT m.group_id, x.item_id, round(avg(x.tpm), 6) AS tpm
FROM (SELECT DISTINCT group_id, tissue FROM matched WHERE tissue IS NOT NULL) m
JOIN matrix x USING (tissue) GROUP BY 1, 2
""")
cte("percentile", """
SELECT group_id, item_id, tpm,
       (rank() OVER (PARTITION BY group_id ORDER BY tpm)
        + (count(*) OVER (PARTITION BY group_id, tpm) - 1) / 2.0)
       / count(*) OVER (PARTITION BY group_id) AS share
FROM relevant
""")


@query("population_percentile", """
SELECT item_id, tpm AS max_tpm,
       round((rank() OVER (ORDER BY tpm) + (count(*) OVER (PARTITION BY tpm) - 1) / 2.0)
             / count(*) OVER (), 9) AS share
FROM (SELECT item_id, max(tpm) AS tpm FROM matrix GROUP BY 1)
""")
def population_percentile(spark: SparkSession, sf: str) -> DataFrame:
    from evirank.operators.ranking import average_rank_share

    best = t.matrix(spark, sf).groupBy("item_id").agg(F.max("tpm").alias("max_tpm"))
    out = average_rank_share(best, "max_tpm", "share", [F.col("item_id")])
    return out.withColumn("share", F.round("share", 9))


@query("relevant_percentile", """
SELECT group_id, item_id, tpm AS expr__relevant_tissue_tpm, round(share, 9) AS dim__expression
FROM percentile
""")
def relevant_percentile(spark: SparkSession, sf: str) -> DataFrame:
    long = t.matrix(spark, sf)
    out = matrix.population_percentile(long, t.matched(spark, sf), ["group_id"])
    return out.select("group_id", "item_id", F.round(matrix.RELEVANT, 6).alias(matrix.RELEVANT),
                      F.round(dim("expression"), 9).alias(dim("expression")))


_PAIRS = "SELECT DISTINCT group_id, item_id FROM kept"


@query("expression_features", f"""
SELECT u.group_id, u.item_id, max_tpm AS expr__max_tpm, median_tpm AS expr__median_tpm,
       n_detected AS expr__n_tissues_detected, round(mean_tpm, 6) AS expr__mean_tpm,
       round(tau, 6) AS expr__tissue_specificity, p.tpm AS expr__relevant_tissue_tpm,
       round(share, 9) AS dim__expression, (max_tpm IS NULL)::INT AS missing__expression
FROM ({_PAIRS}) u LEFT JOIN profile USING (item_id) LEFT JOIN percentile p USING (group_id, item_id)
""")
def expression_features(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    out = matrix.expression_features(
        kept.select("group_id", "item_id"), t.matrix(spark, sf), t.matched(spark, sf),
        t.N_TISSUES, ["group_id"],
    )
    digits = {"expr__mean_tpm": 6, "expr__median_tpm": 6, matrix.SPECIFICITY: 6,
              matrix.RELEVANT: 6, dim("expression"): 9}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("item_tissue_detail", """
SELECT item_id, tissue, round(tpm::FLOAT::DOUBLE, 4) AS median_tpm FROM matrix
WHERE item_id IN (SELECT item_id FROM kept)
""")
def item_tissue_detail(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    out = matrix.item_tissue_detail(kept, t.matrix(spark, sf))
    return out.withColumn("median_tpm", F.round(F.col("median_tpm").cast("double"), 4))


@query("cooccurrence_flags", """
SELECT group_id, item_id,
       (dim__genetics IS NOT NULL AND item_id IN (SELECT item_id FROM rooted))::INT
           AS diversity__genetics_and_pathway,
       (dim__genetics IS NOT NULL AND item_id IN (SELECT item_id FROM matrix))::INT
           AS diversity__genetics_and_expression
FROM dims
""")
def cooccurrence_flags(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    scored = ev.genetics_features(kept, t.DIMENSIONS)
    known_paths = t.memberships(spark, sf).select("item_id").distinct().withColumn("_p", F.lit(0))
    known_cells = t.matrix(spark, sf).select("item_id").distinct().withColumn("_m", F.lit(0))
    joined = scored.join(known_paths, "item_id", "left").join(known_cells, "item_id", "left")
    flagged = joined.withColumns({
        "missing__pathways": F.coalesce("_p", F.lit(1)),
        "missing__expression": F.coalesce("_m", F.lit(1)),
    })
    return ev.cooccurrence_flags(flagged).select(
        "group_id", "item_id", "diversity__genetics_and_pathway",
        "diversity__genetics_and_expression",
    )


@query("score_summary", """
SELECT count(score) AS n, round(avg(score), 6) AS mean, round(stddev(score), 6) AS stddev,
       min(score) AS min, max(score) AS max, median(score) AS median
FROM weighted
""")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.score_summary(t.weighted(spark, sf), "score")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


_SUMMARISED = ("genetics", "evidence_diversity", "functional", "literature", "druggability")


@query("dimension_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
    round(stddev({c}), 6) AS stddev, round(min({c}), 9) AS min, round(max({c}), 9) AS max,
    round(median({c}), 9) AS median FROM {table}"""
    for c, table in [("score", "weighted"), *[(f"dim__{d}", "feats") for d in _SUMMARISED]]
))
def dimension_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The score and every dimension it weighs."""
    columns = ["score", *[f"dim__{d}" for d in _SUMMARISED]]
    out = ev.column_summaries(t.weighted(spark, sf), columns)
    digits = {"mean": 6, "stddev": 6, "min": 9, "max": 9, "median": 9}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("group_medians", """
SELECT group_id, median(score) AS median FROM weighted GROUP BY 1
""")
def group_medians(spark: SparkSession, sf: str) -> DataFrame:
    return exact_median(t.weighted(spark, sf), ["group_id"], "score")


@query("evidence_histogram", """
SELECT n_evidence_types, count(*) AS n_rows FROM dims GROUP BY 1
""")
def evidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    return ev.evidence_histogram(ev.evidence_diversity(kept))


@query("literature_only_share", """
SELECT group_id, count(*) FILTER (n_evidence_types = 1 AND dim__literature IS NOT NULL) AS n_only,
       count(*) AS n_rows,
       round(count(*) FILTER (n_evidence_types = 1 AND dim__literature IS NOT NULL) / count(*), 9)
           AS share
FROM dims GROUP BY 1
""")
def literature_only_share(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    feats = evidence_features(kept, t.CONFIG)
    out = ev.single_dimension_share(feats, "literature", group="group_id")
    return out.withColumn("share", F.round("share", 9))


@query("source_counts", """
SELECT source, count(*) AS n_rows, count(DISTINCT item_id) AS n_items,
       count(DISTINCT group_id) AS n_groups FROM ev GROUP BY 1
""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return t.evidence(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_id").alias("n_items"),
        F.countDistinct("group_id").alias("n_groups"),
    )


@query("items_per_group", """
SELECT group_id, count(DISTINCT item_id) AS n_items FROM ev GROUP BY 1
""")
def items_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return t.evidence(spark, sf).groupBy("group_id").agg(
        F.countDistinct("item_id").alias("n_items")
    )


@query("sparse_columns", """
SELECT group_id, 'expr__relevant_tissue_tpm' AS "column"
FROM (SELECT DISTINCT group_id FROM kept) WHERE group_id NOT IN (SELECT group_id FROM relevant)
""")
def sparse_columns(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES)
    feats = matrix.expression_features(
        kept.select("group_id", "item_id"), t.matrix(spark, sf), t.matched(spark, sf),
        t.N_TISSUES, ["group_id"],
    )
    return quality.sparse_columns(feats, ["expr__max_tpm", "expr__relevant_tissue_tpm"])


def full_features(spark: SparkSession, sf: str, network: DataFrame | None = None) -> DataFrame:
    """The feature table: evidence, flags, roots, network, expression; ``network`` if given, else its local columns."""
    from evirank.operators.graph import node_features
    from evirank.operators.hierarchy import find_roots, with_roots

    rooted = with_roots(t.memberships(spark, sf), find_roots(t.relations(spark, sf)))
    local = node_features(t.edges(spark, sf)) if network is None else network
    local = local.withColumn(
        "item_id", F.substring("node", 2, 20).cast("long")
    ).where(F.col("node").startswith("P")).drop("node")
    return build_feature_table(
        t.evidence(spark, sf), t.CONFIG, flags=t.flags(spark, sf), info=t.item_info(spark, sf),
        rooted=rooted, network=local.withColumn("missing__network", F.lit(0)),
        matrix=t.matrix(spark, sf), matched=t.matched(spark, sf),
    )
