"""Weighted scores, rankings, filters and sorted products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import tables as t
from evirank.columns import contrib, dim
from evirank.operators import evidence as ev
from evirank.operators import joins, ranking, scoring

cte("score_rank", """
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, symbol, item_id) AS rank
FROM weighted
""")
cte("no_lit", """
SELECT group_id, item_id, symbol,
       round((0.4 * coalesce(dim__genetics, 0) + 0.2 * coalesce(dim__evidence_diversity, 0)
         + 0.15 * coalesce(dim__functional, 0) + 0.1 * coalesce(dim__druggability, 0))
         / 0.85, 9) AS score
FROM feats
""")
cte("no_lit_rank", """
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, symbol, item_id) AS rank
FROM no_lit
""")


@query("weighted_score", """
SELECT group_id, item_id, round(c_genetics, 9) AS contrib__genetics,
       round(c_diversity, 9) AS contrib__evidence_diversity,
       round(c_functional, 9) AS contrib__functional, round(c_literature, 9) AS contrib__literature,
       round(c_druggability, 9) AS contrib__druggability, score, completeness
FROM weighted
""")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    names = list(scoring.DEFAULT_WEIGHTS)
    return t.weighted(spark, sf).select(
        "group_id", "item_id", *[F.round(contrib(d), 9).alias(contrib(d)) for d in names],
        "score", F.col("evidence_completeness").alias("completeness"),
    )


@query("top_ranked", """
SELECT group_id, item_id, symbol, score, completeness, rank FROM score_rank WHERE rank <= 20
""")
def top_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, drop the forbidden source, dimensions, diversity, score, rank, first 20."""
    order = [F.col("score").desc_nulls_last(), F.col("symbol").asc_nulls_last(), F.col("item_id")]
    top = ranking.top_n(t.weighted(spark, sf), "group_id", order, 20)
    return top.select("group_id", "item_id", "symbol", "score",
                      F.col("evidence_completeness").alias("completeness"), "rank")


@query("full_ranking", "SELECT group_id, item_id, symbol, score, rank FROM score_rank")
def full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.weighted(spark, sf).select("group_id", "item_id", "symbol", "score")
    return scoring.rank_scored(scored, symbol="symbol", score="score")


@query("rank_within_group", """
SELECT group_id, item_id, score,
       row_number() OVER (PARTITION BY group_id ORDER BY score DESC, item_id) AS rank FROM weighted
""")
def rank_within_group(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.weighted(spark, sf).select("group_id", "item_id", "score")
    return ranking.rank_within_group(scored, "group_id", "score", "item_id")


@query("topn_per_group", """
SELECT * FROM (
  SELECT group_id, item_id, source, score,
         row_number() OVER (PARTITION BY group_id ORDER BY score DESC, item_id, source) AS rank
  FROM (SELECT group_id, item_id, source, max(score) AS score FROM ev GROUP BY 1, 2, 3))
WHERE rank <= 7
""")
def topn_per_group(spark: SparkSession, sf: str) -> DataFrame:
    best = t.evidence(spark, sf).groupBy("group_id", "item_id", "source").agg(
        F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("item_id").asc(), F.col("source").asc()]
    return ranking.top_n(best, "group_id", order, 7)


@query("score_ablation", "SELECT group_id, item_id, score FROM no_lit")
def score_ablation(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.ablate(t.score_features(spark, sf), ["literature"])
    return out.select("group_id", "item_id", F.round("prioritization_score", 9).alias("score"))


def _ablated_rank(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.ablate(t.score_features(spark, sf), ["literature"]).select(
        "group_id", "item_id", "symbol", F.round("prioritization_score", 9).alias("score")
    )
    return scoring.rank_scored(out, symbol="symbol", score="score")


@query("rank_movement", """
SELECT b.group_id, b.item_id, b.score, b.rank, n.rank AS rank_other,
       b.rank - n.rank AS movement
FROM score_rank b LEFT JOIN no_lit_rank n USING (group_id, item_id) WHERE b.rank <= 100
""")
def rank_movement(spark: SparkSession, sf: str) -> DataFrame:
    base = full_ranking(spark, sf).drop("symbol")
    return ranking.rank_movement(base, _ablated_rank(spark, sf), ["group_id", "item_id"], 100)


@query("named_item_ranks", """
SELECT v.symbol, v.group_id, r.item_id, r.rank
FROM (VALUES ('small ring', 'BUILDING'), ('hot rod', 'MACHINERY'), ('no such part', 'BUILDING'))
     AS v(symbol, group_id)
LEFT JOIN score_rank r USING (symbol, group_id)
""")
def named_item_ranks(spark: SparkSession, sf: str) -> DataFrame:
    names = t.rows(spark, [("small ring", "BUILDING"), ("hot rod", "MACHINERY"),
                           ("no such part", "BUILDING")], "symbol STRING, group_id STRING")
    ranked = full_ranking(spark, sf)
    return names.join(ranked.select("symbol", "group_id", "item_id", "rank"),
                      ["symbol", "group_id"], "left")


@query("explain_rows", """
SELECT group_id, item_id, score,
       concat_ws(',', CASE WHEN dim__druggability IS NULL THEN 'druggability' END,
                 CASE WHEN dim__evidence_diversity IS NULL THEN 'evidence_diversity' END,
                 CASE WHEN dim__functional IS NULL THEN 'functional' END,
                 CASE WHEN dim__genetics IS NULL THEN 'genetics' END,
                 CASE WHEN dim__literature IS NULL THEN 'literature' END) AS missing_dimensions,
       round(c_genetics, 9) AS genetics, round(c_druggability, 9) AS druggability,
       dim__genetics AS raw_genetics,
       array_to_string(list_transform(list_sort([
         (-round(c_genetics, 9), 'genetics'), (-round(c_diversity, 9), 'evidence_diversity'),
         (-round(c_functional, 9), 'functional'), (-round(c_literature, 9), 'literature'),
         (-round(c_druggability, 9), 'druggability')])[1:3], lambda x: x[2]), ',')
         AS top_three
FROM weighted JOIN feats USING (group_id, item_id)
""")
def explain_rows(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.weighted(spark, sf)
    rounded = scored.withColumns({
        contrib(d): F.round(contrib(d), 9) for d in scoring.DEFAULT_WEIGHTS
    })
    out = scoring.explain_rows(rounded, top=3)
    return out.select(
        "group_id", "item_id", "score",
        F.array_join("missing_dimensions", ",").alias("missing_dimensions"),
        F.col("contributions")["genetics"].alias("genetics"),
        F.col("contributions")["druggability"].alias("druggability"),
        F.col("dimension_values")["genetics"].alias("raw_genetics"),
        F.array_join(F.col("top_contributors.dimension"), ",").alias("top_three"),
    )


def _profile_sql(weights: dict[str, float]) -> str:
    return " + ".join(f"{w} * coalesce({dim(d)}, 0)" for d, w in weights.items())


_PROFILES = {"default": scoring.DEFAULT_WEIGHTS, **scoring.PROFILES}


@query("scenario_scores", " UNION ALL ".join(
    f"SELECT group_id, item_id, '{p}' AS profile, round({_profile_sql(w)}, 9) AS score FROM feats"
    for p, w in _PROFILES.items()
))
def scenario_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.score_profiles(t.score_features(spark, sf), _PROFILES)
    return out.withColumn("score", F.round("score", 9))


_OWN = {"genetics": 3.0, "literature": 1.0, "druggability": 0.0}
_SCENARIOS = {**scoring.SCENARIOS, "own": scoring.custom_scenario(_OWN)}


@query("scenario_ranking", "WITH scored AS (" + " UNION ALL ".join(
    f"""SELECT group_id, item_id, prio__has_safety_event, '{p}' AS profile,
    round({_profile_sql(w)}, 9) AS score FROM feats""" for p, w in {
        **scoring.PROFILES, "safety_first": scoring.DEFAULT_WEIGHTS,
        "own": {"genetics": 0.75, "literature": 0.25}}.items()
) + """), placed AS (
  SELECT *, row_number() OVER (PARTITION BY profile, group_id ORDER BY score DESC, item_id) AS rank FROM scored
), filtered AS (
  SELECT *, row_number() OVER (PARTITION BY profile, group_id ORDER BY rank) AS place FROM placed
  WHERE profile <> 'safety_first' OR prio__has_safety_event IS DISTINCT FROM -1
) SELECT profile, group_id, item_id, score, rank FROM filtered WHERE place <= 25
""")
def scenario_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 best of every scenario and group; one scenario filters, one has weights on a scale of its own."""
    return scoring.rank_scenarios(t.score_features(spark, sf), _SCENARIOS, n=25, digits=9)


@query("normalized_weights", """
SELECT group_id, source, n / sum(n) OVER (PARTITION BY group_id) AS weight
FROM (SELECT group_id, source, sum(evidence_count)::DOUBLE AS n FROM ev GROUP BY 1, 2)
""")
def normalized_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of a profile table rescaled to sum 1 per profile (one row per source)."""
    raw = t.evidence(spark, sf).groupBy("group_id", "source").agg(F.sum("evidence_count").alias("n"))
    return scoring.weight_shares(raw, ["group_id"], "n", "weight").drop("n")


@query("random_baseline", """
SELECT group_id, item_id,
       ('0x' || substr(md5('42|' || group_id || '|' || item_id), 1, 8))::BIGINT / 4294967296.0
           AS score
FROM (SELECT DISTINCT group_id, item_id FROM kept)
""")
def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    from evirank.functions.numeric import stable_uniform

    pairs = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES).select("group_id", "item_id")
    return pairs.distinct().withColumn(
        "score", stable_uniform(42, F.col("group_id"), F.col("item_id"))
    )


@query("compare_scores", """
SELECT b.group_id, b.item_id, b.score, n.score AS score_other
FROM weighted b JOIN no_lit n USING (group_id, item_id) WHERE abs(b.score - n.score) > 0.1
""")
def compare_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.weighted(spark, sf).select("group_id", "item_id", "score")
    return joins.compare(scored, score_ablation(spark, sf), ["group_id", "item_id"], "score", 0.1)


@query("ablation_columns", """
SELECT w.*, dim__genetics, dim__functional, symbol, dim__druggability
FROM (SELECT group_id, item_id,
             max(CASE WHEN source = '1-URGENT' THEN score END) AS "assoc_ds__1-URGENT_score"
      FROM kept GROUP BY 1, 2) w JOIN feats USING (group_id, item_id)
""")
def ablation_columns(spark: SparkSession, sf: str) -> DataFrame:
    kept = scoring.drop_dimension_columns(
        t.score_features(spark, sf), "literature", t.DIMENSIONS["literature"]
    )
    wanted = {"group_id", "item_id", "assoc_ds__1-URGENT_score", "dim__genetics",
              "dim__functional", "symbol", "dim__druggability", "dim__literature",
              "dim__evidence_diversity", "n_evidence_types", "assoc_ds__4-NOT SPECIFIED_score"}
    return kept.select(*[c for c in kept.columns if c in wanted])


@query("sparse_union", """
SELECT group_id, item_id, max(CASE WHEN source = '1-URGENT' THEN score END) AS urgent,
       NULL::DOUBLE AS low FROM ev GROUP BY 1, 2
UNION ALL
SELECT group_id, item_id, NULL, max(CASE WHEN source = '5-LOW' THEN score END)
FROM ev GROUP BY 1, 2
""")
def sparse_union(spark: SparkSession, sf: str) -> DataFrame:
    """Diagonal union: a column a part lacks becomes null."""
    def part(source: str, out: str) -> DataFrame:
        best = F.max(F.when(F.col("source") == source, F.col("score")))
        return t.evidence(spark, sf).groupBy("group_id", "item_id").agg(best.alias(out))

    return joins.union_all(part("1-URGENT", "urgent"), part("5-LOW", "low"), diagonal=True)


@query("keep_first", """
SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2
""")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return joins.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("set_difference", """
SELECT group_id, item_id FROM ev EXCEPT SELECT group_id, item_id FROM kept
""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    all_rows = t.evidence(spark, sf)
    kept = ev.drop_denied_sources(all_rows, t.RULES)
    return joins.only_in_left(all_rows, kept, ["group_id", "item_id"])


@query("set_intersection", """
SELECT group_id, item_id FROM ev WHERE source = '5-LOW'
INTERSECT SELECT group_id, item_id FROM ev WHERE source = '1-URGENT'
""")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.evidence(spark, sf)
    return joins.in_both(rows.where(F.col("source") == "5-LOW"),
                         rows.where(F.col("source") == "1-URGENT"), ["group_id", "item_id"])


@query("best_worst_groups", """
SELECT group_id, m AS metric, side, place FROM (
  SELECT *, 'best' AS side, row_number() OVER (ORDER BY m DESC, group_id) AS place FROM
    (SELECT group_id, round(avg(score), 6) AS m FROM weighted GROUP BY 1)
  UNION ALL
  SELECT *, 'worst', row_number() OVER (ORDER BY m, group_id) FROM
    (SELECT group_id, round(avg(score), 6) AS m FROM weighted GROUP BY 1)) WHERE place <= 2
""")
def best_worst_groups(spark: SparkSession, sf: str) -> DataFrame:
    means = t.weighted(spark, sf).groupBy("group_id").agg(F.round(F.avg("score"), 6).alias("metric"))
    return ranking.best_and_worst(means, "metric", "group_id", 2)


_MISSING = ("genetics", "functional", "pathways", "expression", "network", "druggability")
cte("display", """
SELECT f.*, (dim__genetics IS NULL)::INT AS m_genetics,
       (dim__functional IS NULL)::INT AS m_functional,
       (f.item_id NOT IN (SELECT item_id FROM rooted))::INT AS m_pathways,
       (f.item_id NOT IN (SELECT item_id FROM matrix))::INT AS m_expression,
       (('P' || f.item_id) NOT IN (SELECT node FROM node_stats))::INT AS m_network,
       (dim__druggability IS NULL)::INT AS m_druggability, p.tpm AS relevant_tpm
FROM feats f LEFT JOIN percentile p USING (group_id, item_id)
""")
cte("display_done", """
SELECT *, (6 - m_genetics - m_functional - m_pathways - m_expression - m_network
           - m_druggability) / 6.0 AS completeness,
       concat_ws(',', CASE m_druggability WHEN 1 THEN 'druggability' END,
                 CASE m_expression WHEN 1 THEN 'expression' END,
                 CASE m_functional WHEN 1 THEN 'functional' END,
                 CASE m_genetics WHEN 1 THEN 'genetics' END,
                 CASE m_network WHEN 1 THEN 'network' END,
                 CASE m_pathways WHEN 1 THEN 'pathways' END) AS missing_evidence
FROM display
""")


@query("completeness", """
SELECT group_id, item_id, round(completeness, 9) AS app_evidence_completeness, missing_evidence
FROM display_done
""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    from evirank.catalog.evidence_queries import full_features

    out = scoring.display_completeness(full_features(spark, sf))
    return out.select(
        "group_id", "item_id", F.round("app_evidence_completeness", 9)
        .alias("app_evidence_completeness"),
        F.array_join("missing_evidence", ",").alias("missing_evidence"),
    )


@query("rank_filter_limit", """
SELECT group_id, item_id, score, rank FROM (
  SELECT r.group_id, r.item_id, r.score, r.rank,
         row_number() OVER (PARTITION BY r.group_id ORDER BY r.rank) AS keep
  FROM score_rank r JOIN display_done d USING (group_id, item_id)
  WHERE coalesce(d.dim__genetics, 0) >= 0.5 AND d.prio__has_small_molecule_binder = 1
    AND d.completeness >= 0.5 AND coalesce(d.relevant_tpm, 0) >= 1.0
    AND NOT coalesce(d.prio__has_safety_event = -1, false)) WHERE keep <= 50
""")
def rank_filter_limit(spark: SparkSession, sf: str) -> DataFrame:
    from evirank.catalog.evidence_queries import full_features

    feats = scoring.display_completeness(full_features(spark, sf))
    scored = scoring.weighted_score(feats).withColumn("score", F.round("prioritization_score", 9))
    kept = scored.select("group_id", "item_id", "symbol", "score", dim("genetics"),
                         "expr__relevant_tissue_tpm", "prio__has_small_molecule_binder",
                         "app_evidence_completeness", "prio__has_safety_event")
    ranked = scoring.rank_scored(kept, symbol="symbol", score="score")
    filters = scoring.RankingFilters(0.5, True, True, 0.5, True)
    return ranking.rank_filter_limit(ranked, filters.predicates(), 50, "group_id").select(
        "group_id", "item_id", "score", "rank"
    )


@query("group_slice", """
SELECT group_id, item_id, score, rank, n_candidates FROM (
  SELECT *, count(*) OVER (PARTITION BY group_id) AS n_candidates FROM score_rank)
WHERE group_id = 'HOUSEHOLD' AND symbol = 'hot rod'
""")
def group_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of named items among all candidates of one group, with the candidate count."""
    group = t.weighted(spark, sf).where(F.col("group_id") == "HOUSEHOLD").select(
        "group_id", "item_id", "symbol", "score"
    ).withColumn("_row", F.lit(1))
    order = [F.col("score").desc_nulls_last(), F.col("symbol"), F.col("item_id")]
    ranked = ranking.running_totals(group, ["group_id"], order, totals={"n_candidates": "_row"})
    return ranked.where(F.col("symbol") == "hot rod").drop("symbol", "_row")
