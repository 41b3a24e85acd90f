"""Products, display bundle, data quality and file integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import graph_queries as gq
from evirank.catalog import metric_queries as mq
from evirank.catalog import tables as t
from evirank.catalog.evidence_queries import full_features
from evirank.catalog.label_queries import drug_table
from evirank.catalog.source_queries import new_path
from evirank.operators import attributions as at
from evirank.operators import evidence as ev
from evirank.operators import graph as gr
from evirank.operators import quality
from evirank.operators import labels as lb
from evirank.operators import metrics as mt
from evirank.operators import scoring
from evirank.plans import features as pf
from evirank.plans import products as pr
from evirank.plans import training as tr
from evirank.session import cut_lineage

W = scoring.DEFAULT_WEIGHTS


cte("raw_rank", """
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY raw DESC, item_id) AS rank
FROM weighted
""")


@query("ranked_product", """
SELECT r.group_id, r.item_id, r.symbol, r.item_name, r.score, r.rank, completeness, missing_evidence,
       n_other_groups_positive, dim__genetics AS genetics, dim__druggability AS druggability,
       'https://platform.example.org/evidence/' || r.item_id || '/' || r.group_id AS evidence_link
FROM (SELECT k.group_id, k.item_id, k.symbol, i.item_name, k.score, k.rank
      FROM raw_rank k JOIN info i USING (item_id) WHERE rank <= 30) r
JOIN display_done d USING (group_id, item_id) JOIN popular USING (group_id, item_id)
""")
def ranked_product(spark: SparkSession, sf: str) -> DataFrame:
    feats = cut_lineage(full_features(spark, sf))
    pairs = feats.select("group_id", "item_id")
    shown = lb.popularity(pairs, cut_lineage(t.labels_of_pairs(spark, sf, pairs)))
    out = pr.rank_groups(feats, shown, n=30)
    return out.select(
        "group_id", "item_id", "symbol", "item_name", F.round("score", 9).alias("score"), "rank",
        F.col("app_evidence_completeness").alias("completeness"),
        F.array_join("missing_evidence", ",").alias("missing_evidence"),
        "n_other_groups_positive", F.col("evidence")["genetics"].alias("genetics"),
        F.col("evidence")["druggability"].alias("druggability"),
        F.col("source_links")["evidence"].alias("evidence_link"),
    )


REMARKS = (
    "Groups are market segments of customers.", "Items are parts that they ordered.",
    "Sources are order priorities.", "Partners are suppliers of the part.",
    "Stages stand for order states.",
)


@query("evidence_card", """
SELECT d.group_id, d.item_id, score,
       array_to_string(list_transform(list_filter(list_sort([
         (-c_genetics, 'genetics'), (-c_diversity, 'evidence_diversity'),
         (-c_functional, 'functional'), (-c_literature, 'literature'),
         (-c_druggability, 'druggability')]), lambda x: x[1] < 0),
         lambda x: 'weighted_baseline__' || x[2]), ',') AS supporting,
       CASE WHEN prio__has_safety_event = -1 THEN 'safety_event' ELSE '' END AS contradicting,
       missing_evidence AS missing, 5 AS n_limitations, 3 AS n_links
FROM display_done d JOIN weighted USING (group_id, item_id)
""")
def evidence_card(spark: SparkSession, sf: str) -> DataFrame:
    cards = pr.evidence_cards(full_features(spark, sf), limitations=REMARKS)
    return cards.select(
        "group_id", "item_id", F.round("score", 9).alias("score"),
        F.array_join("supporting.category", ",").alias("supporting"),
        F.array_join("contradicting.category", ",").alias("contradicting"),
        F.array_join("missing", ",").alias("missing"),
        F.size("limitations").alias("n_limitations"), F.size("source_links").alias("n_links"),
    )


def _detail(spark: SparkSession, sf: str) -> pr.EvidenceDetail:
    """The detail tables of all pairs."""
    feats = t.score_features(spark, sf)
    partners = gr.top_partners(t.edges(spark, sf), t.node_lookup(spark, sf), "node").where(
        F.col("node").startswith("P")
    ).select(F.substring("node", 2, 20).cast("long").alias("item_id"), "partner_id", "score")
    cells = t.matrix(spark, sf).withColumnRenamed("tpm", "median_tpm")
    return pr.evidence_detail(
        feats, feats, gq.detail(spark, sf), cells, _as_item(partners), t.matched(spark, sf),
        "4-NOT SPECIFIED",
    )


def _as_item(partners: DataFrame) -> DataFrame:
    """Supplier partners numbered like items, so that some of them are candidates."""
    return partners.withColumn("partner_id", F.substring("partner_id", 2, 20).cast("long"))


_POSITIVE = """list_transform(list_filter(list_sort([
         (-c_genetics, 'genetics'), (-c_diversity, 'evidence_diversity'),
         (-c_functional, 'functional'), (-c_literature, 'literature'),
         (-c_druggability, 'druggability')]), lambda x: x[1] < 0), lambda x: x[2])"""


@query("evidence_card_factors", f"""
SELECT d.group_id, d.item_id, array_to_string(list_concat(
         list_transform({_POSITIVE}, lambda x: 'weighted_baseline__' || x),
         list_transform({_POSITIVE}, lambda x: 'held_out__dim__' || x)), ',') AS supporting,
       CASE WHEN prio__has_safety_event = -1 THEN 'safety_event' ELSE '' END AS contradicting
FROM display_done d JOIN weighted USING (group_id, item_id)
""")
def evidence_card_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Cards with the factors of a model that did not see the group: here the weights, which saw none."""
    feats = cut_lineage(full_features(spark, sf))
    factors = at.explain_weighted(feats).select(
        "group_id", "item_id", "top_positive_factors", "top_negative_factors")
    cards = pr.evidence_cards(feats, factors=factors, limitations=REMARKS)
    return cards.select(
        "group_id", "item_id", F.array_join("supporting.category", ",").alias("supporting"),
        F.array_join("contradicting.category", ",").alias("contradicting"))


@query("explain_pairs_weighted", f"""
SELECT d.group_id, d.item_id, score,
       array_to_string(list_transform({_POSITIVE}, lambda x: 'dim__' || x), ',') AS positive, 0 AS n_negative,
       concat_ws(',', CASE WHEN dim__druggability IS NOT NULL THEN 'druggability' END,
                 CASE WHEN dim__evidence_diversity IS NOT NULL THEN 'evidence_diversity' END,
                 CASE WHEN dim__functional IS NOT NULL THEN 'functional' END,
                 CASE WHEN dim__genetics IS NOT NULL THEN 'genetics' END,
                 CASE WHEN dim__literature IS NOT NULL THEN 'literature' END) AS present,
       concat_ws(',', CASE WHEN dim__druggability IS NULL THEN 'druggability' END,
                 CASE WHEN dim__evidence_diversity IS NULL THEN 'evidence_diversity' END,
                 CASE WHEN dim__functional IS NULL THEN 'functional' END,
                 CASE WHEN dim__genetics IS NULL THEN 'genetics' END,
                 CASE WHEN dim__literature IS NULL THEN 'literature' END) AS missing,
       'https://platform.example.org/item/' || d.item_id AS item_link, 5 AS n_limitations
FROM feats d JOIN weighted USING (group_id, item_id)
""")
def explain_pairs_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair explained by the weighted model, with links and limits."""
    out = pr.pair_explanations(at.explain_weighted(t.score_features(spark, sf)), REMARKS)
    return out.select(
        "group_id", "item_id", F.round("score", 9).alias("score"),
        F.array_join("top_positive_factors.feature", ",").alias("positive"),
        F.size("top_negative_factors").alias("n_negative"),
        F.array_join("evidence_present", ",").alias("present"),
        F.array_join("evidence_missing", ",").alias("missing"),
        F.col("source_links")["item"].alias("item_link"), F.size("limitations").alias("n_limitations"))


@query("detail_pathways", """
SELECT d.item_id, d.root_id, d.root_name, pathway_id, evidence_code, n_pathways, position
FROM detail d JOIN (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_pathways DESC, root_name, root_id)
         AS position
  FROM (SELECT item_id, root_id, root_name, count(*) AS n_pathways FROM detail GROUP BY 1, 2, 3))
  USING (item_id, root_id)
WHERE d.item_id IN (SELECT item_id FROM dims)
""")
def detail_pathways(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).pathways


@query("detail_tissues", """
SELECT d.group_id, d.item_id, x.tissue, x.tpm AS median_tpm, m.tissue IS NOT NULL AS is_relevant
FROM dims d JOIN matrix x USING (item_id)
LEFT JOIN (SELECT DISTINCT group_id, tissue FROM matched) m
  ON m.group_id = d.group_id AND m.tissue = x.tissue
""")
def detail_tissues(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).tissues


@query("detail_partners", """
SELECT a.group_id, a.item_id, substr(p.partner_id, 2)::BIGINT AS partner_id, p.score,
       coalesce(s.symbol, substr(p.partner_id, 2)) AS partner_symbol,
       c.item_id IS NOT NULL AS is_candidate
FROM (SELECT group_id, item_id FROM dims) a
JOIN partners p ON p.node = 'P' || a.item_id
LEFT JOIN (SELECT item_id, min(symbol) AS symbol FROM feats GROUP BY 1) s
  ON s.item_id = substr(p.partner_id, 2)::BIGINT
LEFT JOIN dims c ON c.group_id = a.group_id AND c.item_id = substr(p.partner_id, 2)::BIGINT
""")
def detail_partners(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).partners


@query("literature_summary", """
SELECT f.group_id, f.item_id, dim__literature AS literature_score, n AS literature_count,
       'https://search.example.org/?query=%22' || replace(symbol, ' ', '+') || '%22+AND+%22'
         || f.group_id || '%22' AS search_url
FROM feats f LEFT JOIN (SELECT group_id, item_id, sum(evidence_count)::BIGINT AS n FROM ev
                        WHERE source = '4-NOT SPECIFIED' GROUP BY 1, 2) USING (group_id, item_id)
""")
def literature_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).literature


@query("group_overview", """
SELECT group_id, count(*) AS n_items, count(*) - sum(m_genetics)::BIGINT AS n_genetics,
       count(*) - sum(m_functional)::BIGINT AS n_functional,
       count(*) - sum(m_pathways)::BIGINT AS n_pathways,
       count(*) - sum(m_expression)::BIGINT AS n_expression,
       count(*) - sum(m_network)::BIGINT AS n_network,
       count(*) - sum(m_druggability)::BIGINT AS n_druggability,
       6 AS categories_built, 6 AS categories_total
FROM display GROUP BY 1
""")
def group_overview(spark: SparkSession, sf: str) -> DataFrame:
    return pr.group_overview(full_features(spark, sf))


cte("sym_rank", """
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY raw DESC, symbol, item_id) AS rank
FROM weighted
""")
cte("sym_rank_no_lit", """
SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY raw DESC, symbol, item_id)
         AS rank
FROM (SELECT group_id, item_id, symbol,
        round(0.4 / 0.85 * coalesce(dim__genetics, 0)
          + 0.2 / 0.85 * coalesce(dim__evidence_diversity, 0)
          + 0.15 / 0.85 * coalesce(dim__functional, 0)
          + 0.1 / 0.85 * coalesce(dim__druggability, 0), 9) AS raw FROM feats)
""")
KNOWN = [("BUILDING", 3), ("BUILDING", 7), ("MACHINERY", 3), ("MACHINERY", 999_999_999)]


def _known(spark: SparkSession) -> DataFrame:
    return t.rows(spark, KNOWN, "group_id STRING, item_id LONG")


@query("known_item_check", """
WITH known AS (SELECT * FROM (VALUES ('BUILDING', 3), ('BUILDING', 7), ('MACHINERY', 3),
               ('MACHINERY', 999999999)) AS k(group_id, item_id))
SELECT k.group_id, count(*) AS n_known, count(*) FILTER (r.rank <= 500) AS n_reached,
       bool_and(coalesce(r.rank <= 500, false)) AS passed
FROM known k LEFT JOIN sym_rank r USING (group_id, item_id) GROUP BY 1
""")
def known_item_check(spark: SparkSession, sf: str) -> DataFrame:
    run = pr.transparent_run(cut_lineage(t.score_features(spark, sf)), _known(spark), n=500)
    return run.acceptance.drop("n_reached_without")


@query("transparent_movement", """
SELECT b.group_id, b.item_id, b.rank, n.rank AS rank_other, b.rank - n.rank AS movement
FROM sym_rank b LEFT JOIN sym_rank_no_lit n USING (group_id, item_id) WHERE b.rank <= 20
""")
def transparent_movement(spark: SparkSession, sf: str) -> DataFrame:
    run = pr.transparent_run(cut_lineage(t.score_features(spark, sf)), _known(spark))
    return run.movement.select("group_id", "item_id", "rank", "rank_other", "movement")


@query("biggest_falls", """
SELECT * FROM (
  SELECT group_id, item_id, b.rank, n.rank AS rank_other, b.rank - n.rank AS movement,
         row_number() OVER (PARTITION BY group_id ORDER BY b.rank - n.rank, item_id) AS place
  FROM score_rank b JOIN no_lit_rank n USING (group_id, item_id) WHERE b.rank <= 100)
WHERE place <= 6
""")
def biggest_falls(spark: SparkSession, sf: str) -> DataFrame:
    from evirank.catalog.score_queries import rank_movement

    return pr.biggest_falls(rank_movement(spark, sf).drop("score"))


@query("contribution_bars", """
SELECT group_id, item_id, symbol, rank,
       unnest(['contrib__genetics', 'contrib__evidence_diversity', 'contrib__functional',
               'contrib__literature', 'contrib__druggability']) AS dimension,
       unnest([round(c_genetics, 9), round(c_diversity, 9), round(c_functional, 9),
               round(c_literature, 9), round(c_druggability, 9)]) AS contribution
FROM score_rank WHERE rank <= 20
""")
def contribution_bars(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.weighted(spark, sf).select(
        "group_id", "item_id", "symbol", "score", *[f"contrib__{d}" for d in W]
    )
    ranked = scoring.rank_scored(scored, symbol="symbol", score="score")
    out = pr.contribution_bars(ranked, W)
    return out.withColumn("contribution", F.round("contribution", 9))


@query("radar_values", """
SELECT group_id, item_id, unnest(['genetics', 'functional', 'literature']) AS dimension,
       unnest([coalesce(dim__genetics, 0), coalesce(dim__functional, 0),
               coalesce(dim__literature, 0)]) AS value FROM dims
""")
def radar_values(spark: SparkSession, sf: str) -> DataFrame:
    return pr.radar_values(t.score_features(spark, sf), ["genetics", "functional", "literature"])


@query("method_bars", """
WITH novel_rows AS (
  SELECT method, group_id,
         CASE WHEN sum(label) > 0 THEN coalesce(sum(label / log2(rank + 1)) FILTER (rank <= 10), 0)
           / list_sum(list_transform(range(1, least(sum(label), 10, count(*))::INT + 1),
                                     lambda i: 1 / log2(i + 1))) END AS v
  FROM (SELECT j.method, j.group_id, j.rank, v.label
        FROM judged j JOIN novel v USING (group_id, item_id)) GROUP BY 1, 2
)
SELECT method, round(p, 9) AS "primary", round(v, 9) AS novel_only,
       row_number() OVER (ORDER BY p DESC, method) AS place
FROM (SELECT method, avg(ndcg_at_10) AS p FROM metric_raw GROUP BY 1)
JOIN (SELECT method, avg(v) AS v FROM novel_rows GROUP BY 1) USING (method)
""")
def method_bars(spark: SparkSession, sf: str) -> DataFrame:
    scores, labels = mq.inputs(spark, sf)
    scores = cut_lineage(scores)

    def means(by: DataFrame) -> DataFrame:
        table = mt.evaluate(scores, by, ("ndcg_at_10",), keys=mq.KEYS, digits=None)
        return mt.mean_over_groups(table, ["ndcg_at_10"], ["method"])

    out = pr.method_bars(means(labels), means(lb.novel_only(labels)), "ndcg_at_10")
    return out.withColumns({c: F.round(c, 9) for c in ("primary", "novel_only")})


@query("display_bundle", """
SELECT d.group_id, d.item_id, o.score AS overall_score, n_other_groups_positive,
       max_clinical_stage AS label__max_clinical_stage, coalesce(label__n_drugs, 0) AS label__n_drugs,
       label__drug_names, description, symbol
FROM dims d LEFT JOIN overall o USING (group_id, item_id) LEFT JOIN popular USING (group_id, item_id)
LEFT JOIN label_table USING (group_id, item_id) LEFT JOIN drugs USING (group_id, item_id)
LEFT JOIN (SELECT c_mktsegment AS group_id, min(c_name) AS description FROM customer GROUP BY 1)
  USING (group_id)
LEFT JOIN info USING (item_id)
""")
def display_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return _bundle(spark, sf)


@query("display_bundle_held_out", """
SELECT r.group_id, r.item_id, r.score AS held_out_score, r.rank AS held_out_rank, o.score AS overall_score,
       n_other_groups_positive, max_clinical_stage AS label__max_clinical_stage,
       coalesce(label__n_drugs, 0) AS label__n_drugs
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, item_id) AS rank FROM weighted) r
LEFT JOIN overall o USING (group_id, item_id) LEFT JOIN popular USING (group_id, item_id)
LEFT JOIN label_table USING (group_id, item_id) LEFT JOIN drugs USING (group_id, item_id)
""")
def display_bundle_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle with score and rank by the model that did not see the group (weights see none)."""
    feats = cut_lineage(t.score_features(spark, sf))
    labels = t.labels_of_pairs(spark, sf, feats)
    held = tr.leave_one_group_out(feats, labels, {"weighted_baseline": {}}, rules=t.RULES)
    held = held.select("group_id", "item_id", F.round("score", 9).alias("held_out_score"))
    ranked = scoring.rank_scored(held, score="held_out_score").withColumnRenamed("rank", "held_out_rank")
    return _bundle(spark, sf, ranked).drop("description", "symbol", "label__drug_names")


def _bundle(spark: SparkSession, sf: str, held_out: DataFrame | None = None) -> DataFrame:
    shared = cut_lineage(t.evidence(spark, sf))
    pairs = ev.drop_denied_sources(shared, t.RULES).select("group_id", "item_id").distinct()
    labels = cut_lineage(t.labels(spark, sf, shared))
    overall = shared.groupBy("group_id", "item_id").agg(
        F.round(F.max("score") * 0.5 + F.count(F.lit(1)) / 10.0, 9).alias("overall_score"))
    text = t.read(spark, sf, "customer", "c_mktsegment", "c_name").select(
        F.col("c_mktsegment").alias("group_id"), F.col("c_name").alias("description"))
    return pf.display_bundle(
        pairs, held_out, overall, lb.popularity(pairs, labels), labels, drug_table(spark, sf),
        lb.descriptions(text, "group_id", "description"),
        t.item_info(spark, sf).select("item_id", "symbol"),
    )


@query("detail_provenance", """
SELECT 'pathways' AS detail, count(*) AS n_rows, count(DISTINCT item_id) AS n_items,
       count(DISTINCT root_id) AS n_kinds FROM detail
UNION ALL SELECT 'tissues', count(*), count(DISTINCT item_id), count(DISTINCT tissue) FROM matrix
UNION ALL SELECT 'partners', count(*), count(DISTINCT node), count(DISTINCT partner_id) FROM partners
""")
def detail_provenance(spark: SparkSession, sf: str) -> DataFrame:
    partners = gr.top_partners(t.edges(spark, sf), t.node_lookup(spark, sf), "node")
    return pf.detail_provenance(
        gq.detail(spark, sf), t.matrix(spark, sf), partners.withColumnRenamed("node", "item_id")
    )


@query("unique_key_check", """
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n - 1)::BIGINT AS n_duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
""")
def unique_key_check(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.read(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return quality.unique_key_report(lines, ["l_orderkey", "l_linenumber"])


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.read(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


_FLAGS = [*t.DRUGGABILITY, *t.SAFETY]


@query("null_round_trip", " UNION ALL ".join(
    f"""SELECT 'dim__{c}' AS "column", count(*) FILTER (dim__{c} IS NULL) AS n_null,
    count(*) FILTER (dim__{c} IS NULL) AS n_null_parquet, count(*) FILTER (dim__{c} IS NULL) AS n_null_json
    FROM feats""" for c in sorted(W)
))
def null_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Missing evidence of a product is still missing after it went through the sinks."""
    columns = [f"dim__{c}" for c in sorted(W)]
    return quality.null_round_trip(
        cut_lineage(t.score_features(spark, sf).select(*columns)), columns, new_path(spark, "nulls"))


@query("null_check", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows
    FROM flags""" for c in _FLAGS
))
def null_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_counts(t.flags(spark, sf), _FLAGS)


@query("drop_audit", """
WITH keyed AS (SELECT *, l_orderkey || '-' || l_linenumber AS k FROM lineitem)
SELECT 0 AS step, 'score' AS stage, 'below the threshold' AS reason,
       count(*) FILTER (NOT l_quantity >= 20) AS dropped, count(*) AS total,
       round(count(*) FILTER (NOT l_quantity >= 20) / count(*) * 100, 6) AS pct,
       (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM keyed WHERE NOT l_quantity >= 20
        ORDER BY k LIMIT 5)) AS examples FROM lineitem
UNION ALL
SELECT 1, 'status', 'returned', count(*) FILTER (l_returnflag = 'R'), count(*),
       round(count(*) FILTER (l_returnflag = 'R') / count(*) * 100, 6),
       (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM keyed WHERE l_quantity >= 20
        AND l_returnflag = 'R' ORDER BY k LIMIT 5))
FROM lineitem WHERE l_quantity >= 20
UNION ALL
SELECT 2, 'tax', 'never drops', 0, count(*), 0, '' FROM lineitem
WHERE l_quantity >= 20 AND l_returnflag <> 'R'
""")
def drop_audit(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.read(spark, sf, "lineitem", "l_quantity", "l_returnflag", "l_tax", "l_orderkey", "l_linenumber")
    lines = lines.withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    out = quality.drop_audit(lines, [
        ("score", "below the threshold", F.col("l_quantity") >= 20),
        ("status", "returned", F.col("l_returnflag") != "R"),
        ("tax", "never drops", F.col("l_tax") >= 0),
    ], "line")
    return out.drop("example").withColumns({
        "pct": F.round("pct", 6), "examples": F.array_join("examples", ",")})


@query("acceptance_suite", """
SELECT * FROM (VALUES ('label columns in the scored table', 0, true),
  ('leakage check can fire', 0, true), ('groups without a ranking', 0, true),
  ('null rank, score or symbol', 0, true), ('row without its three links', 0, true),
  ('missing evidence not listed', 0, true)) AS v("check", n_problems, passed)
WHERE EXISTS (SELECT 1 FROM ev)
""")
def acceptance_suite(spark: SparkSession, sf: str) -> DataFrame:
    feats = cut_lineage(full_features(spark, sf))
    shown = t.labels_of_pairs(spark, sf, feats)
    return quality.acceptance_suite(feats, cut_lineage(pr.rank_groups(feats, n=None)), shown)


@query("source_suite", """
SELECT 'empty evidence' AS "check", (count(*) = 0)::INT AS n_problems, count(*) > 0 AS passed FROM ev
UNION ALL SELECT 'group without items', count(*), count(*) = 0
  FROM (SELECT DISTINCT group_id FROM family WHERE group_id NOT IN (SELECT group_id FROM ev))
UNION ALL SELECT 'known item absent', count(*), count(*) = 0
  FROM (SELECT p_partkey FROM part WHERE p_size = 50 AND p_partkey NOT IN (SELECT item_id FROM ev))
UNION ALL SELECT 'versioned id', 0, true
UNION ALL SELECT 'too few shared items', (count(*) < 100)::INT, count(*) >= 100
  FROM (SELECT DISTINCT item_id FROM ev WHERE item_id IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'more than one species', count(DISTINCT evidence_code) - 1,
  count(DISTINCT evidence_code) = 1 FROM members
UNION ALL SELECT 'too few edges', (count(*) < 1000)::INT, count(*) >= 1000 FROM edges
UNION ALL SELECT 'no forbidden source left to block', (count(*) = 0)::INT, count(*) > 0
  FROM ev WHERE source = '5-LOW'
""")
def source_suite(spark: SparkSession, sf: str) -> DataFrame:
    known = t.read(spark, sf, "part", "p_partkey", "p_size").where(F.col("p_size") == 50).select(
        F.col("p_partkey").alias("item_id"))
    return quality.source_suite(
        cut_lineage(t.evidence(spark, sf)), t.family(spark, sf).select("group_id").distinct(), known,
        t.item_info(spark, sf), t.edges(spark, sf), t.memberships(spark, sf), t.RULES,
        min_overlap=100, min_edges=1000, species="evidence_code",
    )


@query("guard_liveness", """
SELECT 'assoc_ds__' || source || '_score' AS "column", source = '5-LOW' AS forbidden
FROM (SELECT DISTINCT source FROM ev)
""")
def guard_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Every column the sources could produce, and whether a rule forbids it."""
    rows = t.evidence(spark, sf)
    quality.verify_rules_live(rows, ["maxClinicalStage"], t.RULES)
    return rows.select("source").distinct().select(
        F.concat(F.lit("assoc_ds__"), "source", F.lit("_score")).alias("column"),
        ev.is_denied_source(F.col("source"), t.RULES).alias("forbidden"),
    )


@query("file_integrity")
def file_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Checksums of the table files against a manifest built from them."""
    from evirank.sources import integrity

    files = cut_lineage(integrity.checksums(spark, sf, "*.parquet"))
    manifest = integrity.build_manifest(files, source="tables", release="1", version_pinned=True)
    checked = integrity.verify(files, manifest)
    return checked.select(F.element_at(F.split("path", "/"), -1).alias("file"), "detail", "ok")
