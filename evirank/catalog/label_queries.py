"""Labels, families, popularity and drug summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import tables as t
from evirank.operators import evidence as ev
from evirank.operators import labels as lb


@query("clinical_unnest", """
SELECT l_partkey AS item_id, l_suppkey AS drug_id, c_mktsegment AS group_direct,
       CASE WHEN l_quantity >= 49 THEN 'PHASE_3' ELSE 'PHASE_1' END AS stage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT l_partkey, l_suppkey, c_mktsegment || '/' || c_nationkey,
       CASE WHEN l_quantity >= 49 THEN 'PHASE_3' ELSE 'PHASE_1' END
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
def clinical_unnest(spark: SparkSession, sf: str) -> DataFrame:
    """Each record lists the groups it was tested for, as structs."""
    records = t.associations(spark, sf).select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("drug_id"),
        F.when(F.col("l_quantity") >= 49, "PHASE_3").otherwise("PHASE_1").alias("max_stage"),
        F.array(
            F.struct(F.col("c_mktsegment").alias("groupId")),
            F.struct(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("groupId")),
        ).alias("groups"),
    )
    return lb.unnest_clinical(records, "part", "max_stage", "groups", "groupId", ["drug_id"])


@query("stage_levels", """
SELECT CASE level WHEN 4 THEN 'APPROVAL' WHEN 3 THEN 'PHASE_3' WHEN 2 THEN 'PHASE_2'
            WHEN 1 THEN 'PHASE_1' WHEN 0 THEN 'IND' ELSE 'UNKNOWN' END AS stage,
       level, count(*) AS n_rows FROM clin GROUP BY 1, 2
""")
def stage_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.clinical(spark, sf)
    lb.check_stages(rows)
    return rows.withColumn("level", lb.stage_level(F.col("stage"))).groupBy("stage", "level").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query("family_expand", "SELECT group_id, member FROM family")
def family_expand(spark: SparkSession, sf: str) -> DataFrame:
    return t.family(spark, sf)


@query("clinical_by_group", "SELECT * FROM clin_pairs")
def clinical_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return lb.clinical_by_group(t.clinical(spark, sf), t.family(spark, sf))


@query("labels", """
SELECT group_id, item_id, label, label_reason, 'clinical' AS label_source, max_clinical_stage
FROM label_table
""")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    return t.labels(spark, sf)


cte("reconciled", """
SELECT group_id, count(*) FILTER (scored IS NOT NULL) AS n_full_candidates,
       count(*) FILTER (scored) AS n_scored_candidates,
       count(*) FILTER (NOT scored) AS n_dropped_clinical_only,
       count(*) FILTER (max_clinical_stage >= 3) AS n_family_positive,
       count(*) FILTER (max_clinical_stage >= 3 AND scored IS NULL) AS n_positive_outside,
       count(*) FILTER (max_clinical_stage >= 3 AND NOT scored) AS n_positive_dropped,
       count(*) FILTER (scored AND max_clinical_stage >= 3) AS n_positive,
       count(*) FILTER (scored AND label_reason LIKE 'negative%') AS n_negative,
       count(*) FILTER (scored AND label_reason LIKE 'excluded%') AS n_excluded_unknown_stage,
       count(*) FILTER (scored AND direct_stage >= 3) AS n_positive_direct_only
FROM label_universe GROUP BY 1
""")


@query("label_reconciliation", """
SELECT r.*, family_size, n_family_positive = n_positive + n_positive_outside + n_positive_dropped
       AS balanced
FROM reconciled r JOIN (SELECT group_id, count(*) AS family_size FROM family GROUP BY 1)
USING (group_id)
""")
def label_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return lb.reconcile(t.label_universe(spark, sf), t.family(spark, sf))


@query("label_totals", """
SELECT count(*) AS n_groups, sum(n_full_candidates)::BIGINT AS n_full_candidates,
       sum(n_scored_candidates)::BIGINT AS n_scored_candidates,
       sum(n_dropped_clinical_only)::BIGINT AS n_dropped_clinical_only,
       sum(n_family_positive)::BIGINT AS n_family_positive,
       sum(n_positive_outside)::BIGINT AS n_positive_outside,
       sum(n_positive_dropped)::BIGINT AS n_positive_dropped, sum(n_positive)::BIGINT AS n_positive,
       sum(n_negative)::BIGINT AS n_negative,
       sum(n_excluded_unknown_stage)::BIGINT AS n_excluded_unknown_stage,
       sum(n_positive_direct_only)::BIGINT AS n_positive_direct_only, true AS balanced
FROM reconciled
""")
def label_totals(spark: SparkSession, sf: str) -> DataFrame:
    return lb.label_totals(label_reconciliation(spark, sf))


@query("direct_only_positives", "SELECT group_id, n_positive_direct_only FROM reconciled")
def direct_only_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity: positives from the group's own rows, on the same candidates."""
    status = lb.candidate_status(t.evidence(spark, sf), t.RULES)
    own = status.select("group_id").distinct().select(
        "group_id", F.col("group_id").alias("member")
    )
    direct = lb.clinical_by_group(t.clinical(spark, sf), own)
    positive = direct.where(F.col("max_clinical_stage") >= lb.POSITIVE_LEVEL).select(
        "group_id", "item_id", F.lit(1).alias("_p")
    )
    return status.where("scored").join(positive, ["group_id", "item_id"], "left").groupBy(
        "group_id"
    ).agg(F.count("_p").alias("n_positive_direct_only"))


cte("pos", "SELECT group_id, item_id FROM label_table WHERE label = 1")
cte("pos_count", "SELECT item_id, count(*) AS n FROM pos GROUP BY 1")
cte("popular", """
SELECT d.group_id, d.item_id,
       coalesce(c.n, 0) - (p.item_id IS NOT NULL)::INT AS n_other_groups_positive
FROM dims d LEFT JOIN pos_count c USING (item_id) LEFT JOIN pos p USING (group_id, item_id)
""")
cte("novel", """
SELECT group_id, item_id, CASE WHEN label = 1 AND coalesce(n, 0) > 1 THEN 0 ELSE label END AS label
FROM label_table LEFT JOIN pos_count USING (item_id)
""")


@query("popularity", "SELECT * FROM popular")
def popularity(spark: SparkSession, sf: str) -> DataFrame:
    pairs = ev.drop_denied_sources(t.evidence(spark, sf), t.RULES).select(
        "group_id", "item_id").distinct()
    return lb.popularity(pairs, t.labels(spark, sf))


@query("recurring_items", "SELECT item_id, n AS n_groups_positive FROM pos_count WHERE n > 1")
def recurring_items(spark: SparkSession, sf: str) -> DataFrame:
    return lb.recurring_items(t.labels(spark, sf))


@query("novel_only", "SELECT group_id, item_id, label FROM novel")
def novel_only(spark: SparkSession, sf: str) -> DataFrame:
    return lb.novel_only(t.labels(spark, sf)).select("group_id", "item_id", "label")


@query("recurring_share", """
SELECT sum(n)::BIGINT AS n_positive, sum(n) FILTER (n > 1)::BIGINT AS n_recurring,
       round(sum(n) FILTER (n > 1) / sum(n), 9) AS share FROM pos_count
""")
def recurring_share(spark: SparkSession, sf: str) -> DataFrame:
    return lb.recurring_share(t.labels(spark, sf)).withColumn("share", F.round("share", 9))


@query("dataset_table", """
SELECT group_id, count(*) AS n_candidates, count(*) FILTER (label = 1) AS n_positive,
       count(*) FILTER (label = 0) AS n_negative,
       round(count(*) FILTER (label = 1) / count(label), 9) AS prevalence
FROM label_table GROUP BY 1
""")
def dataset_table(spark: SparkSession, sf: str) -> DataFrame:
    return lb.dataset_table(t.labels(spark, sf)).withColumn("prevalence", F.round("prevalence", 9))


cte("drugs", """
SELECT group_id, item_id, count(*) AS label__n_drugs,
       array_to_string(list_sort(list(s_name))[1:5], ', ') AS label__drug_names
FROM (SELECT DISTINCT group_id, item_id, drug_id
      FROM clin JOIN family ON member = group_direct)
JOIN supplier ON s_suppkey = drug_id GROUP BY 1, 2
""")


def drug_table(spark: SparkSession, sf: str) -> DataFrame:
    names = t.read(spark, sf, "supplier", "s_suppkey", "s_name").select(
        F.col("s_suppkey").alias("drug_id"), F.col("s_name").alias("name")
    )
    return lb.drug_summary(t.clinical(spark, sf), t.family(spark, sf), names)


@query("drug_summary", "SELECT * FROM drugs")
def drug_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drug_table(spark, sf)


@query("group_descriptions", """
SELECT c_mktsegment AS group_id, min(c_name) AS description
FROM customer WHERE c_acctbal > 0 GROUP BY 1
""")
def group_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """One non-null text per group."""
    text = t.read(spark, sf, "customer", "c_mktsegment", "c_name", "c_acctbal").select(
        F.col("c_mktsegment").alias("group_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("description"),
    )
    return lb.descriptions(text, "group_id", "description")


@query("first_list_element", """
SELECT s_suppkey AS item_id, CASE WHEN string_split(s_name, '#')[1] = '' THEN NULL
       ELSE string_split(s_name, '#')[1] END AS first_part FROM supplier
""")
def first_list_element(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "supplier", "s_suppkey", "s_name").select(
        F.col("s_suppkey").alias("item_id"),
        lb.first_element(F.split("s_name", "#")).alias("first_part"),
    )
