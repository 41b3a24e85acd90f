"""Held-out training, attributions and explanations. Fits have no SQL form; what must hold for them has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import query
from evirank.catalog import label_queries  # noqa: F401  (registers the label blocks)
from evirank.catalog import tables as t
from evirank.catalog.evidence_queries import full_features
from evirank.catalog.feature_queries import network
from evirank.operators import attributions as at
from evirank.operators import models as md
from evirank.operators.evidence import LeakageError
from evirank.operators.joins import union_all
from evirank.operators.quality import leakage_probe
from evirank.operators.scoring import select_features
from evirank.plans import training as tr
from evirank.session import cut_lineage, ensure_checkpoint_dir, stored

LOGISTIC: dict = {}  # the defaults, as for the others
FOREST: dict = {}
BOOSTED: dict = {}
ALL_MODELS = {
    "weighted_baseline": {}, "logistic_regression": LOGISTIC, "random_forest": FOREST,
    "boosted_trees": BOOSTED,
}


_BUILT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole feature table, pathways, expression and network included, and the labels.

    Built once per application and folder: the stored tables serve all model queries.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        feats = stored(full_features(spark, sf, network(spark, sf)))
        _BUILT[key] = feats, stored(t.labels(spark, sf))
    return _BUILT[key]


def new_folder(spark: SparkSession) -> str:
    """A fresh model folder beside the checkpoints, on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"


@query("lodo_split", """
SELECT group_id, count(*) AS n_test, (SELECT count(*) FROM dims) - count(*) AS n_train
FROM dims GROUP BY 1
""")
def lodo_split(spark: SparkSession, sf: str) -> DataFrame:
    return md.fold_sizes(t.score_features(spark, sf))


_MEDIAN_COLUMNS = ["dim__genetics", "dim__functional", "dim__druggability", "n_evidence_types"]


@query("fold_medians", " UNION ALL ".join(
    f"""SELECT g.group_id AS fold, '{c}' AS "column", median({c}::DOUBLE) AS median
    FROM (SELECT DISTINCT group_id FROM dims) g JOIN feats f ON f.group_id <> g.group_id
    JOIN label_table v ON v.group_id = f.group_id AND v.item_id = f.item_id
    WHERE label IS NOT NULL GROUP BY 1""" for c in _MEDIAN_COLUMNS
))
def fold_medians(spark: SparkSession, sf: str) -> DataFrame:
    """The imputation values each fold learns from its training rows."""
    feats, labels = inputs(spark, sf)
    rows = md.training_slice(feats, labels, _MEDIAN_COLUMNS)
    return md.fold_median_table(rows, _MEDIAN_COLUMNS, feats.select("group_id").distinct())


def _lodo(name: str, params: dict):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        feats, labels = inputs(spark, sf)
        return tr.leave_one_group_out(feats, labels, {name: params}, rules=t.RULES)

    return run


query("logistic_lodo")(_lodo("logistic_regression", LOGISTIC))
query("forest_lodo")(_lodo("random_forest", FOREST))
query("boosted_lodo")(_lodo("boosted_trees", BOOSTED))


@query("baseline_scores", """
SELECT 'popularity' AS method, group_id, item_id, n_other_groups_positive::DOUBLE AS score FROM popular
UNION ALL SELECT 'random', group_id, item_id,
  ('0x' || substr(md5('42|' || group_id || '|' || item_id), 1, 8))::BIGINT / 4294967296.0 FROM dims
UNION ALL SELECT 'overall_score', d.group_id, d.item_id, e.score
FROM dims d LEFT JOIN (SELECT * FROM ev WHERE source = '5-LOW') e USING (group_id, item_id)
""")
def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    shared = cut_lineage(t.evidence(spark, sf))
    from evirank.operators.evidence import drop_denied_sources, overall_scores

    pairs = drop_denied_sources(shared, t.RULES)
    overall = overall_scores(shared, None, "5-LOW", kind_col="source")
    return tr.baseline_scores(pairs, t.labels(spark, sf, shared), overall)


def _attributions(spark: SparkSession, sf: str, name: str, params: dict
                  ) -> tuple[DataFrame, md.FittedModel, DataFrame]:
    feats, labels = inputs(spark, sf)
    fitted = md.train(feats, labels, name, params, rules=t.RULES)
    return feats, fitted, at.shap_values(fitted, feats)


@query("attributions_linear")
def attributions_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _attributions(spark, sf, "logistic_regression", LOGISTIC)[2]


@query("attributions_forest")
def attributions_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _attributions(spark, sf, "random_forest", FOREST)[2]


@query("attributions_boosted")
def attributions_boosted(spark: SparkSession, sf: str) -> DataFrame:
    return _attributions(spark, sf, "boosted_trees", BOOSTED)[2]


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return at.feature_importance(attributions_boosted(spark, sf))


@query("explain_pairs")
def explain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    feats, fitted, values = _attributions(spark, sf, "boosted_trees", BOOSTED)
    return at.explain_pairs(feats, fitted.score(feats), values)


@query("held_out_scores")
def held_out_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Saved fold models, loaded again and routed to the group each did not see."""
    feats, labels = inputs(spark, sf)
    folder = new_folder(spark)
    tr.leave_one_group_out(feats, labels, {"boosted_trees": BOOSTED}, rules=t.RULES, save_to=folder)
    return tr.held_out_scores(feats, folder)


_MODEL_NAMES = ("weighted_baseline", "logistic_regression", "random_forest", "boosted_trees")


@query("fold_coverage", f"""
SELECT m.method, group_id, count(*) AS n_rows, count(*) AS n_items, count(*) AS n_in_unit
FROM dims, (VALUES {", ".join(f"('{m}')" for m in _MODEL_NAMES)}) AS m(method) GROUP BY 1, 2
""")
def fold_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out scores by method and group: every pair once, every score a share (up to rounding)."""
    feats, labels = inputs(spark, sf)
    scores = tr.leave_one_group_out(feats, labels, ALL_MODELS, rules=t.RULES)
    return scores.groupBy("method", "group_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_id").alias("n_items"),
        F.count(F.when(F.col("score").between(-1e-12, 1 + 1e-12), 1)).alias("n_in_unit"),
    )


@query("attribution_sums", """
SELECT m.method, count(*) AS n_rows, count(*) AS n_equal
FROM dims, (VALUES ('logistic_regression'), ('random_forest'), ('boosted_trees')) AS m(method) GROUP BY 1
""")
def attribution_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose base value and attributions add up to the model's own output."""
    feats, labels = inputs(spark, sf)
    parts = []
    for name in _MODEL_NAMES[1:]:
        fitted = md.train(feats, labels, name, ALL_MODELS[name], rules=t.RULES)
        total = at.shap_values(fitted, feats).groupBy("group_id", "item_id").agg(
            (F.first("base_value") + F.sum("shap_value")).alias("total"))
        share = F.col("total") if name == "random_forest" else 1 / (1 + F.exp(-F.col("total")))
        parts.append(fitted.score(feats).join(total, ["group_id", "item_id"]).agg(
            F.lit(name).alias("method"), F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(F.abs(share - F.col("score")) < 1e-9, 1)).alias("n_equal"),
        ))
    return union_all(*parts)


@query("fold_routing", """
SELECT group_id, count(*) AS n_rows, count(*) AS n_equal FROM dims GROUP BY 1
""")
def fold_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by the saved fold models against those of the fits themselves."""
    feats, labels = inputs(spark, sf)
    folder = new_folder(spark)
    fresh = tr.leave_one_group_out(feats, labels, {"boosted_trees": BOOSTED}, rules=t.RULES, save_to=folder)
    both = tr.held_out_scores(feats, folder).join(fresh, ["group_id", "item_id"])
    return both.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.abs(F.col("score") - F.col("held_out_score")) < 1e-12, 1)).alias("n_equal"),
    )


@query("full_evaluation")
def full_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """All fitted models, baselines and the ablation, held out, averaged over groups."""
    feats, labels = inputs(spark, sf)
    run = tr.run_evaluation(feats, labels, ALL_MODELS, t.DIMENSIONS["literature"], rules=t.RULES,
                            min_wins=4)
    return run.means.unionByName(run.means_novel.withColumn(
        "method", F.concat("method", F.lit("_novel_only"))))


@query("leakage_probe", """
SELECT count(*) AS n_rows, true AS refused FROM dims
""")
def probe(spark: SparkSession, sf: str) -> DataFrame:
    """An injected forbidden column must be refused, on the real feature table."""
    feats = t.score_features(spark, sf)
    leakage_probe(feats, t.RULES, "assoc_ds__5-LOW_score")
    try:
        select_features(feats.withColumn("label", F.lit(1)), t.RULES, exclude=set())
    except LeakageError:
        raise AssertionError("the label is an id column, not a feature") from None
    return feats.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("refused", F.lit(True))
