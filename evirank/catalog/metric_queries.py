"""Ranking and classification metrics over several methods at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import label_queries  # noqa: F401  (registers the label blocks)
from evirank.catalog import score_queries  # noqa: F401
from evirank.catalog import tables as t
from evirank.functions.numeric import stable_uniform
from evirank.operators import labels as lb
from evirank.operators import metrics as mt
from evirank.operators import scoring
from evirank.plans.comparison import compare_profiles
from evirank.session import cut_lineage

KEYS = ["method", "group_id"]

cte("overall", """
SELECT group_id, item_id, round(max(score) * 0.5 + count(*) / 10.0, 9) AS score FROM ev GROUP BY 1, 2
""")
cte("methods", """
SELECT 'weighted' AS method, group_id, item_id, score FROM weighted
UNION ALL SELECT 'popularity', group_id, item_id, n_other_groups_positive::DOUBLE FROM popular
UNION ALL SELECT 'overall', group_id, item_id, o.score FROM dims JOIN overall o USING (group_id, item_id)
UNION ALL SELECT 'random', group_id, item_id,
  ('0x' || substr(md5('42|' || group_id || '|' || item_id), 1, 8))::BIGINT / 4294967296.0 FROM dims
""")
cte("judged", """
SELECT method, group_id, item_id, score, label,
       row_number() OVER (PARTITION BY method, group_id ORDER BY score DESC, item_id) AS rank
FROM methods JOIN label_table USING (group_id, item_id) WHERE label IS NOT NULL
""")
cte("hits", """
SELECT *, sum(label) OVER (PARTITION BY method, group_id ORDER BY rank
                           ROWS UNBOUNDED PRECEDING)::BIGINT AS hits,
       sum(label) OVER (PARTITION BY method, group_id)::DOUBLE AS p,
       count(*) OVER (PARTITION BY method, group_id)::DOUBLE AS n
FROM judged
""")


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scores long by method, and labels.

    Evidence and labels feed several branches, so each is computed once.
    """
    shared = cut_lineage(t.evidence(spark, sf))
    labels = cut_lineage(t.labels(spark, sf, shared))
    feats = t.weighted(spark, sf, shared).select("group_id", "item_id", "score")
    overall = shared.groupBy("group_id", "item_id").agg(
        F.round(F.max("score") * 0.5 + F.count(F.lit(1)) / 10.0, 9).alias("overall")
    )
    wide = lb.popularity(feats.join(overall, ["group_id", "item_id"]), labels)
    scores = F.array(
        F.struct(F.lit("weighted").alias("method"), F.col("score").alias("score")),
        F.struct(F.lit("popularity").alias("method"),
                 F.col("n_other_groups_positive").cast("double").alias("score")),
        F.struct(F.lit("overall").alias("method"), F.col("overall").alias("score")),
        F.struct(F.lit("random").alias("method"),
                 stable_uniform(42, F.col("group_id"), F.col("item_id")).alias("score")),
    )
    long = wide.select("group_id", "item_id", F.explode(scores).alias("_s")).select(
        "group_id", "item_id", "_s.method", "_s.score"
    )
    return long, labels


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    scores, labels = inputs(spark, sf)
    return mt.ranked_with_labels(scores, labels, KEYS)


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    scores, labels = inputs(spark, sf)
    known = labels.where(F.col("label").isNotNull()).select("group_id", "item_id", "label")
    return scores.join(known, ["group_id", "item_id"])


_RANK_SQL = {
    "precision_at_5": "count(*) FILTER (rank <= 5 AND label = 1) / least(5, count(*))",
    "precision_at_10": "count(*) FILTER (rank <= 10 AND label = 1) / least(10, count(*))",
    "recall_at_10": "count(*) FILTER (rank <= 10 AND label = 1) / nullif(sum(label), 0)",
    "recall_at_20": "count(*) FILTER (rank <= 20 AND label = 1) / nullif(sum(label), 0)",
    "map": "sum(label * hits / rank) / nullif(sum(label), 0)",
    "mrr": "1.0 / min(CASE WHEN label = 1 THEN rank END)",
    "ndcg_at_10": """coalesce(sum(label / log2(rank + 1)) FILTER (rank <= 10), 0)
        / nullif(sum(CASE WHEN rank <= least(p, 10, n) THEN 1 / log2(rank + 1) END), 0)""",
    "ndcg_at_20": """coalesce(sum(label / log2(rank + 1)) FILTER (rank <= 20), 0)
        / nullif(sum(CASE WHEN rank <= least(p, 20, n) THEN 1 / log2(rank + 1) END), 0)""",
    "hit_rate": "CASE WHEN sum(label) > 0 THEN max(CASE WHEN rank <= 10 THEN label ELSE 0 END) END",
}


def _rank_sql(names: list[str], source: str = "hits") -> str:
    columns = ", ".join(f"round({_RANK_SQL[n]}, 10) AS {n}" for n in names)
    return (f"SELECT method, group_id, count(*) AS n_candidates, sum(label)::BIGINT AS n_positive, "
            f"{columns} FROM {source} GROUP BY 1, 2")


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 10) for n in names})


def _register(name: str, metrics: list[str]) -> None:
    @query(name, _rank_sql(metrics))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = mt.ranking_metrics_table(_ranked(spark, sf), tuple(metrics), KEYS)
        return _rounded(table, metrics)


_register("precision_recall_at_k", ["precision_at_5", "precision_at_10", "recall_at_10",
                                    "recall_at_20"])
_register("ndcg", ["ndcg_at_10", "ndcg_at_20"])
_register("average_precision", ["map"])
_register("mrr_hit_rate", ["mrr", "hit_rate"])


@query("running_hits", "SELECT method, group_id, item_id, score, label, rank, hits FROM hits")
def running_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


cte("levels", """
SELECT method, group_id, score, sum(label) AS lp, count(*) AS ln FROM judged GROUP BY 1, 2, 3
""")
cte("cumulative", """
SELECT *, sum(lp) OVER w AS cp, sum(ln) OVER w AS cn,
       sum(lp) OVER (PARTITION BY method, group_id) AS p,
       sum(ln) OVER (PARTITION BY method, group_id) AS n
FROM levels WINDOW w AS (PARTITION BY method, group_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
""")
cte("areas", """
SELECT method, group_id,
       CASE WHEN any_value(p) > 0 AND any_value(n) > any_value(p) THEN
         (any_value(p) * (any_value(n) - any_value(p))
          - sum(lp * (cn - cp - (ln - lp) / 2.0))) / (any_value(p) * (any_value(n) - any_value(p)))
       END AS roc_auc,
       CASE WHEN any_value(p) > 0 AND any_value(n) > any_value(p)
            THEN sum(lp * cp / cn) / any_value(p) END AS pr_auc
FROM cumulative GROUP BY 1, 2
""")
cte("auc_pairs", """
SELECT j.method, j.group_id,
       sum(CASE WHEN label = 1 THEN r END) AS rank_sum, sum(label) AS p, count(*) AS n
FROM (SELECT *, rank() OVER (PARTITION BY method, group_id ORDER BY score)
         + (count(*) OVER (PARTITION BY method, group_id, score) - 1) / 2.0 AS r FROM judged) j
GROUP BY 1, 2
""")
cte("at_half", """
SELECT method, group_id, count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
       count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
       count(*) FILTER (score < 0.5 AND label = 1) AS fn,
       CASE WHEN min(score) >= 0 AND max(score) <= 1 THEN avg((score - label) ** 2) END
           AS brier_score
FROM judged GROUP BY 1, 2
""")


@query("roc_auc", """
SELECT method, group_id, round((rank_sum - p * (p + 1) / 2) / (p * (n - p)), 10) AS roc_auc
FROM auc_pairs
""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mt.threshold_free(_joined(spark, sf), KEYS).drop("pr_auc"), ["roc_auc"])


@query("pr_auc", "SELECT method, group_id, round(pr_auc, 10) AS pr_auc FROM areas")
def pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mt.threshold_free(_joined(spark, sf), KEYS).drop("roc_auc"), ["pr_auc"])


@query("brier", "SELECT method, group_id, round(brier_score, 10) AS brier_score FROM at_half")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    table = mt.threshold_metrics(_joined(spark, sf), KEYS)
    return _rounded(table.select(*KEYS, "brier_score"), ["brier_score"])


@query("threshold_metrics", """
SELECT method, group_id, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 10) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 10) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 10) AS f1
FROM at_half
""")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    table = mt.threshold_metrics(_joined(spark, sf), KEYS).drop("brier_score")
    return _rounded(table, ["precision", "recall", "f1"])


def per_group(spark: SparkSession, sf: str, digits: int | None = mt.DIGITS,
              classification: tuple[str, ...] = ()) -> DataFrame:
    scores, labels = inputs(spark, sf)
    return mt.evaluate(scores, labels, classification=classification, keys=KEYS, digits=digits)


@query("evaluate_ranking", f"""
SELECT r.*, round(roc_auc, 10) AS roc_auc, round(pr_auc, 10) AS pr_auc,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 10) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 10) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 10) AS f1,
       round(brier_score, 10) AS brier_score
FROM ({_rank_sql(list(mt.RANKING_METRICS))}) r JOIN areas USING (method, group_id)
JOIN at_half USING (method, group_id)
""")
def evaluate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return per_group(spark, sf, classification=mt.CLASSIFICATION_METRICS)


cte("metric_rows", _rank_sql(list(mt.RANKING_METRICS)))
cte("metric_raw", _rank_sql(list(mt.RANKING_METRICS)).replace(", 10) AS", ", 17) AS"))


@query("mean_metrics", "SELECT method, " + ", ".join(
    f"round(avg({n}), 10) AS {n}, count(*) FILTER ({n} IS NULL) AS {n}_excluded"
    for n in mt.RANKING_METRICS
) + " FROM metric_raw GROUP BY 1")
def mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return mt.mean_over_groups(
        per_group(spark, sf, digits=None), list(mt.RANKING_METRICS), ["method"]
    )


@query("novel_evaluation", _rank_sql(["ndcg_at_10", "map"], """(
SELECT *, sum(label) OVER (PARTITION BY method, group_id ORDER BY rank ROWS UNBOUNDED PRECEDING)
           AS hits,
       sum(label) OVER (PARTITION BY method, group_id)::DOUBLE AS p,
       count(*) OVER (PARTITION BY method, group_id)::DOUBLE AS n
FROM (SELECT j.method, j.group_id, j.item_id, j.rank, v.label
      FROM judged j JOIN novel v USING (group_id, item_id)))"""))
def novel_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    scores, labels = inputs(spark, sf)
    return mt.evaluate(scores, lb.novel_only(labels), ("ndcg_at_10", "map"), keys=KEYS)


@query("wins_vs_random", """
SELECT m.method, count(*) FILTER (m.ndcg_at_10 > r.ndcg_at_10) AS n_wins,
       count(*) FILTER (m.ndcg_at_10 IS NOT NULL AND r.ndcg_at_10 IS NOT NULL) AS n_compared
FROM metric_rows m JOIN metric_rows r ON r.group_id = m.group_id AND r.method = 'random'
WHERE m.method <> 'random' GROUP BY 1
""")
def wins_vs_random(spark: SparkSession, sf: str) -> DataFrame:
    return mt.wins(per_group(spark, sf), "random")


@query("acceptance_beats_random", """
SELECT bool_and(n_wins >= 3) AS passed FROM (
  SELECT m.method, count(*) FILTER (m.ndcg_at_10 > r.ndcg_at_10) AS n_wins
  FROM metric_rows m JOIN metric_rows r ON r.group_id = m.group_id AND r.method = 'random'
  WHERE m.method <> 'random' GROUP BY 1)
""")
def acceptance_beats_random(spark: SparkSession, sf: str) -> DataFrame:
    return mt.all_beat_reference(wins_vs_random(spark, sf), 3)


_METHODS = ["overall", "popularity", "random", "weighted"]


@query("metric_matrix", "SELECT group_id, " + ", ".join(
    f"max(CASE WHEN method = '{m}' THEN ndcg_at_10 END) AS {m}" for m in _METHODS
) + " FROM metric_rows GROUP BY 1")
def metric_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_matrix(per_group(spark, sf), _METHODS)


@query("metrics_long", "SELECT method, group_id, unnest(['map', 'mrr']) AS metric, "
       "unnest([map, mrr]) AS value FROM metric_rows")
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return mt.to_long(per_group(spark, sf).select(*KEYS, "map", "mrr"), ["map", "mrr"], KEYS)


_ABLATIONS = {
    "without_literature": {"drop_groups": ["literature"]},
    "genetics_only": {"keep_groups": ["genetics"]},
    "without_unknown": {"drop_groups": ["no_such_dimension"]},
}


@query("weight_profile_comparison", """
WITH scored AS (
  SELECT 'default' AS profile, group_id, item_id, score FROM weighted
  UNION ALL SELECT 'without_literature', group_id, item_id, score FROM no_lit
  UNION ALL SELECT 'genetics_only', group_id, item_id, round(coalesce(dim__genetics, 0), 9) FROM feats
), placed AS (
  SELECT profile, group_id, item_id, label, coalesce(v.label, 0) AS l,
         row_number() OVER (PARTITION BY profile, group_id ORDER BY score DESC, item_id) AS rank
  FROM scored JOIN label_table v USING (group_id, item_id) WHERE label IS NOT NULL
), graded AS (
  SELECT profile, group_id, sum(CASE WHEN rank <= 10 THEN l / log2(rank + 1) END) AS dcg,
         sum(l) AS p, count(*) AS n FROM placed GROUP BY 1, 2
)
SELECT profile, round(avg(ndcg), 10) AS ndcg_at_10, count(*) FILTER (ndcg IS NULL)
       AS ndcg_at_10_excluded
FROM (SELECT profile, g.group_id,
             CASE WHEN p > 0 THEN dcg / list_sum(list_transform(range(1, least(p, 10, n)::INT + 1),
               lambda i: 1 / log2(i + 1))) END AS ndcg FROM graded g) GROUP BY 1
""")
def weight_profile_comparison(spark: SparkSession, sf: str) -> DataFrame:
    profiles, _skipped = scoring.plan_ablations(scoring.DEFAULT_WEIGHTS, _ABLATIONS)
    shared = cut_lineage(t.evidence(spark, sf))
    scored = scoring.score_profiles(
        t.score_features(spark, sf, shared), {"default": scoring.DEFAULT_WEIGHTS, **profiles}
    ).withColumn("score", F.round("score", 9))
    table = mt.evaluate(scored, t.labels(spark, sf, shared), ("ndcg_at_10",),
                        keys=["profile", "group_id"], digits=None)
    return mt.mean_over_groups(table, ["ndcg_at_10"], ["profile"])


@query("profile_comparison", """
WITH scored AS (
  SELECT 'default' AS profile, group_id, item_id, score FROM weighted
  UNION ALL SELECT 'without_literature', group_id, item_id, score FROM no_lit
  UNION ALL SELECT 'genetics_only', group_id, item_id, round(coalesce(dim__genetics, 0), 9) FROM feats
), scopes AS (
  SELECT 'primary' AS scope, group_id, item_id, label FROM label_table WHERE label IS NOT NULL
  UNION ALL SELECT 'novel_only', group_id, item_id, label FROM novel WHERE label IS NOT NULL
), placed AS (
  SELECT profile, scope, group_id, label AS l,
         row_number() OVER (PARTITION BY scope, profile, group_id ORDER BY score DESC, item_id) AS rank
  FROM scored JOIN scopes USING (group_id, item_id)
), graded AS (
  SELECT profile, scope, group_id, sum(CASE WHEN rank <= 10 THEN l / log2(rank + 1) END) AS dcg,
         sum(CASE WHEN rank <= 10 THEN l END) AS h, sum(l) AS p, count(*) AS n FROM placed GROUP BY 1, 2, 3
)
SELECT profile, scope, round(avg(CASE WHEN p > 0 THEN dcg / list_sum(list_transform(
         range(1, least(p, 10, n)::INT + 1), lambda i: 1 / log2(i + 1))) END), 10) AS ndcg_at_10,
       count(*) FILTER (p = 0) AS ndcg_at_10_excluded, round(avg(h / least(10, n)), 10) AS precision_at_10,
       count(*) FILTER (n = 0) AS precision_at_10_excluded, NULL::VARCHAR AS skipped
FROM graded GROUP BY 1, 2
UNION ALL SELECT 'without_unknown', NULL, NULL, NULL, NULL, NULL, 'drops no scored dimension'
""")
def profile_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Both scopes of every profile, and the ablation that cannot be made with its reason."""
    shared = cut_lineage(t.evidence(spark, sf))
    return compare_profiles(
        t.score_features(spark, sf, shared), t.labels(spark, sf, shared),
        {"default": scoring.DEFAULT_WEIGHTS}, "default", _ABLATIONS, digits=9)
