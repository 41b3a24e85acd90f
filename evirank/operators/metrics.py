"""Ranking and classification metrics per group, then means over groups.

Everything is one grouped job over ``keys`` (for instance method and group):
a distributed ranking feeds the rank-based metrics, a table of distinct scores
with running counts feeds the threshold-free ones. No group is ever collected.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.columns import GROUP, ITEM, LABEL
from evirank.functions.numeric import dcg_discount
from evirank.operators.ranking import running_totals
from evirank.session import cut_lineage

# The metric lists in force and the decision threshold.
RANKING_METRICS = (
    "precision_at_5", "precision_at_10", "recall_at_10", "recall_at_20", "map", "mrr",
    "ndcg_at_10", "ndcg_at_20", "hit_rate",
)
CLASSIFICATION_METRICS = ("roc_auc", "pr_auc", "precision", "recall", "f1", "brier_score")
PRIMARY_METRIC = "ndcg_at_10"
HIT_RATE_K = 10
THRESHOLD = 0.5
DIGITS = 10


def _label() -> Column:
    return F.col(LABEL).cast("double")


def _rank() -> Column:
    return F.col("rank")


def _positives() -> Column:
    return F.sum(LABEL).cast("double")


def _rows() -> Column:
    return F.count(F.lit(1)).cast("double")


def _has_positives(value: Column) -> Column:
    return F.when(_positives() > 0, value)


def precision_at(k: int) -> Column:
    hits = F.count_if((_rank() <= k) & (F.col(LABEL) == 1))
    return F.when(_rows() > 0, hits / F.least(F.lit(float(k)), _rows())).otherwise(F.lit(0.0))


def recall_at(k: int) -> Column:
    hits = F.count_if((_rank() <= k) & (F.col(LABEL) == 1))
    return _has_positives(hits / _positives())


def ndcg_at(k: int) -> Column:
    """Binary NDCG; the ideal list holds min(positives, k, rows) hits."""
    gain = F.sum(F.when(_rank() <= k, _label() * dcg_discount(_rank())).otherwise(F.lit(0.0)))
    ideal_hits = F.least(_positives(), F.lit(float(k)), _rows()).cast("int")
    prefix, running = [0.0], 0.0
    for i in range(1, k + 1):
        running += 1.0 / math.log2(i + 1)
        prefix.append(running)
    ideal = F.element_at(F.array(*[F.lit(x) for x in prefix]), ideal_hits + 1)
    return _has_positives(gain / ideal)


def average_precision() -> Column:
    """Needs ``rank`` and the running number of positives ``hits``."""
    return _has_positives(F.sum(_label() * F.col("hits") / _rank()) / _positives())


def reciprocal_rank() -> Column:
    return F.lit(1.0) / F.min(F.when(F.col(LABEL) == 1, _rank()))


def hit_rate(k: int = HIT_RATE_K) -> Column:
    return _has_positives(F.max(F.when(_rank() <= k, _label()).otherwise(F.lit(0.0))))


_AT_K = {"precision": precision_at, "recall": recall_at, "ndcg": ndcg_at}
_PLAIN = {"map": average_precision, "mrr": reciprocal_rank, "hit_rate": hit_rate}


def ranking_metric(name: str) -> Column:
    """Aggregate expression for a metric name; an unknown name raises."""
    at = re.fullmatch(r"(precision|recall|ndcg)_at_(\d+)", name)
    if at:
        return _AT_K[at[1]](int(at[2]))
    if name in _PLAIN:
        return _PLAIN[name]()
    raise ValueError(f"unknown ranking metric {name!r}")


def ranked_with_labels(
    scored: DataFrame, labels: DataFrame, keys: list[str] | None = None, group: str = GROUP,
    item: str = ITEM, score: str = "score",
) -> DataFrame:
    """Known labels joined to scores, ranked inside each key, with running hits."""
    keys = keys or [group]
    known = labels.where(F.col(LABEL).isNotNull()).select(
        group, item, F.col(LABEL).cast("int").alias(LABEL)
    )
    joined = scored.select(*keys, item, score).join(known, [group, item])
    order = [F.col(score).desc_nulls_last(), F.col(item).asc_nulls_last()]
    return running_totals(joined, keys, order, {"hits": LABEL})


def ranking_metrics_table(
    ranked: DataFrame, names: tuple[str, ...] = RANKING_METRICS, keys: list[str] | None = None,
    more: list[Column] | None = None,
) -> DataFrame:
    """One row per key; ``more`` adds aggregates to the same pass."""
    keys = keys or [GROUP]
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(LABEL).alias("n_positive"),
        *[ranking_metric(n).alias(n) for n in names],
        *(more or []),
    )


def threshold_free(
    joined: DataFrame, keys: list[str] | None = None, score: str = "score"
) -> DataFrame:
    """ROC-AUC (ties averaged) and step-wise PR-AUC (ties grouped) per key."""
    keys = keys or [GROUP]
    levels = joined.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(LABEL).alias("_p")
    )
    cum = running_totals(
        levels, keys, [F.col(score).desc_nulls_last()], {"_cn": "_n", "_cp": "_p"}, rank=None
    )
    positives, rows = F.sum("_p").cast("double"), F.sum("_n").cast("double")
    negatives = rows - positives
    both = (positives > 0) & (negatives > 0)
    # negatives scored higher than this level, plus half of those tied with it
    above = F.col("_cn") - F.col("_cp") - (F.col("_n") - F.col("_p")) / 2.0
    lost = F.sum(F.col("_p") * above)
    area = F.sum(F.col("_p") * F.col("_cp") / F.col("_cn")) / positives
    return cum.groupBy(*keys).agg(
        F.when(both, 1.0 - lost / (positives * negatives)).alias("roc_auc"),
        F.when(both, area).alias("pr_auc"),
    )


def threshold_expressions(score: str = "score", threshold: float = THRESHOLD) -> list[Column]:
    """Precision, recall and F1 at the threshold (0 for 0/0) and the Brier score.

    Brier is null when any score of the key lies outside [0, 1].
    """
    said = F.col(score) >= threshold
    tp = F.count_if(said & (F.col(LABEL) == 1))
    fp = F.count_if(said & (F.col(LABEL) == 0))
    fn = F.count_if(~said & (F.col(LABEL) == 1))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    inside = (F.min(score) >= 0) & (F.max(score) <= 1)
    gap = F.col(score) - F.col(LABEL)
    return [
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(inside, F.avg(gap * gap)).alias("brier_score"),
    ]


def threshold_metrics(
    joined: DataFrame, keys: list[str] | None = None, score: str = "score",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The threshold metrics per key."""
    return joined.groupBy(*(keys or [GROUP])).agg(*threshold_expressions(score, threshold))


def evaluate(
    scored: DataFrame, labels: DataFrame, ranking: tuple[str, ...] = RANKING_METRICS,
    classification: tuple[str, ...] = (), keys: list[str] | None = None, group: str = GROUP,
    item: str = ITEM, score: str = "score", digits: int | None = DIGITS,
) -> DataFrame:
    """All metrics, one row per key, rounded (``digits=None`` keeps them for averaging)."""
    keys = keys or [group]
    unknown = [c for c in classification if c not in CLASSIFICATION_METRICS]
    if unknown:
        raise ValueError(f"unknown classification metrics {unknown}")
    ranked = ranked_with_labels(scored, labels, keys, group, item, score)
    areas = bool({"roc_auc", "pr_auc"} & set(classification))
    if areas:
        # read twice: by row and by distinct score
        ranked = cut_lineage(ranked)
    more = threshold_expressions(score) if classification else []
    out = ranking_metrics_table(ranked, ranking, keys, more)
    if areas:
        out = out.join(threshold_free(ranked, keys, score), keys, "left")
    names = [*ranking, *classification]
    out = out.select(*keys, "n_candidates", "n_positive", *names)
    return out if digits is None else out.withColumns({n: F.round(n, digits) for n in names})


def mean_over_groups(
    per_group: DataFrame, names: list[str], by: list[str] | None = None
) -> DataFrame:
    """Mean of each metric with undefined groups left out, and how many were."""
    by = by or []
    aggs = [F.round(F.avg(n), DIGITS).alias(n) for n in names]
    aggs += [F.count_if(F.col(n).isNull()).alias(f"{n}_excluded") for n in names]
    return per_group.groupBy(*by).agg(*aggs) if by else per_group.agg(*aggs)


def to_long(per_group: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Metric per row: the form the metrics sink writes."""
    return per_group.unpivot(keys, names, "metric", "value")


def wins(
    per_group: DataFrame, reference: str, metric: str = PRIMARY_METRIC, method: str = "method",
    group: str = GROUP,
) -> DataFrame:
    """Groups in which a method beats the reference method; null pairs are skipped."""
    base = per_group.where(F.col(method) == reference).select(group, F.col(metric).alias("_base"))
    pairs = per_group.where(F.col(method) != reference).join(base, group)
    defined = F.col(metric).isNotNull() & F.col("_base").isNotNull()
    return pairs.groupBy(method).agg(
        F.count_if(defined & (F.col(metric) > F.col("_base"))).alias("n_wins"),
        F.count_if(defined).alias("n_compared"),
    )


def all_beat_reference(win_table: DataFrame, min_wins: int) -> DataFrame:
    """One row: does every method win in at least ``min_wins`` groups?"""
    return win_table.agg(F.every(F.col("n_wins") >= min_wins).alias("passed"))


def metric_matrix(
    per_group: DataFrame, methods: list[str], metric: str = PRIMARY_METRIC, group: str = GROUP,
    method: str = "method",
) -> DataFrame:
    """Groups as rows, methods as columns."""
    return per_group.groupBy(group).pivot(method, methods).agg(F.first(metric))
