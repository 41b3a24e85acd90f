"""Weight profiles and ablations side by side, on all positives and on the novel ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.columns import GROUP, ITEM
from evirank.operators import metrics as mt
from evirank.operators.labels import novel_only
from evirank.operators.scoring import plan_ablations, score_profiles
from evirank.session import cut_lineage


def compare_profiles(
    features: DataFrame, labels: DataFrame, profiles: dict[str, dict[str, float]], base: str,
    ablations: dict[str, dict[str, list[str]]], metrics: tuple[str, ...] = ("ndcg_at_10", "precision_at_10"),
    digits: int | None = None,
) -> DataFrame:
    """``profile, scope``, the mean of every metric over groups with how many were undefined, ``skipped``.

    The ablations take weights from the profile ``base``. Scope is ``primary`` (all positives) or
    ``novel_only`` (positives of recurring items count as 0); every profile is scored in one pass,
    kept for both scopes. An ablation that cannot be made is one row: scope and metrics
    null, the reason in ``skipped``. ``digits`` rounds scores before they are ranked.
    """
    made, skipped = plan_ablations(profiles[base], ablations)
    clash = set(made) & set(profiles) | set(skipped) & set(profiles)
    if clash:
        raise ValueError(f"ablations named like profiles: {sorted(clash)}")
    labels = cut_lineage(labels.select(GROUP, ITEM, "label"))
    scored = score_profiles(features, {**profiles, **made})
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    scored = cut_lineage(scored)
    parts = []
    for scope, judged in (("primary", labels), ("novel_only", novel_only(labels))):
        table = mt.evaluate(scored, judged, metrics, keys=["profile", GROUP], digits=None)
        parts.append(mt.mean_over_groups(table, list(metrics), ["profile"]).withColumn("scope", F.lit(scope)))
    out = parts[0].unionByName(parts[1]).withColumn("skipped", F.lit(None).cast("string"))
    if skipped:
        # one row per ablation of the configuration
        reasons = features.sparkSession.createDataFrame(
            sorted(skipped.items()), "profile STRING, skipped STRING")
        out = out.unionByName(reasons, allowMissingColumns=True)
    return out.select("profile", "scope", *[c for c in out.columns if c not in ("profile", "scope")])
