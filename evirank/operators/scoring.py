"""Transparent weighted scores: contributions, ablations, profiles, filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.columns import (
    COMPLETENESS,
    DISPLAY_COMPLETENESS,
    FLAG_PREFIX,
    GROUP,
    ITEM,
    LABEL_PREFIX,
    WEIGHTED_SCORE,
    contrib,
    dim,
    missing,
    source_count,
    source_score,
)
from evirank.functions.numeric import row_sum
from evirank.operators.evidence import DEFAULT_RULES, DenyRule, LeakageError, violations
from evirank.operators.matrix import DETECTION_LEVEL, RELEVANT
from evirank.operators.ranking import rank_within_group, top_n

# Default weights, scenario weights and display categories.
DEFAULT_WEIGHTS = {
    "genetics": 0.40,
    "evidence_diversity": 0.20,
    "functional": 0.15,
    "literature": 0.15,
    "druggability": 0.10,
}
PROFILES = {
    "research": {
        "genetics": 0.45, "evidence_diversity": 0.25, "functional": 0.15,
        "literature": 0.10, "druggability": 0.05,
    },
    "clinical": {
        "genetics": 0.20, "evidence_diversity": 0.10, "functional": 0.15,
        "literature": 0.15, "druggability": 0.40,
    },
    "novel": {
        "genetics": 0.40, "evidence_diversity": 0.30, "functional": 0.25,
        "literature": 0.0, "druggability": 0.05,
    },
}
DISPLAY_CATEGORIES = (
    "genetics", "functional", "pathways", "expression", "network", "druggability",
)
SAFETY_LIABILITY = -1

NON_FEATURE_COLUMNS = frozenset({
    GROUP, "group_name", ITEM, "symbol", "item_name", "biotype", "dataset_version",
    "extraction_date", "label", "label_source", "label_reason", "max_clinical_stage",
})
ID_ORDER = (
    GROUP, "group_name", ITEM, "symbol", "item_name", "biotype", "dataset_version",
    "extraction_date",
)


def weight_shares(
    table: DataFrame, profile: list[str], weight: str = "weight", out: str = "weight"
) -> DataFrame:
    """Every weight as its share of its profile's total.

    The sum is a partial aggregate joined back, so a profile of any size is never one task's
    window. A null or negative weight, or a profile without a positive one, fails the query when
    its rows are read.
    """
    totals = table.groupBy(*profile).agg(
        F.sum(weight).alias("_total"),
        F.count_if(F.col(weight).isNull() | (F.col(weight) < 0)).alias("_refused"),
    )
    usable = (F.col("_refused") == 0) & (F.col("_total") > 0)
    share = F.when(usable, F.col(weight) / F.col("_total")).otherwise(
        F.raise_error(F.lit("weights must be known, none negative, some positive")).cast("double")
    )
    return table.join(totals, profile).withColumn(out, share).drop("_total", "_refused")


def check_weights(weights: dict[str, float], columns: list[str]) -> None:
    """Weights must be non-negative, sum to 1 and have their columns."""
    if any(v < 0 for v in weights.values()):
        raise ValueError(f"negative weights: {weights}")
    if not math.isclose(sum(weights.values()), 1.0, abs_tol=1e-6):
        raise ValueError(f"weights sum to {sum(weights.values())}, not 1")
    absent = [dim(d) for d in weights if dim(d) not in columns]
    if absent:
        raise KeyError(f"missing dimension columns: {absent}")


def label_derived(column: str) -> bool:
    """True for the label columns and those carried for display under ``label__``."""
    return column in {"label", "label_source", "label_reason", "max_clinical_stage"} or (
        column.startswith(LABEL_PREFIX)
    )


def weighted_score(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Contributions, their sum and the share of weighted dimensions that are known.

    Row-wise only, so it runs unchanged on a streaming DataFrame.
    """
    weights = DEFAULT_WEIGHTS if weights is None else weights
    check_weights(weights, features.columns)
    leaked = [c for c in features.columns if label_derived(c)]
    if leaked:
        raise LeakageError(f"label-derived columns reached the score: {leaked}")
    parts = {
        contrib(d): F.coalesce(F.col(dim(d)), F.lit(0.0)) * F.lit(float(w))
        for d, w in weights.items()
    }
    known = [F.col(dim(d)).isNotNull().cast("double") for d in weights]
    return features.withColumns(parts).withColumns({
        WEIGHTED_SCORE: row_sum([F.col(c) for c in parts]),
        COMPLETENESS: row_sum(known) / F.lit(float(len(weights))),
    })


def ablated_weights(weights: dict[str, float], drop: list[str]) -> dict[str, float]:
    """The other weights, scaled up by what the dropped ones held."""
    rest = {d: w for d, w in weights.items() if d not in drop}
    held = math.fsum(rest.values())
    if not held > 0:
        raise ValueError(f"nothing left to score after dropping {drop}")
    return {d: w / held for d, w in rest.items()}


def ablate(features: DataFrame, drop: list[str], weights: dict[str, float] | None = None
           ) -> DataFrame:
    """Rescore without some dimensions, the other weights rescaled."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    return weighted_score(features, ablated_weights(weights, drop))


def rank_scored(
    scored: DataFrame, n: int | None = None, group: str = GROUP, item: str = ITEM,
    symbol: str | None = None, score: str = WEIGHTED_SCORE,
) -> DataFrame:
    """Score descending, symbol, then id (nulls last)."""
    ties = [F.col(symbol).asc_nulls_last()] if symbol else []
    ranked = rank_within_group(scored, group, score, item, tiebreaks=ties)
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def explain_rows(
    scored: DataFrame, weights: dict[str, float] | None = None, top: int | None = None
) -> DataFrame:
    """Per row: contributions and raw values as maps, missing list, top contributors."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    names = list(weights)
    pairs = [x for d in names for x in (F.lit(d), F.col(contrib(d)))]
    raw = [x for d in names for x in (F.lit(d), F.col(dim(d)))]
    absent = F.filter(
        F.array(*[F.when(F.col(dim(d)).isNull(), F.lit(d)) for d in names]),
        lambda x: x.isNotNull(),
    )
    out = scored.withColumns({
        "contributions": F.create_map(*pairs),
        "dimension_values": F.create_map(*raw),
        "missing_dimensions": F.array_sort(absent),
    })
    return out.withColumn("top_contributors", top_contributors(names, top)) if top else out


def top_contributors(names: list[str], n: int) -> Column:
    """The n largest contributions of a row as an array of structs."""
    entries = F.array(*[
        F.struct((-F.col(contrib(d))).alias("order"), F.lit(d).alias("dimension"),
                 F.col(contrib(d)).alias("contribution"))
        for d in names
    ])
    return F.transform(
        F.slice(F.array_sort(entries), 1, n),
        lambda e: F.struct(e["dimension"].alias("dimension"),
                           e["contribution"].alias("contribution")),
    )


def score_profiles(
    features: DataFrame, profiles: dict[str, dict[str, float]], keep: list[str] | None = None
) -> DataFrame:
    """Score every profile in one pass over the features: one output row per profile."""
    keep = keep or [GROUP, ITEM]
    names = sorted({d for w in profiles.values() for d in w})
    for weights in profiles.values():
        check_weights(weights, features.columns)
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("profile"),
            row_sum([
                F.coalesce(F.col(dim(d)), F.lit(0.0)) * F.lit(float(w.get(d, 0.0))) for d in names
            ]).alias("score"),
        )
        for p, w in profiles.items()
    ])
    return features.select(*keep, F.explode(rows).alias("_r")).select(
        *keep, "_r.profile", "_r.score"
    )


def plan_ablations(
    weights: dict[str, float], ablations: dict[str, dict[str, list[str]]]
) -> tuple[dict[str, dict[str, float]], dict[str, str]]:
    """Profiles for named ablations and the skipped ones with the reason.

    An ablation names ``drop_groups`` or ``keep_groups``.
    """
    profiles, skipped = {}, {}
    for name, scope in ablations.items():
        if "drop_groups" in scope:
            drop = list(scope["drop_groups"])
        elif "keep_groups" in scope:
            drop = [d for d in weights if d not in scope["keep_groups"]]
        else:
            raise ValueError(f"ablation {name} names no groups")
        if not set(drop) & set(weights):
            skipped[name] = "drops no scored dimension"
            continue
        try:
            profiles[name] = ablated_weights(weights, drop)
        except ValueError as error:
            skipped[name] = str(error)
    return profiles, skipped


def display_completeness(features: DataFrame) -> DataFrame:
    """Share of the six display categories that are known, and the missing ones by name."""
    present = [1 - F.col(missing(c)) for c in DISPLAY_CATEGORIES]
    absent = F.filter(
        F.array(*[F.when(F.col(missing(c)) == 1, F.lit(c)) for c in DISPLAY_CATEGORIES]),
        lambda x: x.isNotNull(),
    )
    return features.withColumns({
        DISPLAY_COMPLETENESS: row_sum(present) / F.lit(float(len(DISPLAY_CATEGORIES))),
        "missing_evidence": F.array_sort(absent),
    })


@dataclass(frozen=True)
class RankingFilters:
    """Filters of a ranking; they act after the rank is known.

    ``item_family`` is part of the type but has no column behind it, so asking
    for it raises.
    """

    min_genetics: float | None = None
    relevant_tissue: bool = False
    require_druggable: bool = False
    min_completeness: float | None = None
    exclude_safety: bool = False
    item_family: str | None = None

    def predicates(self) -> list[Column]:
        if self.item_family:
            raise ValueError("item_family has no source column; refusing to ignore the filter")
        out: list[Column] = []
        if self.min_genetics is not None:
            out.append(F.coalesce(F.col(dim("genetics")), F.lit(0.0)) >= self.min_genetics)
        if self.relevant_tissue:
            out.append(F.coalesce(F.col(RELEVANT), F.lit(0.0)) >= DETECTION_LEVEL)
        if self.require_druggable:
            out.append(F.col(FLAG_PREFIX + "has_small_molecule_binder") == 1)
        if self.min_completeness is not None:
            out.append(F.col(DISPLAY_COMPLETENESS) >= self.min_completeness)
        if self.exclude_safety:
            liability = F.col(FLAG_PREFIX + "has_safety_event") == SAFETY_LIABILITY
            out.append(~F.coalesce(liability, F.lit(False)))
        return out


@dataclass(frozen=True)
class Scenario:
    """A way to look at a ranking: weights, and filters that act after the rank is known."""

    weights: dict[str, float]
    filters: RankingFilters = RankingFilters()


SCENARIOS = {name: Scenario(weights) for name, weights in PROFILES.items()} | {
    "safety_first": Scenario(DEFAULT_WEIGHTS, RankingFilters(exclude_safety=True)),
}


def custom_scenario(weights: dict[str, float], filters: RankingFilters | None = None) -> Scenario:
    """A scenario of the caller's own weights on any scale; zero weights are left out."""
    if any(not (math.isfinite(w) and w >= 0) for w in weights.values()):
        raise ValueError(f"weights must be finite and not negative: {weights}")
    total = math.fsum(weights.values())
    if not total > 0:
        raise ValueError("a scenario needs a positive weight")
    return Scenario({d: w / total for d, w in weights.items() if w > 0}, filters or RankingFilters())


def rank_scenarios(
    features: DataFrame, scenarios: dict[str, Scenario], n: int | None = None,
    digits: int | None = None, group: str = GROUP, item: str = ITEM,
) -> DataFrame:
    """``profile, group, item, score, rank``: every scenario from one pass over the features.

    Ranks are over all candidates of the group; a scenario's filters then drop rows, so ranks
    keep their gaps, and at most n rows per scenario and group stay.
    """
    needed = {dim("genetics"), RELEVANT, FLAG_PREFIX + "has_small_molecule_binder",
              FLAG_PREFIX + "has_safety_event", DISPLAY_COMPLETENESS}
    keep = [group, item, *sorted(needed & set(features.columns))]
    scored = score_profiles(features, {name: s.weights for name, s in scenarios.items()}, keep)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    kept = rank_within_group(scored, ["profile", group], "score", item)
    for name, scenario in scenarios.items():
        for p in scenario.filters.predicates():
            kept = kept.where((F.col("profile") != name) | p)
    kept = kept.select("profile", group, item, "score", "rank")
    return kept if n is None else top_n(
        kept, ["profile", group], [F.col("rank").asc()], n, "_keep").drop("_keep")


def select_features(
    df: DataFrame, rules: tuple[DenyRule, ...] = DEFAULT_RULES, exclude: set[str] | None = None
) -> list[str]:
    """Model-input columns: all but the known non-features; a forbidden one raises."""
    out = NON_FEATURE_COLUMNS | (exclude or set())
    columns = [c for c in df.columns if c not in out]
    bad = violations(columns, rules)
    if bad:
        raise LeakageError(f"forbidden feature columns: {bad}")
    return columns


def drop_dimension_columns(df: DataFrame, dimension: str, sources: list[str]) -> DataFrame:
    """Without every column derived from one dimension.

    The source counts go too: a model could read the dimension back from them.
    """
    doomed = {dim(dimension), missing(dimension), dim("evidence_diversity"), "n_evidence_types"}
    doomed |= {name(s) for s in sources for name in (source_score, source_count)}
    return df.drop(*[c for c in df.columns if c in doomed])


def ordered_columns(df: DataFrame) -> DataFrame:
    """Ids first in their fixed order, everything else alphabetically."""
    ids = [c for c in ID_ORDER if c in df.columns]
    return df.select(*ids, *sorted(c for c in df.columns if c not in ids))
