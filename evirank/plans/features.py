"""The feature table of all groups at once: the group is a key, there is no loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.columns import COUNT, FLAG_PREFIX, GROUP, ITEM, SCORE, SOURCE, dim, missing
from evirank.columns import source_count, source_score
from evirank.functions.numeric import saturate
from evirank.operators.evidence import (
    DEFAULT_RULES,
    DIVERSITY_SATURATION,
    DenyRule,
    cooccurrence_flags,
    drop_denied_sources,
    flag_mean,
    nonnull_count,
    violations,
)
from evirank.operators.hierarchy import add_root_features
from evirank.operators.matrix import add_expression_features
from evirank.operators.quality import assert_no_leakage
from evirank.operators.scoring import ordered_columns, select_features


@dataclass(frozen=True)
class FeatureConfig:
    dimensions: dict[str, list[str]]
    druggability_flags: list[str]
    safety_flags: list[str]
    sources: list[str] = field(default_factory=list)
    rules: tuple[DenyRule, ...] = DEFAULT_RULES
    saturation: int = DIVERSITY_SATURATION
    matrix_columns: int = 2
    unique_sources: bool = False  # the evidence has one row per key and source
    unique_cells: bool = False  # the matrix has one row per item and column
    dataset_version: str | None = None
    stamp_date: bool = False

    def __post_init__(self) -> None:
        """Dimensions are disjoint, and no forbidden source is scored."""
        scored = [s for sources in self.dimensions.values() for s in sources]
        twice = sorted({s for s in scored if scored.count(s) > 1})
        if twice:
            raise ValueError(f"sources in more than one dimension: {twice}")
        forbidden = violations([source_score(s) for s in [*scored, *self.sources]], self.rules)
        if forbidden:
            raise ValueError(f"forbidden sources are scored: {sorted(forbidden)}")


def evidence_features(evidence: DataFrame, config: FeatureConfig, keys: list[str] | None = None
                      ) -> DataFrame:
    """Dimensions, source count and the wide per-source columns in one aggregation."""
    keys = keys or [GROUP, ITEM]
    best = [
        F.max(F.when(F.col(SOURCE).isin(list(s)), F.col(SCORE))).alias(dim(d))
        for d, s in config.dimensions.items()
    ]
    wide = []
    for s in config.sources:
        here = F.col(SOURCE) == F.lit(s)
        wide.append(F.max(F.when(here, F.col(SCORE))).alias(source_score(s)))
        wide.append(F.sum(F.when(here, F.col(COUNT))).alias(source_count(s)))
    n_types = F.count(SOURCE) if config.unique_sources else F.countDistinct(SOURCE)
    out = evidence.groupBy(*keys).agg(*best, n_types.alias("n_evidence_types"), *wide)
    return out.withColumns({
        dim("evidence_diversity"): saturate(F.col("n_evidence_types"), config.saturation),
        **{missing(d): F.col(dim(d)).isNull().cast("byte") for d in config.dimensions},
    })


def build_feature_table(
    evidence: DataFrame, config: FeatureConfig, flags: DataFrame | None = None,
    info: DataFrame | None = None, rooted: DataFrame | None = None,
    network: DataFrame | None = None, matrix: DataFrame | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """One row per (group, item) with a scoreable source.

    Forbidden sources leave before anything is built. The evidence is aggregated
    once; every other part is appended by left joins. ``flags``, ``info``,
    ``rooted`` and ``network`` are keyed by item, ``matrix`` is long, ``matched``
    holds the matrix columns each group cares about.
    """
    kept = drop_denied_sources(evidence, config.rules)
    out = evidence_features(kept, config)
    if info is not None:
        out = out.join(info, ITEM, "left")
    if flags is not None:
        rated = flag_mean(flags, config.druggability_flags)
        rated = nonnull_count(rated, config.safety_flags)
        out = out.join(rated, ITEM, "left").withColumn(
            missing("druggability"), F.col(dim("druggability")).isNull().cast("byte")
        )
    if rooted is not None:
        out = add_root_features(out, rooted)
    if network is not None:
        out = out.join(network, ITEM, "left").withColumn(
            missing("network"), F.coalesce(missing("network"), F.lit(1)).cast("byte")
        )
    if matrix is not None and matched is not None:
        out = add_expression_features(out, matrix, matched, config.matrix_columns, [GROUP],
                                      unique_cells=config.unique_cells)
    if rooted is not None and matrix is not None:
        out = cooccurrence_flags(out)
    if config.dataset_version:
        out = out.withColumn("dataset_version", F.lit(config.dataset_version))
    if config.stamp_date:
        out = out.withColumn("extraction_date", F.current_date().cast("string"))
    out = ordered_columns(out)
    assert_no_leakage(select_features(out, config.rules), config.rules, check_stale=False)
    return out


def detail_provenance(pathways: DataFrame, tissues: DataFrame, partners: DataFrame,
                      item: str = ITEM) -> DataFrame:
    """Rows and covered items of the three detail tables, roots and tissues: one row each."""
    def row(name: str, df: DataFrame, kinds: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct(item).alias("n_items"),
            F.countDistinct(kinds).alias("n_kinds"),
        ).select(F.lit(name).alias("detail"), "n_rows", "n_items", "n_kinds")

    return row("pathways", pathways, "root_id").unionByName(
        row("tissues", tissues, "tissue")).unionByName(row("partners", partners, "partner_id"))


def display_bundle(
    universe: DataFrame, held_out: DataFrame | None, overall: DataFrame, popular: DataFrame,
    labels: DataFrame, drugs: DataFrame, group_text: DataFrame, item_text: DataFrame,
) -> DataFrame:
    """Everything shown beside a ranking, keyed by (group, item); joined after scoring only."""
    keys = [GROUP, ITEM]
    out = universe.select(*keys).distinct()
    if held_out is not None:
        out = out.join(held_out, keys, "left")
    out = out.join(overall, keys, "left").join(popular, keys, "left")
    out = out.join(
        labels.select(*keys, F.col("max_clinical_stage").alias("label__max_clinical_stage")),
        keys, "left",
    ).join(drugs, keys, "left")
    out = out.join(group_text, GROUP, "left").join(item_text, ITEM, "left")
    zero = ["n_other_groups_positive", "label__n_drugs"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FLAG_PREFIX)]
