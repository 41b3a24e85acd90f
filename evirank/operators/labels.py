"""Tri-state labels from staged clinical evidence over a group's family."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.columns import GROUP, ITEM, LABEL, LABEL_PREFIX
from evirank.operators.evidence import DEFAULT_RULES, DenyRule, is_denied_source
from evirank.operators.ranking import top_n

# Stage names and their level (None: excluded from both classes), and reasons.
STAGE_LEVELS = {
    "APPROVAL": 4,
    "PREAPPROVAL": 4,
    "PHASE_3": 3,
    "PHASE_2_3": 3,
    "PHASE_2": 2,
    "PHASE_1_2": 2,
    "PHASE_1": 1,
    "EARLY_PHASE_1": 1,
    "IND": 0,
    "PRECLINICAL": 0,
    "UNKNOWN": None,
}
POSITIVE_LEVEL = 3
NO_EVIDENCE = "negative_no_clinical_evidence"
UNKNOWN_STAGE = "excluded_unknown_stage"
EARLY_STAGE = "negative_early_stage"
NAMES_SHOWN = 5


def positive_reason(threshold: int = POSITIVE_LEVEL) -> str:
    return f"positive_stage_ge_{threshold}"


def stage_level(stage: Column, levels: dict[str, int | None] | None = None) -> Column:
    """Stage name to level; call :func:`check_stages` first, since unknown names give null."""
    levels = STAGE_LEVELS if levels is None else levels
    pairs = chain.from_iterable((F.lit(k), F.lit(v).cast("long")) for k, v in levels.items())
    return F.element_at(F.create_map(*pairs), stage)


def unmapped_stages(
    clinical: DataFrame, stage: str = "stage", levels: dict[str, int | None] | None = None
) -> DataFrame:
    """Stage names without a level, with their row counts."""
    known = list(STAGE_LEVELS if levels is None else levels)
    return (
        clinical.where(F.col(stage).isNull() | ~F.col(stage).isin(known))
        .groupBy(stage).agg(F.count(F.lit(1)).alias("n_rows"))
    )


def check_stages(
    clinical: DataFrame, stage: str = "stage", levels: dict[str, int | None] | None = None
) -> None:
    """Raise when a stage name has no level."""
    bad = [r[0] for r in unmapped_stages(clinical, stage, levels).limit(20).collect()]
    if bad:
        raise ValueError(f"stage names without a level: {bad}")


def unnest_clinical(
    records: DataFrame, item: str, stage: str, groups: str, group_field: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per (item, direct group) from a list-of-structs column."""
    exploded = records.select(
        F.col(item).alias(ITEM), F.col(stage).alias("stage"), *(keep or []),
        F.explode(groups).alias("_g"),
    )
    return exploded.select(
        ITEM, F.col(f"_g.{group_field}").alias("group_direct"), "stage", *(keep or [])
    )


def expand_family(
    groups: DataFrame, group: str = GROUP, descendants: str = "descendants"
) -> DataFrame:
    """``group, member`` with the group itself and every descendant."""
    empty = F.array().cast("array<string>")
    members = F.concat(F.array(F.col(group)), F.coalesce(F.col(descendants), empty))
    return groups.select(group, F.explode(members).alias("member")).distinct()


def clinical_by_group(clinical: DataFrame, family: DataFrame, group: str = GROUP,
                      item: str = ITEM, levels: dict[str, int | None] | None = None) -> DataFrame:
    """Max level and row count per (group, item) over the family, and over the group alone.

    Clinical rows are first combined per (direct group, item), so the family
    join works on unique pairs.
    """
    direct = clinical.groupBy("group_direct", item).agg(
        F.max(stage_level(F.col("stage"), levels)).alias("_level"),
        F.count(F.lit(1)).alias("_rows"),
    )
    joined = direct.join(family.withColumnRenamed("member", "group_direct"), "group_direct")
    own = F.col("group_direct") == F.col(group)
    return joined.groupBy(group, item).agg(
        F.max("_level").alias("max_clinical_stage"),
        F.sum("_rows").alias("n_clinical_rows"),
        F.max(F.when(own, F.col("_level"))).alias("direct_stage"),
    )


def candidate_status(
    evidence: DataFrame, rules: tuple[DenyRule, ...] = DEFAULT_RULES, group: str = GROUP,
    item: str = ITEM, source: str = "source",
) -> DataFrame:
    """``group, item, scored``: false when only forbidden sources speak for the pair."""
    return evidence.groupBy(group, item).agg(
        F.max(~is_denied_source(F.col(source), rules)).alias("scored")
    )


def labelled_universe(
    status: DataFrame, clinical: DataFrame, threshold: int = POSITIVE_LEVEL,
    group: str = GROUP, item: str = ITEM,
) -> DataFrame:
    """Full outer view of candidates and clinical pairs with the reason for each pair.

    ``scored`` is null for pairs outside the group's own candidates; those and
    the unscored ones are counted, not labelled.
    """
    joined = status.join(clinical, [group, item], "full_outer")
    reason = (
        F.when(F.col("n_clinical_rows").isNull(), NO_EVIDENCE)
        .when(F.col("max_clinical_stage").isNull(), UNKNOWN_STAGE)
        .when(F.col("max_clinical_stage") >= threshold, positive_reason(threshold))
        .otherwise(EARLY_STAGE)
    )
    return joined.withColumn("label_reason", reason)


def build_labels(
    evidence: DataFrame, clinical: DataFrame, family: DataFrame,
    rules: tuple[DenyRule, ...] = DEFAULT_RULES, threshold: int = POSITIVE_LEVEL,
    label_source: str = "clinical", group: str = GROUP, item: str = ITEM,
    levels: dict[str, int | None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Labels of every group at once, and one reconciliation row per group."""
    known = (STAGE_LEVELS if levels is None else levels).values()
    if not any(v is not None and v >= threshold for v in known):
        raise ValueError(f"no stage reaches the threshold {threshold}")
    check_stages(clinical, levels=levels)
    per_pair = clinical_by_group(clinical, family, group, item, levels)
    groups = evidence.select(group).distinct()
    per_pair = per_pair.join(groups, group, "left_semi")
    universe = labelled_universe(
        candidate_status(evidence, rules, group, item), per_pair, threshold, group, item
    )
    return labels_of(universe, threshold, label_source, group, item), reconcile(
        universe, family, threshold, group
    )


def labels_of(
    universe: DataFrame, threshold: int = POSITIVE_LEVEL, label_source: str = "clinical",
    group: str = GROUP, item: str = ITEM,
) -> DataFrame:
    """The label table: scored candidates only, 1 / 0 / null."""
    label = (
        F.when(F.col("label_reason") == positive_reason(threshold), F.lit(1))
        .when(F.col("label_reason") == UNKNOWN_STAGE, F.lit(None))
        .otherwise(F.lit(0))
    )
    return universe.where(F.coalesce("scored", F.lit(False))).select(
        group, item, label.cast("byte").alias(LABEL), "label_reason",
        F.lit(label_source).alias("label_source"), "max_clinical_stage",
    )


def reconcile(
    universe: DataFrame, family: DataFrame, threshold: int = POSITIVE_LEVEL, group: str = GROUP
) -> DataFrame:
    """Counts per group; ``balanced`` states that the positive buckets add up."""
    positive = F.coalesce(F.col("max_clinical_stage") >= threshold, F.lit(False))
    scored = F.coalesce("scored", F.lit(False))
    candidate = F.col("scored").isNotNull()
    direct = F.coalesce(F.col("direct_stage") >= threshold, F.lit(False))
    unknown = F.col("label_reason") == UNKNOWN_STAGE
    counts = universe.groupBy(group).agg(
        F.count_if(candidate).alias("n_full_candidates"),
        F.count_if(scored).alias("n_scored_candidates"),
        F.count_if(candidate & ~scored).alias("n_dropped_clinical_only"),
        F.count_if(positive).alias("n_family_positive"),
        F.count_if(positive & ~candidate).alias("n_positive_outside"),
        F.count_if(positive & candidate & ~scored).alias("n_positive_dropped"),
        F.count_if(scored & positive).alias("n_positive"),
        F.count_if(scored & ~positive & ~unknown).alias("n_negative"),
        F.count_if(scored & unknown).alias("n_excluded_unknown_stage"),
        F.count_if(scored & direct).alias("n_positive_direct_only"),
    )
    sizes = family.groupBy(group).agg(F.count(F.lit(1)).alias("family_size"))
    parts = F.col("n_positive") + F.col("n_positive_outside") + F.col("n_positive_dropped")
    return counts.join(sizes, group, "left").withColumn(
        "balanced", F.col("n_family_positive") == parts
    )


def label_totals(reconciled: DataFrame) -> DataFrame:
    """Counts summed over all groups."""
    numeric = [c for c in reconciled.columns if c.startswith("n_")]
    return reconciled.agg(
        F.count(F.lit(1)).alias("n_groups"), *[F.sum(c).alias(c) for c in numeric],
        F.every("balanced").alias("balanced"),
    )


def positives_per_item(labels: DataFrame, item: str = ITEM) -> DataFrame:
    return labels.groupBy(item).agg(F.count_if(F.col(LABEL) == 1).alias("n_groups_positive"))


def popularity(
    pairs: DataFrame, labels: DataFrame, group: str = GROUP, item: str = ITEM,
    out: str = "n_other_groups_positive",
) -> DataFrame:
    """Groups other than the pair's own in which the item is positive; absent counts as 0."""
    total = positives_per_item(labels.where(F.col(LABEL) == 1), item)
    own = labels.where(F.col(LABEL) == 1).select(group, item, F.lit(1).alias("_own"))
    return (
        pairs.join(total, item, "left").join(own, [group, item], "left")
        .withColumn(out, (F.coalesce("n_groups_positive", F.lit(0))
                          - F.coalesce("_own", F.lit(0))).cast("long"))
        .drop("n_groups_positive", "_own")
    )


def recurring_items(labels: DataFrame, item: str = ITEM) -> DataFrame:
    """Items positive in more than one group."""
    return positives_per_item(labels, item).where(F.col("n_groups_positive") > 1)


def novel_only(labels: DataFrame, item: str = ITEM) -> DataFrame:
    """Positives of recurring items become 0; every row stays."""
    recurring = recurring_items(labels, item).select(item, F.lit(True).alias("_again"))
    relabel = F.when((F.col(LABEL) == 1) & F.coalesce("_again", F.lit(False)), F.lit(0))
    return labels.join(recurring, item, "left").withColumn(
        LABEL, relabel.otherwise(F.col(LABEL)).cast("byte")
    ).drop("_again")


def recurring_share(labels: DataFrame, item: str = ITEM) -> DataFrame:
    """Share of positive rows whose item is positive in more than one group."""
    per_item = positives_per_item(labels, item).where(F.col("n_groups_positive") > 0)
    again = F.sum(
        F.when(F.col("n_groups_positive") > 1, F.col("n_groups_positive")).otherwise(0)
    )
    return per_item.agg(
        F.sum("n_groups_positive").alias("n_positive"),
        again.alias("n_recurring"),
        (again / F.sum("n_groups_positive")).alias("share"),
    )


def dataset_table(labels: DataFrame, group: str = GROUP) -> DataFrame:
    """Candidates, positives, negatives and prevalence per group."""
    positive, known = F.count_if(F.col(LABEL) == 1), F.count(LABEL)
    return labels.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        positive.alias("n_positive"),
        F.count_if(F.col(LABEL) == 0).alias("n_negative"),
        (positive / F.when(known > 0, known)).alias("prevalence"),
    )


def drug_summary(
    clinical: DataFrame, family: DataFrame, names: DataFrame, drug: str = "drug_id",
    name: str = "name", group: str = GROUP, item: str = ITEM, shown: int = NAMES_SHOWN,
) -> DataFrame:
    """Distinct drugs and the first names in order, per (group, item) over the family.

    Only the first few names are ever brought together; the counts are plain
    distributed aggregates.
    """
    direct = clinical.select("group_direct", item, drug).distinct()
    pairs = direct.join(
        family.withColumnRenamed("member", "group_direct"), "group_direct"
    ).select(group, item, drug).distinct()
    counts = pairs.groupBy(group, item).agg(F.count(drug).alias(LABEL_PREFIX + "n_drugs"))
    named = pairs.join(names.select(drug, name), drug).where(F.col(name).isNotNull())
    first = top_n(
        named.select(group, item, name).distinct(), [group, item], [F.col(name).asc()], shown, "_i"
    )
    listed = first.groupBy(group, item).agg(
        F.array_join(F.array_sort(F.collect_list(name)), ", ").alias(LABEL_PREFIX + "drug_names")
    )
    return counts.join(listed, [group, item], "left").withColumn(
        LABEL_PREFIX + "drug_names",
        F.coalesce(F.col(LABEL_PREFIX + "drug_names"), F.lit("")),
    )


def descriptions(table: DataFrame, key: str, text: str) -> DataFrame:
    """One non-null description per key (the smallest, so reruns agree)."""
    return table.where(F.col(text).isNotNull()).groupBy(key).agg(F.min(text).alias(text))


def first_element(c: Column) -> Column:
    """First list element; null for an empty or null list."""
    return F.get(c, F.lit(0))
