"""Long evidence tables: candidates, leakage rules, dimensions and pivots."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.columns import (
    COUNT,
    DIVERSITY_PREFIX,
    GROUP,
    ITEM,
    OVERALL_PREFIX,
    SCORE,
    SOURCE,
    dim,
    missing,
    source_count,
    source_score,
)
from evirank.functions.numeric import flag, row_count, row_mean, saturate
from evirank.operators.ranking import exact_median

DIVERSITY_SATURATION = 4


@dataclass(frozen=True)
class DenyRule:
    """A column-name glob that must not reach a model.

    A *required* rule has to match something the sources could produce, else it
    is stale.
    """

    name: str
    match: str
    required: bool = False
    reason: str = ""


class LeakageError(RuntimeError):
    """A forbidden column reached a feature table, or a required rule is stale."""


# The default column-name rules.
DEFAULT_RULES = (
    DenyRule("clinical_source", "assoc_ds__clinical_precedence*", True, "the source is the label"),
    DenyRule("clinical_source_legacy", "assoc_ds__chembl*", False, "older name of the source"),
    DenyRule("overall_score", "assoc_overall__*", False, "aggregates the clinical source"),
    DenyRule("flag_clinical_stage", "prio__max_clinical_stage", True, "computed from the stage"),
    DenyRule("known_drug", "*known_drug*", False, "known-drug aggregates"),
    DenyRule("label", "label*", False, "the label itself"),
    DenyRule("clinical_stage", "*clinical_stage*", False, "any stage column"),
)


def violations(columns: list[str], rules: tuple[DenyRule, ...] = DEFAULT_RULES) -> dict[str, str]:
    """Forbidden column -> name of the first rule that matches it."""
    found: dict[str, str] = {}
    for column in columns:
        for rule in rules:
            if fnmatchcase(column, rule.match):
                found[column] = rule.name
                break
    return found


def stale_rules(columns: list[str], rules: tuple[DenyRule, ...] = DEFAULT_RULES) -> list[str]:
    """Required rules that match none of the columns."""
    return [
        r.name for r in rules
        if r.required and not any(fnmatchcase(c, r.match) for c in columns)
    ]


def glob_to_regex(glob: str) -> str:
    """Regex for a glob with ``*``, ``?`` and ``[...]`` or ``[!...]`` classes, usable in ``rlike``.

    A bracket without an end stands for itself, as in ``fnmatchcase``.
    """
    out, rest = [], glob
    while rest:
        found = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if found:
            inner = re.sub(r"([\\\[\]^&~|])", r"\\\1", found[2])
            out.append(f"[{'^' if found[1] else ''}{inner}]")
            rest = rest[found.end():]
        else:
            out.append({"*": ".*", "?": "."}.get(rest[0]) or re.escape(rest[0]))
            rest = rest[1:]
    return rf"(?s)^(?:{''.join(out)})(?!.)"


def is_denied_source(source: Column, rules: tuple[DenyRule, ...] = DEFAULT_RULES) -> Column:
    """True when the column this source would become is forbidden."""
    name = F.concat(F.lit(source_score("")[: -len("_score")]), source, F.lit("_score"))
    return F.coalesce(
        name.rlike("|".join(glob_to_regex(r.match) for r in rules)) if rules else F.lit(False),
        F.lit(False),
    )


def drop_denied_sources(
    evidence: DataFrame, rules: tuple[DenyRule, ...] = DEFAULT_RULES, source: str = SOURCE
) -> DataFrame:
    """Rows whose derived column name no rule forbids. Apply before any pivot."""
    return evidence.where(~is_denied_source(F.col(source), rules))


def denied_sources(
    evidence: DataFrame, rules: tuple[DenyRule, ...] = DEFAULT_RULES, source: str = SOURCE,
    item: str = ITEM,
) -> DataFrame:
    """What the rules drop: rows and items per forbidden source."""
    return (
        evidence.where(is_denied_source(F.col(source), rules))
        .groupBy(source)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(item).alias("n_items"))
    )


def candidates(
    associations: DataFrame, group_value: str | None, columns: dict[str, str], group: str
) -> DataFrame:
    """Project and rename, for one group or (``None``) for all of them."""
    kept = associations if group_value is None else associations.where(
        F.col(group) == F.lit(group_value)
    )
    return kept.select(*[F.col(old).alias(new) for old, new in columns.items()])


def overall_scores(
    associations: DataFrame, group_value: str | None, kind: str = "overall",
    group: str = GROUP, item: str = ITEM, score: str = SCORE, kind_col: str = "aggregation_type",
) -> DataFrame:
    """Overall association score per pair (one aggregation kind of the table)."""
    kept = associations.where(F.col(kind_col) == F.lit(kind))
    if group_value is not None:
        kept = kept.where(F.col(group) == F.lit(group_value))
    return kept.select(group, item, F.col(score).alias(f"{OVERALL_PREFIX}score"))


def dimension_scores(
    evidence: DataFrame, dimensions: dict[str, list[str]], keys: list[str] | None = None,
    source: str = SOURCE, score: str = SCORE,
) -> DataFrame:
    """Max score within each dimension plus a missing flag, in one aggregation.

    Every dimension column exists even when none of its sources occurs.
    """
    keys = keys or [GROUP, ITEM]
    best = [
        F.max(F.when(F.col(source).isin(list(sources)), F.col(score))).alias(dim(name))
        for name, sources in dimensions.items()
    ]
    scored = evidence.groupBy(*keys).agg(*best)
    return scored.withColumns(
        {missing(name): F.col(dim(name)).isNull().cast("byte") for name in dimensions}
    )


def genetics_features(
    evidence: DataFrame, dimensions: dict[str, list[str]], keys: list[str] | None = None
) -> DataFrame:
    """Only the genetics dimension and its flag."""
    return dimension_scores(evidence, {"genetics": dimensions["genetics"]}, keys)


def evidence_diversity(
    evidence: DataFrame, keys: list[str] | None = None, saturation: int = DIVERSITY_SATURATION,
    source: str = SOURCE,
) -> DataFrame:
    """Distinct sources per key and their saturating share."""
    keys = keys or [GROUP, ITEM]
    return (
        evidence.groupBy(*keys)
        .agg(F.countDistinct(source).alias("n_evidence_types"))
        .withColumn(dim("evidence_diversity"), saturate(F.col("n_evidence_types"), saturation))
    )


def source_values(evidence: DataFrame, source: str = SOURCE) -> list[str]:
    """Distinct source names: schema-sized metadata for an explicit pivot."""
    return sorted(r[0] for r in evidence.select(source).distinct().collect() if r[0] is not None)


def pivot_evidence(
    evidence: DataFrame, sources: list[str], keys: list[str] | None = None,
    source: str = SOURCE, score: str = SCORE, count: str = COUNT,
) -> DataFrame:
    """Long to wide: max score and summed count per source; absent stays null."""
    keys = keys or [GROUP, ITEM]
    at = {s: F.col(source) == F.lit(s) for s in sources}
    return evidence.groupBy(*keys).agg(
        *[F.max(F.when(at[s], F.col(score))).alias(source_score(s)) for s in sources],
        *[F.sum(F.when(at[s], F.col(count))).alias(source_count(s)) for s in sources],
    )


def unpivot(
    wide: DataFrame, ids: list[str], values: list[str], variable: str, value: str
) -> DataFrame:
    """Wide to long."""
    return wide.unpivot(ids, values, variable, value)


def cooccurrence_flags(features: DataFrame) -> DataFrame:
    """Genetics together with pathway / expression evidence; never null."""
    has_genetics = F.col(dim("genetics")).isNotNull()
    return features.withColumns({
        f"{DIVERSITY_PREFIX}genetics_and_{other}": flag(
            has_genetics & (F.col(missing(f"{column}")) == 0)
        )
        for other, column in (("pathway", "pathways"), ("expression", "expression"))
    })


def flag_mean(
    flags: DataFrame, columns: list[str], out: str = dim("druggability")
) -> DataFrame:
    """Mean of binary flags, nulls skipped; null when every flag is null."""
    return flags.withColumn(out, row_mean([F.col(c) for c in columns])).withColumn(
        missing(out.removeprefix(dim(""))), F.col(out).isNull().cast("byte")
    )


def nonnull_count(flags: DataFrame, columns: list[str], out: str = "safety__n_flags") -> DataFrame:
    """Number of flags that are known at all."""
    return flags.withColumn(out, row_count([F.col(c) for c in columns]))


def score_summary(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, min, median and max of a column, in one row."""
    basic = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("stddev"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    # two one-row tables
    middle = exact_median(df, [], value).withColumn("_one", F.lit(1))
    return basic.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one", "left").drop("_one")


def column_summaries(df: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`score_summary` of several columns: one row per column, one pass and one exact median.

    A column without values keeps its row: n is 0, the rest null.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("stddev"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basic.join(exact_median(long, ["column"], "value"), "column", "left")


def evidence_histogram(df: DataFrame, n: str = "n_evidence_types") -> DataFrame:
    """Number of rows per distinct count value."""
    return df.groupBy(n).agg(F.count(F.lit(1)).alias("n_rows"))


def single_dimension_share(
    df: DataFrame, dimension: str, n: str = "n_evidence_types", group: str | None = None
) -> DataFrame:
    """Share of rows whose only evidence is one dimension."""
    only = (F.col(n) == 1) & F.col(dim(dimension)).isNotNull()
    aggs = [
        F.count_if(only).alias("n_only"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_if(only) / F.count(F.lit(1))).alias("share"),
    ]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)
