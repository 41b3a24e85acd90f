"""Ranking products, evidence cards, evidence detail, overviews and figure data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.columns import (
    DISPLAY_COMPLETENESS,
    FLAG_PREFIX,
    GROUP,
    ITEM,
    WEIGHTED_SCORE,
    contrib,
    dim,
    missing,
    source_count,
    source_score,
)
from evirank.functions.text import search_url
from evirank.operators.hierarchy import root_groups
from evirank.operators.joins import partner_lookup
from evirank.operators.quality import assert_no_leakage, product_contract
from evirank.operators.ranking import rank_filter_limit, rank_movement, ranks_of, top_n
from evirank.operators.scoring import (
    DEFAULT_WEIGHTS,
    DISPLAY_CATEGORIES,
    SAFETY_LIABILITY,
    RankingFilters,
    ablate,
    display_completeness,
    rank_scored,
    select_features,
    top_contributors,
    weighted_score,
)

LINK_BASE = "https://platform.example.org"
SEARCH_BASE = "https://search.example.org/?query="
SORT_KEYS = {"weighted_baseline": WEIGHTED_SCORE, "held_out": "held_out_score"}

def source_links(item: Column, group: Column, base: str = LINK_BASE) -> Column:
    """Three links per pair: the item, the group, and their evidence."""
    item, group = item.cast("string"), group.cast("string")
    return F.create_map(
        F.lit("item"), F.concat(F.lit(f"{base}/item/"), item),
        F.lit("group"), F.concat(F.lit(f"{base}/group/"), group),
        F.lit("evidence"), F.concat(F.lit(f"{base}/evidence/"), item, F.lit("/"), group),
    )


def rank_groups(
    features: DataFrame, display: DataFrame | None = None, weights: dict[str, float] | None = None,
    filters: RankingFilters | None = None, n: int | None = 50, sort_by: str = "weighted_baseline",
    group_value: object | None = None, group: str = GROUP, item: str = ITEM,
) -> DataFrame:
    """The ranked product of one group, or of all of them.

    Score on feature columns only, then join display columns, rank over every
    candidate, and only then filter and cut: ranks keep their gaps.
    """
    if sort_by not in SORT_KEYS:
        raise ValueError(f"unknown sort {sort_by!r}; expected one of {sorted(SORT_KEYS)}")
    predicates = (filters or RankingFilters()).predicates()
    weights = DEFAULT_WEIGHTS if weights is None else weights
    if group_value is not None:
        features = features.where(F.col(group) == F.lit(group_value))
        if features.isEmpty():
            raise KeyError(f"no features for {group_value!r}")
    scored = display_completeness(weighted_score(features, weights))
    if display is not None:
        scored = scored.join(display, [group, item], "left")
    for column in ("held_out_score", "n_other_groups_positive", "symbol", "item_name"):
        if column not in scored.columns:
            scored = scored.withColumn(column, F.lit(None))
    needed = {
        group, item, "symbol", "item_name", WEIGHTED_SCORE, "held_out_score",
        DISPLAY_COMPLETENESS, "missing_evidence", "n_other_groups_positive",
        *[dim(d) for d in weights], dim("genetics"), "expr__relevant_tissue_tpm",
        FLAG_PREFIX + "has_small_molecule_binder", FLAG_PREFIX + "has_safety_event",
    }
    narrow = scored.select(*[c for c in scored.columns if c in needed])
    ranked = rank_scored(narrow, group=group, item=item, score=SORT_KEYS[sort_by])
    kept = rank_filter_limit(ranked, predicates, n, group)
    values = [x for d in weights for x in (F.lit(d), F.col(dim(d)))]
    product = kept.select(
        group, item, "rank", "symbol", "item_name", F.col(SORT_KEYS[sort_by]).alias("score"),
        F.col(WEIGHTED_SCORE).alias("weighted_score"), "held_out_score",
        F.create_map(*values).alias("evidence"), DISPLAY_COMPLETENESS, "missing_evidence",
        "n_other_groups_positive", source_links(F.col(item), F.col(group)).alias("source_links"),
    )
    product_contract(product)
    return product


def evidence_cards(
    features: DataFrame, weights: dict[str, float] | None = None, factors: DataFrame | None = None,
    top: int = 5, group: str = GROUP, item: str = ITEM, limitations: tuple[str, ...] = (),
) -> DataFrame:
    """One card per pair: what supports it, what speaks against it, what is missing.

    ``factors`` holds ``top_positive_factors`` and ``top_negative_factors`` per
    pair from the model that did not see the group; ``limitations`` are the
    caller's standing remarks, repeated on every card.
    """
    weights = DEFAULT_WEIGHTS if weights is None else weights
    scored = display_completeness(weighted_score(features, weights))

    def entry(category: Column, value: Column, source: str) -> Column:
        return F.struct(category.alias("category"), value.cast("double").alias("value"),
                        F.lit(source).alias("source"))

    own = F.transform(
        F.filter(top_contributors(list(weights), top), lambda e: e["contribution"] > 0),
        lambda e: entry(F.concat(F.lit("weighted_baseline__"), e["dimension"]),
                        e["contribution"], "weighted_baseline"),
    )
    liability = F.coalesce(F.col(FLAG_PREFIX + "has_safety_event") == SAFETY_LIABILITY, F.lit(False))
    none = F.filter(own, lambda e: F.lit(False))
    unsafe = F.when(
        liability, F.array(entry(F.lit("safety_event"), F.lit(float(SAFETY_LIABILITY)), "item_flags"))
    ).otherwise(none)
    supporting, contradicting = own, unsafe
    if factors is not None:
        scored = scored.join(factors, [group, item], "left")

        def held_out(column: str) -> Column:
            return F.coalesce(F.transform(
                F.col(column),
                lambda f: entry(F.concat(F.lit("held_out__"), f["feature"]), f["contribution"],
                                "held_out"),
            ), none)

        supporting = F.concat(own, held_out("top_positive_factors"))
        contradicting = F.concat(held_out("top_negative_factors"), unsafe)
    return scored.select(
        group, item, *[c for c in ("symbol",) if c in scored.columns],
        F.col(WEIGHTED_SCORE).alias("score"), supporting.alias("supporting"),
        contradicting.alias("contradicting"), F.col("missing_evidence").alias("missing"),
        F.array(*[F.lit(x) for x in limitations]).cast("array<string>").alias("limitations"),
        source_links(F.col(item), F.col(group)).alias("source_links"),
    )


def pair_explanations(
    explained: DataFrame, limitations: tuple[str, ...] = (), group: str = GROUP, item: str = ITEM
) -> DataFrame:
    """Explained pairs of any model with their three links and the caller's standing remarks."""
    return explained.withColumns({
        "source_links": source_links(F.col(item), F.col(group)),
        "limitations": F.array(*[F.lit(x) for x in limitations]).cast("array<string>"),
    })


@dataclass(frozen=True)
class EvidenceDetail:
    """The detail tables of the asked pairs; each is long, so nothing grows per row."""

    pathways: DataFrame
    tissues: DataFrame
    partners: DataFrame
    literature: DataFrame


def evidence_detail(
    pairs: DataFrame, features: DataFrame, pathways: DataFrame, tissues: DataFrame,
    partners: DataFrame, matched: DataFrame, literature_source: str, group_name: str = GROUP,
    group: str = GROUP, item: str = ITEM,
) -> EvidenceDetail:
    """Pathway groups, tissues with relevance, partners with candidacy, literature summary.

    ``pairs`` holds the asked ``group + item``; the detail tables are keyed by item.
    """
    asked = pairs.select(group, item).distinct()
    items = asked.select(item).distinct()
    mine = pathways.join(items, item, "left_semi")
    sized = mine.join(root_groups(mine, item), [item, "root_id", "root_name"])
    relevant = matched.where(F.col("tissue").isNotNull()).select(group, "tissue").distinct()
    flagged = (
        asked.join(tissues, item)
        .join(relevant.withColumn("_r", F.lit(True)), [group, "tissue"], "left")
        .withColumn("is_relevant", F.coalesce("_r", F.lit(False))).drop("_r")
    )
    linked = partner_lookup(
        asked.join(partners, item), features.select(item, "symbol"), features, [group], item,
        "partner_id", "symbol",
    )
    score, count = source_score(literature_source), source_count(literature_source)
    summary = features.join(asked, [group, item], "left_semi").select(
        group, item, F.col(score).alias("literature_score"), F.col(count).alias("literature_count"),
        search_url(SEARCH_BASE, F.col("symbol"), F.col(group_name)).alias("search_url"),
    )
    return EvidenceDetail(sized, flagged, linked, summary)


def group_overview(features: DataFrame, names: DataFrame | None = None, group: str = GROUP
                   ) -> DataFrame:
    """One row per group: items, categories with any evidence, version and date stamps."""
    built = [c for c in DISPLAY_CATEGORIES if missing(c) in features.columns]
    stamps = [c for c in ("dataset_version", "extraction_date") if c in features.columns]
    known = {c: F.count_if(F.col(missing(c)) == 0).alias(f"n_{c}") for c in built}
    out = features.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_items"), *known.values(), *[F.max(c).alias(c) for c in stamps]
    ).withColumns({
        "categories_built": F.lit(len(built)), "categories_total": F.lit(len(DISPLAY_CATEGORIES)),
    })
    return out if names is None else out.join(names, group, "left")


@dataclass(frozen=True)
class TransparentRun:
    """Ranking, ranking without one dimension, movement between them, and known items."""

    ranked: DataFrame
    ranked_without: DataFrame
    movement: DataFrame
    known: DataFrame
    acceptance: DataFrame


def transparent_run(
    features: DataFrame, known_items: DataFrame, drop: str = "literature", n: int = 20,
    weights: dict[str, float] | None = None, group: str = GROUP, item: str = ITEM,
    symbol: str = "symbol",
) -> TransparentRun:
    """Score, rank, ablate, compare, and see where the known items (``group + item``) land."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    assert_no_leakage(select_features(features), check_stale=False)
    keep = [group, item, symbol, WEIGHTED_SCORE, *[contrib(d) for d in weights]]
    rest = [group, item, symbol, WEIGHTED_SCORE]
    ranked = rank_scored(weighted_score(features, weights).select(*keep), symbol=symbol)
    without = rank_scored(ablate(features, [drop], weights).select(*rest), symbol=symbol)
    keys = [group, item]
    both = ranks_of(ranked, known_items, keys).join(
        without.select(*keys, F.col("rank").alias("rank_without")), keys, "left"
    )
    reached = F.coalesce(F.col("rank") <= n, F.lit(False))
    survived = F.coalesce(F.col("rank_without") <= n, F.lit(False))
    acceptance = both.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_known"), F.count_if(reached).alias("n_reached"),
        F.count_if(survived).alias("n_reached_without"), F.every(reached).alias("passed"),
    )
    movement = rank_movement(ranked.select(*keys, symbol, "rank"), without, keys, n)
    return TransparentRun(ranked, without, movement, both, acceptance)


def contribution_bars(ranked: DataFrame, weights: dict[str, float], n: int = 20, group: str = GROUP,
                      item: str = ITEM) -> DataFrame:
    """Long contributions of the first n items of each group (stacked bars)."""
    top = top_n(ranked, group, [F.col("rank").asc()], n, "_k").drop("_k")
    names = [contrib(d) for d in weights]
    return top.select(
        group, item, F.coalesce("symbol", F.lit("(unnamed)")).alias("symbol"), "rank", *names
    ).unpivot([group, item, "symbol", "rank"], names, "dimension", "contribution")


def method_bars(primary: DataFrame, novel: DataFrame, metric: str, method: str = "method"
                ) -> DataFrame:
    """Primary and novel-only value per method (undefined counts as 0), best first by ``place``."""
    from pyspark.sql import Window as W

    both = primary.select(method, F.coalesce(metric, F.lit(0.0)).alias("primary")).join(
        novel.select(method, F.coalesce(metric, F.lit(0.0)).alias("novel_only")), method, "left"
    )
    # one row per method
    w = W.partitionBy(F.lit(1)).orderBy(F.col("primary").desc(), F.col(method))
    return both.withColumn("place", F.row_number().over(w).cast("long"))


def radar_values(features: DataFrame, dimensions: list[str], group: str = GROUP, item: str = ITEM
                 ) -> DataFrame:
    """Long dimension values per pair, missing drawn as 0."""
    filled = features.select(
        group, item, *[F.coalesce(dim(d), F.lit(0.0)).alias(d) for d in dimensions]
    )
    return filled.unpivot([group, item], dimensions, "dimension", "value")


def biggest_falls(movement: DataFrame, n: int = 6, group: str = GROUP, item: str = ITEM
                  ) -> DataFrame:
    """The n largest falls per group."""
    moved = movement.where(F.col("movement").isNotNull())
    return top_n(moved, group, [F.col("movement").asc(), F.col(item).asc()], n, "place")
