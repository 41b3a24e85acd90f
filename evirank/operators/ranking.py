"""Ranking inside groups without putting a whole group into one task.

A window partitioned by the group sends every row of that group to one task. A
group may hold a third of all rows here, so full rankings use range-partitioned
prefix sums instead: rows are range-partitioned by ``(group, order)`` and sorted,
each slice keeps its row positions, and a small table (at most one row per slice
plus one per group) carries what precedes each slice. Windows are used only
where Spark cuts to the first n rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evirank.operators.skew import lookup_join
from evirank.session import cut_lineage

# spark.sql.optimizer.windowGroupLimitThreshold's default
GROUP_LIMIT = 1000
_OFFSET_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def running_totals(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    sums: dict[str, str] | None = None,
    rank: str | None = "rank",
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Exact running position and running sums inside each group.

    ``sums`` maps an output column to the numeric column summed from the first
    row of the group up to and including the current one; ``totals`` maps an
    output column to the numeric column summed over the whole group. ``order``
    must be total inside a group.
    """
    sums, totals = sums or {}, totals or {}
    by = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    placed = cut_lineage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumns({
        "_slice": F.shiftright("_at", _OFFSET_BITS),
        "_pos": F.col("_at").bitwiseAND((1 << _OFFSET_BITS) - 1),
    }).drop("_at")

    wanted = sorted({*sums.values(), *totals.values()})
    slices = placed.groupBy(*groups, "_slice").agg(
        F.min("_pos").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in wanted],
    )
    before = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    none = F.lit(0)
    offsets = slices.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_slice").alias("_s"),
        "_first",
        F.coalesce(F.sum("_rows").over(before), none).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), none).alias(f"_before_{o}")
          for o, c in sums.items()],
        *[F.sum(f"_sum_{c}").over(whole).alias(o) for o, c in totals.items()],
    )
    on = [placed["_slice"] == offsets["_s"]]
    on += [placed[g].eqNullSafe(offsets[f"_g_{g}"]) for g in groups]
    joined = placed.join(offsets, on, "inner")

    added: dict[str, Column] = {}
    if rank:
        added[rank] = (F.col("_pos") - F.col("_first") + 1 + F.col("_rows_before")).cast("long")
    if sums:
        local = (
            W.partitionBy("_slice", *groups).orderBy("_pos")
            .rowsBetween(W.unboundedPreceding, W.currentRow)
        )
        for out, c in sums.items():
            added[out] = F.col(f"_before_{out}") + F.coalesce(F.sum(c).over(local), none)
    return joined.withColumns(added).select(*df.columns, *added, *totals)


def rank_within_group(
    df: DataFrame,
    group: str | list[str],
    score: str,
    item: str,
    out: str = "rank",
    tiebreaks: list[Column] | None = None,
) -> DataFrame:
    """1..n inside each group, score descending (nulls last), then the unique item."""
    groups = [group] if isinstance(group, str) else group
    ties = tiebreaks if tiebreaks is not None else []
    return running_totals(
        df, groups, [F.col(score).desc_nulls_last(), *ties, F.col(item).asc_nulls_last()], rank=out
    )


def top_n(
    df: DataFrame, group: str | list[str], order: list[Column], n: int, out: str = "rank"
) -> DataFrame:
    """First n rows per group. Spark cuts to n per task before the shuffle.

    It does so up to a limit on n; beyond it the distributed ranking takes over.
    """
    groups = [group] if isinstance(group, str) else group
    if n > GROUP_LIMIT:
        return running_totals(df, groups, order, rank=out).where(F.col(out) <= n)
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= n)


def average_rank_share(
    df: DataFrame, value: str, out: str, spread_by: list[Column], groups: list[str] | None = None
) -> DataFrame:
    """Average-method rank divided by the non-null count, per group; null stays null.

    Ranks the distinct values with their counts, so ties cost nothing, and joins
    the shares back by value with frequent values spread.
    """
    groups = groups or []
    df = cut_lineage(df)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cum = running_totals(
        counts, groups, [F.col(value).asc()], {"_cum": "_n"}, rank=None, totals={"_all": "_n"}
    )
    mean_rank = F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0
    shares = cum.select(*groups, value, "_n", (mean_rank / F.col("_all")).alias(out))
    return lookup_join(
        df, shares.drop("_n"), [*groups, value], spread_by, shares.drop(out)
    )


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Median per key over all rows (mean of the two middle values), nulls skipped."""
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return median_of_counts(counts, keys, value, "_n", out)


def median_of_counts(
    counts: DataFrame, keys: list[str], value: str, n: str, out: str = "median"
) -> DataFrame:
    """Median per key of a table of distinct values with their counts."""
    cum = running_totals(
        counts, keys, [F.col(value).asc()], {"_cum": n}, rank=None, totals={"_all": n}
    )
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1

    def holds(position: Column) -> Column:
        return (position > F.col("_cum") - F.col(n)) & (position <= F.col("_cum"))

    middle = cum.where(holds(low) | holds(high))
    pair = (
        F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))
    ) / 2.0
    return middle.groupBy(*keys).agg(pair.alias(out)) if keys else middle.agg(pair.alias(out))


def rank_filter_limit(
    ranked: DataFrame, predicates: list[Column], n: int | None, group: str, rank: str = "rank"
) -> DataFrame:
    """Filter rows that already carry their rank, then keep the first n per group."""
    kept = ranked
    for p in predicates:
        kept = kept.where(p)
    if n is None:
        return kept
    return top_n(kept, group, [F.col(rank).asc()], n, "_keep").drop("_keep")


def rank_movement(
    base: DataFrame, other: DataFrame, keys: list[str], n: int | None = None,
    group: str | None = None,
) -> DataFrame:
    """Signed movement ``rank - other rank``: a fall is negative.

    Rows missing from the other ranking keep a null movement. With ``n`` only
    the first n of the base ranking are kept.
    """
    head = base if n is None else base.where(F.col("rank") <= n)
    right = other.select(*keys, F.col("rank").alias("rank_other"))
    return head.join(right, keys, "left").withColumn(
        "movement", F.col("rank").cast("long") - F.col("rank_other").cast("long")
    )


def ranks_of(ranked: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """Ranks of a named set; names that are absent keep a null rank."""
    return names.join(ranked.select(*on, "rank"), on, "left")


def best_and_worst(df: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    """The n best and n worst rows by a metric (nulls skipped), each with its place."""
    known = df.where(F.col(metric).isNotNull())
    best = known.orderBy(F.col(metric).desc(), F.col(key)).limit(n).withColumn("side", F.lit("best"))
    worst = known.orderBy(F.col(metric).asc(), F.col(key)).limit(n).withColumn("side", F.lit("worst"))
    w_best = W.partitionBy("side").orderBy(F.col(metric).desc(), F.col(key))
    w_worst = W.partitionBy("side").orderBy(F.col(metric).asc(), F.col(key))
    return best.withColumn("place", F.row_number().over(w_best).cast("long")).unionByName(
        worst.withColumn("place", F.row_number().over(w_worst).cast("long"))
    )
