"""Join shapes shared by the products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pad_to_universe(universe: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Exactly one row per requested key, null where nothing is known."""
    return universe.select(*keys).distinct().join(features, keys, "left")


def assemble(universe: DataFrame, parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left-join chain; parts with the same key reuse one shuffle of the left side."""
    out = universe
    for part, keys in sorted(parts, key=lambda p: len(p[1])):
        out = out.join(part, keys, "left")
    return out


def keep_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Semi join by a key table (instead of a list of values in the driver)."""
    return df.join(keys.select(*on), on, "left_semi")


def unmapped_examples(df: DataFrame, lookup: DataFrame, on: list[str], n: int = 5) -> DataFrame:
    """First n keys without a partner, in order."""
    return (
        df.select(*on).join(lookup.select(*on), on, "left_anti").distinct()
        .orderBy(*on).limit(n)
    )


def resolve_name(df: DataFrame, names: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Name of a key, or the key itself when it has none. ``names`` is unique per key."""
    return df.join(names.select(key, F.col(name).alias(out)), key, "left").withColumn(
        out, F.coalesce(F.col(out), F.col(key).cast("string"))
    )


def compare(
    left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9
) -> DataFrame:
    """Rows of two tables whose values differ by more than the tolerance."""
    other = right.select(*keys, F.col(value).alias(f"{value}_other"))
    gap = F.abs(F.col(value) - F.col(f"{value}_other"))
    return left.select(*keys, value).join(other, keys).where(gap > tolerance)


def key_overlap(left: DataFrame, right: DataFrame, key: str, minimum: int) -> DataFrame:
    """One row: distinct keys on both sides, shared keys, and whether there are enough."""
    sides = left.select(key).distinct().withColumn("_l", F.lit(1)).join(
        right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer"
    )
    shared = F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    return sides.agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), shared.alias("n_shared"),
        (shared >= minimum).alias("enough"),
    )


def partner_lookup(
    partners: DataFrame, items: DataFrame, candidates: DataFrame, groups: list[str],
    item: str, partner: str, symbol: str,
) -> DataFrame:
    """Symbol of each partner (falling back to its id) and candidacy in the row's group.

    ``partners`` holds ``groups + item + partner``; ``candidates`` holds ``groups + item``.
    """
    symbols = items.groupBy(F.col(item).alias(partner)).agg(F.min(symbol).alias("partner_symbol"))
    flags = candidates.select(*groups, F.col(item).alias(partner)).distinct().withColumn(
        "_candidate", F.lit(True)
    )
    return (
        partners.join(symbols, partner, "left").join(flags, [*groups, partner], "left")
        .withColumns({
            "partner_symbol": F.coalesce("partner_symbol", F.col(partner).cast("string")),
            "is_candidate": F.coalesce("_candidate", F.lit(False)),
        }).drop("_candidate")
    )


def union_all(*parts: DataFrame, diagonal: bool = False) -> DataFrame:
    """Union by name; ``diagonal`` fills columns a part lacks with null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=diagonal)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (an aggregate, so it combines map-side)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(c) for c in [*order, *[r for r in rest if r not in order]]]))
    return df.groupBy(*keys).agg(first.alias("_f")).select(
        *keys, *[F.col(f"_f.{c}").alias(c) for c in rest]
    )


def only_in_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).distinct().join(right, on, "left_anti")


def in_both(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).distinct().join(right, on, "left_semi")


