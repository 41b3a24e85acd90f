"""Row-wise reducers that skip nulls, and small numeric expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(c: Column) -> Column:
    """Clip to [0, 1]; null stays null (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def row_sum(cols: list[Column]) -> Column:
    """Sum of the non-null values; 0 when all are null."""
    return reduce(add, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def row_count(cols: list[Column]) -> Column:
    """Number of non-null values."""
    return reduce(add, [c.isNotNull().cast("int") for c in cols])


def row_mean(cols: list[Column]) -> Column:
    """Mean of the non-null values; null when all are null."""
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / n)


def row_max(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def saturate(n: Column, at: int | float) -> Column:
    return clip01(n.cast("double") / F.lit(float(at)))


def dcg_discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + 1.0)


def stable_uniform(seed: int, *keys: Column) -> Column:
    """Uniform [0, 1) value that depends on the seed and the keys only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def flag(c: Column) -> Column:
    """0/1 byte flag; null conditions count as 0."""
    return F.coalesce(c, F.lit(False)).cast("byte")
