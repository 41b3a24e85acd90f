"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above total/MAX_HOT_KEYS rows, so there are at most that many hot
# keys and the hot-key table may be broadcast whatever the data size.
MAX_HOT_KEYS = 1000
MIN_HOT_ROWS = 1_000_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, min_rows: int = MIN_HOT_ROWS
             ) -> DataFrame:
    """``keys, _copies`` for the keys that carry too many rows for one task."""
    cut = counts.agg(
        F.greatest(F.lit(float(min_rows)), F.sum(n) / F.lit(float(MAX_HOT_KEYS)))
    ).scalar()
    return counts.where(F.col(n) > cut).select(
        *keys, F.ceil(F.col(n) / cut).cast("int").alias("_copies")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[Column],
    counts: DataFrame,
    n: str = "_n",
    how: str = "left",
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to a ``right`` side with few rows per key, hot keys spread.

    For callers that know the rows per key of ``left`` already (``counts``,
    column ``n``): rows of a hot key go to several tasks by a hash of
    ``spread_by``, and the matching rows of ``right`` are repeated for each of
    them. A join without such counts is left to adaptive execution, which splits
    skewed partitions of a shuffled join without another pass over the data.
    """
    hot = F.broadcast(hot_keys(counts, keys, n, min_rows))
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), copies).cast("int")
    ).drop("_copies")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), copies - 1))
    ).drop("_copies")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
