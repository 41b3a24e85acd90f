"""Measurement matrices in long form: profiles, specificity, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evirank.columns import EXPRESSION_PREFIX, ITEM, dim, missing
from evirank.functions.text import QUERY_STOPWORDS, tokens
from evirank.operators.ranking import average_rank_share

# Detection is strictly above this in features, at or above it in filters.
DETECTION_LEVEL = 1.0
MAX = EXPRESSION_PREFIX + "max_tpm"
MEDIAN = EXPRESSION_PREFIX + "median_tpm"
DETECTED = EXPRESSION_PREFIX + "n_tissues_detected"
SPECIFICITY = EXPRESSION_PREFIX + "tissue_specificity"
RELEVANT = EXPRESSION_PREFIX + "relevant_tissue_tpm"


def _one_row_per_column(long: DataFrame, item: str, variable: str, value: str, unique: bool = False) -> DataFrame:
    """Max per cell: makes the cell unique and pre-aggregates before the item shuffle, unless it is ``unique`` already."""
    if unique:
        return long.select(item, variable, value)
    return long.groupBy(item, variable).agg(F.max(value).alias(value))


def matrix_profile(
    long: DataFrame, item: str = ITEM, variable: str = "tissue", value: str = "tpm",
    detection: float = DETECTION_LEVEL, n_columns: int | None = None, unique_cells: bool = False,
) -> DataFrame:
    """Max, median, number detected and mean per item; with ``n_columns`` also Tau.

    The median is the mean of the middle places of a matrix row, found by one window over its columns.
    """
    tau = [] if n_columns is None else [_tau(value, n_columns).alias(SPECIFICITY)]
    row = W.partitionBy(item).orderBy(F.col(value).asc_nulls_last())
    whole = row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = _one_row_per_column(long, item, variable, value, unique_cells).select(
        item, value, F.count(value).over(whole).alias("_n"), F.row_number().over(row).alias("_at"),
    )
    middle = F.col("_at").between(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    return placed.groupBy(item).agg(
        F.max(value).alias(MAX),
        F.avg(F.when(middle, F.col(value))).alias(MEDIAN),
        F.count_if(F.col(value) > detection).alias(DETECTED),
        F.avg(value).alias(EXPRESSION_PREFIX + "mean_tpm"),
        *tau,
    )


def _tau(value: str, n_columns: int) -> Column:
    if n_columns < 2:
        raise ValueError("specificity needs at least two columns")
    raw = (F.lit(float(n_columns)) - F.sum(value) / F.max(value)) / F.lit(float(n_columns - 1))
    return F.when(F.max(value) > 0, raw)


def tissue_specificity(
    long: DataFrame, n_columns: int, item: str = ITEM, variable: str = "tissue",
    value: str = "tpm",
) -> DataFrame:
    """Tau over ``n_columns`` columns: ``sum(1 - x/max) / (n - 1)``.

    A null or absent cell counts as 0. Because the max is constant per item,
    the sum is ``n - sum(x)/max`` and one aggregation is enough. Null when the
    max is not positive.
    """
    return _one_row_per_column(long, item, variable, value).groupBy(item).agg(
        _tau(value, n_columns).alias(SPECIFICITY)
    )


def match_columns(
    queries: DataFrame, columns: DataFrame, query: str = "query", column: str = "tissue",
    keys: list[str] | None = None,
) -> DataFrame:
    """Token-set containment: a column matches when it has every query token.

    Each query meets only the columns that have its rarest token (an equi-join);
    the other tokens are then checked on the row. Queries without a match keep
    one row with a null column.
    """
    keys = keys or []
    q = queries.select(*keys, query).distinct().withColumn(
        "_asked", tokens(F.col(query), QUERY_STOPWORDS)
    )
    has = columns.select(column).distinct().withColumn("_has", tokens(F.col(column)))
    index = has.select(column, "_has", F.explode("_has").alias("_token"))
    seen = index.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        q.select(*keys, query, "_asked", F.explode("_asked").alias("_token"))
        .join(seen, "_token", "left")
        .groupBy(*keys, query, "_asked")
        # a token no column has sorts first and finds nothing
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), F.col("_token").alias("_token")))
             .alias("_rare"))
        .select(*keys, query, "_asked", F.col("_rare._token").alias("_token"))
    )
    hits = (
        rarest.join(index, "_token")
        .where(F.size(F.array_except("_asked", "_has")) == 0)
        .select(*keys, query, column)
    )
    return q.select(*keys, query).join(hits, [*keys, query], "left")


def population_percentile(
    long: DataFrame, matched: DataFrame, keys: list[str], item: str = ITEM,
    variable: str = "tissue", value: str = "tpm", unique_cells: bool = False,
) -> DataFrame:
    """Mean over each key's matched columns, ranked against the whole population.

    ``matched`` holds ``keys + variable``. The ranking covers every item of the
    matrix, never a candidate list, so the result does not depend on who is asked for.
    """
    cols = matched.where(F.col(variable).isNotNull()).select(*keys, variable).distinct()
    cells = _one_row_per_column(long, item, variable, value, unique_cells)
    # rounded, so that ties do not depend on the order of summation
    relevant = cells.join(cols, variable).groupBy(*keys, item).agg(
        F.round(F.avg(value), 10).alias(RELEVANT)
    )
    # half of a matrix can share one value (0): that value's rows are spread
    return average_rank_share(relevant, RELEVANT, dim("expression"), [F.col(item)], keys)


def add_expression_features(
    df: DataFrame, long: DataFrame, matched: DataFrame, n_columns: int,
    keys: list[str], item: str = ITEM, variable: str = "tissue", value: str = "tpm",
    unique_cells: bool = False,
) -> DataFrame:
    """Append profile, specificity, percentile and missing flag by ``keys + item``."""
    profile = matrix_profile(long, item, variable, value, n_columns=n_columns, unique_cells=unique_cells)
    pct = population_percentile(long, matched, keys, item, variable, value, unique_cells)
    return (
        df.join(profile, item, "left").join(pct, [*keys, item], "left")
        .withColumn(missing("expression"), F.col(MAX).isNull().cast("byte"))
    )


def expression_features(
    universe: DataFrame, long: DataFrame, matched: DataFrame, n_columns: int,
    keys: list[str], item: str = ITEM, variable: str = "tissue", value: str = "tpm",
) -> DataFrame:
    """The expression features of the requested ``keys + item``, one row each."""
    asked = universe.select(*keys, item).distinct()
    return add_expression_features(asked, long, matched, n_columns, keys, item, variable, value)


def item_tissue_detail(
    universe: DataFrame, long: DataFrame, item: str = ITEM, variable: str = "tissue",
    value: str = "tpm",
) -> DataFrame:
    """Long detail for the requested items, single precision. Sorting is left to the writer."""
    kept = long.join(universe.select(item).distinct(), item, "left_semi")
    return kept.select(item, variable, F.col(value).cast("float").alias("median_tpm"))
