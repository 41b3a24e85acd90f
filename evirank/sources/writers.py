"""Writers: data as parquet, what happened as JSON next to it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a ranking export.
EXPORT_COLUMNS = (
    "rank", "symbol", "item_id", "item_name", "score", "sort_by", "weighted_score",
    "held_out_score", "genetics", "evidence_diversity", "functional", "literature",
    "druggability", "completeness_count", "completeness_total", "n_other_groups_positive",
)


def write_table(df: DataFrame, path: str, provenance: dict | None = None) -> None:
    """Parquet table and, if given, its one-row provenance record beside it."""
    df.write.mode("overwrite").parquet(path)
    if provenance is not None:
        write_record(df.sparkSession, provenance, path.rstrip("/") + ".provenance")


def write_sorted(df: DataFrame, path: str, key: str, then: list | None = None) -> None:
    """zstd parquet clustered and sorted by a key, so that point lookups prune row groups.

    Rows are ranged by the key and the further order together: a key that holds
    many rows spans several files instead of one.
    """
    order = [F.col(key).asc(), *(then or [])]
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("compression", "zstd").parquet(path)
    )


def write_record(spark: SparkSession, record: dict, path: str, mode: str = "overwrite") -> None:
    """One JSON record (provenance, run metadata); nested values become JSON text."""
    row = {
        k: json.dumps(v, sort_keys=True) if isinstance(v, dict | list | tuple) else v
        for k, v in record.items()
    }
    spark.createDataFrame([row]).coalesce(1).write.mode(mode).json(path)


def append_log(spark: SparkSession, record: dict, path: str) -> None:
    """Append-only JSON-lines log."""
    write_record(spark, record, path, mode="append")


def write_metrics(long_metrics: DataFrame, path: str) -> None:
    """Metrics in long form as JSON lines."""
    long_metrics.write.mode("overwrite").json(path)


def export_ranking(shown: DataFrame, n_total: int, path: str) -> int:
    """CSV of the shown rows with how many of how many they are; returns the row count."""
    n_shown = shown.count()
    columns = [c for c in EXPORT_COLUMNS if c in shown.columns]
    (
        shown.select(*columns).withColumns(
            {"n_exported": F.lit(n_shown), "n_total": F.lit(n_total)}
        )
        .orderBy("rank").write.mode("overwrite").option("header", True).option("escape", '"')
        .csv(f"{path.rstrip('/')}_{n_shown}_of_{n_total}")
    )
    return n_shown
