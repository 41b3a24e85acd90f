"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from evirank.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read again: cuts the lineage like a checkpoint, compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
