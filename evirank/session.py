"""Session helpers: a local session for tests, and lineage cutting."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


ROWS_PER_TASK = 500_000
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _FREEING = Lock(), {"now": 0}


def local_session(cores: int = 8, app_name: str = "evirank") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for checkpoints: the one the cluster names, else (local mode only) a new one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if named:
        context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries begun here leave no shuffle files, unless the session has its own setting; threads may overlap."""
    with _LOCK:
        ours = _FREEING["now"] > 0 or spark.conf.get(_FREED, None) is None
        if ours:
            _FREEING["now"] += 1
            spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        with _LOCK:
            if ours:
                _FREEING["now"] -= 1
                if not _FREEING["now"]:
                    spark.conf.unset(_FREED)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint: survives lost executors and ends the plan here; its shuffle files go."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, but compressed: Parquet in the folder all executors share. Rows keep no order."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as ``rows`` need, so that a task's memory does not grow with them.

    Small tables keep the session's number of partitions, which adaptive execution merges.
    """
    n = math.ceil(rows / ROWS_PER_TASK)
    if n <= df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df.repartition(n, *keys)


def together(*calls: Callable[[], Any]) -> list:
    """The results of calls that run Spark jobs, side by side: jobs of a few long tasks leave cores to others."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(c)) for c in calls]]
