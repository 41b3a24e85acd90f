"""File integrity: sizes and checksums against a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 << 20
MANIFEST_SCHEMA = (
    "path STRING, bytes LONG, sha256 STRING, sha1 STRING, source STRING, dataset STRING, "
    "url STRING, release STRING, license STRING, version_pinned BOOLEAN"
)


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream each file through both digests; a file never sits in memory."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            system, inner = fs.FileSystem.from_uri(path)
            strong, weak = hashlib.sha256(), hashlib.sha1()
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK):
                    strong.update(chunk)
                    weak.update(chunk)
            rows.append((path, strong.hexdigest(), weak.hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "sha256", "sha1"])


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, bytes`` of the files under a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    path = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select(path.alias("path"), F.col("length").alias("bytes"))


def checksums(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, sha256, sha1``: one task per file at most."""
    files = list_files(spark, root, pattern)
    hashed = files.select("path").repartition("path").mapInPandas(
        _hash_files, "path STRING, sha256 STRING, sha1 STRING"
    )
    return files.join(hashed, "path")


def build_manifest(files: DataFrame, **facts: object) -> DataFrame:
    """Manifest rows: checksums plus constant facts (source, release, license, pinned)."""
    return files.withColumns({k: F.lit(v) for k, v in facts.items()})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows from JSON; unknown keys are ignored."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def verify(files: DataFrame, manifest: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """One row per file on disk or in the manifest with its verdict; no manifest row fails."""
    on_disk = files.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"),
                           F.col("sha1").alias("_sha1"))
    joined = manifest.select("path", "bytes", "sha256").join(on_disk, "path", "full_outer")
    if upstream is not None:
        joined = joined.join(upstream.select("path", F.col("sha1").alias("_want")), "path", "left")
    else:
        joined = joined.withColumn("_want", F.lit(None).cast("string"))
    detail = (
        F.when(F.col("_bytes").isNull(), "file missing")
        .when(F.col("sha256").isNull(), "no manifest")
        .when(F.col("bytes") != F.col("_bytes"), "size mismatch")
        .when(F.col("sha256") != F.col("_sha256"), "sha256 mismatch")
        .when(F.col("_want").isNotNull() & (F.col("_want") != F.col("_sha1")),
              "upstream sha1 mismatch")
        .otherwise("ok")
    )
    return joined.select(
        "path", detail.alias("detail"), (detail == "ok").alias("ok"),
        F.col("_want").isNotNull().alias("upstream_checked"),
    )
