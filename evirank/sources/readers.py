"""Readers. Text layouts get explicit schemas, so nothing is inferred from the data."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evirank.functions.text import snake_case

log = logging.getLogger(__name__)


class MissingDataset(FileNotFoundError):
    """The dataset folder or file does not exist."""


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet dataset (a folder of parts or one file), pruned to the named columns."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise MissingDataset(f"no parquet dataset at {path}; build or fetch it first") from error
        raise
    return select_columns(df, columns, path) if columns else df


def select_columns(df: DataFrame, columns: list[str], context: str = "") -> DataFrame:
    """Select; the error names every missing column."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"{context}: missing columns {absent}; present: {sorted(df.columns)}")
    return df.select(*columns)


def read_flags(
    spark: SparkSession, path: str, fields: list[str], key: str, items: DataFrame | None = None
) -> DataFrame:
    """Per-item flags under their ``prio__`` names, optionally for some items only."""
    df = read_dataset(spark, path, [key, *fields])
    if items is not None:
        df = df.join(items.select(key), key, "left_semi")
    return df.withColumnsRenamed({f: f"prio__{snake_case(f)}" for f in fields})


def read_gct(spark: SparkSession, path: str, id_columns: int = 2) -> DataFrame:
    """GCT matrix (two preamble lines, then a header), wide, values as doubles.

    Only the head of the file is looked at in the driver; the rows are parsed in
    parallel with a schema built from the header line.
    """
    lines = spark.read.text(path)
    head = [r[0] for r in lines.limit(3).collect()]
    if len(head) < 3 or not head[0].startswith("#1."):
        raise ValueError(f"{path} is not a GCT file")
    names = head[2].split("\t")
    kinds = ["STRING"] * id_columns + ["DOUBLE"] * (len(names) - id_columns)
    ddl = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    body = lines.where(~F.col("value").isin(*head))
    parsed = F.from_csv("value", F.lit(ddl), {"sep": "\t"})
    # gzip does not split: spread the rows before the matrix is worked on
    return body.repartition("value").select(parsed.alias("_r")).select("_r.*")


def clean_matrix(df: DataFrame, id_col: str, duplicate_marker: str = "_PAR_Y",
                 counted: Observation | None = None) -> DataFrame:
    """Drop the duplicate-region rows and strip id versions.

    ``counted`` observes ``n_rows`` and ``n_duplicates`` in the pass that drops them; it can be
    read once an action has run on the result.
    """
    from evirank.functions.text import normalize_id

    if counted is not None:
        df = df.observe(counted, F.count(F.lit(1)).alias("n_rows"),
                        F.count_if(F.col(id_col).contains(duplicate_marker)).alias("n_duplicates"))
    return df.where(~F.col(id_col).contains(duplicate_marker)).withColumn(
        id_col, normalize_id(F.col(id_col))
    )


def matrix_columns(df: DataFrame, ids: list[str]) -> list[str]:
    return [c for c in df.columns if c not in ids]


def to_long(df: DataFrame, ids: list[str], variable: str = "tissue", value: str = "tpm"
            ) -> DataFrame:
    return df.unpivot(ids, matrix_columns(df, ids), variable, value)


def read_headered_tsv(spark: SparkSession, path: str, columns: list[str] | None = None
                      ) -> DataFrame:
    """All-string TSV, quoting off, empty as null; absent wanted columns only warn."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", nullValue="", inferSchema=False)
    if columns is None:
        return df
    absent = [c for c in columns if c not in df.columns]
    if absent:
        log.warning("%s lacks the columns %s", path, absent)
    return df.select(*[c for c in columns if c in df.columns])


def read_headerless_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string TSV with the names given, quoting off."""
    ddl = ", ".join(f"`{c}` STRING" for c in columns)
    return spark.read.csv(path, schema=ddl, sep="\t", header=False, quote="")


# The column names of the headerless layouts.
PATHWAY_COLUMNS = (
    "item_id", "pathway_id", "pathway_url", "pathway_name", "evidence_code", "species",
)
NAME_COLUMNS = ("pathway_id", "pathway_name", "species")
RELATION_COLUMNS = ("parent_id", "child_id")


def read_item_pathways(spark: SparkSession, path: str, species: str | None = "Homo sapiens"
                       ) -> DataFrame:
    """Membership rows, optionally of one species with clean ids."""
    from evirank.operators.identifiers import species_filter

    df = read_headerless_tsv(spark, path, list(PATHWAY_COLUMNS))
    return df if species is None else species_filter(df, species, "item_id")


def read_pathway_names(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless_tsv(spark, path, list(NAME_COLUMNS))


def read_pathway_relations(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless_tsv(spark, path, list(RELATION_COLUMNS))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated scored pairs; spread by pair, since gzip does not split."""
    df = spark.read.csv(path, sep=" ", header=True, schema="raw_a STRING, raw_b STRING, score INT")
    return df.repartition("raw_a", "raw_b")


def read_hash_header_tsv(spark: SparkSession, path: str, first_column: str) -> DataFrame:
    """All-string TSV whose header starts with ``#``; the first column gets a clean name."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return df.withColumnRenamed(df.columns[0], first_column)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return read_hash_header_tsv(spark, path, "protein_id")


def read_protein_info(spark: SparkSession, path: str) -> DataFrame:
    return read_hash_header_tsv(spark, path, "protein_id")


def lookup_key(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """Rows of one key; on a file written by ``write_sorted`` the row groups prune."""
    return read_dataset(spark, path).where(F.col(key) == F.lit(value))


def register_keys(keys: DataFrame, name: str) -> None:
    """A key table as a temp view for ``IN (SELECT …)``."""
    keys.createOrReplaceTempView(name)
