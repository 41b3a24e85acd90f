"""Readers and writers: tables written in each layout, read back and compared with SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import query
from evirank.catalog import tables as t
from evirank.session import ensure_checkpoint_dir
from evirank.sources import integrity, readers, writers


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None, gzip: bool = False) -> None:
    """Text lines; with header lines as one file, since these layouts have them on top of one file."""
    if header:
        spark = lines.sparkSession
        head = spark.createDataFrame([(h,) for h in header], "value STRING").coalesce(1)
        lines = head.unionByName(lines).coalesce(1)
    lines.write.option("compression", "gzip" if gzip else "none").text(path)


def tabbed(*columns: str, sep: str = "\t"):  # noqa: ANN201
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")


@query("dataset_read", "SELECT p_partkey, p_name, p_size FROM part")
def dataset_read(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "dataset")
    part = t.read(spark, sf, "part")
    writers.write_table(part, path, {"table": "part", "columns": part.columns})
    return readers.read_dataset(spark, path, ["p_partkey", "p_name", "p_size"])


@query("provenance_record", """
SELECT 'part' AS "table", count(*) AS n_rows, max(p_partkey) AS last_key FROM part
""")
def provenance_record(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "dataset")
    part = t.read(spark, sf, "part", "p_partkey")
    facts = part.agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("last")).first()
    writers.write_table(part, path, {"table": "part", "n_rows": facts["n"], "last_key": facts["last"]})
    return spark.read.json(f"{path}.provenance")


@query("flags_read", """
SELECT p_partkey AS item_id, (p_size > 25)::INT AS prio__has_pocket, p_size AS prio__max_clinical_stage
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)
""")
def flags_read(spark: SparkSession, sf: str) -> DataFrame:
    """Flags under their feature names, for the items with large line items only."""
    path = new_path(spark, "flags")
    t.read(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), (F.col("p_size") > 25).cast("int").alias("hasPocket"),
        F.col("p_size").alias("maxClinicalStage"), "p_name",
    ).write.parquet(path)
    wanted = t.read(spark, sf, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 40").select(
        F.col("l_partkey").alias("item_id"))
    return readers.read_flags(spark, path, ["hasPocket", "maxClinicalStage"], "item_id", wanted)


@query("gct_read", """
SELECT 'I' || p_partkey AS item_id, p_brand AS symbol, v.tissue, round(v.tpm, 6) AS tpm
FROM part, LATERAL (SELECT 'size of part' AS tissue, p_size::DOUBLE AS tpm
                    UNION ALL SELECT 'price', p_retailprice::DOUBLE) v
""")
def gct_read(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix with its preamble, versioned ids and duplicate-region rows; the latter go."""
    clean = readers.clean_matrix(readers.read_gct(spark, _gct(spark, sf)), "Name")
    long = readers.to_long(clean, ["Name", "Description"])
    return long.select(F.col("Name").alias("item_id"), F.col("Description").alias("symbol"), "tissue",
                       F.round("tpm", 6).alias("tpm"))


@query("gct_duplicates", """
SELECT count(*) + count(*) FILTER (p_partkey % 5 = 0) AS n_rows, count(*) FILTER (p_partkey % 5 = 0) AS n_duplicates,
       count(*) AS n_kept FROM part
""")
def gct_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """How many duplicate-region rows went, counted in the pass that writes the clean matrix."""
    counted = Observation("duplicates")
    path = new_path(spark, "matrix")
    readers.clean_matrix(readers.read_gct(spark, _gct(spark, sf)), "Name", counted=counted).write.parquet(path)
    found = counted.get
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_kept")).withColumns({
        "n_rows": F.lit(found["n_rows"]), "n_duplicates": F.lit(found["n_duplicates"])})


def _gct(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "gct")
    part = t.read(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    ids = [F.concat(F.lit("I"), "p_partkey", F.lit(".3")), F.when(
        F.col("p_partkey") % 5 == 0, F.concat(F.lit("I"), "p_partkey", F.lit(".3_PAR_Y")))]
    rows = part.withColumn("Name", F.explode(F.array_compact(F.array(*ids))))
    write_lines(rows.select(tabbed("Name", "p_brand", "p_size", "p_retailprice")), path, [
        "#1.2", f"{part.count()}\t2", "Name\tDescription\tsize of part\tprice",
    ], gzip=True)
    return path


@query("headered_tsv_read", """
SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_nationkey <> 3 THEN s_nationkey::VARCHAR END AS note
FROM supplier
""")
def headered_tsv_read(spark: SparkSession, sf: str) -> DataFrame:
    """All columns stay text, empty is null, quotes mean nothing, an absent wanted column only warns."""
    path = new_path(spark, "headered")
    note = F.when(F.col("s_nationkey") != 3, F.col("s_nationkey"))
    suppliers = t.read(spark, sf, "supplier").withColumn("note", note)
    write_lines(suppliers.select(tabbed("s_suppkey", "s_name", "note")), path, ["s_suppkey\ts_name\tnote"])
    return readers.read_headered_tsv(spark, path, ["s_suppkey", "s_name", "note", "gone"])


@query("pathways_read", """
SELECT 'ENSG' || lpad(item_id::VARCHAR, 11, '0') AS item_id, pathway_id, 'u/' || pathway_id AS pathway_url,
       'n ' || pathway_id AS pathway_name, evidence_code, 'Homo sapiens' AS species
FROM members WHERE evidence_code <> 'R'
""")
def pathways_read(spark: SparkSession, sf: str) -> DataFrame:
    """Headerless membership rows of one species, versions stripped from their ids."""
    path = new_path(spark, "pathways")
    rows = t.memberships(spark, sf).select(
        F.format_string("ENSG%011d.7", "item_id").alias("item"), "pathway_id",
        F.concat(F.lit("u/"), "pathway_id").alias("url"), F.concat(F.lit("n "), "pathway_id").alias("name"),
        "evidence_code",
        F.when(F.col("evidence_code") == "R", "Mus musculus").otherwise("Homo sapiens").alias("species"),
    )
    write_lines(rows.select(tabbed(*rows.columns)), path)
    return readers.read_item_pathways(spark, path)


@query("pathway_names_read", """
SELECT 'N' || n_nationkey AS pathway_id, n_name AS pathway_name, 'R' || n_regionkey AS species FROM nation
""")
def pathway_names_read(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "names")
    rows = t.read(spark, sf, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("id"), "n_name",
        F.concat(F.lit("R"), "n_regionkey").alias("species"))
    write_lines(rows.select(tabbed(*rows.columns)), path)
    return readers.read_pathway_names(spark, path)


@query("relations_read", "SELECT * FROM relations")
def relations_read(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "relations")
    write_lines(t.relations(spark, sf).select(tabbed("parent_id", "child_id")), path)
    return readers.read_pathway_relations(spark, path)


@query("edge_list_read", """
SELECT 'p-' || l_partkey AS raw_a, 's-' || l_suppkey AS raw_b, (l_quantity * 20)::INT AS score FROM lineitem
""")
def edge_list_read(spark: SparkSession, sf: str) -> DataFrame:
    """Scored pairs, space-separated with a header, compressed."""
    path = new_path(spark, "edges")
    t.raw_edges(spark, sf).withColumnsRenamed(
        {"raw_a": "protein1", "raw_b": "protein2", "score": "combined_score"}
    ).write.csv(path, sep=" ", header=True, compression="gzip")
    return readers.read_edge_list(spark, path)


_HASH_HEADER = "#string_protein_id"


@query("aliases_read", """
SELECT 'p-' || p_partkey AS protein_id, p_name AS alias, p_brand AS source FROM part
""")
def aliases_read(spark: SparkSession, sf: str) -> DataFrame:
    """A header that begins with a hash sign."""
    path = new_path(spark, "aliases")
    rows = t.read(spark, sf, "part", "p_partkey", "p_name", "p_brand").withColumn(
        "id", F.concat(F.lit("p-"), "p_partkey"))
    write_lines(rows.select(tabbed("id", "p_name", "p_brand")), path, [f"{_HASH_HEADER}\talias\tsource"])
    return readers.read_aliases(spark, path)


@query("protein_info_read", """
SELECT 's-' || s_suppkey AS protein_id, s_name AS preferred_name, s_nationkey::VARCHAR AS protein_size
FROM supplier
""")
def protein_info_read(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "info")
    rows = t.read(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").withColumn(
        "id", F.concat(F.lit("s-"), "s_suppkey"))
    write_lines(rows.select(tabbed("id", "s_name", "s_nationkey")), path,
                [f"{_HASH_HEADER}\tpreferred_name\tprotein_size"])
    return readers.read_protein_info(spark, path)


@query("sorted_lookup", """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_partkey = (SELECT max(p_partkey) // 2 FROM part)
""")
def sorted_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One key of a table clustered and sorted by it."""
    path = new_path(spark, "sorted")
    lines = t.read(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    writers.write_sorted(lines, path, "l_partkey", [F.col("l_quantity").desc()])
    key = t.read(spark, sf, "part", "p_partkey").agg(F.max("p_partkey")).first()[0] // 2
    return readers.lookup_key(spark, path, "l_partkey", key)


@query("keys_view", """
SELECT l_partkey, count(*) AS n_lines FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50) GROUP BY 1
""")
def keys_view(spark: SparkSession, sf: str) -> DataFrame:
    """Keys as a view for IN (SELECT …)."""
    name = f"wanted_{uuid.uuid4().hex}"
    readers.register_keys(t.read(spark, sf, "part", "p_partkey", "p_size").where("p_size = 50"), name)
    return t.read(spark, sf, "lineitem", "l_partkey").where(
        f"l_partkey IN (SELECT p_partkey FROM {name})"
    ).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"))


_LOGGED = ("part", "supplier", "orders", "lineitem")


@query("json_log", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}" for n in _LOGGED
))
def json_log(spark: SparkSession, sf: str) -> DataFrame:
    """An append-only log with one record per table."""
    path = new_path(spark, "log")
    for name in _LOGGED:
        writers.append_log(spark, {"table": name, "n_rows": t.read(spark, sf, name).count()}, path)
    return spark.read.json(path)


@query("metrics_json", """
SELECT l_returnflag AS group_id, 'mean_quantity' AS metric, round(avg(l_quantity), 6) AS value
FROM lineitem GROUP BY 1
""")
def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "metrics")
    long = t.read(spark, sf, "lineitem", "l_returnflag", "l_quantity").groupBy(
        F.col("l_returnflag").alias("group_id")
    ).agg(F.lit("mean_quantity").alias("metric"), F.round(F.avg("l_quantity"), 6).alias("value"))
    writers.write_metrics(long, path)
    return spark.read.json(path)


@query("csv_export", """
SELECT row_number() OVER (ORDER BY score DESC, item_id)::INT AS rank, symbol, item_id, score,
       count(*) OVER () AS n_exported, (SELECT count(*) FROM part) AS n_total
FROM (SELECT p_name || ', "' || p_brand || '"' AS symbol, p_partkey AS item_id,
             p_retailprice::DOUBLE AS score FROM part WHERE p_size <= 25)
""")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """An export states how many of how many rows it holds; commas and quotes survive."""
    from evirank.operators.ranking import rank_within_group

    part = t.read(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    shown = rank_within_group(part.where("p_size <= 25").select(
        F.lit("all").alias("group_id"), F.col("p_partkey").alias("item_id"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("symbol"),
        F.col("p_retailprice").cast("double").alias("score"),
    ), "group_id", "score", "item_id")
    path, total = new_path(spark, "export"), part.count()
    n = writers.export_ranking(shown, total, path)
    ddl = "rank INT, symbol STRING, item_id LONG, score DOUBLE, n_exported LONG, n_total LONG"
    return spark.read.csv(f"{path}_{n}_of_{total}", header=True, escape='"', schema=ddl)


@query("integrity_faults", """
SELECT name AS file, CASE name WHEN 'nation' THEN 'size mismatch' WHEN 'part' THEN 'sha256 mismatch'
       WHEN 'region' THEN 'no manifest' WHEN 'gone' THEN 'file missing' ELSE 'ok' END AS detail
FROM (VALUES ('nation'), ('part'), ('region'), ('gone'), ('supplier'), ('orders'), ('lineitem'),
             ('customer'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'),
             ('labels'), ('conversations')) AS v(name)
""")
def integrity_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The tables against a manifest with one wrong size, one wrong hash, one lost and one extra row.

    A table is a file or a folder of files; it is ok if all its files are.
    """
    files = integrity.checksums(spark, sf, "*.parquet")
    name = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/|$)", 1)
    listed = integrity.build_manifest(files, release="1").withColumns({
        "bytes": F.when(name == "nation", F.col("bytes") + 1).otherwise(F.col("bytes")),
        "sha256": F.when(name == "part", F.reverse("sha256")).otherwise(F.col("sha256")),
    })
    extra = listed.where(name == "region").withColumn(
        "path", F.regexp_replace("path", r"/region\.parquet(?=/|$)", "/gone.parquet"))
    path = new_path(spark, "manifest")
    listed.where(name != "region").unionByName(extra).write.json(path)
    checked = integrity.verify(files, integrity.read_manifest(spark, path))
    return checked.groupBy(name.alias("file")).agg(
        F.coalesce(F.max(F.when(~F.col("ok"), F.col("detail"))), F.lit("ok")).alias("detail"))
