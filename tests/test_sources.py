import gzip
import json

import pytest
from pyspark.sql import functions as F

from evirank.sources import integrity, readers, writers


def write(path, text):
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_missing_dataset_and_columns(spark, tmp_path):
    with pytest.raises(readers.MissingDataset):
        readers.read_dataset(spark, str(tmp_path / "none"))
    path = str(tmp_path / "t")
    spark.range(3).withColumn("hasPocket", F.lit(1)).write.parquet(path)
    assert readers.read_dataset(spark, path, ["id"]).columns == ["id"]
    with pytest.raises(KeyError, match="x.*y"):
        readers.read_dataset(spark, path, ["id", "x", "y"])
    flags = readers.read_flags(spark, path, ["hasPocket"], "id", spark.range(2))
    assert flags.columns == ["id", "prio__has_pocket"] and flags.count() == 2


def test_gct(spark, tmp_path):
    path = write(tmp_path / "m.gct.gz", "#1.2\n3\t2\nName\tDescription\tA B\tC\n"
                 "ENSG00000000001.5\tX\t1.5\t2\nENSG00000000002.1\tY\t0\t3\n"
                 "ENSG00000000002.1_PAR_Y\tY\t9\t9\n")
    df = readers.clean_matrix(readers.read_gct(spark, path), "Name")
    long = readers.to_long(df, ["Name", "Description"])
    got = {(r["Name"], r["tissue"], r["tpm"]) for r in long.collect()}
    assert got == {("ENSG00000000001", "A B", 1.5), ("ENSG00000000001", "C", 2.0),
                   ("ENSG00000000002", "A B", 0.0), ("ENSG00000000002", "C", 3.0)}
    with pytest.raises(ValueError):
        readers.read_gct(spark, write(tmp_path / "bad.gct", "a\nb\nc\n"))


def test_headered_tsv_stays_text(spark, tmp_path, caplog):
    path = write(tmp_path / "h.tsv", 'id\tsymbol\tnote\n007\tA"b\t\n8\t"q\tz\n')
    df = readers.read_headered_tsv(spark, path, ["id", "symbol", "gone"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("007", 'A"b'), ("8", '"q')]
    assert "gone" in caplog.text
    assert readers.read_headered_tsv(spark, path).where("note IS NULL").count() == 1


def test_pathway_layouts(spark, tmp_path):
    path = write(tmp_path / "p.txt", "ENSG00000000001.2\tR1\tu\tn\tIEA\tHomo sapiens\n"
                 "ENSG00000000001\tR1\tu\tn\tIEA\tMus musculus\n")
    assert readers.read_item_pathways(spark, path).first()["item_id"] == "ENSG00000000001"
    assert readers.read_item_pathways(spark, path, None).count() == 2
    rel = readers.read_pathway_relations(spark, write(tmp_path / "r.txt", "a\tb\n"))
    names = readers.read_pathway_names(spark, write(tmp_path / "n.txt", "a\tName\tHomo sapiens\n"))
    assert rel.first()["child_id"] == "b" and names.first()["pathway_name"] == "Name"


def test_edge_layouts(spark, tmp_path):
    path = write(tmp_path / "e.txt.gz", "protein1 protein2 combined_score\n9606.a 9606.b 700\n")
    assert tuple(readers.read_edge_list(spark, path).first()) == ("9606.a", "9606.b", 700)
    path = write(tmp_path / "a.txt", "#string_protein_id\talias\tsource\np\tA\ts\n")
    assert readers.read_aliases(spark, path).columns == ["protein_id", "alias", "source"]
    assert readers.read_protein_info(spark, path).first()["protein_id"] == "p"


def test_sorted_table_prunes_a_key_lookup(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    writers.write_sorted(df, path, "k", [F.col("v").desc()])
    found = readers.lookup_key(spark, path, "k", 7)
    assert found.count() == 20
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,7)]" in found._jdf.queryExecution().toString()


def test_keys_as_a_view(spark):
    readers.register_keys(spark.range(2), "wanted")
    assert spark.sql("SELECT * FROM range(5) WHERE id IN (SELECT id FROM wanted)").count() == 2


def test_records_and_logs(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(3), path, {"n": 3, "weights": {"b": 1, "a": 2}})
    note = spark.read.json(path + ".provenance").first()
    assert note["n"] == 3 and json.loads(note["weights"]) == {"a": 2, "b": 1}
    log = str(tmp_path / "log")
    for i in range(2):
        writers.append_log(spark, {"i": i}, log)
    assert spark.read.json(log).count() == 2
    metrics = str(tmp_path / "metrics")
    writers.write_metrics(spark.createDataFrame([("m", 0.5)], "metric STRING, value DOUBLE"), metrics)
    assert spark.read.json(metrics).first()["value"] == 0.5


def test_export_states_that_it_is_partial(spark, tmp_path):
    df = spark.createDataFrame([(2, "a,b"), (1, 'q"x')], "rank INT, symbol STRING")
    path = str(tmp_path / "out")
    assert writers.export_ranking(df, 10, path) == 2
    rows = spark.read.csv(f"{path}_2_of_10", header=True, escape='"').collect()
    assert {(r["symbol"], r["n_exported"], r["n_total"]) for r in rows} == {
        ("a,b", "2", "10"), ('q"x', "2", "10")}


def test_integrity(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    for name, text in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / "d" / name).write_bytes(text)
    files = integrity.checksums(spark, str(tmp_path / "d"), "*.bin").persist()
    one = files.where("path LIKE '%a.bin'").first()
    assert one["sha256"] == hashlib.sha256(b"one").hexdigest() and one["bytes"] == 3
    manifest = integrity.build_manifest(files, source="s", release="1")
    path = str(tmp_path / "manifest")
    manifest.withColumn("unknown_key", F.lit(1)).write.json(path)
    loaded = integrity.read_manifest(spark, path)
    assert "unknown_key" not in loaded.columns
    ok = integrity.verify(files, loaded)
    assert ok.where("NOT ok").count() == 0
    gone = F.regexp_replace("path", "c.bin", "z.bin")
    broken = loaded.withColumn("path", gone).withColumn(
        "sha256", F.when(F.col("path").like("%b.bin"), "x").otherwise(F.col("sha256")))
    got = {r["path"][-5:]: r["detail"] for r in integrity.verify(files, broken).collect()}
    assert got == {"a.bin": "ok", "b.bin": "sha256 mismatch", "c.bin": "no manifest",
                   "z.bin": "file missing"}
    upstream = files.select("path", F.lit("0").alias("sha1"))
    up = integrity.verify(files, loaded, upstream)
    assert {r["detail"] for r in up.collect()} == {"upstream sha1 mismatch"}


def test_duplicate_rows_are_counted_as_they_go(spark):
    from pyspark.sql import Observation

    counted = Observation("duplicates")
    df = spark.createDataFrame([("A.1", 1.0), ("A.1_PAR_Y", 1.0), ("B", 2.0)], "Name STRING, v DOUBLE")
    clean = readers.clean_matrix(df, "Name", counted=counted)
    assert sorted(r["Name"] for r in clean.collect()) == ["A", "B"]
    assert counted.get == {"n_rows": 3, "n_duplicates": 1}


def test_integrity_faults_of_tables_in_folders(spark, tmp_path):
    from evirank.catalog import load, source_queries

    load()
    names = ["nation", "part", "region", "documents", "orders"]
    for name in names:
        (tmp_path / f"{name}.parquet").mkdir()
        for k in range(2):
            (tmp_path / f"{name}.parquet" / f"part-000{k}.parquet").write_bytes(f"{name} {k}".encode())
    (tmp_path / "events.parquet").write_bytes(b"events")
    got = [tuple(r) for r in source_queries.integrity_faults(spark, str(tmp_path)).collect()]
    assert sorted(got) == [
        ("documents", "ok"), ("events", "ok"), ("gone", "file missing"), ("nation", "size mismatch"),
        ("orders", "ok"), ("part", "sha256 mismatch"), ("region", "no manifest")]
