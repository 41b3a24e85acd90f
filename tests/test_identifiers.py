import pytest
from pyspark.sql import functions as F

from evirank.functions import text as tx
from evirank.operators import identifiers as ids


@pytest.mark.parametrize("raw, want", [
    ("ENSG00000145335.16", "ENSG00000145335"), (" ensg00000145335 ", "ENSG00000145335"),
    ("a.b", "A.B"), ("x.1.2", "X.1"), ("  ", None), (None, None)])
def test_version_strip(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x STRING")
    assert df.select(tx.normalize_id(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("ENSG00000145335", True), ("ENSG00000145335.2", True), ("ENSG123", False),
    ("ENSP00000145335", False), (None, False)])
def test_id_format(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x STRING").select(tx.is_gene_id(F.col("x"))).first()[0] is want


def test_text_normalize_has_a_driver_twin(spark):
    for text in ("Parkinson's  disease", "non-small—cell  LUNG", "’x’", ""):
        df = spark.createDataFrame([(text,)], "x STRING")
        assert df.select(tx.normalize_text(F.col("x"))).first()[0] == tx.normalized_literal(text)


def test_snake_case():
    assert tx.snake_case("hasSafetyEvent") == "has_safety_event"


def test_alias_lookup_and_report(spark):
    df = spark.createDataFrame([("p1", "ensg00000000001.3"), ("p1", "ENSG00000000001"), ("p2", "ENSG00000000002"),
                                ("p3", "name")], "protein_id STRING, alias STRING")
    got = {tuple(r) for r in ids.alias_lookup(df).collect()}
    assert got == {("p1", "ENSG00000000001"), ("p2", "ENSG00000000002")}
    row = ids.mapping_report(df, "s", "protein_id", tx.is_gene_id(F.col("alias"))).first()
    assert (row["total"], row["mapped"], row["examples"]) == (3, 2, "p3")
    empty = ids.mapping_report(df.where("false"), "s", "protein_id", tx.is_gene_id(F.col("alias"))).first()
    assert (empty["total"], empty["fraction"]) == (0, 0.0)


def test_species_filter(spark):
    df = spark.createDataFrame(
        [("ENSG00000000001.16", "Homo sapiens"), ("ENSG00000000002", "Homo sapiens"),
         ("ENSMUSG1", "Mus musculus"), ("bad", "Homo sapiens")], "item_id STRING, species STRING")
    got = {r["item_id"] for r in ids.species_filter(df, "Homo sapiens", "item_id").collect()}
    assert got == {"ENSG00000000001", "ENSG00000000002"}


def test_symbol_lookup(spark):
    df = spark.createDataFrame(
        [("PRKN", "ENSG1", "PARK2|old ", "|AR-JP"), ("PARK2", "ENSG2", None, None), ("X", "", "Y", "Z")],
        "symbol STRING, item_id STRING, prev_symbol STRING, alias_symbol STRING")
    lookup = ids.symbol_lookup(df)
    got = {(r["symbol"], r["item_id"], r["symbol_kind"], r["priority"]) for r in lookup.collect()}
    assert got == {("PRKN", "ENSG1", "approved", 0), ("PARK2", "ENSG1", "previous", 1),
                   ("OLD", "ENSG1", "previous", 1), ("AR-JP", "ENSG1", "alias", 2),
                   ("PARK2", "ENSG2", "approved", 0)}
    assert [r["symbol"] for r in ids.ambiguous_symbols(lookup).collect()] == ["PARK2"]
    assert ids.symbol_lookup(df.drop("alias_symbol")).count() == 4


@pytest.fixture
def index(spark):
    return spark.createDataFrame(
        [("MONDO_1", "Parkinson disease", (["PD"], None)), ("EFO_9", "asthma", (["wheeze"], ["x"])),
         ("MONDO_2", "asthma", (None, None)), ("EFO_3", "juvenile arthritis", (None, ["JIA", "asthma"])),
         ("EFO_4", "rheumatoid arthritis", (None, None))],
        "id STRING, name STRING, synonyms STRUCT<exact: ARRAY<STRING>, related: ARRAY<STRING>>")


@pytest.mark.parametrize("query, match, kind, n", [
    ("Parkinson's-disease", None, None, None), ("Parkinson disease", "MONDO_1", "exact_name", 1),
    ("pd", "MONDO_1", "exact_synonym", 1), ("Asthma", "EFO_9", "exact_name_ambiguous", 2),
    ("arthritis", "EFO_3", "substring_ambiguous", 2), ("th", "EFO_3", "substring_ambiguous", None),
    ("nothing", None, None, None)])
def test_resolution_cascade(spark, index, query, match, kind, n):
    specs = spark.createDataFrame([("k", query)], "key STRING, query STRING")
    row = ids.resolve_names(specs, index, synonyms="synonyms").first()
    assert (row["match_id"], row["match_kind"]) == (match, kind)
    if n is not None:
        assert row["n_candidates"] == n
    if n and n > 1:
        assert len(row["alternatives"]) == n - 1


def test_unresolved_is_kept(spark, index):
    specs = spark.createDataFrame([("a", "asthma"), ("b", "zzz")], "key STRING, query STRING")
    out = ids.resolve_names(specs, index, synonyms="synonyms")
    assert out.count() == 2 and [r["key"] for r in ids.unresolved(out).collect()] == ["b"]


@pytest.fixture
def groups(spark):
    return spark.createDataFrame(
        [("parkinsons_disease", "Parkinson's disease"), ("alzheimers", "Alzheimer's disease"),
         ("disease", "disease")], "key STRING, name STRING")


def test_search_puts_the_exact_name_first(groups):
    def names(q, n=10):
        return [r["name"] for r in ids.search_groups(groups, q, n).orderBy("position").collect()]
    assert names("disease") == ["disease", "Alzheimer's disease", "Parkinson's disease"]
    assert names("parkinsons") == ["Parkinson's disease"]
    assert len(names("")) == 3 and names("disease", 1) == ["disease"] and names("xyz") == []


def test_suggest_is_prefix_only(groups):
    assert [r["name"] for r in ids.suggest(groups, "alz").collect()] == ["Alzheimer's disease"]
    assert ids.suggest(groups, "heimer").count() == 0


def test_names_of_any_shape(spark):
    rows = [
        (1, ((["a", None], [("b", ["c"]), None]), "d", {"k": ["e"]}, 7)),
        (2, ((None, None), None, None, None)),
        (3, None),
    ]
    df = spark.createDataFrame(
        rows, "id INT, n STRUCT<deep: STRUCT<l: ARRAY<STRING>, s: ARRAY<STRUCT<x: STRING, y: ARRAY<STRING>>>>, "
              "plain STRING, by_key: MAP<STRING, ARRAY<STRING>>, size INT>")
    got = {r["id"]: r["names"] for r in df.select("id", ids.flatten_names(df, "n").alias("names")).collect()}
    assert got == {1: ["a", "b", "c", "d", "e"], 2: [], 3: []}
    plain = spark.createDataFrame([("x", 1), (None, 2)], "a STRING, b INT")
    assert [r[0] for r in plain.select(ids.flatten_names(plain, "a")).collect()] == [["x"], []]
    assert [r[0] for r in plain.select(ids.flatten_names(plain, "b")).collect()] == [[], []]


def test_a_common_beginning_is_not_the_key_of_the_join(spark):
    named = spark.range(300).select(
        F.concat(F.lit("m"), "id").alias("match_id"), F.concat(F.lit("common start "), "id").alias("_name"))
    asked = spark.createDataFrame([("a", "common start 271"), ("b", "start 9"), ("c", "zz"), ("d", "co")],
                                  "key STRING, _q STRING")
    chosen = {r["key"]: r for r in ids.rarest_pieces(asked, ids.name_pieces(named, asked)).collect()}
    assert chosen["a"]["n_names"] <= 3 and chosen["c"]["n_names"] == 0 and chosen["d"]["n_names"] == 300
    held = chosen["b"]
    assert held["n_names"] == sum(held["_piece"] in f"common start {i}" for i in range(300)) == 11


def test_substring_resolution_equals_a_scan(spark):
    names = ["Alpha beta", "alpha", "beta-alpha gamma", "x", "gamma ray", "", "phase alpha"]
    index = spark.createDataFrame([(f"I{i}", n) for i, n in enumerate(names)], "id STRING, name STRING")
    queries = ["alpha b", "amma", "a", "ray", "zeta", "pha", "ph alpha", ""]
    specs = spark.createDataFrame([(q or "none", q) for q in queries], "key STRING, query STRING")
    got = {r["query"]: (r["match_id"], r["n_candidates"]) for r in ids.resolve_names(specs, index).collect()}

    def scan(q):
        plain = [n.lower().replace("-", " ") for n in names]
        hits = [f"I{i}" for i, n in enumerate(plain) if n == q]
        hits = hits or ([f"I{i}" for i, n in enumerate(plain) if q in n] if q else [])
        return (min(hits), len(hits)) if hits else (None, None)

    assert got == {q: scan(q) for q in queries}
