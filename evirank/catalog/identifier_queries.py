"""Identifier mapping, symbol lookups, name resolution and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.catalog import cte, query
from evirank.catalog import tables as t
from evirank.functions.text import is_gene_id, normalize_id, normalize_text, search_url
from evirank.operators import identifiers as ids
from evirank.operators import joins


def _norm(x: str) -> str:
    return (f"trim(regexp_replace(replace(replace(lower({x}), '''', ''), '’', ''), "
            "'[^a-z0-9]+', ' ', 'g'))")


cte("aliases", """
SELECT 'p-' || p_partkey AS protein_id,
       CASE WHEN p_size % 3 = 0 THEN ' ensg' || lpad(p_partkey::VARCHAR, 11, '0') || '.' || p_size
            WHEN p_size % 3 = 1 THEN 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0')
            ELSE p_name END AS alias,
       p_type AS species
FROM part
""")


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 3
    padded = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    return t.read(spark, sf, "part", "p_partkey", "p_size", "p_name", "p_type").select(
        F.concat(F.lit("p-"), "p_partkey").alias("protein_id"),
        F.when(size == 0, F.concat(F.lit(" ensg"), padded, F.lit("."), "p_size"))
        .when(size == 1, F.concat(F.lit("ENSG"), padded)).otherwise(F.col("p_name")).alias("alias"),
        F.col("p_type").alias("species"),
    )


cte("alias_pairs", r"""
SELECT DISTINCT protein_id AS raw_id, regexp_replace(upper(trim(alias)), '\.\d+$', '') AS node
FROM aliases WHERE regexp_full_match(upper(trim(alias)), 'ENSG\d{11}(\.\d+)?')
""")


@query("alias_lookup", "SELECT * FROM alias_pairs")
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ids.alias_lookup(aliases(spark, sf))


@query("mapping_report", """
SELECT 'aliases' AS stage, count(*) AS total, sum(ok)::BIGINT AS mapped,
       count(*) - sum(ok)::BIGINT AS unmapped, round(sum(ok) / count(*), 9) AS fraction,
       (SELECT string_agg(protein_id, ', ' ORDER BY protein_id) FROM
         (SELECT protein_id FROM aliases WHERE protein_id NOT IN (SELECT raw_id FROM alias_pairs)
          ORDER BY 1 LIMIT 5)) AS examples
FROM (SELECT protein_id, (protein_id IN (SELECT raw_id FROM alias_pairs))::INT AS ok FROM aliases)
""")
def mapping_report(spark: SparkSession, sf: str) -> DataFrame:
    out = ids.mapping_report(aliases(spark, sf), "aliases", "protein_id", is_gene_id(F.col("alias")))
    return out.withColumn("fraction", F.round("fraction", 9))


@query("unmapped_examples", """
SELECT protein_id FROM aliases WHERE protein_id NOT IN (SELECT raw_id FROM alias_pairs)
ORDER BY 1 LIMIT 5
""")
def unmapped_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = aliases(spark, sf)
    lookup = ids.alias_lookup(rows).withColumnRenamed("raw_id", "protein_id")
    return joins.unmapped_examples(rows, lookup, ["protein_id"])


@query("species_filter", r"""
SELECT protein_id, regexp_replace(upper(trim(alias)), '\.\d+$', '') AS alias, species
FROM aliases WHERE species = 'ECONOMY'
  AND regexp_full_match(regexp_replace(upper(trim(alias)), '\.\d+$', ''), 'ENSG\d{11}')
""")
def species_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ids.species_filter(aliases(spark, sf), "ECONOMY", "alias")


@query("version_strip", r"""
SELECT p_partkey AS item_id, regexp_replace(upper(trim(p_name || '.' || p_size)), '\.\d+$', '') AS bare
FROM part
""")
def version_strip(spark: SparkSession, sf: str) -> DataFrame:
    versioned = F.concat_ws(".", "p_name", "p_size")
    return t.read(spark, sf, "part", "p_partkey", "p_name", "p_size").select(
        F.col("p_partkey").alias("item_id"), normalize_id(versioned).alias("bare")
    )


cte("symbol_table", """
SELECT CASE WHEN p_size % 13 <> 0 THEN lower(p_brand) END AS item_id, p_name AS symbol,
       CASE WHEN p_size % 2 = 0 THEN p_type || '|' || p_name END AS prev_symbol,
       p_brand || ' | ' || p_type || '|' AS alias_symbol
FROM part
""")
cte("symbol_pairs", """
SELECT DISTINCT symbol, upper(item_id) AS item_id, symbol_kind, priority FROM (
  SELECT upper(trim(unnest(string_split(symbol, '|')))) AS symbol, item_id,
         'approved' AS symbol_kind, 0 AS priority FROM symbol_table
  UNION ALL SELECT upper(trim(unnest(string_split(prev_symbol, '|')))), item_id, 'previous', 1
  FROM symbol_table
  UNION ALL SELECT upper(trim(unnest(string_split(alias_symbol, '|')))), item_id, 'alias', 2
  FROM symbol_table) WHERE symbol <> '' AND item_id IS NOT NULL
""")


def symbol_table(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return t.read(spark, sf, "part", "p_brand", "p_name", "p_type", "p_size").select(
        F.when(size % 13 != 0, F.lower("p_brand")).alias("item_id"),
        F.col("p_name").alias("symbol"),
        F.when(size % 2 == 0, F.concat_ws("|", "p_type", "p_name")).alias("prev_symbol"),
        F.concat(F.col("p_brand"), F.lit(" | "), F.col("p_type"), F.lit("|")).alias("alias_symbol"),
    )


@query("symbol_lookup", "SELECT * FROM symbol_pairs")
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ids.symbol_lookup(symbol_table(spark, sf))


@query("ambiguous_symbols", """
SELECT symbol, count(DISTINCT item_id) AS n_items FROM symbol_pairs GROUP BY 1
HAVING count(DISTINCT item_id) > 1
""")
def ambiguous_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return ids.ambiguous_symbols(ids.symbol_lookup(symbol_table(spark, sf)))


SPECS = [
    ("a", "Small-Ring"), ("b", "brand 2"), ("c", "ue plat"), ("d", "no such name"),
    ("e", "hot rod"), ("f", "ECONOMY"),
]
_SPEC_VALUES = ", ".join(f"('{k}', '{q}')" for k, q in SPECS)
cte("specs", f"SELECT key, query, {_norm('query')} AS q FROM (VALUES {_SPEC_VALUES}) AS s(key, query)")
cte("name_index", f"""
SELECT CASE WHEN p_size % 2 = 0 THEN 'EFO_' ELSE 'MONDO_' END || lpad(p_partkey::VARCHAR, 9, '0')
         AS id, p_name AS name, {_norm('p_name')} AS n, {_norm('p_brand')} AS s1,
       {_norm('p_type')} AS s2 FROM part
""")
cte("name_hits", """
SELECT key, id, name, CASE WHEN n = q THEN 1 WHEN s1 = q OR s2 = q THEN 2 ELSE 3 END AS tier
FROM specs JOIN name_index ON n = q OR s1 = q OR s2 = q OR contains(n, q)
""")
cte("name_best", """
SELECT *, row_number() OVER (PARTITION BY key ORDER BY NOT starts_with(id, 'EFO_'), id) AS place,
       count(*) OVER (PARTITION BY key) AS n_candidates
FROM name_hits JOIN (SELECT key, min(tier) AS tier FROM name_hits GROUP BY 1) USING (key, tier)
""")


@query("name_resolution", """
SELECT s.key, s.query, b.id AS match_id, b.name AS match_name,
       CASE b.tier WHEN 1 THEN 'exact_name' WHEN 2 THEN 'exact_synonym' WHEN 3 THEN 'substring' END
         || CASE WHEN n_candidates > 1 THEN '_ambiguous' ELSE '' END AS match_kind,
       n_candidates,
       (SELECT string_agg(id, ',' ORDER BY place) FROM name_best x
        WHERE x.key = s.key AND place BETWEEN 2 AND 6) AS alternatives
FROM specs s LEFT JOIN name_best b ON b.key = s.key AND place = 1
""")
def name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    out = ids.resolve_names(_specs(spark), _name_index(spark, sf), synonyms="synonyms")
    joined = F.array_join("alternatives", ",")
    return out.withColumn("alternatives", F.when(joined != "", joined))


def _specs(spark: SparkSession) -> DataFrame:
    return t.rows(spark, SPECS, "key STRING, query STRING")


def _name_index(spark: SparkSession, sf: str) -> DataFrame:
    prefix = F.when(F.col("p_size") % 2 == 0, "EFO_").otherwise("MONDO_")
    return t.read(spark, sf, "part").select(
        F.concat(prefix, F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"),
        F.col("p_name").alias("name"),
        F.struct(
            F.array("p_brand").alias("exact"), F.array("p_type").alias("related"),
        ).alias("synonyms"),
    )


@query("nested_names", """
SELECT p_partkey AS item_id, unnest(list_filter(
         [p_brand, p_type, p_brand || ' x', CASE WHEN p_size % 2 = 0 THEN p_name END, p_name || '!', p_type || '?'],
         lambda x: x IS NOT NULL)) AS name FROM part
""")
def nested_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names from lists of structs, structs in structs, lists of lists, plain strings and map values."""
    part = t.read(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_name")
    shaped = part.select(F.col("p_partkey").alias("item_id"), F.struct(
        F.array(F.struct(F.col("p_brand").alias("label"), F.array("p_type").alias("other"),
                         F.col("p_size").alias("size"))).alias("exact"),
        F.struct(F.array(F.array(F.concat("p_brand", F.lit(" x"))), F.lit(None).cast("array<string>"))
                 .alias("lists")).alias("deep"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("plain"),
        F.create_map(F.lit("k"), F.struct(
            F.concat("p_name", F.lit("!")).alias("a"), F.concat("p_type", F.lit("?")).alias("b"))).alias("by_key"),
    ).alias("names"))
    return shaped.select("item_id", F.explode(ids.flatten_names(shaped, "names")).alias("name"))


@query("unresolved_names", """
SELECT key, query FROM specs WHERE key NOT IN (SELECT key FROM name_hits)
""")
def unresolved_names(spark: SparkSession, sf: str) -> DataFrame:
    out = ids.resolve_names(_specs(spark), _name_index(spark, sf), synonyms="synonyms")
    return ids.unresolved(out).select("key", "query")


@query("text_normalize", f"""
SELECT doc_id, {_norm('text')} AS norm, length({_norm('text')}) AS n FROM documents
""")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", normalize_text(F.col("text")).alias("norm"),
        F.length(normalize_text(F.col("text"))).alias("n"),
    )


cte("named_groups", f"""
SELECT 'key_' || s_suppkey AS key, s_name AS name, n_name AS resolved_name, {_norm('s_name')} AS n,
       s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")


def _named_groups(spark: SparkSession, sf: str) -> DataFrame:
    nation = t.read(spark, sf, "nation", "n_nationkey", "n_name")
    return t.read(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.concat(F.lit("key_"), "s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("n_name").alias("resolved_name"), "s_suppkey",
    )


@query("group_search", f"""
SELECT key, name, resolved_name, n_items,
       row_number() OVER (ORDER BY n <> 'nation 1', name, key) AS position
FROM named_groups LEFT JOIN
  (SELECT l_suppkey AS s_suppkey, count(DISTINCT l_partkey) AS n_items FROM lineitem GROUP BY 1)
  USING (s_suppkey)
WHERE contains(n, 'nation 1') OR contains({_norm("replace(key, '_', ' ')")}, 'nation 1')
   OR contains({_norm('resolved_name')}, 'nation 1')
ORDER BY position LIMIT 25
""")
def group_search(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers found by name, key or nation, with their item counts."""
    counts = t.read(spark, sf, "lineitem", "l_suppkey", "l_partkey").groupBy(
        F.col("l_suppkey").alias("s_suppkey")
    ).agg(F.countDistinct("l_partkey").alias("n_items"))
    found = ids.search_groups(
        _named_groups(spark, sf), "NATION - 1", 25, resolved_name="resolved_name",
        details=counts, details_on="s_suppkey",
    )
    return found.select("key", "name", "resolved_name", "n_items", "position")


@query("prefix_suggest", """
SELECT name, row_number() OVER (ORDER BY name) AS position FROM named_groups
WHERE starts_with(n, 'supplier 00000001') ORDER BY name LIMIT 4
""")
def prefix_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return ids.suggest(_named_groups(spark, sf), "Supplier#00000001", 4)


@query("search_url", """
SELECT p_partkey AS item_id, 'https://search.example.org/?query=%22'
       || replace(p_name, ' ', '+') || '%22+AND+%22' || replace(p_brand, '#', '%23') || '%22' AS url
FROM part
""")
def search_url_query(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "part", "p_partkey", "p_name", "p_brand").select(
        F.col("p_partkey").alias("item_id"),
        search_url("https://search.example.org/?query=", F.col("p_name"), F.col("p_brand"))
        .alias("url"),
    )


@query("join_overlap", """
SELECT count(*) FILTER (l) AS n_left, count(*) FILTER (r) AS n_right,
       count(*) FILTER (l AND r) AS n_shared, count(*) FILTER (l AND r) >= 100 AS enough
FROM (SELECT item_id, bool_or(l) AS l, bool_or(r) AS r FROM (
        SELECT l_partkey AS item_id, true AS l, false AS r FROM lineitem
        UNION ALL SELECT p_partkey, false, true FROM part) GROUP BY 1)
""")
def join_overlap(spark: SparkSession, sf: str) -> DataFrame:
    big = t.read(spark, sf, "lineitem", "l_partkey").withColumnRenamed("l_partkey", "item_id")
    parts = t.read(spark, sf, "part", "p_partkey").withColumnRenamed("p_partkey", "item_id")
    return joins.key_overlap(big, parts, "item_id", 100)


@query("name_fallback", """
SELECT item_id, CASE WHEN p_size > 10 THEN p_name ELSE item_id::VARCHAR END AS shown
FROM (SELECT DISTINCT l_partkey AS item_id FROM lineitem) JOIN part ON p_partkey = item_id
""")
def name_fallback(spark: SparkSession, sf: str) -> DataFrame:
    items = t.read(spark, sf, "lineitem", "l_partkey").select(
        F.col("l_partkey").alias("item_id")).distinct()
    names = t.read(spark, sf, "part", "p_partkey", "p_name", "p_size").where(
        F.col("p_size") > 10
    ).select(F.col("p_partkey").alias("item_id"), "p_name")
    return joins.resolve_name(items, names, "item_id", "p_name", "shown")
