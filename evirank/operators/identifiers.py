"""Identifier mapping, symbol lookups, name resolution and group search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.functions.text import (
    BARE_GENE_ID_PATTERN,
    is_gene_id,
    matches_prefix,
    matches_substring,
    normalize_id,
    normalize_text,
    normalized_literal,
    unpack,
)
from evirank.operators.ranking import top_n

ALTERNATIVES_KEPT = 5
PREFERRED_PREFIX = "EFO_"


def mapping_report(df: DataFrame, stage: str, raw: str, mapped: Column, examples: int = 5
                   ) -> DataFrame:
    """One row: distinct raw ids, how many map, the share (0 when empty), a few that do not."""
    ids = df.groupBy(raw).agg(F.max(mapped.cast("int")).alias("_ok"))
    counts = ids.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("_ok"), F.lit(0)).alias("mapped"),
    )
    # at most `examples` rows are brought together
    few = ids.where(F.col("_ok") == 0).orderBy(raw).limit(examples).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(raw).cast("string"))), ", ")
        .alias("examples")
    )
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(few.withColumn("_one", F.lit(1))), "_one", "left")
        .select(
            F.lit(stage).alias("stage"), "total", "mapped",
            (F.col("total") - F.col("mapped")).alias("unmapped"),
            F.when(F.col("total") > 0, F.col("mapped") / F.col("total"))
            .otherwise(F.lit(0.0)).alias("fraction"),
            "examples",
        )
    )


def alias_lookup(
    aliases: DataFrame, raw: str = "protein_id", alias: str = "alias", valid: Column | None = None
) -> DataFrame:
    """``raw_id, node``: aliases that are gene ids, normalised, distinct."""
    ok = is_gene_id(F.col(alias)) if valid is None else valid
    return aliases.where(ok).select(
        F.col(raw).alias("raw_id"), normalize_id(F.col(alias)).alias("node")
    ).distinct()


def species_filter(
    mapping: DataFrame, species: str, item: str, species_col: str = "species",
    pattern: str = BARE_GENE_ID_PATTERN,
) -> DataFrame:
    """Keep one species, strip versions, keep well-formed ids."""
    kept = mapping.where(F.col(species_col) == species)
    return kept.withColumn(item, normalize_id(F.col(item))).where(F.col(item).rlike(pattern))


def symbol_lookup(
    table: DataFrame, item: str = "item_id", approved: str = "symbol",
    previous: str = "prev_symbol", alias: str = "alias_symbol",
) -> DataFrame:
    """``symbol, item, symbol_kind, priority``: approved before previous before alias.

    One pass over the table; a column that is absent contributes nothing.
    """
    kinds = [(approved, "approved", 0), (previous, "previous", 1), (alias, "alias", 2)]
    none = F.array().cast("array<string>")

    def tagged(kind: str, priority: int):  # noqa: ANN202
        return lambda s: F.struct(
            s.alias("symbol"), F.lit(kind).alias("symbol_kind"), F.lit(priority).alias("priority")
        )

    packed = F.concat(*[
        F.transform(F.coalesce(unpack(F.col(c)), none), tagged(kind, p))
        for c, kind, p in kinds if c in table.columns
    ])
    known = table.where(F.col(item).isNotNull() & (F.trim(item) != ""))
    return known.select(
        F.upper(F.trim(item)).alias(item), F.explode(packed).alias("_s")
    ).select("_s.symbol", item, "_s.symbol_kind", "_s.priority").distinct()


def ambiguous_symbols(lookup: DataFrame, item: str = "item_id") -> DataFrame:
    """Symbols that point to more than one item."""
    return lookup.groupBy("symbol").agg(F.countDistinct(item).alias("n_items")).where(
        F.col("n_items") > 1
    )


def _strings(value: Column, kind: T.DataType) -> Column | None:
    """All strings inside a value of the given type as one list; None where the type holds none."""
    if isinstance(kind, T.StringType):
        return F.array(value)
    if isinstance(kind, T.MapType):
        return _strings(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if _strings(F.lit(None), kind.elementType) is None:
            return None
        found = F.flatten(F.transform(value, lambda v: _strings(v, kind.elementType)))
    elif isinstance(kind, T.StructType):
        parts = [_strings(value.getField(f.name), f.dataType) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        if not parts:
            return None
        found = F.concat(*parts)
    else:
        return None
    return F.coalesce(found, F.array().cast("array<string>"))


def flatten_names(df: DataFrame, column: str) -> Column:
    """All strings of a column as one list: strings, lists, structs and map values, nested to any depth.

    Order follows the schema. Nulls at any level add nothing; values that are not text are left out.
    """
    found = _strings(F.col(f"`{column}`"), df.schema[column].dataType)
    return F.array().cast("array<string>") if found is None else F.array_compact(found)


PIECE = 3  # letters of the pieces that substring searches are joined on


def _pieces(text: Column, length: Column) -> Column:
    """The distinct pieces of ``length`` letters of a text (the text itself if it is shorter)."""
    last = F.greatest(F.length(text) - length + 1, F.lit(1))
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substring(text, i, length)))


def name_pieces(named: DataFrame, asked: DataFrame, name: str = "_name", query: str = "_q") -> DataFrame:
    """One row per name and piece, in the lengths that the queries need (1, 2 or 3: at most three)."""
    sizes = asked.select(F.least(F.length(query), F.lit(PIECE)).alias("_len")).distinct()
    return named.join(F.broadcast(sizes), F.length(name) >= F.col("_len")).withColumn(
        "_piece", F.explode(_pieces(F.col(name), F.col("_len")))
    ).drop("_len")


def rarest_pieces(asked: DataFrame, pieces: DataFrame, key: str = "key", query: str = "_q") -> DataFrame:
    """``key, query, _piece, n_names``: of each query's pieces the one that fewest names hold.

    Ties go to the smaller piece. A piece that no name holds counts zero, so its query meets nothing.
    """
    held = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("n_names"))
    length = F.least(F.length(query), F.lit(PIECE))
    own = asked.select(key, query, F.explode(_pieces(F.col(query), length)).alias("_piece"))
    counted = own.join(held, "_piece", "left").withColumn(
        "n_names", F.coalesce("n_names", F.lit(0).cast("long")))
    return counted.groupBy(key, query).agg(
        F.min(F.struct("n_names", "_piece")).alias("_least")
    ).select(key, query, "_least._piece", "_least.n_names")


def resolve_names(
    specs: DataFrame, index: DataFrame, key: str = "key", query: str = "query", id_col: str = "id",
    name: str = "name", synonyms: str | None = None,
) -> DataFrame:
    """Resolve each query by exact name, then exact synonym, then substring of a name.

    The first tier with a candidate decides. Several candidates: the preferred
    prefix first, then the id; the kind gets ``_ambiguous`` and up to five
    alternatives are kept. Queries that match nothing keep one row with nulls.
    Tiers 1 and 2 are equi-joins. Tier 3, for queries still open, joins on the one of
    the query's three-letter pieces that fewest names hold and then checks ``contains``.
    """
    asked = specs.select(key, query, normalize_text(F.col(query)).alias("_q"))
    named = index.select(
        F.col(id_col).alias("match_id"), F.col(name).alias("match_name"),
        normalize_text(F.coalesce(F.col(name), F.lit(""))).alias("_name"),
        *([flatten_names(index, synonyms).alias("_syn")] if synonyms else []),
    )
    exact = asked.join(named, F.col("_q") == F.col("_name")).select(
        key, "match_id", "match_name", F.lit(1).alias("tier")
    )
    hits = exact
    if synonyms:
        spelled = named.select("match_id", "match_name", "_name", F.explode("_syn").alias("_s"))
        by_synonym = (
            asked.join(spelled.withColumn("_s", normalize_text(F.col("_s"))),
                       F.col("_q") == F.col("_s"))
            .where(F.col("_name") != F.col("_q"))
            .select(key, "match_id", "match_name", F.lit(2).alias("tier")).distinct()
        )
        hits = hits.unionByName(by_synonym)
    open_specs = asked.join(hits.select(key).distinct(), key, "left_anti").where(F.col("_q") != "")
    # a name that contains the query contains every piece of it, so also the rarest
    pieces = name_pieces(named.select("match_id", "match_name", "_name"), open_specs)
    chosen = rarest_pieces(open_specs, pieces, key).where(F.col("n_names") > 0)
    partial = (
        chosen.join(pieces, "_piece")
        .where((F.length("_name") >= F.length("_q")) & F.col("_name").contains(F.col("_q")))
        .select(key, "match_id", "match_name", F.lit(3).alias("tier")).distinct()
    )
    hits = hits.unionByName(partial)

    best_tier = hits.groupBy(key).agg(F.min("tier").alias("tier"))
    tied = hits.join(best_tier, [key, "tier"])
    counts = tied.groupBy(key, "tier").agg(F.count(F.lit(1)).alias("n_candidates"))
    order = [(~F.col("match_id").startswith(PREFERRED_PREFIX)).asc(), F.col("match_id").asc()]
    first = top_n(tied, key, order, ALTERNATIVES_KEPT + 1, "_place")
    chosen = first.groupBy(key).agg(
        F.max(F.when(F.col("_place") == 1, F.col("match_id"))).alias("match_id"),
        F.max(F.when(F.col("_place") == 1, F.col("match_name"))).alias("match_name"),
        # at most five entries
        F.transform(
            F.array_sort(F.collect_list(
                F.when(F.col("_place") > 1, F.struct("_place", "match_id"))
            )), lambda s: s["match_id"],
        ).alias("alternatives"),
    )
    kinds = F.element_at(
        F.array(F.lit("exact_name"), F.lit("exact_synonym"), F.lit("substring")), F.col("tier")
    )
    resolved = chosen.join(counts, key).select(
        key, "match_id", "match_name",
        F.concat(kinds, F.when(F.col("n_candidates") > 1, "_ambiguous").otherwise(""))
        .alias("match_kind"),
        "n_candidates", "alternatives",
    )
    return specs.select(key, query).join(resolved, key, "left")


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("match_id").isNull())


def search_groups(
    groups: DataFrame, query: str, limit: int = 10, key: str = "key", name: str = "name",
    resolved_name: str | None = None, details: DataFrame | None = None, details_on: str | None = None,
) -> DataFrame:
    """Substring search over name, resolved name and key: exact name first, then by name."""
    q = normalized_literal(query)
    fields = [F.col(name), F.translate(F.col(key), "_", " ")]
    if resolved_name:
        fields.append(F.col(resolved_name))
    match = F.lit(q == "")
    for f in fields:
        match = match | matches_substring(f, q)
    found = groups.where(match)
    if details is not None:
        found = found.join(details, details_on or key, "left")
    return _numbered(found, [(normalize_text(F.col(name)) != F.lit(q)).asc(), F.col(name).asc(),
                             F.col(key).asc()], limit)


def suggest(groups: DataFrame, prefix: str, limit: int = 10, name: str = "name") -> DataFrame:
    """Names that start with the prefix, in order."""
    q = normalized_literal(prefix)
    found = groups.where(matches_prefix(F.col(name), q)).select(name).distinct()
    return _numbered(found, [F.col(name).asc()], limit)


def _numbered(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows with their position; the limit runs before the numbering."""
    first = df.orderBy(*order).limit(n)
    w = W.partitionBy(F.lit(1)).orderBy(*order)
    return first.withColumn("position", F.row_number().over(w).cast("long"))
