"""Data-quality checks: every check is a small table, every assertion names all problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evirank.columns import GROUP, ITEM, missing, source_count, source_score
from evirank.functions.text import snake_case
from evirank.operators.evidence import (
    DEFAULT_RULES,
    DenyRule,
    LeakageError,
    source_values,
    stale_rules,
    violations,
)
from evirank.operators.ranking import top_n
from evirank.operators.scoring import DISPLAY_CATEGORIES, label_derived, select_features


class SchemaError(ValueError):
    """A table does not have the columns or keys it promises."""


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_key_report(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct keys and surplus rows."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column, null count, row count: one pass."""
    counted = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
        F.count(F.lit(1)).alias("_rows"),
    )
    return counted.unpivot(["_rows"], columns, "column", "n_null").select(
        "column", "n_null", F.col("_rows").alias("n_rows")
    )


def contract_report(
    df: DataFrame, present: list[str] | None = None, key: list[str] | None = None,
    filled: list[str] | None = None,
) -> DataFrame:
    """(rule, subject, n): every breach of a table's contract, none if the table keeps it.

    ``present`` names columns that must exist, ``key`` columns that identify a row, ``filled``
    columns without nulls. Rules on absent columns are reported as absent, not evaluated.
    """
    spark, have = df.sparkSession, set(df.columns)
    named = dict.fromkeys([*(present or []), *(key or []), *(filled or [])])
    breaches = [spark.createDataFrame(
        [("absent", c, 1) for c in named if c not in have], "rule string, subject string, n long"
    )]
    if key and have.issuperset(key):
        breaches.append(unique_key_report(df, key).select(
            F.lit("repeated key").alias("rule"), F.lit(", ".join(key)).alias("subject"),
            F.col("n_duplicates").alias("n"),
        ))
    if checked := [c for c in filled or [] if c in have]:
        breaches.append(null_counts(df, checked).select(
            F.lit("null").alias("rule"), F.col("column").alias("subject"), F.col("n_null").alias("n")
        ))
    return reduce(DataFrame.unionByName, breaches).where("n > 0")


def assert_contract(df: DataFrame, **contract: list[str] | None) -> None:
    """Raise with the whole ``contract_report``; its length is bounded by the columns named."""
    if broken := contract_report(df, **contract).orderBy("rule", "subject").collect():
        raise SchemaError("; ".join(f"{r.rule} {r.subject} ({r.n})" for r in broken))


def check_leakage(
    columns: list[str], rules: tuple[DenyRule, ...] = DEFAULT_RULES, check_stale: bool = True
) -> dict[str, list[str]]:
    """Forbidden columns and (optionally) required rules that match nothing."""
    return {
        "violations": sorted(violations(columns, rules)),
        "stale": stale_rules(columns, rules) if check_stale else [],
    }


def assert_no_leakage(
    columns: list[str], rules: tuple[DenyRule, ...] = DEFAULT_RULES, check_stale: bool = True
) -> None:
    found = check_leakage(columns, rules, check_stale)
    if found["violations"] or found["stale"]:
        raise LeakageError(str(found))


def potential_columns(evidence: DataFrame, flag_fields: list[str], source: str = "source"
                      ) -> list[str]:
    """Every column the sources could produce, built or not."""
    names = [f(s) for s in source_values(evidence, source) for f in (source_score, source_count)]
    return [*names, *[f"prio__{snake_case(f)}" for f in flag_fields], "assoc_overall__score"]


def verify_rules_live(
    evidence: DataFrame, flag_fields: list[str], rules: tuple[DenyRule, ...] = DEFAULT_RULES,
    source: str = "source",
) -> None:
    """A required rule that no source could ever trigger raises."""
    stale = stale_rules(potential_columns(evidence, flag_fields, source), rules)
    if stale:
        raise LeakageError(f"stale rules: {stale}")


def leakage_probe(features: DataFrame, rules: tuple[DenyRule, ...] = DEFAULT_RULES,
                  column: str = "assoc_ds__clinical_precedence_score") -> None:
    """Inject a forbidden column; column selection must refuse it."""
    try:
        select_features(features.withColumn(column, F.lit(0.99)), rules)
    except LeakageError:
        return
    raise AssertionError("the leakage guard accepted an injected forbidden column")


def _drop_counts(steps: list[tuple[str, str, Column]]) -> list[Column]:
    """Per step the rows it sees (``t0``, ...) and those it drops (``d0``, ...)."""
    aggs, alive = [], F.lit(True)
    for i, (_, _, keep) in enumerate(steps):
        ok = F.coalesce(keep, F.lit(False))
        aggs += [F.count_if(alive).alias(f"t{i}"), F.count_if(alive & ~ok).alias(f"d{i}")]
        alive = alive & ok
    return aggs


def drop_audit(
    df: DataFrame, steps: list[tuple[str, str, Column]], example: str | None = None, examples: int = 5
) -> DataFrame:
    """Sequential filter accounting: one row per step, zeros included.

    ``steps`` are ``(stage, reason, keep)``; each sees the rows that the steps
    before it kept. The counts are one pass. With ``example`` (a column that tells rows apart)
    ``examples`` holds the smallest values, as text, among the rows that a step dropped, at most
    that many, and ``example`` the first; every task sends at most that many rows per step.
    """
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"),
            F.col(f"d{i}").alias("dropped"), F.col(f"t{i}").alias("total"),
            F.when(F.col(f"t{i}") > 0, F.col(f"d{i}") / F.col(f"t{i}") * 100.0)
            .otherwise(F.lit(0.0)).alias("pct"),
        )
        for i, (stage, reason, _) in enumerate(steps)
    ])
    counts = df.agg(*_drop_counts(steps)).select(F.inline(rows))
    none = F.array().cast("array<string>")
    if example is None:
        return counts.withColumns({"example": F.lit(None).cast("string"), "examples": none})
    dropped = df.select(
        F.coalesce(*[F.when(~F.coalesce(keep, F.lit(False)), F.lit(i))
                     for i, (_, _, keep) in enumerate(steps)]).alias("step"),
        F.col(example).cast("string").alias("_example"),
    ).where(F.col("step").isNotNull() & F.col("_example").isNotNull())
    few = top_n(dropped, "step", [F.col("_example").asc()], examples, "_place").groupBy("step").agg(
        # at most `examples` entries
        F.array_distinct(F.array_sort(F.collect_list("_example"))).alias("examples"))
    return counts.join(few, "step", "left").withColumn(
        "examples", F.coalesce("examples", none)).withColumn("example", F.get("examples", F.lit(0)))


def observed_filter(df: DataFrame, steps: list[tuple[str, str, Column]], name: str = "drops"
                    ) -> tuple[DataFrame, Observation]:
    """The rows that all steps keep, and an observation that counts the drops in that same pass.

    Once an action has run on the kept rows, :func:`observed_drops` reads the counts: nothing is
    scanned again.
    """
    seen = Observation(name)
    kept = df.observe(seen, *_drop_counts(steps))
    for _, _, keep in steps:
        kept = kept.where(keep)
    return kept, seen


def observed_drops(seen: Observation, steps: list[tuple[str, str, Column]]) -> list[dict]:
    """``step, stage, reason, dropped, total, pct`` of every step; waits for the action."""
    found = seen.get
    return [
        {"step": i, "stage": stage, "reason": reason, "dropped": found[f"d{i}"], "total": found[f"t{i}"],
         "pct": found[f"d{i}"] / found[f"t{i}"] * 100.0 if found[f"t{i}"] else 0.0}
        for i, (stage, reason, _) in enumerate(steps)
    ]


def sparse_columns(df: DataFrame, columns: list[str], group: str = GROUP) -> DataFrame:
    """``group, column`` for columns without any value inside the group."""
    known = df.groupBy(group).agg(*[F.count(c).alias(c) for c in columns])
    return known.unpivot([group], columns, "column", "n_known").where(
        F.col("n_known") == 0
    ).select(group, "column")


def check_row(name: str, problems: DataFrame) -> DataFrame:
    """``name, n_problems`` for a table of problem rows."""
    return problems.agg(F.count(F.lit(1)).alias("n_problems")).select(
        F.lit(name).alias("check"), "n_problems"
    )


def value_check(df: DataFrame, name: str, n_problems: Column) -> DataFrame:
    """``name, n_problems`` from one aggregate expression."""
    return df.agg(n_problems.cast("long").alias("n_problems")).select(
        F.lit(name).alias("check"), "n_problems"
    )


def combine(checks: list[DataFrame]) -> DataFrame:
    suite = reduce(lambda a, b: a.unionByName(b), checks)
    return suite.withColumn("passed", F.col("n_problems") == 0)


def acceptance_suite(
    features: DataFrame, ranked: DataFrame, display: DataFrame, held_out: DataFrame | None = None,
    stored: DataFrame | None = None, refit: DataFrame | None = None, group: str = GROUP,
    item: str = ITEM,
) -> DataFrame:
    """Checks on finished products: one row per check.

    With the three score tables also fold routing: stored held-out scores equal a
    fresh score by the fold model, and are not the in-sample refit's.
    """
    from evirank.operators.joins import compare

    leaked = [c for c in features.columns if label_derived(c)]
    can_fire = any(label_derived(c) for c in display.columns)
    any_missing = reduce(lambda a, b: a | b, [F.col(missing(c)) == 1 for c in DISPLAY_CATEGORIES])
    checks = [
        value_check(features, "label columns in the scored table", F.max(F.lit(len(leaked)))),
        value_check(features, "leakage check can fire", F.max(F.lit(0 if can_fire else 1))),
        check_row("groups without a ranking", features.select(group).distinct()
                  .join(ranked.select(group).distinct(), group, "left_anti")),
        value_check(ranked, "null rank, score or symbol", F.count_if(
            F.col("rank").isNull() | F.col("score").isNull() | F.col("symbol").isNull())),
        value_check(ranked, "row without its three links", F.count_if(
            F.coalesce(F.size("source_links"), F.lit(0)) != 3)),
        check_row("missing evidence not listed", features.where(any_missing).select(group, item)
                  .join(ranked.where(F.size("missing_evidence") > 0), [group, item], "left_anti")),
    ]
    if held_out is not None and stored is not None and refit is not None:
        keys = [group, item]
        checks.append(check_row("held-out score not from its fold",
                                compare(stored, held_out, keys, "score")))
        same = compare(stored, refit, keys, "score").agg(
            (F.count(F.lit(1)) == 0).cast("long").alias("n_problems")
        ).select(F.lit("held-out scores equal the refit").alias("check"), "n_problems")
        checks.append(same)
    return combine(checks)


def source_suite(
    evidence: DataFrame, groups: DataFrame, known_items: DataFrame, item_table: DataFrame,
    edges: DataFrame, memberships: DataFrame, rules: tuple[DenyRule, ...] = DEFAULT_RULES,
    min_overlap: int = 10_000, min_edges: int = 100_000, group: str = GROUP, item: str = ITEM,
    species: str = "species",
) -> DataFrame:
    """Checks on the sources before anything is built: one row per check."""
    from evirank.operators.evidence import is_denied_source
    from evirank.operators.joins import key_overlap

    overlap = key_overlap(evidence, item_table, item, min_overlap)
    return combine([
        value_check(evidence, "empty evidence", (F.count(F.lit(1)) == 0).cast("int")),
        check_row("group without items", groups.select(group).join(
            evidence.select(group).distinct(), group, "left_anti")),
        check_row("known item absent", known_items.select(item).join(
            evidence.select(item).distinct(), item, "left_anti")),
        value_check(evidence, "versioned id", F.count_if(
            F.col(item).cast("string").rlike(r"\.\d+$"))),
        value_check(overlap, "too few shared items", F.max((~F.col("enough")).cast("int"))),
        value_check(memberships, "more than one species",
                    F.greatest(F.countDistinct(species) - 1, F.lit(0))),
        value_check(edges, "too few edges", (F.count(F.lit(1)) < min_edges).cast("int")),
        value_check(evidence, "no forbidden source left to block",
                    (F.count_if(is_denied_source(F.col("source"), rules)) == 0).cast("int")),
    ])


def null_round_trip(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """``column, n_null, n_null_parquet, n_null_json``: nulls before and after both sinks.

    The table is written below ``path`` in both formats and read back with its own schema; JSON
    keeps null fields. Equal counts mean that no null became a zero, or the other way round.
    """
    kept = df.select(*columns)
    kept.write.parquet(f"{path}/parquet")
    kept.write.option("ignoreNullFields", "false").json(f"{path}/json")
    spark = df.sparkSession

    def nulls(table: DataFrame, out: str) -> DataFrame:
        return null_counts(table, columns).select("column", F.col("n_null").alias(out))

    return nulls(kept, "n_null").join(
        nulls(spark.read.schema(kept.schema).parquet(f"{path}/parquet"), "n_null_parquet"), "column"
    ).join(nulls(spark.read.schema(kept.schema).json(f"{path}/json"), "n_null_json"), "column")


def product_contract(df: DataFrame, allowed_prefixes: tuple[str, ...] = ()) -> None:
    """A ranking product carries no label field."""
    bad = [c for c in df.columns if label_derived(c) and not c.startswith(allowed_prefixes or "\0")]
    if bad:
        raise SchemaError(f"label fields in a ranking product: {bad}")
