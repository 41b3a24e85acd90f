import pytest

from evirank.operators import evidence as ev

DIMS = {
    "genetics": ["panel", "cohort"], "functional": ["screen"], "literature": ["papers"],
    "pathways": ["maps"],
}
ROWS = [  # item, source, score, count
    ("u", "panel", 0.35, 4), ("u", "cohort", 0.62, 1), ("u", "panel", 0.15, 2), ("u", "papers", 0.05, 31),
    ("v", "screen", 0.71, 6), ("v", "clinical_precedence", 0.88, 2), ("w", "papers", 0.44, 8),
    ("w", "cohort", 0.11, 3), ("w", "screen", 0.52, 5),
]


@pytest.fixture
def evidence(spark):
    return spark.createDataFrame(
        ROWS, "item_id STRING, source STRING, score DOUBLE, evidence_count LONG")


def test_max_within_a_dimension_and_null_when_absent(evidence, by):
    rows = by(ev.dimension_scores(evidence, DIMS, ["item_id"]), "item_id")
    for item in "uvw":
        for d, sources in DIMS.items():
            best = max((x for i, s, x, _ in ROWS if i == item and s in sources), default=None)
            assert rows[item][f"dim__{d}"] == best
            assert rows[item][f"missing__{d}"] == (best is None)
    assert len(rows) == 3


def test_diversity_counts_distinct_sources_and_saturates(spark, evidence, by):
    rows = by(ev.evidence_diversity(evidence, ["item_id"], saturation=4), "item_id")
    assert [rows[i]["n_evidence_types"] for i in "uvw"] == [3, 2, 3]
    assert [rows[i]["dim__evidence_diversity"] for i in "uvw"] == [0.75, 0.5, 0.75]
    few = by(ev.evidence_diversity(evidence, ["item_id"], saturation=2), "item_id")
    assert all(r["dim__evidence_diversity"] == 1.0 for r in few.values())


def test_denylist_blocks_by_derived_name_before_the_pivot(evidence):
    kept = ev.drop_denied_sources(evidence)
    assert kept.count() == len(ROWS) - 1
    assert "clinical_precedence" not in ev.source_values(kept)
    dropped = ev.denied_sources(evidence).collect()
    assert [(r["source"], r["n_rows"]) for r in dropped] == [("clinical_precedence", 1)]


def test_no_rules_keep_everything(evidence):
    assert ev.drop_denied_sources(evidence, ()).count() == len(ROWS)


def test_glob_is_escaped():
    import re

    assert re.match(ev.glob_to_regex("a.b*"), "a.bcd")
    assert not re.match(ev.glob_to_regex("a.b*"), "axbcd")


def test_required_rule_can_be_stale():
    assert ev.stale_rules(["assoc_ds__cohort_score"]) == ["clinical_source", "flag_clinical_stage"]
    live = ["assoc_ds__clinical_precedence_score", "prio__max_clinical_stage"]
    assert ev.stale_rules(live) == []


def test_pivot_keeps_absent_null(evidence, by):
    rows = by(ev.pivot_evidence(evidence, ["cohort", "papers"], ["item_id"]), "item_id")
    assert [rows[i]["assoc_ds__cohort_score"] for i in "uvw"] == [0.62, None, 0.11]
    assert [rows[i]["assoc_ds__papers_evidence_count"] for i in "uvw"] == [31, None, 8]


def test_fused_features_agree_with_the_single_operators(spark, evidence, by):
    from evirank.plans.features import FeatureConfig, evidence_features

    config = FeatureConfig(DIMS, [], [], ["cohort", "papers"])
    rows = by(evidence_features(evidence, config, ["item_id"]), "item_id")
    dims = by(ev.dimension_scores(evidence, DIMS, ["item_id"]), "item_id")
    wide = by(ev.pivot_evidence(evidence, ["cohort", "papers"], ["item_id"]), "item_id")
    for k in rows:
        for c, v in {**dims[k], **wide[k]}.items():
            assert rows[k][c] == v


def test_cooccurrence_is_never_null(spark, by):
    df = spark.createDataFrame(
        [("a", 0.5, 0, 1), ("b", None, 0, 0), ("c", 0.1, None, 0)],
        "item_id STRING, dim__genetics DOUBLE, missing__pathways INT, missing__expression INT",
    )
    rows = by(ev.cooccurrence_flags(df), "item_id")
    pathway = [rows[k]["diversity__genetics_and_pathway"] for k in "abc"]
    expression = [rows[k]["diversity__genetics_and_expression"] for k in "abc"]
    assert (pathway, expression) == ([1, 0, 0], [0, 0, 1])


def test_flag_mean_skips_nulls(spark, by):
    df = spark.createDataFrame([("a", 1, None), ("b", None, None), ("c", 1, 0)],
                               "item_id STRING, x INT, y INT")
    rows = by(ev.flag_mean(df, ["x", "y"]), "item_id")
    assert [rows[k]["dim__druggability"] for k in "abc"] == [1.0, None, 0.5]
    assert [rows[k]["missing__druggability"] for k in "abc"] == [0, 1, 0]
    counts = by(ev.nonnull_count(df, ["x", "y"]), "item_id")
    assert [counts[k]["safety__n_flags"] for k in "abc"] == [1, 0, 2]


def test_score_summary_uses_the_exact_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 3, 5, 7)], "s DOUBLE")
    row = ev.score_summary(df, "s").first()
    assert (row["median"], row["max"], row["n"]) == (4.0, 7.0, 4)


def test_config_invariants():
    from evirank.plans.features import FeatureConfig

    with pytest.raises(ValueError, match="more than one"):
        FeatureConfig({"a": ["x"], "b": ["x"]}, [], [])
    with pytest.raises(ValueError, match="forbidden"):
        FeatureConfig({"a": ["clinical_precedence"]}, [], [])


def test_column_summaries_keep_empty_columns(spark, by):
    df = spark.createDataFrame([(1.0, None, 1), (4.0, None, 2), (7.0, None, None)], "a DOUBLE, b DOUBLE, c INT")
    got = by(ev.column_summaries(df, ["a", "b", "c"]), "column")
    assert got["a"] == {"column": "a", "n": 3, "mean": 4.0, "stddev": 3.0, "min": 1.0, "max": 7.0, "median": 4.0}
    assert got["b"]["n"] == 0 and got["b"]["median"] is None and got["c"]["median"] == 1.5
