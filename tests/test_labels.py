import pytest

from evirank.operators import labels as lb


FAMILIES = {"north": ["north", "n-east", "n-west"], "south": ["south"]}
EVIDENCE = {  # (group, item) -> sources
    ("north", "oak"): ["assay"], ("north", "elm"): ["assay", "clinical_precedence"],
    ("north", "fir"): ["clinical_precedence"], ("north", "ash"): ["survey"],
    ("north", "yew"): ["survey", "assay"], ("south", "oak"): ["assay"], ("south", "yew"): ["assay"],
    ("south", "ash"): ["clinical_precedence"],
}
CLINICAL = [  # item, group, stage
    ("elm", "n-east", "PHASE_3"), ("elm", "north", "PHASE_1"), ("fir", "n-west", "APPROVAL"),
    ("ash", "north", "UNKNOWN"), ("yew", "n-west", "PHASE_1"), ("yew", "north", "UNKNOWN"),
    ("oak", "south", "PHASE_2_3"), ("larch", "n-east", "PHASE_3"), ("ash", "south", "PHASE_1"),
    ("yew", "elsewhere", "APPROVAL"),
]


@pytest.fixture
def built(spark):
    evidence = spark.createDataFrame(
        [(g, i, s, 0.3) for (g, i), sources in EVIDENCE.items() for s in sources],
        "group_id STRING, item_id STRING, source STRING, score DOUBLE")
    clinical = spark.createDataFrame(CLINICAL, "item_id STRING, group_direct STRING, stage STRING")
    groups = spark.createDataFrame([(g, m[1:]) for g, m in FAMILIES.items()],
                                   "group_id STRING, descendants ARRAY<STRING>")
    return lb.build_labels(evidence, clinical, lb.expand_family(groups))


def test_tri_state_labels(built, by):
    rows = by(built[0], "group_id", "item_id")
    want = {}
    for (group, item), sources in EVIDENCE.items():
        if sources == ["clinical_precedence"]:
            continue
        levels = [lb.STAGE_LEVELS[s] for i, g, s in CLINICAL if i == item and g in FAMILIES[group]]
        known = [x for x in levels if x is not None]
        if not levels:
            want[group, item] = (0, lb.NO_EVIDENCE)
        elif not known:
            want[group, item] = (None, lb.UNKNOWN_STAGE)
        elif max(known) < lb.POSITIVE_LEVEL:
            want[group, item] = (0, lb.EARLY_STAGE)
        else:
            want[group, item] = (1, lb.positive_reason(lb.POSITIVE_LEVEL))
    assert {k: (r["label"], r["label_reason"]) for k, r in rows.items()} == want
    assert {v[0] for v in want.values()} == {0, 1, None}


def test_buckets_reconcile(built, by):
    rows = by(built[1], "group_id")
    north, south = rows["north"], rows["south"]
    assert (north["n_positive"], north["n_positive_outside"], north["n_positive_dropped"]) == (1, 1, 1)
    assert north["n_family_positive"] == 3 and north["balanced"] and south["balanced"]
    assert (north["n_full_candidates"], north["n_scored_candidates"]) == (5, 4)
    assert north["n_dropped_clinical_only"] == south["n_dropped_clinical_only"] == 1
    assert north["n_excluded_unknown_stage"] == 1 and north["n_positive_direct_only"] == 0
    assert (north["family_size"], south["family_size"]) == (3, 1)
    assert (south["n_positive"], south["n_negative"], south["n_positive_direct_only"]) == (1, 1, 1)
    totals = lb.label_totals(built[1]).first()
    assert totals["n_groups"] == 2 and totals["balanced"]


def test_unknown_stage_names_raise(spark):
    df = spark.createDataFrame([("PHASE_9",), ("UNKNOWN",)], "stage STRING")
    assert [r["stage"] for r in lb.unmapped_stages(df).collect()] == ["PHASE_9"]
    with pytest.raises(ValueError, match="PHASE_9"):
        lb.check_stages(df)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [("D1", "a", 1), ("D2", "a", 1), ("D3", "a", 0), ("D1", "b", 1), ("D2", "b", 0),
         ("D1", "c", None)], "group_id STRING, item_id STRING, label INT")


def test_popularity_leaves_the_own_group_out(labels, by):
    rows = by(lb.popularity(labels.select("group_id", "item_id"), labels), "group_id", "item_id")
    n = {k: r["n_other_groups_positive"] for k, r in rows.items()}
    assert n == {("D1", "a"): 1, ("D2", "a"): 1, ("D3", "a"): 2, ("D1", "b"): 0, ("D2", "b"): 1,
                 ("D1", "c"): 0}


def test_novel_only_keeps_rows(labels, by):
    rows = by(lb.novel_only(labels), "group_id", "item_id")
    assert len(rows) == 6 and rows["D1", "a"]["label"] == 0 and rows["D1", "b"]["label"] == 1
    assert rows["D1", "c"]["label"] is None
    share = lb.recurring_share(labels).first()
    assert (share["n_positive"], share["n_recurring"]) == (3, 2)


def test_unnest_and_drug_names(spark, by):
    records = spark.createDataFrame(
        [("T", f"d{i}", "PHASE_1", [("M",), ("X",)]) for i in range(7)],
        "item STRING, drug_id STRING, stage STRING, groups ARRAY<STRUCT<gid: STRING>>")
    clinical = lb.unnest_clinical(records, "item", "stage", "groups", "gid", ["drug_id"])
    assert clinical.count() == 14
    names = spark.createDataFrame([(f"d{i}", f"N{9 - i}") for i in range(6)], "drug_id STRING, name STRING")
    family = spark.createDataFrame([("M", "M")], "group_id STRING, member STRING")
    row = lb.drug_summary(clinical, family, names).first()
    assert row["label__n_drugs"] == 7 and row["label__drug_names"] == "N4, N5, N6, N7, N8"


def test_a_stage_must_reach_the_threshold(spark):
    empty = spark.createDataFrame([], "group_id STRING, item_id STRING, source STRING")
    with pytest.raises(ValueError, match="threshold"):
        lb.build_labels(empty, empty, empty, threshold=9)
