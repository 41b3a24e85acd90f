"""Defects found by hand: each of these failed before it was mended."""

import re
from fnmatch import fnmatchcase

import pytest

from evirank.columns import OVERALL_PREFIX
from evirank.operators.evidence import glob_to_regex, overall_scores
from evirank.operators.labels import build_labels
from evirank.operators.models import fold_path


def test_groups_never_share_a_model_folder():
    groups = ["a-b", "a_b", "a b", "a_2db", "é", "e", "_"]
    assert len({fold_path("/models", g) for g in groups}) == len(groups)


def test_globs_agree_with_fnmatch():
    names = ["a__x", "b__x", "c__x", "a\n", "[ab]", "a]", "^", "-", "a.b", "aXb", ""]
    for glob in ("*", "?__x", "[ab]__x", "[!ab]__x", "[a-b]*", "a.b", "[", "[]a]", "a?", "[!]a]", "[^a]"):
        pattern = re.compile(glob_to_regex(glob))
        assert [bool(pattern.search(n)) for n in names] == [fnmatchcase(n, glob) for n in names], glob


def test_globs_with_classes_in_spark(spark):
    df = spark.createDataFrame([("assoc_ds__a",), ("assoc_ds__c",), ("assoc_ds__b\n",)], "name string")
    kept = df.where(df.name.rlike(glob_to_regex("assoc_ds__[ab]*")))
    assert {r.name for r in kept.collect()} == {"assoc_ds__a", "assoc_ds__b\n"}


def test_overall_score_keeps_the_guarded_name(spark):
    df = spark.createDataFrame([("g", "i", 0.5, "overall")], "group_id string, item_id string, score double, aggregation_type string")
    assert overall_scores(df, "g").columns[-1].startswith(OVERALL_PREFIX)


def test_labels_refuse_a_stage_without_a_level(spark):
    evidence = spark.createDataFrame([("g", "i", "s", 0.5, 1)], "group_id string, item_id string, source string, score double, evidence_count long")
    clinical = spark.createDataFrame([("i", "g", "PHASE_4_NEW")], "item_id string, group_direct string, stage string")
    family = spark.createDataFrame([("g", "g")], "group_id string, group_direct string")
    with pytest.raises(ValueError, match="PHASE_4_NEW"):
        build_labels(evidence, clinical, family)
