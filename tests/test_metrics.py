import math

import pytest

from evirank.operators import metrics as mt


def frames(spark, labels, scores=None, group="g"):
    scores = scores or [float(-i) for i in range(len(labels))]
    rows = [(group, f"t{i}", s, y) for i, (s, y) in enumerate(zip(scores, labels))]
    scored = spark.createDataFrame([(g, t, s) for g, t, s, _ in rows],
                                   "group_id STRING, item_id STRING, score DOUBLE")
    known = spark.createDataFrame([(g, t, y) for g, t, _, y in rows],
                                  "group_id STRING, item_id STRING, label INT")
    return scored, known


def measure(spark, labels, names, scores=None):
    scored, known = frames(spark, labels, scores)
    ranking = tuple(n for n in names if n not in mt.CLASSIFICATION_METRICS)
    classes = tuple(n for n in names if n in mt.CLASSIFICATION_METRICS)
    row = mt.evaluate(scored, known, ranking, classes, digits=None).first()
    return {n: row[n] for n in names}


def test_hand_computed(spark):
    got = measure(spark, [1, 0, 1, 0, 0], [
        "precision_at_1", "precision_at_3", "precision_at_10", "recall_at_1", "recall_at_3",
        "ndcg_at_3", "map", "mrr", "hit_rate"])
    dcg, ideal = 1 + 1 / math.log2(4), 1 + 1 / math.log2(3)
    want = [1.0, 2 / 3, 2 / 5, 0.5, 1.0, dcg / ideal, 0.5 * (1 + 2 / 3), 1.0, 1.0]
    assert list(got.values()) == pytest.approx(want)


def test_no_positives_is_null_not_zero(spark):
    got = measure(spark, [0, 0, 0], ["precision_at_5", "recall_at_1", "ndcg_at_2", "map", "mrr",
                                     "hit_rate", "roc_auc", "pr_auc"])
    assert got.pop("precision_at_5") == 0.0
    assert set(got.values()) == {None}


def test_ideal_list_is_capped_by_the_rows(spark):
    assert measure(spark, [1], ["ndcg_at_10"])["ndcg_at_10"] == pytest.approx(1.0)


def test_auc_with_ties_and_step_wise_pr(spark):
    got = measure(spark, [1, 0, 1, 0], ["roc_auc", "pr_auc", "map"], [0.9, 0.9, 0.5, 0.5])
    # pairs: tie, win, loss, tie
    assert got["roc_auc"] == pytest.approx(0.5)
    assert got["pr_auc"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)
    assert got["map"] == pytest.approx(0.5 * (1 + 2 / 3))
    perfect = measure(spark, [1, 1, 0], ["roc_auc", "pr_auc"])
    assert list(perfect.values()) == [1.0, 1.0]


def test_threshold_metrics_and_brier(spark):
    got = measure(spark, [1, 0, 1], ["precision", "recall", "f1", "brier_score"], [0.8, 0.6, 0.2])
    want = [0.5, 0.5, 0.5, (0.04 + 0.36 + 0.64) / 3]
    assert list(got.values()) == pytest.approx(want)
    zero = measure(spark, [1, 0], ["precision", "f1"], [0.1, 0.2])
    assert list(zero.values()) == [0.0, 0.0]
    assert measure(spark, [1, 0], ["brier_score"], [3.0, 0.2])["brier_score"] is None


def test_null_labels_are_dropped(spark):
    scored, known = frames(spark, [None, 1, 0])
    row = mt.evaluate(scored, known, ("mrr",)).first()
    assert row["n_candidates"] == 2 and row["mrr"] == 1.0


def test_means_are_per_group_and_skip_undefined(spark):
    a, la = frames(spark, [1, 0], group="a")
    b, lb = frames(spark, [0, 1], group="b")
    c, lc = frames(spark, [0, 0], group="c")
    table = mt.evaluate(a.union(b).union(c), la.union(lb).union(lc), ("mrr",))
    row = mt.mean_over_groups(table, ["mrr"]).first()
    assert row["mrr"] == pytest.approx(0.75) and row["mrr_excluded"] == 1


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        mt.ranking_metric("precision_at")
    with pytest.raises(ValueError):
        mt.evaluate(*frames(spark, [1]), classification=("auc",))


def test_wins_skip_null_pairs(spark, by):
    df = spark.createDataFrame(
        [("m", "a", 0.5), ("m", "b", None), ("m", "c", 0.1), ("random", "a", 0.1),
         ("random", "b", 0.1), ("random", "c", 0.1)],
        "method STRING, group_id STRING, ndcg_at_10 DOUBLE")
    row = mt.wins(df, "random").first()
    assert (row["n_wins"], row["n_compared"]) == (1, 2)
    assert mt.all_beat_reference(mt.wins(df, "random"), 1).first()["passed"]
    matrix = by(mt.metric_matrix(df, ["m", "random"]), "group_id")
    assert matrix["b"]["m"] is None and matrix["c"]["random"] == 0.1
