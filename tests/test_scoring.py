import pytest
from pyspark.sql import functions as F

from evirank.operators import scoring as sc
from evirank.operators.evidence import LeakageError
from evirank.plans import products as pr

W = {"genetics": 0.25, "functional": 0.35, "literature": 0.4}
VALUES = {  # item -> value of each dimension
    "kappa": (0.8, None, 0.25), "sigma": (0.2, 0.6, None), "omega": (None, None, 0.9),
    "rho": (0.4, 0.4, 0.4),
}


@pytest.fixture
def features(spark):
    return spark.createDataFrame(
        [("wool", f"id-{name}", name, *v) for name, v in VALUES.items()],
        "group_id STRING, item_id STRING, symbol STRING, "
        + ", ".join(f"dim__{d} DOUBLE" for d in W))


def plain_score(values, weights):
    return sum(w * (v or 0.0) for v, w in zip(values, weights))


def test_score_contributions_and_completeness(features, by):
    rows = by(sc.weighted_score(features, W), "symbol")
    for name, values in VALUES.items():
        r = rows[name]
        assert r["prioritization_score"] == pytest.approx(plain_score(values, W.values()))
        assert r["evidence_completeness"] == pytest.approx(sum(v is not None for v in values) / 3)
        assert [r[f"contrib__{d}"] for d in W] == pytest.approx(
            [w * (v or 0.0) for v, w in zip(values, W.values())])
    assert rows["rho"]["prioritization_score"] == pytest.approx(0.4)


@pytest.mark.parametrize("weights, error", [
    ({"genetics": 0.5}, ValueError), ({"genetics": 1.5, "literature": -0.5}, ValueError),
    ({"nothing": 1.0}, KeyError)])
def test_bad_weights_raise(features, weights, error):
    with pytest.raises(error):
        sc.weighted_score(features, weights)


def test_weight_shares(spark, by):
    table = spark.createDataFrame(
        [("p", "x", 3.0), ("p", "y", 5.0), ("p", "z", 0.0), ("q", "x", 0.2)], "profile STRING, d STRING, w DOUBLE")
    rows = by(sc.weight_shares(table, ["profile"], "w", "share"), "profile", "d")
    assert {k: r["share"] for k, r in rows.items()} == pytest.approx(
        {("p", "x"): 0.375, ("p", "y"): 0.625, ("p", "z"): 0.0, ("q", "x"): 1.0})
    for bad in (-1.0, None):
        broken = table.union(spark.createDataFrame([("q", "y", bad)], table.schema))
        with pytest.raises(Exception, match="weights must be known"):
            sc.weight_shares(broken, ["profile"], "w", "share").collect()
    with pytest.raises(Exception, match="weights must be known"):
        sc.weight_shares(table.where("w = 0"), ["profile"], "w", "share").collect()
    assert sc.weight_shares(table.limit(0), ["profile"], "w", "share").count() == 0


def test_label_columns_never_reach_the_score(features):
    for name in ("label", "label__n_drugs"):
        with pytest.raises(LeakageError):
            sc.weighted_score(features.withColumn(name, F.lit(1)), W)


def test_ties_break_by_symbol_then_id(spark):
    df = spark.createDataFrame([("D", "3", "b", 1.0), ("D", "2", "a", 1.0), ("D", "1", "b", 1.0),
                                ("D", "0", None, 1.0), ("D", "9", "z", None)],
                               "group_id STRING, item_id STRING, symbol STRING, s DOUBLE")
    ranked = sc.rank_scored(df, symbol="symbol", score="s").orderBy("rank").collect()
    assert [r["item_id"] for r in ranked] == ["2", "1", "3", "0", "9"]


def test_ablation_rescales(features, by):
    rows = by(sc.ablate(features, ["literature"], W), "symbol")
    assert rows["sigma"]["prioritization_score"] == pytest.approx((0.25 * 0.2 + 0.35 * 0.6) / 0.6)
    with pytest.raises(ValueError):
        sc.ablate(features, list(W), W)


def test_explain_lists_missing_and_top(features, by):
    rows = by(sc.explain_rows(sc.weighted_score(features, W), W, top=1), "symbol")
    assert rows["kappa"]["missing_dimensions"] == ["functional"]
    assert rows["kappa"]["dimension_values"]["functional"] is None
    (best,) = rows["kappa"]["top_contributors"]
    assert best["dimension"] == "genetics" and best["contribution"] == pytest.approx(0.2)


def test_profiles_score_like_single_runs(features, by):
    profiles = {"p": W, "q": {"genetics": 1.0}}
    rows = by(sc.score_profiles(features, profiles), "profile", "item_id")
    assert rows["p", "id-rho"]["score"] == pytest.approx(0.4)
    assert rows["q", "id-omega"]["score"] == 0.0 and len(rows) == 8


def test_planned_ablations_name_the_skipped():
    profiles, skipped = sc.plan_ablations(W, {
        "no_lit": {"drop_groups": ["literature"]}, "only": {"keep_groups": ["genetics"]},
        "void": {"drop_groups": ["x"]}, "all": {"keep_groups": []}})
    assert profiles["only"] == {"genetics": 1.0} and set(skipped) == {"void", "all"}
    assert sum(profiles["no_lit"].values()) == pytest.approx(1.0)


def test_score_runs_on_a_stream(spark, features, tmp_path):
    path = str(tmp_path / "in")
    features.write.parquet(path)
    stream = sc.weighted_score(spark.readStream.schema(features.schema).parquet(path), W)
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scored").count() == len(VALUES)


DIMS = ("genetics", "evidence_diversity", "functional", "literature", "druggability")
SHOWN = ("genetics", "functional", "druggability", "pathways", "network", "expression")


def made(n=13):
    """Candidates by rule: every value is a residue of the number, some are null."""
    out = []
    for k in range(1, n + 1):
        v = {d: None if (k + j) % 7 == 0 else (k * (3 + 2 * j) ** 2 % 97) / 97 for j, d in enumerate(DIMS)}
        gone = {c: int((k * (j + 2)) % 5 == 0) for j, c in enumerate(SHOWN)}
        out.append({
            "group_id": "wool", "item_id": f"c{k:02d}", "symbol": f"sym{(k * 5) % n:02d}",
            **{f"dim__{d}": x for d, x in v.items()}, **{f"missing__{c}": m for c, m in gone.items()},
            "expr__relevant_tissue_tpm": None if k % 6 == 0 else k % 4 * 0.5,
            "prio__has_small_molecule_binder": None if k % 9 == 0 else k % 2,
            "prio__has_safety_event": -1 if k % 4 == 1 else None,
            "held": (k * 4 % n) / n,
        })
    return {r["item_id"]: r for r in out}


ROWS = made()


def expected_score(r):
    return sum(w * (r[f"dim__{d}"] or 0.0) for d, w in sc.DEFAULT_WEIGHTS.items())


def known_share(r):
    return 1 - sum(r[f"missing__{c}"] for c in SHOWN) / len(SHOWN)


@pytest.fixture
def candidates(spark):
    kinds = ("group_id STRING, item_id STRING, symbol STRING, "
             + ", ".join(f"dim__{d} DOUBLE" for d in DIMS) + ", "
             + ", ".join(f"missing__{c} INT" for c in SHOWN)
             + ", expr__relevant_tissue_tpm DOUBLE, prio__has_small_molecule_binder INT, prio__has_safety_event INT")
    return spark.createDataFrame([tuple(v for k, v in r.items() if k != "held") for r in ROWS.values()], kinds)


@pytest.fixture
def shown(spark):
    return spark.createDataFrame(
        [(r["group_id"], r["item_id"], r["held"], k) for k, r in enumerate(ROWS.values())],
        "group_id STRING, item_id STRING, held_out_score DOUBLE, n_other_groups_positive INT")


def run(candidates, shown, **kw):
    rows = pr.rank_groups(candidates, shown, **kw).orderBy("rank").collect()
    return [(r["item_id"], r["rank"]) for r in rows]


def test_ranking_and_sort_keys(candidates, shown):
    order = sorted(ROWS, key=lambda i: -expected_score(ROWS[i]))  # no ties by the rule of made()
    assert run(candidates, shown) == [(i, k) for k, i in enumerate(order, 1)]
    order = sorted(ROWS, key=lambda i: -ROWS[i]["held"])
    assert [i for i, _ in run(candidates, shown, sort_by="held_out")] == order
    with pytest.raises(ValueError):
        run(candidates, shown, sort_by="x")
    with pytest.raises(KeyError):
        run(candidates, shown, group_value="silk")


def test_filters_keep_ranks_and_nulls(candidates, shown):
    every = dict(run(candidates, shown))
    f = sc.RankingFilters
    def kept(**kw):
        got = run(candidates, shown, filters=f(**kw))
        assert all(every[i] == rank for i, rank in got)
        return {i for i, _ in got}
    def those(test):
        found = {i for i, r in ROWS.items() if test(r)}
        assert found and found != set(ROWS)
        return found
    assert kept(exclude_safety=True) == those(lambda r: r["prio__has_safety_event"] is None)
    assert kept(min_genetics=0.0) == set(every)
    assert kept(min_genetics=0.5) == those(lambda r: (r["dim__genetics"] or 0) >= 0.5)
    assert kept(relevant_tissue=True) == those(lambda r: (r["expr__relevant_tissue_tpm"] or 0) >= 1)
    assert kept(require_druggable=True) == those(lambda r: r["prio__has_small_molecule_binder"] == 1)
    assert kept(min_completeness=0.8) == those(lambda r: known_share(r) >= 0.8)
    with pytest.raises(ValueError):
        kept(item_family="kinase")
    assert len(run(candidates, shown, n=2)) == 2


def test_completeness_and_missing_list(candidates, shown, by):
    rows = by(pr.rank_groups(candidates, shown), "item_id")
    for i, r in ROWS.items():
        assert rows[i]["app_evidence_completeness"] == pytest.approx(known_share(r))
        assert set(rows[i]["missing_evidence"]) == {c for c in SHOWN if r[f"missing__{c}"]}
        assert rows[i]["evidence"]["genetics"] == r["dim__genetics"]
        assert set(rows[i]["source_links"]) == {"item", "group", "evidence"}


def test_cards(candidates, by):
    rows = by(pr.evidence_cards(candidates, limitations=("read with care",)), "item_id")
    for i, r in ROWS.items():
        unsafe = ["safety_event"] if r["prio__has_safety_event"] == -1 else []
        assert [c["category"] for c in rows[i]["contradicting"]] == unsafe
        values = [c["value"] for c in rows[i]["supporting"]]
        assert values == sorted(values, reverse=True)
        assert sum(values) == pytest.approx(rows[i]["score"]) == expected_score(r)
        assert rows[i]["limitations"] == ["read with care"]
    assert all(r["limitations"] == [] for r in by(pr.evidence_cards(candidates), "item_id").values())


def test_transparent_run(spark, candidates, by):
    best = max(ROWS, key=lambda i: expected_score(ROWS[i]))
    known = spark.createDataFrame([("wool", best), ("wool", "nowhere")], "group_id STRING, item_id STRING")
    done = pr.transparent_run(candidates, known, n=3)
    row = done.acceptance.first()
    assert (row["n_known"], row["n_reached"], row["passed"]) == (2, 1, False)
    assert done.movement.count() == 3


def test_select_features_and_dropped_dimension(candidates):
    columns = sc.select_features(candidates)
    assert "symbol" not in columns and "dim__genetics" in columns
    with pytest.raises(LeakageError):
        sc.select_features(candidates.withColumn("assoc_overall__score", F.lit(1.0)))
    bare = sc.drop_dimension_columns(candidates, "literature", ["x"]).columns
    assert "dim__literature" not in bare and "dim__evidence_diversity" not in bare


def test_nulls_survive_the_sinks(spark, candidates, shown, tmp_path, by):
    product = pr.rank_groups(candidates, shown)
    for kind in ("json", "parquet"):
        path = str(tmp_path / kind)
        product.write.format(kind).save(path)
        back = by(spark.read.schema(product.schema).format(kind).load(path), "item_id")
        for i, r in ROWS.items():
            assert back[i]["evidence"].get("genetics") == r["dim__genetics"]


def _wide(spark):
    rows = [("g", i, 0.1 * i, None if i % 2 else 1.0, 0.5, 0.2, None, -1 if i in (8, 9) else None) for i in range(10)]
    return spark.createDataFrame(rows, "group_id STRING, item_id INT, dim__genetics DOUBLE, "
                                 "dim__evidence_diversity DOUBLE, dim__functional DOUBLE, dim__literature DOUBLE, "
                                 "dim__druggability DOUBLE, prio__has_safety_event INT")


def test_safety_first_filters_after_the_rank(spark):
    got = sc.rank_scenarios(_wide(spark), sc.SCENARIOS, n=3, digits=9).collect()
    first = {(r["profile"]): [] for r in got}
    for r in sorted(got, key=lambda r: r["rank"]):
        first[r["profile"]].append((r["rank"], r["item_id"]))
    assert set(first) == set(sc.SCENARIOS)
    assert first["research"] == [(1, 8), (2, 6), (3, 4)]
    safe = sc.rank_scenarios(_wide(spark), {"safety_first": sc.SCENARIOS["safety_first"]}).collect()
    assert len(safe) == 8 and min(r["rank"] for r in safe) == 2


def test_custom_scenarios_are_rescaled_or_refused():
    own = sc.custom_scenario({"genetics": 3, "literature": 1, "functional": 0})
    assert own.weights == {"genetics": 0.75, "literature": 0.25}
    for bad in ({"genetics": -1.0}, {"genetics": 0.0}, {}, {"genetics": float("nan")}):
        with pytest.raises(ValueError):
            sc.custom_scenario(bad)


def test_weighted_explanations_carry_links_and_limits(spark):
    from evirank.operators.attributions import explain_weighted
    from evirank.plans.products import pair_explanations

    out = pair_explanations(explain_weighted(_wide(spark), n=2), ("a", "b")).where("item_id = 9").first()
    assert [f["feature"] for f in out["top_positive_factors"]] == ["dim__genetics", "dim__functional"]
    assert [f["place"] for f in out["top_positive_factors"]] == [1, 2] and out["top_negative_factors"] == []
    assert out["evidence_missing"] == ["druggability", "evidence_diversity"]
    assert out["evidence_present"] == ["functional", "genetics", "literature"]
    assert len(out["source_links"]) == 3 and out["limitations"] == ["a", "b"]


def test_profile_comparison_reports_scopes_and_skipped_ablations(spark, by):
    from evirank.plans.comparison import compare_profiles

    feats = _wide(spark)
    feats = feats.unionByName(feats.withColumn("group_id", F.lit("h")))
    labels = feats.select("group_id", "item_id", (
        (F.col("item_id") == 9) | ((F.col("group_id") == "h") & (F.col("item_id") == 0))).cast("int").alias("label"))
    got = by(compare_profiles(feats, labels, {"base": sc.DEFAULT_WEIGHTS}, "base", {
        "no_genetics": {"drop_groups": ["genetics"]}, "all": {"drop_groups": list(sc.DEFAULT_WEIGHTS)},
        "other": {"drop_groups": ["absent"]}}), "profile", "scope")
    assert set(got) == {("base", "primary"), ("base", "novel_only"), ("no_genetics", "primary"),
                        ("no_genetics", "novel_only"), ("all", None), ("other", None)}
    assert got["other", None]["skipped"] == "drops no scored dimension" and got["all", None]["ndcg_at_10"] is None
    # item 9 is positive in both groups, so group g has no novel positive
    assert got["base", "novel_only"]["ndcg_at_10_excluded"] == 1
    assert got["base", "primary"]["ndcg_at_10_excluded"] == 0 and got["base", "primary"]["precision_at_10"] == 0.15
