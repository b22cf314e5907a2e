import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsieve import plans, sources
from featsieve.operators import audit, consensus, metrics, pareto, reports, scoring, subsets
from featsieve.streaming import append_results, latest_results, pending_combinations

EQUAL = {"effectiveness": {"accuracy": 0.2, "precision": 0.2, "recall": 0.2, "f1": 0.2, "inv_far": 0.2},
         "efficiency": {"inv_training_time": 0.4, "inv_inference_time": 0.4, "inv_num_features": 0.2}}
ZONES = {"effectiveness": {"effectiveness_quantile_min": 0.67}, "balanced": {"effectiveness_quantile_min": 0.33, "efficiency_quantile_min": 0.33},
         "efficiency": {"efficiency_quantile_min": 0.67}}
RANKING = "dataset string, method string, family string, rank int, feature string, score double, status string"


def ranking_rows(method, scores, dataset="d"):
    return [(dataset, method, "filter", i + 1, f"f{i}", s, "ok") for i, s in enumerate(scores)]


def test_subset_sizes(spark):
    rows = ranking_rows("m", [10.0, 9.0, 8.5, 1.0, 0.9, 0.8, 0.7, 0.6]) + ranking_rows("flat", [1.0] * 5) + ranking_rows("one", [3.0])
    rows.append(("d", "bad", "unknown", None, "", None, "failed"))
    got = {(r["method"], r["criterion"]): r["num_features"] for r in subsets.subset_sizes(spark.createDataFrame(rows, RANKING), min_features=2).collect()}
    assert [got[("m", c)] for c in ("q25", "q50", "q75")] == [2, 4, 6]
    s = np.array([r[5] for r in rows[:8]])
    y = (s - s.min()) / (np.ptp(s) + 1e-12)
    assert got[("m", "elbow")] == np.abs(y - np.linspace(y[0], y[-1], 8)).argmax() + 1 and got[("flat", "elbow")] == 2 and got[("one", "elbow")] == 1 and got[("one", "q25")] == 1
    assert ("bad", "q25") not in got
    with pytest.raises(ValueError):
        subsets.subset_sizes(spark.createDataFrame(rows, RANKING), ("q10",)).collect()


def test_candidate_guards(spark):
    schema = "dataset string, feature_set_id string, selected_features string"
    known = spark.createDataFrame([("a",), ("b",)], "feature string")
    good = spark.createDataFrame([("d", "s1", "a;b"), ("d", "s2", "")], schema)
    assert [r["features"] for r in subsets.usable_candidates(good, known).collect()] == [["a", "b"]]
    for text in ("a;zz", "a;a"):
        with pytest.raises(ValueError):
            subsets.usable_candidates(spark.createDataFrame([("d", "s", text)], schema), known)


def loop_metrics(y, p, k):
    cm = np.zeros((k, k))
    np.add.at(cm, (y, p), 1)
    tp, fp, fn = np.diag(cm), cm.sum(0) - np.diag(cm), cm.sum(1) - np.diag(cm)
    tn = cm.sum() - tp - fp - fn
    div = lambda a, b: np.divide(a, b, out=np.zeros(k), where=b > 0)
    w = (tp + fn) / cm.sum()
    rec, spe, far = div(tp, tp + fn), div(tn, tn + fp), div(fp, fp + tn)
    return {"accuracy": tp.sum() / cm.sum(), "precision": (w * div(tp, tp + fp)).sum(), "recall": (w * rec).sum(), "f1": (w * div(2 * tp, 2 * tp + fp + fn)).sum(),
            "macro_DR": rec.mean(), "macro_FAR": far.mean(), "macro_BCI": ((rec + spe) / 2).mean(), "TP_sum": tp.sum(), "FP_sum": fp.sum(), "TN_sum": tn.sum(), "FN_sum": fn.sum()}, cm


def test_metrics_with_absent_classes(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for model, (k, used) in {"full": (4, 4), "absent": (4, 2), "single": (4, 1)}.items():
        y, p = rng.integers(0, used, 50), rng.integers(0, used, 50)
        rows += [(model, int(a), int(b)) for a, b in zip(y, p)]
        want[model] = loop_metrics(y, p, k)
    confusion = metrics.confusion_counts(spark.createDataFrame(rows, "model string, y_true int, y_pred int"), ["model"])
    for r in metrics.metrics_of(confusion, ["model"], 4).collect():
        for name, value in want[r["model"]][0].items():
            assert r[name] == pytest.approx(value), (r["model"], name)
    for r in metrics.confusion_json(confusion, ["model"], 4).collect():
        assert json.loads(r["confusion_matrix_json"]) == want[r["model"]][1].astype(int).tolist() and r["encoded_labels_json"] == "[0,1,2,3]"


def test_the_chosen_metric_source_decides(spark):
    """Three models whose order in validation is the reverse of that on the holdout."""
    holdout = {"slim": 0.61, "plain": 0.74, "wide": 0.88}
    rows = []
    for i, (name, value) in enumerate(holdout.items()):
        validation = 0.95 - value / 2
        row = {"dataset": "wind", "classifier": "tree", "feature_set_id": name, "macro_FAR": 1 - value, "cv_macro_FAR_mean": 1 - validation,
               "final_training_plus_prediction_time_s": 2.5, "final_inference_time_ms_per_sample_mean": 0.2, "num_features": 3 + i}
        for metric in metrics.CV_METRICS[:4]:
            row |= {metric: value, f"cv_{metric}_mean": validation}
        rows.append(row)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    order = {s: [r["feature_set_id"] for r in scoring.apply_scores(df, {"equal": EQUAL}, s).orderBy("effectiveness_score").collect()] for s in scoring.SOURCES}
    assert order == {"cross_validation": ["wide", "plain", "slim"], "final_test": ["slim", "plain", "wide"]}
    with pytest.raises(ValueError, match="missing columns"):
        scoring.minmax_scores(df.drop("cv_f1_mean"), "cross_validation")
    with pytest.raises(ValueError, match="sum to 1.0"):
        scoring.require_scenarios({"s": {**EQUAL, "efficiency": {"inv_training_time": 0.8}}})


def test_minmax_order_of_tests(spark):
    base = {v[0]: 1.0 for v in scoring.INPUTS.values()}
    rows = []
    for group, values in {"nan": [None, math.nan], "flat": [2.0, None], "mix": [0.0, 5.0, 10.0, math.inf, None]}.items():
        rows += [(group, "c", i, *[v if k == "accuracy" or k == "macro_FAR" else b for k, b in base.items()]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"dataset string, classifier string, i int, {', '.join(f'{k} double' for k in base)}")
    got = {(r["dataset"], r["i"]): (r["n_accuracy"], r["n_inv_far"]) for r in scoring.minmax_scores(df, "final_test").collect()}
    assert got[("nan", 0)] == (0.0, 0.0) and got[("nan", 1)] == (0.0, 0.0)
    assert got[("flat", 0)] == (1.0, 1.0) and got[("flat", 1)] == (1.0, 1.0)
    assert [got[("mix", i)] for i in range(5)] == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def brute_front(points):
    return [i for i, (a, b) in enumerate(points) if not any(x >= a and y >= b and (x > a or y > b) for x, y in points)]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        grid = 8 if g == 0 else 100_000  # many ties and exact duplicates, or hardly any
        for i, (a, b) in enumerate(rng.integers(0, grid + 1, (150, 2)) / grid):
            a = a if g < 2 else 0.5 + a / 10_000  # all in one slice
            rows.append((f"d{g}", "c", "s", f"{i:03d}", round(float(a), 12), round(float(b), 12)))
    return spark.createDataFrame(rows, "dataset string, classifier string, scenario string, feature_set_id string, effectiveness_score double, efficiency_score double").persist(), rows


def test_front_zones_and_champions_match_brute_force(scored):
    df, rows = scored
    front = pareto.pareto_front(df)
    got = {(r["dataset"], r["feature_set_id"]) for r in front.collect()}
    want, champs = set(), {}
    for d in ("d0", "d1", "d2"):
        mine = [r for r in rows if r[0] == d]
        best = [mine[i] for i in brute_front([r[4:] for r in mine])]
        want |= {(d, r[3]) for r in best}
        for zone, q in ZONES.items():
            e, s = (np.quantile([r[c] for r in best], q.get(k, 0.0)).round(12) for c, k in ((4, "effectiveness_quantile_min"), (5, "efficiency_quantile_min")))
            z = [r for r in best if r[4] >= e and r[5] >= s] or best
            ue, us = max(r[4] for r in z), max(r[5] for r in z)
            champs[(d, zone)] = min(z, key=lambda r: (round(math.sqrt((ue - r[4]) ** 2 + (us - r[5]) ** 2), 12), r[3]))[3]
    assert got == want
    found = pareto.champions(pareto.zone_members(front, ZONES))
    assert {(r["dataset"], r["zone"]): r["feature_set_id"] for r in found.collect()} == champs


@pytest.mark.parametrize("spread", ["outlier", "beyond one", "all equal", "falling line"])
def test_front_of_any_range_matches_brute_force(spark, spread):
    rng = np.random.default_rng(11)
    a, b = rng.random(300).round(3), rng.random(300).round(3)
    if spread == "outlier":
        a, b = np.append(0.5 + a[1:] / 1e6, -1e12), b  # all but one row in one slice of the first cut
    elif spread == "beyond one":
        a, b = a * 5000 - 900, b * 80 - 40
    elif spread == "all equal":
        a = np.full(300, 0.25)
    else:
        b = -a  # every point is on the front
    points = [(float(x), float(y)) for x, y in zip(a, b)]
    df = spark.createDataFrame([("d", "c", "s", i, *p) for i, p in enumerate(points)], "dataset string, classifier string, scenario string, id int, effectiveness_score double, efficiency_score double")
    for levels in (1, 2, 3):
        assert sorted(r["id"] for r in pareto.pareto_front(df, levels=levels).collect()) == brute_front(points)


def test_slices_of_a_dense_group_stay_small(spark):
    rows = [("d", "c", "s", 0.5 + i / 1e7, -i / 1e7) for i in range(3000)] + [("d", "c", "s", -1e6, 1.0)]
    df = spark.createDataFrame(rows, "dataset string, classifier string, scenario string, effectiveness_score double, efficiency_score double")
    keys = list(pareto.KEYS)
    once = pareto._above_bar(df, keys, "_c0", "effectiveness_score", "efficiency_score")
    twice = pareto._above_bar(once, [*keys, "_c0"], "_c1", "effectiveness_score", "efficiency_score")
    assert once.groupBy("_c0").count().agg({"count": "max"}).head()[0] == 3000
    assert twice.groupBy("_c0", "_c1").count().agg({"count": "max"}).head()[0] <= 4
    assert pareto.pareto_front(df).count() == 3001


def test_empty_zone_falls_back_to_the_front(spark):
    rows = [("d", "c", "s", "a", 1.0, 0.0), ("d", "c", "s", "b", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "dataset string, classifier string, scenario string, feature_set_id string, effectiveness_score double, efficiency_score double")
    members = pareto.zone_members(pareto.pareto_front(df), {"both": {"effectiveness_quantile_min": 0.9, "efficiency_quantile_min": 0.9}})
    assert members.count() == 2
    assert pareto.champions(members).head()["feature_set_id"] == "a"


@pytest.mark.parametrize("n", [1, 2, 3, 25])
def test_tiers_are_the_best_partition(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.random(n), 6)
    df = spark.createDataFrame([("d", f"f{i}", float(x)) for i, x in enumerate(v)], "dataset string, feature string, rrf_score double")
    got = consensus.consensus_tiers(df).toPandas()
    k = min(3, n)
    s = np.sort(v)
    sse = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(s, cuts))
    best = min(itertools.combinations(range(1, n), k - 1), key=sse)
    assert got.tier.nunique() == k and sorted(got.tier.value_counts()) == sorted(len(p) for p in np.split(s, best))
    assert got.groupby("tier").rrf_score.mean().is_monotonic_decreasing
    assert consensus.core_features(consensus.consensus_tiers(df)).count() == (got.tier == 1).sum()


def test_consensus_formulas(spark):
    rows = ranking_rows("a", [3.0, 2.0, 1.0]) + [("d", "b", "filter", 1, "f2", 1.0, "ok"), ("d", "x", "unknown", None, "", None, "failed")]
    got = {r["feature"]: r for r in consensus.consensus_scores(spark.createDataFrame(rows, RANKING)).collect()}
    assert got["f2"]["selection_frequency"] == 2 and got["f2"]["mean_rank"] == 2.0 and got["f2"]["borda_score"] == 4.0
    assert got["f2"]["rrf_score"] == pytest.approx(1 / 63 + 1 / 61) and set(got) == {"f0", "f1", "f2"}
    with pytest.raises(ValueError):
        consensus.require_rankings(spark.createDataFrame(rows[-1:], RANKING))


def test_reports_on_edge_cases(spark):
    schema = ("dataset string, classifier string, scenario string, scenario_idx int, zone string, feature_set_id string, method string, criterion string, selected_features string, "
              "accuracy double, f1 double, final_training_plus_prediction_time_s double, final_inference_time_ms_per_sample_mean double, num_features int")
    rows = [("d", "c", "s1", 0, "effectiveness", "x", "m", "q", "a;b", 0.8, 0.0, 2.0, 4.0, 2), ("d", "c", "s2", 1, "effectiveness", "y", "m", "q", "a", 0.4, 0.5, 1.0, 0.0, 1),
            ("d", "c", "s1", 0, "balanced", "z", "m", "q", "", 0.4, 0.5, 1.0, 2.0, 1), ("e", "c", "s1", 0, "balanced", "w", "n", "q", "q", 0.5, 0.5, 1.0, 1.0, 1)]
    champs = spark.createDataFrame(rows, schema)
    tiers = spark.createDataFrame([("d", "a", 1), ("d", "c", 1), ("d", "b", 2)], "dataset string, feature string, tier int")
    stable = {(r["dataset"], r["zone"]): r for r in reports.champion_stability(champs).collect()}
    assert stable[("d", "effectiveness")]["feature_sets_by_scenario"] == "x;y" and not stable[("d", "effectiveness")]["stable_same_feature_set_across_scenarios"]
    kept = {(r["scenario"], r["zone"]): r for r in reports.retention_cost(champs).collect()}
    assert kept[("s1", "balanced")]["accuracy_retention_vs_reference"] == 0.5 and kept[("s1", "balanced")]["f1_retention_vs_reference"] is None
    assert kept[("s2", "effectiveness")]["inference_time_reduction_factor"] is None and ("s1", "balanced") in kept and len(kept) == 3
    cover = {r["scenario"] + r["zone"] + r["dataset"]: r for r in reports.core_coverage(champs, tiers).collect()}
    assert (cover["s1effectivenessd"]["core_coverage_recall"], cover["s1effectivenessd"]["core_purity_alignment"]) == (0.5, 0.5)
    assert cover["s1balancedd"]["core_purity_alignment"] == 0.0 and cover["s1balancede"]["num_core_features"] == 0
    member = reports.core_membership(champs, tiers).filter("dataset = 'd' AND scenario = 's1' AND zone = 'effectiveness'").collect()
    assert {r["feature"]: (r["in_core"], r["in_selected"]) for r in member} == {"a": (True, True), "b": (False, True), "c": (True, False)}
    assert reports.classifier_matrix(champs, "s2").count() == 1
    assert consensus.champion_features(champs).count() == 4


def test_result_log_resumes(spark, tmp_path):
    schema = "dataset string, feature_set_id string, classifier string, v int, written_at int"
    path = str(tmp_path / "log")
    append_results(spark.createDataFrame([("d", "a", "c1", 1, 1)], schema), path)
    append_results(spark.createDataFrame([("d", "a", "c1", 2, 2), ("d", "b", "c1", 3, 2)], schema), path)
    log = spark.read.parquet(path)
    assert {(r["feature_set_id"], r["v"]) for r in latest_results(log).collect()} == {("a", 2), ("b", 3)}
    sets = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, feature_set_id string")
    assert {(r["feature_set_id"], r["classifier"]) for r in pending_combinations(sets, ["c1", "c2"], log).collect()} == {("a", "c2"), ("b", "c2")}
    assert pending_combinations(sets, ["c1"]).count() == 2


def test_combine_fills_missing_columns(spark):
    out = audit.combine([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int")])
    assert out.columns == ["a", "b"] and out.filter("b IS NULL").count() == 1


def test_whole_study(spark, tmp_path):
    rng = np.random.default_rng(11)
    x, noise = rng.normal(size=240), rng.normal(size=240)
    kind = rng.choice(["oak", "elm", "ash"], 240)
    y = np.where(x + 0.8 * (kind == "ash") + 0.5 * rng.normal(size=240) > 0.2, "tall", "low")
    (tmp_path / "trees").mkdir()
    lines = [f"{i},{a},{'' if i % 40 == 3 else k},{b},{c}" for i, (a, k, b, c) in enumerate(zip(x, kind, noise, y))]
    (tmp_path / "trees" / "t.csv").write_text("\n".join(["no,girth,kind,hum,size", *lines]) + "\n")
    spec = {"name": "trees", "display_name": "Trees", "path": str(tmp_path / "trees"), "target_col": "size", "task": "binary", "identifier_columns": ["no"],
            "missing_value_tokens": ["?", "NA"], "benign_labels": ["low"], "row_key_column": "no"}
    plan = {"methods": ["pearson", "fisher", "nope"], "criteria": ["q50"], "min_features": 2, "n_splits": 2, "classifiers": ["dt_cpu"], "repeats": 1,
            "classifier_options": {"dt_cpu": {"max_depth": 3}}, "scenarios": {"equal": EQUAL}, "zones": ZONES}
    root = str(tmp_path / "out")
    out = plans.run(spark, [spec], plan, root)
    assert out["audit"].head()["missing_values_total"] == 6
    assert {r["zone"] for r in out["champions"].collect()} == set(ZONES)
    assert [r["method"] for r in out["rankings"].filter("status = 'failed'").collect()] == ["nope"]
    assert all(r["present"] for r in out["evidence"].collect())
    best = out["evaluations"].agg(F.max("accuracy")).head()[0]
    assert best > 0.6
    again = plans.analysis_only(spark, root, plan)
    assert again["champions"].count() == out["champions"].count()
    with pytest.raises(FileNotFoundError):
        plans.analysis_only(spark, str(tmp_path / "empty"), plan)
    assert plans.validate_only(spark, [spec], 2).head()["splittable"]
    # a second run takes the stored rankings; one on changed files is refused
    before = {(r["method"], r["feature"]): r["runtime_seconds"] for r in out["rankings"].filter("status = 'ok'").collect()}
    later = plans.run(spark, [spec], plan, root)
    assert {(r["method"], r["feature"]): r["runtime_seconds"] for r in later["rankings"].filter("status = 'ok'").collect()} == before
    (tmp_path / "trees" / "t.csv").write_text("\n".join(["no,girth,kind,hum,size", *lines[:200]]) + "\n")
    with pytest.raises(ValueError, match="changed since"):
        plans.run(spark, [spec], plan, root)
