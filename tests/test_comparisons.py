"""Tests of deltas, grouped shuffles, clusters of columns, pruning and the other selection methods."""

import random
import threading
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import baselines, boosting, clusters, greedy, importance, significance
from winnow.operators.metrics import score_counts
from winnow.plans.checks.boosted import fixed_model
from winnow.plans.experiment import run_experiment
from winnow.plans.matrices import orders_matrix
from winnow.session import scratch_path
from winnow.sources.registry import Dataset


@pytest.fixture(scope="module")
def rows(spark):
    """A label that follows ``plain`` and the pair ``left``, ``right`` of equal columns; ``noise`` says nothing."""
    draw = np.random.default_rng(3)
    made = []
    for i in range(1_500):
        plain, pair, noise = draw.normal(size=3)
        made.append((i, int(plain + pair + draw.normal() > 0.8), float(plain), float(pair), float(pair), float(noise), float(round(noise))))
    return spark.createDataFrame(made, "row_key long, label int, plain double, left double, right double, noise double, steps double").repartition(4).cache()


NAMES = ["plain", "left", "right", "noise", "steps"]


def average_precision(scores, y, w):
    total, gained, pos, seen = (y * w).sum(), 0.0, 0.0, 0.0
    for s in sorted(set(scores), reverse=True):
        here = scores == s
        pos, seen = pos + (y * w)[here].sum(), seen + w[here].sum()
        gained += (y * w)[here].sum() * (pos / seen if seen else 0.0)
    return gained / total if total else 0.0


def test_replicates_against_plain_weights(spark):
    draw = random.Random(1)
    made = [("m", f, i, draw.randrange(2), draw.choice([0.1, 0.2, 0.5, 0.9, draw.random()])) for f in ("", "a") for i in range(120)]
    scores = spark.createDataFrame(made, "model string, feature string, k long, y int, s double").repartition(5)
    counts = significance.replicate_counts(scores, ["model", "feature"], "y", "k", "s", replicates=20, seed=7)
    found = {r["feature"]: r for r in significance.replicate_precision(counts, ["model", "feature"], 20).collect()}
    hashes = scores.where("feature = ''").select("k", *significance.replicate_hashes("k", 20, 7))
    weights = {r["k"]: r for r in hashes.select("k", *[significance.replicate_weight(b).alias(f"w{b}") for b in range(20)]).collect()}
    for feature, row in found.items():
        own = [m for m in made if m[1] == feature]
        s, y = np.array([m[4] for m in own]), np.array([m[3] for m in own])
        assert row["pr_auc"] == pytest.approx(average_precision(s, y, np.ones(len(own))))
        for b, value in enumerate(row["replicate_pr_auc"]):
            assert value == pytest.approx(average_precision(s, y, np.array([weights[m[2]][f"w{b}"] for m in own]))), (feature, b)
    assert len(found[""]["replicate_pr_auc"]) == 20


@pytest.mark.parametrize("limits", [{}, {"PART_ROWS": 100}, {"SPREAD": 1, "CELLS": 500}])
def test_ranked_rows_agree_with_counts(spark, monkeypatch, limits):
    draw = random.Random(2)
    # A third of the rows share a score, and nothing lies above the other frequent one.
    made = [("m", f, i, int(draw.random() < 0.3), draw.choice([0.5, 0.5, 1.0, draw.random(), draw.random(), -draw.random()])) for f in ("", "a") for i in range(1500)]
    scores = spark.createDataFrame(made, "model string, feature string, k long, y int, s double").repartition(3)
    counts = significance.replicate_counts(scores, ["model", "feature"], "y", "k", "s", replicates=20, seed=7)
    wanted = {r["feature"]: r for r in significance.replicate_precision(counts, ["model", "feature"], 20).collect()}
    for name, value in {"TIED": 10**9, **limits}.items():
        monkeypatch.setattr(significance, name, value)
    found = {r["feature"]: r for r in significance.resampled_precision(scores, ["model", "feature"], "y", "k", "s", 20, 7).collect()}
    assert set(found) == set(wanted)
    for feature, row in found.items():
        assert row["pr_auc"] == pytest.approx(wanted[feature]["pr_auc"], abs=1e-12)
        assert row["replicate_pr_auc"] == pytest.approx(wanted[feature]["replicate_pr_auc"], abs=1e-12)


def test_a_frequent_score_is_dealt_over_its_slices():
    edges = [i // 64 for i in range(significance.SLICES - 1)]
    parts, spans = significance._layout(edges, significance.SPREAD)
    assert parts == list(range(significance.SLICES)) and [spans[n] for n in (0, 1, 64, 65, 128, 255)] == [0, 0, 63, 0, 63, 62]
    few, none = significance._layout(edges, 3 * significance.PART_ROWS)
    assert sorted(set(few)) == [0, 1, 2] and not any(none)


def test_rows_travel_without_their_replicates(spark, rows):
    weights = {"m": {"plain": 1.0, "left": 1.0}}
    tested = significance.delta_significance(rows, weights, ["plain", "left"], rows_per_block=500)
    tested.collect()
    plan = tested._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # A distinct score carried two longs per replicate through two shuffles.
    assert "r63" not in plan and "_r4" not in plan


def test_weights_are_poisson(spark):
    hashed = spark.range(4_000).select(*significance.replicate_hashes("id", 32))
    found = hashed.select(F.explode(F.array(*[significance.replicate_weight(b) for b in range(32)])).alias("w")).groupBy("w").count().collect()
    total = sum(r["count"] for r in found)
    shares = {r["w"]: r["count"] / total for r in found}
    assert all(abs(shares[k] - p) < 0.01 for k, p in enumerate([0.368, 0.368, 0.184, 0.061, 0.0153]))


def test_significance_tells_noise_from_signal(spark, rows):
    weights = {"m": {"plain": 1.0, "left": 1.0, "noise": 0.02}}
    found = {r["feature"]: r for r in significance.delta_significance(rows, weights, ["plain", "left", "noise", "steps"], rows_per_block=500).collect()}
    assert found["plain"]["significant"] and found["left"]["significant"] and found["plain"]["delta_low"] > 0
    # A column that no scorer uses changes nothing: every replicate counts against it.
    assert abs(found["steps"]["delta_mean"]) < 1e-12 and found["steps"]["n_nonpositive"] == significance.REPLICATES and found["steps"]["p_value"] == 1
    assert not found["noise"]["significant"] and all(r["q_value"] >= r["p_value"] for r in found.values())


def test_tree_scores_and_counts_agree(spark, sf):
    df, model = orders_matrix(spark, sf), fixed_model()
    names = list(model.features)
    scores = importance.tree_permutation_scores(df, [model], names, rows_per_block=300)
    again = score_counts(scores, ["model", "feature"], "_y").collect()
    plain = importance.tree_permutation_counts(df.repartition(3), [model], names, rows_per_block=300).collect()
    assert sorted(map(tuple, again)) == sorted((r["model"], r["feature"], r["score"], r["n_pos"], r["n_rows"]) for r in plain)
    tested = significance.delta_significance(df, [model], names, replicates=16, rows_per_block=300)
    assert {r["feature"] for r in tested.where("delta_mean > 0").collect()} >= {"sum_qty"}


def test_groups_of_one_are_single_columns(spark, rows, sf):
    weights = {"m": {"plain": 1.0, "left": 0.5, "right": 0.5}, "n": {"right": 1.0}}
    single = importance.permutation_table(importance.linear_permutation_counts(rows, weights, ["plain", "left"], rows_per_block=400)).collect()
    groups = importance.permutation_table(importance.linear_permutation_counts(rows, weights, {"plain": ["plain"], "left": ["left"]}, rows_per_block=400)).collect()
    assert single == groups
    df, model = orders_matrix(spark, sf), fixed_model()
    assert importance.permutation_importance(df, [model], ["sum_qty"]).collect() == importance.permutation_importance(df, [model], {"sum_qty": ["sum_qty"]}).collect()


def test_groups_move_whole_rows(spark, rows):
    moved = importance.group_shuffle(rows, {"pair": ["left", "right"], "plain": ["plain"]}, rows_per_block=300).collect()
    assert all(r["shuffled"][0] == r["shuffled"][1] for r in moved if r["feature"] == "pair")
    assert sorted(r["shuffled"] for r in moved) == sorted(r["value"] for r in moved)
    # Alone each of the equal columns can be stood in for; together they matter more than the sum of both.
    weights = {"m": {"plain": 1.0, "left": 0.5, "right": 0.5}}
    found = {r["feature"]: r["delta_mean"] for r in importance.permutation_table(
        importance.linear_permutation_counts(rows, weights, {"left": ["left"], "right": ["right"], "pair": ["left", "right"]})).collect()}
    assert found["pair"] > found["left"] + found["right"]


def test_tree_groups_touch_the_union_of_trees(spark, sf):
    df, model = orders_matrix(spark, sf), fixed_model()
    table = {r["feature"]: r["delta_mean"] for r in importance.permutation_importance(
        df, [model], {"both": ["sum_qty", "n_lines"], "sum_qty": ["sum_qty"], "all": list(model.features)}).collect()}
    assert table["all"] >= table["sum_qty"] - 0.05 and table["both"] > 0


def merged_one_by_one(names, similarity, least, linkage):
    """Textbook clustering: the most similar pair of clusters, first by name among equals, again and again."""
    found = {n: [n] for n in names}
    while True:
        def near(a, b):
            values = [similarity.get(frozenset((x, y)), 0.0) for x in found[a] for y in found[b]]
            return round(min(values) if linkage == "complete" else sum(values) / len(values), 12)
        pairs = sorted((-near(a, b), a, b) for a in found for b in found if a < b)
        if not pairs or -pairs[0][0] < least:
            return {n: c for c, members in found.items() for n in members}
        _, a, b = pairs[0]
        found[a] += found.pop(b)


@pytest.mark.parametrize("linkage", clusters.LINKAGES)
def test_clusters_against_merging_one_by_one(spark, linkage):
    draw = random.Random(6)
    for size, least in ((9, 0.3), (14, 0.5), (1, 0.5)):
        names = [f"c{draw.randrange(10_000)}" for _ in range(size)]
        similarity = {frozenset((a, b)): draw.random() for i, a in enumerate(names) for b in names[i + 1:] if draw.random() < 0.9}
        listed = [(*draw.sample(sorted(p), 2), s) for p, s in similarity.items()]
        pairs = spark.createDataFrame(listed, "feature_a string, feature_b string, similarity double")
        found = {r["feature"]: r["cluster"] for r in clusters.cluster_columns(names, pairs, least, linkage).collect()}
        assert found == merged_one_by_one(names, similarity, least, linkage)


def test_equal_columns_cluster(spark, rows):
    for wide in (6, 100):
        found = {r["feature"]: r for r in clusters.correlation_clusters(rows, NAMES, 0.8, wide_pairs=wide).collect()}
        assert found["left"]["cluster"] == found["right"]["cluster"] == "left" and found["left"]["representative"] == "left"
        assert found["noise"]["cluster"] == found["steps"]["cluster"] and found["plain"]["cluster_size"] == 1 and found["plain"]["merged_at"] is None
    with pytest.raises(ValueError, match="linkage"):
        clusters.correlation_clusters(rows, NAMES, linkage="single")


def test_shadows_are_shuffled_copies(spark, rows):
    first = baselines.with_shadows(rows, NAMES, rows_per_block=200)
    plain = sorted(map(tuple, first.collect()))
    assert plain == sorted(map(tuple, baselines.with_shadows(rows.repartition(7), NAMES, rows_per_block=200).collect()))
    found = first.toPandas().sort_values("row_key")
    for name in NAMES:
        assert sorted(found[name]) == sorted(found[baselines.SHADOW + name]) and abs(found[name].corr(found[baselines.SHADOW + name])) < 0.1
    assert (found[baselines.SHADOW + "left"] != found[baselines.SHADOW + "right"]).any()


def test_needed_hits_are_binomial_tails():
    for runs, columns, alpha in ((1, 1, 0.6), (12, 5, 0.05), (30, 200, 0.01)):
        for r, needed in enumerate(baselines.needed_hits(runs, columns, alpha), start=1):
            def tail(h):
                return sum(comb(r, k) for k in range(h, r + 1)) / 2**r
            assert tail(needed) * columns <= alpha and (needed == 0 or tail(needed - 1) * columns > alpha)


def test_boruta_decides_in_order(spark):
    needed = baselines.needed_hits(10, 3, 0.05)
    at = next(r for r, n in enumerate(needed, start=1) if n <= r)
    hits = [(r, f, h) for r in range(1, 11) for f, h in (("yes", int(r <= at)), ("no", int(r > at)), ("even", r % 2))]
    found = {r["feature"]: tuple(r)[1:] for r in baselines.boruta_decisions(spark.createDataFrame(hits, "run int, feature string, hit long"), 10, 3).collect()}
    assert found == {"yes": ("confirmed", at, at), "no": ("rejected", at, 0), "even": ("tentative", None, 5)}


def test_boruta_on_trees(spark, rows):
    measure = baselines.tree_measure(rows, params=boosting.BoostParams(rounds=5, depth=3))
    found = {r["feature"]: r["status"] for r in baselines.boruta(spark, ["plain", "left", "steps"], measure, runs=7, alpha=0.2).collect()}
    assert found["plain"] == found["left"] == "confirmed" and found["steps"] != "confirmed"
    assert baselines.boruta(spark, [], measure).count() == 0


def test_rejected_columns_leave(spark):
    seen = []

    def measure(active, number):
        seen.append(list(active))
        return spark.createDataFrame([(f, 1.0 if f == "a" else 0.0, 0.5) for f in active], "feature string, importance double, shadow double")

    found = {r["feature"]: (r["status"], r["hits"]) for r in baselines.boruta(spark, ["a", "b"], measure, runs=30).collect()}
    assert found["a"][0] == "confirmed" and found["b"] == ("rejected", 0) and len(seen) < 30


def test_elimination_halves(spark):
    value = {f"f{i}": float(i % 7) for i in range(11)}
    rounds = baselines.rfe(list(value), lambda active, number: spark.createDataFrame([(f, value[f]) for f in active], "feature string, importance double"), keep=2)
    assert [len(active) for _, active in rounds] == [11, 5, 2] and rounds[-1][1] == ["f5", "f6"]


def test_greedy_goes_on_from_its_log(spark):
    worth = {"a": 0.5, "b": 0.3, "c": 0.004, "d": 0.002}
    judged, path = [], scratch_path(spark, "greedy-test")

    def judge(active):
        judged.append(sorted(active))
        if len(judged) == 3:
            raise KeyboardInterrupt
        return greedy.Judgement(0.1 + sum(worth[f] for f in active), min(active, key=worth.get))

    with pytest.raises(KeyboardInterrupt):
        greedy.greedy_prune(spark, worth, judge, 0.02, path=path)
    log = greedy.greedy_prune(spark, worth, judge, 0.02, path=path)
    assert judged == [["a", "b", "c", "d"], ["a", "b", "c"], ["a", "b"], ["a", "b"], ["a"]]
    found = [(r["step"], r["removed"], r["stopped"]) for r in log.orderBy("step").collect()]
    assert found == [(0, None, False), (1, "d", False), (2, "c", False), (3, "b", True)] and greedy.chosen_features(log) == ["a", "b"]
    whole = greedy.greedy_prune(spark, worth, lambda active: greedy.Judgement(1.0, active[0]), least=2)
    assert [r["n_features"] for r in whole.orderBy("step").collect()] == [4, 3, 2]


def test_greedy_search_and_tests_by_settings(spark, sf):
    data = Dataset(orders_matrix(spark, sf).select("row_key", "label", "sum_qty", "n_lines", "sum_price", "acct_bal"))
    settings = {
        "fs": {"n_fs_models": 1, "topk_shap": 4, "fs_eval": {"neg_pos_ratio": 3}, "significance": {"enabled": True, "replicates": 16, "alpha": 0.3}, "groups": {"enabled": True, "least": 0.4}},
        "xgb_fs_params": {"n_estimators": 3, "max_depth": 3}, "xgb_final_params": {"n_estimators": 3, "max_depth": 3, "early_stopping_rounds": 2},
        "fs_search": {"mode": "greedy", "greedy": {"tolerance_relative": 0.05}},
    }
    done = run_experiment(spark, settings, data)
    kept = {r["feature"] for r in done.tables["decisions"].where("kept").collect()}
    assert "sum_qty" in kept and kept == set(greedy.chosen_features(done.tables["greedy_log"]))
    rows = {r["feature"]: r for r in done.tables["decisions"].collect()}
    assert rows["sum_qty"]["significant"] and rows["sum_qty"]["group"] == rows["n_lines"]["group"] and rows["acct_bal"]["group"] == "acct_bal"
    assert {r["model"] for r in done.tables["models"].collect()} == {"all_features", "fs_filtered"}
    assert all(r["significant"] or r["feature"] == r["group_representative"] for r in rows.values() if r["passes"])


def test_rounds_that_cannot_decide_run_side_by_side(spark):
    early = next(r for r, n in enumerate(baselines.needed_hits(12, 2, 0.5), start=1) if n <= r)
    assert early == 2
    together = threading.Barrier(early, timeout=30)

    def measure(active, number):
        if number <= early:
            together.wait()
        return spark.createDataFrame([(f, 1.0 if f == "a" else 0.0, 0.5) for f in active], "feature string, importance double, shadow double")

    found = {r["feature"]: (r["status"], r["decided_run"]) for r in baselines.boruta(spark, ["a", "b"], measure, runs=12, alpha=0.5).collect()}
    assert found == {"a": ("confirmed", early), "b": ("rejected", early)}


def test_training_tasks_follow_the_rows(spark, rows):
    with boosting.training_rows(rows, ["plain", "left"], "label", "row_key") as (held, _):
        assert held.rdd.getNumPartitions() == 1
    assert [boosting._parts_for(n) for n in (0, 90_000, 540_000, 32_000_000)] == [1, 2, 11, 128]


def test_a_round_of_shadows_is_placed_as_it_is_made(spark, rows, monkeypatch):
    names, how = ["plain", "left", "steps"], boosting.BoostParams(rounds=3, depth=3)
    both = [*names, *[baselines.SHADOW + f for f in names]]
    stored, passes, real = [], [], boosting._fills_and_count
    monkeypatch.setattr(baselines, "materialise", lambda df, label: stored.append(label) or df)
    monkeypatch.setattr(boosting, "_fills_and_count", lambda *given: passes.append(1) or real(*given))
    measure = baselines.tree_measure(rows, params=how, seed=5)
    found = {number: {r["feature"]: tuple(r)[1:] for r in measure(names, number).collect()} for number in (1, 2)}
    assert stored == [] and len(passes) == 1
    shuffled = baselines.with_shadows(rows.select("row_key", "label", *names), names, seed=5 + 2)
    model = boosting.train_gbt(shuffled, both, params=how)
    alone = {r["feature"]: r["mean_abs_shap"] for r in importance.shap_importance(shuffled, [model]).collect()}
    for f in names:
        assert found[2][f] == pytest.approx((alone[f], alone[baselines.SHADOW + f]), abs=1e-12)
    assert found[1] != found[2]


def test_fits_on_one_placement_equal_fits_alone(spark, rows, monkeypatch):
    passes, real, how = [], boosting._fills_and_count, boosting.BoostParams(rounds=3, depth=3)
    sets = [["plain", "left", "noise"], ["noise", "plain"]]
    alone = [boosting.train_gbt(rows, s, params=how) for s in sets]
    monkeypatch.setattr(boosting, "_fills_and_count", lambda *given: passes.append(1) or real(*given))
    with boosting.fits_on(rows, ["noise", "plain", "left"], params=how) as fit:
        placed = [fit("model", s) for s in sets]
    assert len(passes) == 1
    for a, b in zip(alone, placed):
        assert a.features == b.features and a.fills == b.fills and np.array_equal(a.trees.value, b.trees.value) and np.array_equal(a.trees.threshold, b.trees.threshold)
