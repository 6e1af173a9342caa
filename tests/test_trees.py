"""Boosted trees: scoring, Shapley values and shuffling, against Spark ML and the definitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from winnow.operators import boosting as B
from winnow.operators import importance as I

FEATURES = ["a", "b", "c", "unused"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.random(2000), rng.random(2000), rng.random(2000)
    y = (a + 0.3 * b * (c > 0.5) + rng.normal(0, 0.1, 2000) > 0.7).astype(int)
    rows = [(i, int(y[i]), float(a[i]) if i % 9 else None, float(b[i]), float(c[i]), 1.0) for i in range(2000)]
    schema = "row_key bigint, label int, a double, b double, c double, unused double"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.fixture(scope="module")
def model(data):
    return B.train_gbt(data, FEATURES, params=B.BoostParams(rounds=5, depth=4, column_rate=1.0))


def test_scores_equal_spark_ml(spark, data, model):
    fitted = GBTClassificationModel.load(model.nodes_path.removesuffix("/data"))
    theirs = fitted.transform(data.withColumn("features", array_to_vector(B.feature_array(FEATURES, model.fills))))
    theirs = {r[0]: r[1] for r in theirs.select("row_key", vector_to_array("probability")[1]).collect()}
    ours = {r[0]: r[1] for r in B.predict_score(data, model, keep=["row_key"]).collect()}
    assert ours.keys() == theirs.keys()
    assert max(abs(ours[k] - theirs[k]) for k in ours) < 1e-12


def test_same_seed_same_model(data, model):
    again = B.train_gbt(data, FEATURES, params=B.BoostParams(rounds=5, depth=4, column_rate=1.0))
    assert np.array_equal(again.trees.value, model.trees.value)


def test_shapley_values_add_up(data, model):
    base = model.ensemble.expected_margin()
    for row in I.shapley_values(data, model).limit(200).collect():
        assert sum(row["phi"]) + base == pytest.approx(row["margin"], abs=1e-9)


def brute_force_shapley(ensemble, row, features):
    def expectation(tree, node, known):
        split = int(ensemble.feature[tree, node])
        if split < 0:
            return float(ensemble.value[tree, node])
        left, right = int(ensemble.left[tree, node]), int(ensemble.right[tree, node])
        if split in known:
            return expectation(tree, left if row[split] <= ensemble.threshold[tree, node] else right, known)
        share = ensemble.cover[tree, left] / ensemble.cover[tree, node]
        return share * expectation(tree, left, known) + (1 - share) * expectation(tree, right, known)

    def worth(known):
        return sum(w * expectation(t, 0, known) for t, w in enumerate(ensemble.weight))

    phi = np.zeros(features)
    for j in range(features):
        others = [i for i in range(features) if i != j]
        for size in range(features):
            scale = factorial(size) * factorial(features - 1 - size) / factorial(features)
            for chosen in combinations(others, size):
                phi[j] += scale * (worth(frozenset(chosen) | {j}) - worth(frozenset(chosen)))
    return phi


def test_shapley_values_by_definition(model):
    rows = np.random.default_rng(1).random((20, len(FEATURES)))
    fast = model.ensemble.shapley(rows)
    for i, row in enumerate(rows):
        assert fast[i] == pytest.approx(brute_force_shapley(model.ensemble, row, len(FEATURES)), abs=1e-12)


def test_prefixes_and_patience(data, model):
    curve = [r["pr_auc"] for r in B.prefix_metrics(data, model).orderBy("trees").collect()]
    assert len(curve) == 5
    assert B.best_prefix(data, model, patience=10) == (int(np.argmax(curve)) + 1, False)
    assert B.best_prefix(data, model, patience=1)[1] == any(
        all(curve[t + 1] <= max(curve[: t + 1]) for t in [i]) for i in range(4))
    stopped = B.train_gbt(data, FEATURES, params=B.BoostParams(rounds=3, depth=2, patience=1), validation=data)
    assert 1 <= stopped.used <= 3 and stopped.ensemble.size == stopped.used


def test_shuffling(data, model):
    table = {r["feature"]: r for r in I.permutation_importance(data, [model], FEATURES, rows_per_block=300).collect()}
    assert table["unused"]["delta_mean"] == 0.0 and table["unused"]["delta_std"] == 0.0
    assert max(table, key=lambda f: table[f]["delta_mean"]) == "a"
    moved = data.repartition(3, "b")
    again = {r["feature"]: r for r in I.permutation_importance(moved, [model], FEATURES, rows_per_block=300).collect()}
    assert all(again[f]["delta_mean"] == pytest.approx(table[f]["delta_mean"], abs=1e-12) for f in FEATURES)


def test_column_shuffle_is_a_permutation_without_fixed_rows(data):
    filled = data.select("row_key", "b", "c")
    for block in (300, 10_000):
        rows = I.column_shuffle(filled, ["b", "c"], rows_per_block=block).collect()
        for feature in ("b", "c"):
            mine = [r for r in rows if r["feature"] == feature]
            assert sorted(r["value"] for r in mine) == sorted(r["shuffled"] for r in mine)
            assert all(r["value"] != r["shuffled"] for r in mine)


def test_shuffled_scores_by_brute_force(data, model):
    """Score counts of one block equal a full re-evaluation of the shuffled rows."""
    counts = I.tree_permutation_counts(data, [model], ["a"], rows_per_block=5000).where("feature = 'a'").collect()
    local = data.orderBy("row_key").toPandas()
    fills = dict(zip(FEATURES, model.fills))
    x = local[FEATURES].fillna(fills).to_numpy()
    x[:, 0] = x[np.random.default_rng([42, 0, 0, 0]).permutation(len(x)), 0]
    scores, n = np.unique(model.ensemble.margin(x), return_counts=True)
    assert sorted(r["score"] for r in counts) == pytest.approx(list(scores))
    assert [r["n_rows"] for r in sorted(counts, key=lambda r: r["score"])] == list(n)


def test_gain_lists_every_feature(data, model):
    gains = {r["feature"]: r["mean_gain"] for r in I.gain_importance([model]).collect()}
    assert set(gains) == set(FEATURES) and gains["unused"] == 0.0 and max(gains, key=gains.get) == "a"


def test_parameter_names():
    found = B.BoostParams.from_names({"n_estimators": 7, "eta": 0.05, "lambda": 2.0, "min_child_weight": 3, "subsample": 0.5})
    assert (found.rounds, found.step, found.min_rows, found.row_rate) == (7, 0.05, 3, 0.5)


def test_missing_values_are_kept_apart(data, model):
    low = data.agg(F.min("a")).first()[0]
    assert model.fills[0] == pytest.approx(low - 1.0)


def test_shapley_values_add_up_beyond_the_edges(model):
    rows = np.random.default_rng(2).random((4, len(FEATURES)))
    rows[0, 0], rows[1, 1], rows[2, 2], rows[3, 0] = -np.inf, np.inf, -np.inf, np.nan
    assert model.ensemble.shapley(rows).sum(axis=1) + model.ensemble.expected_margin() == pytest.approx(model.ensemble.margin(rows), abs=1e-9)
