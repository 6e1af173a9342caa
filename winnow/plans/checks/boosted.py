"""Queries around boosted trees. Training has no SQL twin; these are checked by invariants in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.trees import TreeEnsemble
from winnow.operators import boosting as B
from winnow.operators import importance as I
from winnow.plans import experiment as X
from winnow.plans.checks.encoding import SMOOTH, split_orders
from winnow.operators.encoding import encode_splits
from winnow.plans.config import merged
from winnow.plans.matrices import NUMERIC, ORDERS_SQL, events_matrix, orders_matrix, stored_once
from winnow.sources.registry import Dataset

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


FEATURES = [*NUMERIC, "priority", "segment", "nation", "line_status"]
PARAMS = B.BoostParams(rounds=6, depth=4)
_models: dict = {}


def encoded(spark, sf):
    def build():
        df = split_orders(spark, sf).select("row_key", "label", "split", *FEATURES)
        return encode_splits(df, how=SMOOTH)[0]
    return stored_once(spark, sf, "orders-all-encoded", build)


def ensemble(spark, sf):
    """Two models on TRAIN, fitted once per application and input."""
    slot = (spark.sparkContext.applicationId, sf)
    if slot not in _models:
        train = encoded(spark, sf).where("split = 'train'")
        _models[slot] = B.fs_ensemble(train, FEATURES, models=2, params=PARAMS)
    return _models[slot]


def validation(spark, sf):
    return encoded(spark, sf).where("split = 'val'")


@query("train_gbt")
def train_gbt(spark, sf):
    """Average precision and ROC area of each tree prefix on the validation rows."""
    df = encoded(spark, sf)
    model = B.train_gbt(df.where("split = 'train'"), FEATURES, params=B.BoostParams(rounds=4, depth=3, row_rate=1.0))
    return B.prefix_metrics(validation(spark, sf), model)


@query("predict_score")
def predict_score(spark, sf):
    return B.predict_score(encoded(spark, sf), ensemble(spark, sf)[0], keep=["row_key", "split", "label"])


@query("fs_ensemble")
def fs_ensemble(spark, sf):
    parts = [
        B.predict_score(validation(spark, sf), m, keep=["row_key", "label"]).withColumn("model", F.lit(m.name))
        for m in ensemble(spark, sf)
    ]
    from winnow.operators.metrics import ranking_metrics

    return ranking_metrics(parts[0].unionByName(parts[1]), ["model"])


@query("shap_importance")
def shap_importance(spark, sf):
    return I.shap_importance(validation(spark, sf), ensemble(spark, sf))


@query("shapley_values")
def shapley_values(spark, sf):
    return I.shapley_values(validation(spark, sf), ensemble(spark, sf)[0])


@query("gain_importance")
def gain_importance(spark, sf):
    return I.gain_importance(ensemble(spark, sf))


@query("permutation_importance_trees")
def permutation_trees(spark, sf):
    return I.permutation_importance(validation(spark, sf), ensemble(spark, sf), FEATURES)


@query("train_eval_sets")
def train_eval_sets(spark, sf):
    sets = {"all_features": FEATURES, "fs_filtered": ["sum_qty", "avg_disc", "n_lines"], "aggressive": ["sum_qty"]}
    return X.train_eval_sets(encoded(spark, sf), sets, params={"n_estimators": 4, "max_depth": 3, "early_stopping_rounds": 3})[0]


@query("aggressive_set_model")
def aggressive_set_model(spark, sf):
    """The one-feature model beside the full one: the third, strictest set of the comparison."""
    top = I.permutation_importance(validation(spark, sf), ensemble(spark, sf), FEATURES).limit(1).collect()
    sets = {"all_features": FEATURES, "aggressive": [r["feature"] for r in top]}
    return X.train_eval_sets(encoded(spark, sf), sets, params={"n_estimators": 3, "max_depth": 3, "early_stopping_rounds": 3})[0]


# --- a fixed small ensemble: the same evaluation code, with an SQL twin ------------------------

_LEAF = {"feature": -1, "threshold": 0.0, "left": -1, "right": -1}
FIXED_FEATURES = ("sum_qty", "avg_disc", "n_lines")
FIXED_NODES = [
    {"tree": 0, "id": 0, "feature": 0, "threshold": 150.0, "left": 1, "right": 2, "value": 0.0, "cover": 1000.0},
    {**_LEAF, "tree": 0, "id": 1, "value": -0.5, "cover": 800.0},
    {"tree": 0, "id": 2, "feature": 1, "threshold": 0.05, "left": 3, "right": 4, "value": 0.0, "cover": 200.0},
    {**_LEAF, "tree": 0, "id": 3, "value": 0.75, "cover": 150.0},
    {**_LEAF, "tree": 0, "id": 4, "value": 0.25, "cover": 50.0},
    {"tree": 1, "id": 0, "feature": 2, "threshold": 4.0, "left": 1, "right": 2, "value": 0.0, "cover": 1000.0},
    {"tree": 1, "id": 1, "feature": 0, "threshold": 100.0, "left": 3, "right": 4, "value": 0.0, "cover": 600.0},
    {**_LEAF, "tree": 1, "id": 2, "value": 0.5, "cover": 400.0},
    {**_LEAF, "tree": 1, "id": 3, "value": -0.25, "cover": 450.0},
    {**_LEAF, "tree": 1, "id": 4, "value": 0.125, "cover": 150.0},
]


def fixed_model() -> B.BoostedModel:
    trees = TreeEnsemble.from_nodes(FIXED_NODES, [1.0, 0.5])
    return B.BoostedModel(FIXED_FEATURES, (-1.0, -1.0, -1.0), trees, "", 2, "fixed")


_FIXED_SQL = f"""WITH {ORDERS_SQL}, t AS (SELECT row_key, label, coalesce(sum_qty, -1) <= 150 AS q1, coalesce(sum_qty, -1) <= 100 AS q2,
  coalesce(avg_disc, -1) <= 0.05 AS d, coalesce(n_lines, -1) <= 4 AS n FROM m),
v AS (SELECT *, CASE WHEN q1 THEN -0.5 WHEN d THEN 0.75 ELSE 0.25 END AS a_qd, CASE WHEN q1 THEN -0.5 ELSE 0.75 * 0.75 + 0.25 * 0.25 END AS a_q,
  0.8 * -0.5 + 0.2 * CASE WHEN d THEN 0.75 ELSE 0.25 END AS a_d, 0.8 * -0.5 + 0.2 * (0.75 * 0.75 + 0.25 * 0.25) AS a_,
  CASE WHEN NOT n THEN 0.5 WHEN q2 THEN -0.25 ELSE 0.125 END AS b_nq, CASE WHEN n THEN 0.75 * -0.25 + 0.25 * 0.125 ELSE 0.5 END AS b_n,
  0.6 * CASE WHEN q2 THEN -0.25 ELSE 0.125 END + 0.4 * 0.5 AS b_q, 0.6 * (0.75 * -0.25 + 0.25 * 0.125) + 0.4 * 0.5 AS b_ FROM t)"""


@query("predict_fixed_trees", f"{_FIXED_SQL} SELECT row_key, round(1 / (1 + exp(CAST(-2 * (a_qd + 0.5 * b_nq) AS DOUBLE))), 9) AS score FROM v")
def predict_fixed(spark, sf):
    scored = B.predict_score(orders_matrix(spark, sf), fixed_model(), keep=["row_key"])
    return scored.withColumn("score", F.round("score", 9))


@query("shap_fixed_trees", f"""{_FIXED_SQL}, p AS (SELECT
  0.5 * ((a_q - a_) + (a_qd - a_d)) + 0.5 * 0.5 * ((b_q - b_) + (b_nq - b_n)) AS sum_qty,
  0.5 * ((a_d - a_) + (a_qd - a_q)) AS avg_disc, 0.5 * 0.5 * ((b_n - b_) + (b_nq - b_q)) AS n_lines FROM v)
SELECT 'fixed' AS model, unnest(['sum_qty', 'avg_disc', 'n_lines']) AS feature,
  unnest([round(avg(abs(CAST(sum_qty AS DOUBLE))), 6), round(avg(abs(CAST(avg_disc AS DOUBLE))), 6), round(avg(abs(CAST(n_lines AS DOUBLE))), 6)]) AS mean_abs_shap FROM p""")
def shap_fixed(spark, sf):
    found = I.shap_importance(orders_matrix(spark, sf), [fixed_model()])
    return found.withColumn("mean_abs_shap", F.round("mean_abs_shap", 6))


SMALL = {
    "fs": {"n_fs_models": 2, "fs_eval": {"neg_pos_ratio": 3}},
    "xgb_fs_params": {"n_estimators": 4, "max_depth": 3},
    "xgb_final_params": {"n_estimators": 4, "max_depth": 3, "early_stopping_rounds": 3},
}


@query("run_experiment")
def run_experiment(spark, sf):
    """All profiles on the orders matrix, random split."""
    data = Dataset(orders_matrix(spark, sf).drop("order_ts"))
    return X.run_experiment(spark, SMALL, data).tables["mode_summary"]


@query("run_experiment_frontier")
def run_frontier(spark, sf):
    """A frontier search on the events matrix, split by time."""
    data = Dataset(
        events_matrix(spark, sf).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), time_column="ts")
    search = {"mode": "frontier", "frontier": {
        "delta_abs_min_values": [0.0, 0.002, 0.01], "k_noise_std_values": [0.1, 1.0],
        "rest_policies": ["keep_all", "drop_all"], "max_candidates": 3}}
    settings = merged(SMALL, {"splits": {"strategy": "chronological"}, "fs_search": search})
    return X.run_experiment(spark, settings, data).tables["frontier_log"]
