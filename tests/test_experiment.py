"""The workflow end to end on the orders matrix, and its error paths."""

import pytest
from pyspark.sql import functions as F

from winnow.operators import boosting
from winnow.operators.metrics import metrics_by_split
from winnow.plans import config, experiment
from winnow.plans.checks import boosted
from winnow.plans.experiment import compute_artifacts, run_experiment, train_eval_sets
from winnow.plans.matrices import orders_matrix
from winnow.session import scratch_path
from winnow.sources.registry import Dataset

SMALL = {
    "fs": {"n_fs_models": 2, "topk_shap": 5, "fs_eval": {"neg_pos_ratio": 3}},
    "xgb_fs_params": {"n_estimators": 3, "max_depth": 3},
    "xgb_final_params": {"n_estimators": 3, "max_depth": 3, "early_stopping_rounds": 2},
}


@pytest.fixture(scope="module")
def data(spark, sf):
    return Dataset(orders_matrix(spark, sf).select("row_key", "label", "sum_qty", "acct_bal", "total_price", "nation", "site"))


def test_profiles(spark, data):
    root = scratch_path(spark, "results")
    settings = config.merged(SMALL, {"prefilter": {"top_share": 0.999}})
    done = run_experiment(spark, settings, data, root)
    again = run_experiment(spark, settings, data)
    rows = {(r["mode"], r["model"]): r for r in done.tables["models"].collect()}
    assert rows == {(r["mode"], r["model"]): r for r in again.tables["models"].collect()}
    assert {m for m, _ in rows} == {"aggressive", "moderate", "mild"} and done.primary_mode == "moderate"
    assert all(sum(r["selected"] for (m, _), r in rows.items() if m == mode) == 1 for mode, _ in rows)
    # `site` is constant after encoding and is filtered; the planted column comes first.
    assert rows[("moderate", "all_features")]["feature_count"] == 4
    assert done.tables["top_kept"].first()["feature"] == "sum_qty"
    best, base = (rows[("moderate", m)]["val_pr_auc"] for m in ("fs_filtered", "all_features"))
    assert best >= 0.9 * base
    assert spark.read.parquet(f"{done.run_dir}/models").where("model = 'fs_filtered'").count() >= 1
    assert spark.read.parquet(f"{done.run_dir}/eda_class_balance").count() == 2


def test_frontier_fits_each_distinct_set_once(spark, data):
    search = {"mode": "frontier", "frontier": {
        "delta_abs_min_values": [0.0, 0.001, 0.5], "k_noise_std_values": [0.1], "rest_policies": ["keep_all", "drop_all"],
        "max_candidates": 2}}
    done = run_experiment(spark, config.merged(SMALL, {"fs_search": search}), data)
    log = {r["candidate"]: r for r in done.tables["frontier_log"].collect()}
    assert sorted(log) == [1, 2, 3, 4, 5, 6]
    owners = [r for r in log.values() if not r["is_duplicate"] and not r["skipped_due_to_limit"]]
    assert len(owners) <= 2 and all(r["val_pr_auc"] is not None and r["gap_penalty_score"] is not None for r in owners)
    assert all(r["val_pr_auc"] is None for r in log.values() if r not in owners)
    assert len(done.models) == len(owners) + 1
    chosen = done.tables["models"].where("selected").collect()
    assert [(r["mode"], r["model"]) for r in chosen] == [(done.primary_mode, "fs_filtered")]
    assert done.tables["frontier_curve"].where("is_best").count() == 1


def test_chronological_needs_a_time_column(spark, data):
    with pytest.raises(ValueError, match="time column"):
        run_experiment(spark, config.merged(SMALL, {"splits": {"strategy": "chronological"}}), data)


def test_time_holdout_and_bounded_fit(spark, sf):
    df = orders_matrix(spark, sf).select("row_key", "label", "sum_qty", F.unix_date(F.col("order_ts").cast("date")).alias("day"))
    rules = {**SMALL["fs"], "holdout_time_column": "day", "fit_rows": 500}
    table = compute_artifacts(df, ["sum_qty", "day"], rules, params=SMALL["xgb_fs_params"])
    found = {r["feature"]: r for r in table.collect()}
    assert set(found) == {"sum_qty", "day"} and found["sum_qty"]["delta_mean"] > found["day"]["delta_mean"]


def test_no_features(spark, data):
    with pytest.raises(ValueError, match="no features"):
        compute_artifacts(data.frame, [], {})


def test_overrides_merge_with_defaults():
    merged = config.merged(config.DEFAULTS, {"fs_modes": {"moderate": {"rest_policy": "drop_all"}}, "fs": {"topk_shap": 3}})
    rules = config.mode_rules(merged)
    assert list(rules) == ["aggressive", "moderate", "mild"]
    assert rules["moderate"]["rest_policy"] == "drop_all" and rules["moderate"]["topk_shap"] == 3
    assert rules["moderate"]["thresholds"] == {"delta_abs_min": 0.0025, "k_noise_std": 1.8}
    assert config.mode_rules({"fs": {"topk_shap": 1}}) == {"moderate": {"topk_shap": 1}}


def test_feature_sets_share_one_placement_of_the_rows(spark, data, monkeypatch):
    df = data.frame.select("row_key", "label", "sum_qty", "acct_bal", "total_price").withColumn(
        "split", F.when(F.col("row_key") % 5 == 0, "val").when(F.col("row_key") % 5 == 1, "test").otherwise("train"))
    sets = {"all": ["sum_qty", "acct_bal", "total_price"], "two": ["total_price", "sum_qty"], "one": ["acct_bal"]}
    placed, plain = [], boosting._fills_and_count
    monkeypatch.setattr(boosting, "_fills_and_count", lambda rows, features: placed.append(list(features)) or plain(rows, features))
    metrics, models = train_eval_sets(df, sets, params=SMALL["xgb_final_params"])
    assert placed == [["sum_qty", "acct_bal", "total_price"]]

    # The same trees and the same figures as by one fit and one scoring for each set.
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    how = boosting.BoostParams.from_names({"random_state": 42, **SMALL["xgb_final_params"], "subsample": 1.0})
    scored = None
    for name, features in sets.items():
        alone = boosting.train_gbt(train, features, "label", "row_key", how, val, name)
        assert (alone.used, alone.fills, alone.features) == (models[name].used, models[name].fills, models[name].features)
        assert (alone.trees.threshold == models[name].trees.threshold).all() and (alone.trees.value == models[name].trees.value).all()
        part = boosting.predict_score(df, alone, keep=["split", "label"]).withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    wanted = {(r["model"], r["split"]): r.asDict() for r in metrics_by_split(scored, ["model"]).collect()}
    found = {(r["model"], r["split"]): r.asDict() for r in metrics.collect()}
    assert len(found) == 9 and found.keys() == wanted.keys()
    for place, row in found.items():
        assert (row["n_rows"], row["n_pos"]) == (wanted[place]["n_rows"], wanted[place]["n_pos"])
        assert row["pr_auc"] == pytest.approx(wanted[place]["pr_auc"], abs=1e-12) and row["roc_auc"] == pytest.approx(wanted[place]["roc_auc"], abs=1e-12)


def test_holdout_is_marked_once(spark, data, monkeypatch):
    plans, plain = [], experiment.fs_ensemble

    def watched(rows, *others):
        plans.extend([rows, others[-1]])
        return plain(rows, *others)

    monkeypatch.setattr(experiment, "fs_ensemble", watched)
    df = data.frame.select("row_key", "label", "sum_qty", "acct_bal")
    table = compute_artifacts(df, ["sum_qty", "acct_bal"], {"n_fs_models": 1, "fs_eval": {"neg_pos_ratio": 3}}, params=SMALL["xgb_fs_params"])
    assert table.count() == 2
    fitted, held = plans
    assert all("md5" not in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    assert held.count() == -(-df.count() // 4) and fitted.count() + held.count() == df.count()


def test_the_registered_experiment_shuffles_every_column(spark, sf, monkeypatch):
    runs = []

    def kept(*given):
        runs.append(run_experiment(*given))
        return runs[-1]

    monkeypatch.setattr(boosted.X, "run_experiment", kept)
    assert boosted.run_experiment(spark, sf).count() == 3
    decided = runs[0].tables["decisions"]
    assert decided.where("permuted").count() == decided.count() == 3 * 14
