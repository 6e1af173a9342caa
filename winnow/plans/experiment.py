"""The whole workflow: profile, split, encode, measure, select, compare, persist.

The driver holds configuration, column names and a few numbers per model; every row-level step is a
Spark job. Three tables are stored on the way and read back by later steps: the encoded frame, the
evaluation sample and the importances.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators import (
    cleaning, clusters, encoding, greedy, importance, profiling, reports, sampling, search, selection, significance, splitting,
)
from winnow.operators.boosting import BoostedModel, BoostParams, fs_ensemble, model_score_counts, train_sets
from winnow.operators.metrics import metrics_from_counts, score_counts
from winnow.operators.prefilters import prefilter
from winnow.plans import comparison
from winnow.plans.config import DEFAULTS, FINAL_PATIENCE, FS_PATIENCE, merged, mode_rules
from winnow.session import materialise
from winnow.sources.readers import scan_descriptions
from winnow.sources.registry import Dataset, load_dataset
from winnow.sources.writers import write_frontier_log, write_run_tables

ALL, FILTERED = "all_features", "fs_filtered"


@dataclass(frozen=True)
class Experiment:
    primary_mode: str
    tables: dict[str, DataFrame]
    run_dir: str | None = None
    models: dict[str, BoostedModel] = field(default_factory=dict, repr=False)


def profile_tables(dataset: Dataset) -> dict[str, DataFrame]:
    """What the exploratory report shows."""
    features = dataset.frame.select(*dataset.features)
    numbers = cleaning.numeric_columns(features)
    found = {
        "class_balance": profiling.class_balance(dataset.frame, dataset.label),
        "column_summary": profiling.column_summary(features),
    }
    if numbers:
        found["numeric_describe"] = profiling.numeric_describe(features, numbers)
        found["corr_with_target"] = profiling.corr_with_target(dataset.frame, numbers, dataset.label)
    if len(numbers) > 1:
        found["corr_top_pairs"] = profiling.corr_top_pairs(features, numbers)
    return found


def split_and_encode(dataset: Dataset, config: Mapping) -> DataFrame:
    """(row_key, label, split, features as numbers), stored."""
    how = config["splits"]
    sizes = {"test_size": how.get("test_size", 0.2), "val_size": how.get("val_size", 0.2)}
    df = cleaning.booleans_to_int(dataset.frame)
    if how.get("strategy") == "chronological":
        if not dataset.time_column:
            raise ValueError("a chronological split needs a dataset with a time column")
        marked = splitting.chronological_split(df, dataset.time_column, dataset.row_key, **sizes)
    else:
        marked = splitting.stratified_split(df, dataset.label, dataset.row_key, seed=how.get("random_state", 42), **sizes)
    settings = config.get("feature_engineering") or {}
    target = dict(settings.get("target_encoding") or {})
    names = {"n_splits": "folds", "random_state": "seed"}
    encoded, _ = encoding.encode_splits(
        marked, settings.get("categorical_columns"), dataset.label, dataset.row_key,
        encoding.TargetEncoding(**{names.get(k, k): v for k, v in target.items()}),
        settings.get("binary_missing_value", 0.5),
    )
    return materialise(encoded, "encoded")


def compute_artifacts(
    train: DataFrame, features: Sequence[str], rules: Mapping, label: str = "label", key: str = "row_key",
    params: Mapping | None = None, seed: int = 42,
) -> DataFrame:
    """The importance table of one rule set's measuring part (holdout, models, evaluation sample, top k).

    The holdout is stratified random, or the latest rows where the rules name a ``holdout_time_column``.
    """
    if not features:
        raise ValueError("there are no features to select from")
    seed, share = rules.get("random_state", seed), rules.get("holdout_fraction", 0.25)
    if rules.get("holdout_time_column"):
        marked = splitting.time_inner_split(train, rules["holdout_time_column"], share)
    else:
        marked = splitting.inner_holdout_split(train, label, key, share, seed)
    ratio = (rules.get("fs_eval") or {}).get("neg_pos_ratio", 5)
    wanted = [key, label, *features]
    # Stored, since a dozen passes follow and each would hash every key again.
    marked = materialise(marked.select(*wanted, "is_holdout"), "holdout")
    fit_rows, holdout = marked.where(~F.col("is_holdout")), marked.where("is_holdout")
    if rules.get("fit_rows"):
        # Importances need no more rows than this; the sample keeps the class ratio.
        fit_rows = sampling.train_row_subsample(fit_rows, key, rules["fit_rows"], [label], seed)
    evaluation = materialise(sampling.fs_eval_sample(holdout.select(*wanted), label, key, ratio, seed), "fs-eval")
    boost = BoostParams.from_names({"early_stopping_rounds": FS_PATIENCE, **(params or {})}, seed=seed)
    models = fs_ensemble(fit_rows.select(*wanted), features, label, key, rules.get("n_fs_models", 3), boost, holdout)
    shap = materialise(importance.shap_aggregate(importance.shap_importance(evaluation, models)), "shap")
    top = importance.topk_shap(shap, rules.get("topk_shap", min(50, len(features))))
    names = [r["feature"] for r in top.collect()]  # at most k names
    test, groups = rules.get("significance") or {}, rules.get("groups") or {}
    if test.get("enabled"):
        # One shuffle serves the table and the test.
        scores = materialise(importance.tree_permutation_scores(evaluation, models, names, label, key, seed), "shuffled-scores")
        permutation = importance.permutation_table(score_counts(scores, ["model", "feature"], "_y"))
        precision = significance.resampled_precision(scores, ["model", "feature"], "_y", "_key", "score", test.get("replicates", significance.REPLICATES), seed)
        tested = significance.delta_test(precision, test.get("alpha", 0.05)).select("feature", *selection.TESTED)
        permutation = permutation.join(tested, "feature", "left")
    else:
        permutation = importance.permutation_importance(evaluation, models, names, label, key, seed)
    if groups.get("enabled") and len(names) > 1:
        permutation = permutation.join(group_deltas(evaluation, models, names, groups, label, key, seed), "feature", "left")
    table = selection.artifact_table(shap, importance.gain_importance(models), permutation)
    return materialise(table, "artifacts")


def group_deltas(
    evaluation: DataFrame, models: Sequence[BoostedModel], names: Sequence[str], how: Mapping, label: str, key: str, seed: int,
) -> DataFrame:
    """(feature, group, group_representative, group_delta_mean, group_delta_std): correlated columns shuffled together."""
    found = clusters.correlation_clusters(evaluation, names, how.get("least", 0.8), how.get("linkage", "complete"))
    found = materialise(found, "column-groups")
    members: dict[str, list[str]] = {}
    for r in found.orderBy("feature").collect():  # one row per column
        members.setdefault(r["cluster"], []).append(r["feature"])
    deltas = importance.permutation_importance(evaluation, models, members, label, key, seed).select(
        F.col("feature").alias("group"), F.col("delta_mean").alias("group_delta_mean"), F.col("delta_std").alias("group_delta_std"))
    named = found.select("feature", F.col("cluster").alias("group"), F.col("representative").alias("group_representative"))
    return named.join(deltas, "group").select("feature", *selection.GROUPED)


def train_eval_sets(
    df: DataFrame, sets: Mapping[str, Sequence[str]], label: str = "label", key: str = "row_key",
    params: Mapping | None = None, seed: int = 42, parallel: int = 4,
) -> tuple[DataFrame, dict[str, BoostedModel]]:
    """Fit one model per feature set on ``train`` (stopped on ``val``); (set, split, pr_auc, roc_auc, ...) of all
    of them from one scoring pass."""
    boost = BoostParams.from_names({"early_stopping_rounds": FINAL_PATIENCE, "random_state": seed, **(params or {}), "subsample": 1.0})
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    models = train_sets(train, sets, label, key, boost, val, parallel)
    return materialise(metrics_from_counts(model_score_counts(df, models, "split", label), ["model", "split"]), "metrics"), models


def _distinct_sets(sets: DataFrame, names: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Feature lists by fit name, and the fit that serves each mode: equal lists share one fit."""
    fits: dict[str, list[str]] = {}
    owner: dict[tuple, str] = {}
    serves: dict[str, str] = {}
    for row in sets.select(names, "kept_features").orderBy("candidate").collect():  # one row per candidate
        kept = tuple(row["kept_features"])
        name = owner.setdefault(kept, row[names])
        fits.setdefault(name, list(kept))
        serves[row[names]] = name
    return fits, serves


def _model_table(spark: SparkSession, metrics: DataFrame, serves: Mapping[str, str], sizes: Mapping[str, int]) -> DataFrame:
    """(mode, model, feature_count, <split>_<metric>...): each mode's all-features and filtered model."""
    rows = [(mode, ALL, ALL, sizes[ALL]) for mode in serves]
    rows += [(mode, FILTERED, fit, sizes[fit]) for mode, fit in serves.items()]
    plan = spark.createDataFrame(rows, "mode string, model string, fit string, feature_count int")
    wide = reports.metrics_table(metrics.withColumnRenamed("model", "fit").withColumns(
        {"mode": F.lit(""), "model": F.col("fit")})).drop("mode").withColumnRenamed("model", "fit")
    return plan.join(wide, "fit").drop("fit")


#: All rules that the importances depend on; modes that agree in these share them.
ARTIFACT_KEYS = ("holdout_fraction", "holdout_time_column", "fit_rows", "n_fs_models", "topk_shap", "fs_eval", "random_state", "significance", "groups")


def run_profiles(encoded: DataFrame, features: Sequence[str], config: Mapping, label: str, key: str) -> Experiment:
    """Every named profile, on one set of importances and one fit per distinct feature set."""
    spark, seed = encoded.sparkSession, config["splits"].get("random_state", 42)
    rules = mode_rules(config)
    train = encoded.where("split = 'train'")
    measured, parts = {}, []
    for number, (mode, rule) in enumerate(rules.items(), start=1):
        shape = repr([rule.get(k) for k in ARTIFACT_KEYS])
        if shape not in measured:
            measured[shape] = compute_artifacts(train, features, rule, label, key, config.get("xgb_fs_params"), seed)
        option = selection.candidates(spark, {mode: rule}).withColumn("candidate", F.lit(number))
        parts.append(selection.select_features(measured[shape], option))
    decisions = parts[0]
    for part in parts[1:]:
        decisions = decisions.unionByName(part)
    decisions = materialise(decisions, "decisions")
    sets = selection.feature_sets(decisions)
    fits, serves = _distinct_sets(sets, "mode")
    choice = config["selection"]
    metrics, models = train_eval_sets(
        encoded, {ALL: list(features), **fits}, label, key, config.get("xgb_final_params"),
        choice.get("final_model_random_state", 42),
    )
    sizes = {ALL: len(features), **{n: len(f) for n, f in fits.items()}}
    weight = choice.get("gap_penalty_weight", 0.0)
    table = search.select_model_within_tolerance(
        _model_table(spark, metrics, serves, sizes), choice.get("val_tolerance_relative", 0.01), weight)
    primary = config.get("fs_primary_mode", "moderate")
    primary = primary if primary in rules else next(iter(rules))
    same = search.identical_modes(table, sets, primary)
    return Experiment(primary, {
        "decisions": decisions, "feature_sets": sets, "models": table, "identical_modes": same,
        "mode_summary": reports.mode_summary(sets, table, primary, weight),
        "mode_ranking": reports.mode_ranking(table, primary, weight),
        "feature_summary": reports.feature_summary(decisions),
    }, models=models)


def run_frontier(encoded: DataFrame, features: Sequence[str], config: Mapping, label: str, key: str) -> Experiment:
    """The whole grid decided in one query; only distinct sets within the cap are fitted."""
    spark, seed = encoded.sparkSession, config["splits"].get("random_state", 42)
    base, frontier, choice = config.get("fs") or {}, config["fs_search"].get("frontier") or {}, config["selection"]
    artifacts = compute_artifacts(
        encoded.where("split = 'train'"), features, base, label, key, config.get("xgb_fs_params"), seed)
    decided = selection.select_features(artifacts, selection.grid_candidates(spark, base, frontier))
    marked = materialise(search.mark_feature_sets(selection.feature_sets(decided), frontier.get("max_candidates")), "grid")
    own = marked.where(~F.col("is_duplicate") & ~F.col("skipped_due_to_limit"))
    fits, serves = _distinct_sets(own, "set_mode")
    if not fits:
        raise ValueError("the frontier search produced no feature set")
    metrics, models = train_eval_sets(
        encoded, {ALL: list(features), **fits}, label, key, config.get("xgb_final_params"),
        choice.get("final_model_random_state", 42),
    )
    weight = choice.get("gap_penalty_weight", 0.0)
    sizes = {ALL: len(features), **{n: len(f) for n, f in fits.items()}}
    table = search.with_score(_model_table(spark, metrics, serves, sizes), weight)
    best = search.select_frontier_primary(table.drop("score"), choice.get("val_tolerance_relative", 0.01), weight)
    primary = best.first()["mode"]
    table = table.withColumn("selected", (F.col("mode") == primary) & (F.col("model") == FILTERED))
    filtered = table.where(F.col("model") == FILTERED).drop("model", "feature_count", "selected")
    log = marked.drop("mode", "first_candidate", "set_number").withColumnRenamed("set_mode", "mode").join(
        filtered.withColumn("is_duplicate", F.lit(False)).withColumnRenamed("score", "gap_penalty_score"),
        ["mode", "is_duplicate"], "left")
    evaluated = log.where(~F.col("is_duplicate") & ~F.col("skipped_due_to_limit")).select(
        "candidate", "mode", F.col("n_kept").alias("feature_count"), "train_pr_auc", "val_pr_auc")
    decisions = decided.drop("mode").join(
        marked.where(~F.col("is_duplicate")).select("candidate", F.col("set_mode").alias("mode")), "candidate"
    ).where(F.col("mode").isNotNull())
    sets = own.drop("mode").withColumnRenamed("set_mode", "mode")
    return Experiment(primary, {
        "decisions": decisions, "feature_sets": sets.drop("is_duplicate", "skipped_due_to_limit", "first_candidate", "set_number"),
        "models": table, "frontier_log": log,
        "frontier_counts": search.frontier_counts(log), "frontier_curve": reports.frontier_curve(evaluated, weight),
        "mode_summary": reports.mode_summary(sets, table, primary, weight),
        "mode_ranking": reports.mode_ranking(table, primary, weight),
        "feature_summary": reports.feature_summary(decisions),
    }, models=models)


def run_greedy(encoded: DataFrame, features: Sequence[str], config: Mapping, label: str, key: str) -> Experiment:
    """Pruning by a light surrogate until validation suffers; ``fs_search.greedy`` has tolerance_relative, least_features and log_path.

    A ``log_path`` that holds the log of an interrupted search is gone on with.
    """
    spark, seed = encoded.sparkSession, config["splits"].get("random_state", 42)
    base, how, choice = config.get("fs") or {}, config["fs_search"].get("greedy") or {}, config["selection"]
    artifacts = compute_artifacts(
        encoded.where("split = 'train'"), features, base, label, key, config.get("xgb_fs_params"), seed)
    light = BoostParams.from_names(how.get("params") or config.get("xgb_fs_params") or {}, seed=seed)
    log = greedy.greedy_prune(
        spark, features, comparison.surrogate_judge(encoded, label, key, light), how.get("tolerance_relative", choice.get("val_tolerance_relative", 0.01)),
        how.get("least_features", 1), how.get("log_path"))
    kept = greedy.chosen_features(log)
    decisions = selection.select_features(artifacts, selection.candidates(spark, {"greedy": base}))
    decisions = materialise(decisions.withColumn("kept", F.col("feature").isin(kept)), "decisions")
    sets = selection.feature_sets(decisions)
    metrics, models = train_eval_sets(
        encoded, {ALL: list(features), "greedy": kept}, label, key, config.get("xgb_final_params"), choice.get("final_model_random_state", 42))
    weight = choice.get("gap_penalty_weight", 0.0)
    table = search.select_model_within_tolerance(
        _model_table(spark, metrics, {"greedy": "greedy"}, {ALL: len(features), "greedy": len(kept)}), choice.get("val_tolerance_relative", 0.01), weight)
    return Experiment("greedy", {
        "decisions": decisions, "feature_sets": sets, "models": table, "greedy_log": log,
        "mode_summary": reports.mode_summary(sets, table, "greedy", weight), "mode_ranking": reports.mode_ranking(table, "greedy", weight),
        "feature_summary": reports.feature_summary(decisions),
    }, models=models)


#: ``fs_search.mode`` and what runs it.
SEARCHES = {"profiles": run_profiles, "frontier": run_frontier, "greedy": run_greedy}


def run_experiment(
    spark: SparkSession, config: Mapping | None = None, dataset: Dataset | None = None, results_root: str | None = None
) -> Experiment:
    """Run by configuration (see :data:`winnow.plans.config.DEFAULTS`) on a registered dataset or a given one.

    With ``results_root`` the tables of the run are written to ``<root>/<dataset>/<time>``.
    """
    settings = merged(DEFAULTS, config)
    data = dataset
    # Loaders clean and deduplicate lazily; the many narrow passes that follow read one stored copy.
    if data is None:
        data = load_dataset(spark, settings["dataset"], settings.get("dataset_path"))
    data = replace(data, frame=materialise(data.frame, "clean"))
    encoded = split_and_encode(data, settings)
    features = data.features
    static = dict(settings.get("prefilter") or {})
    if static and static.pop("enabled", True):
        # Static filters see TRAIN only; encoded columns stand for their originals.
        features = prefilter(
            encoded.where("split = 'train'"), features, data.row_key, **static)
    done = SEARCHES[settings["fs_search"].get("mode", "profiles")](encoded, features, settings, data.label, data.row_key)
    paths = [p for p in [
        (settings.get("reporting") or {}).get("feature_description_path"),
        f"{settings['dataset_path'].rstrip('/')}/variable_descriptions.csv" if settings.get("dataset_path") else None,
    ] if p]
    report = reports.feature_report(done.tables["decisions"], scan_descriptions(spark, paths) if paths else None)
    one = report.where(F.col("mode") == done.primary_mode)
    tables = {
        **done.tables, "feature_report": report, "top_kept": reports.top_kept(one),
        "top_shap_overfit": reports.top_overfit(one, "shap"), "top_gain_overfit": reports.top_overfit(one, "gain"),
    }
    tables.update({f"eda_{name}": table for name, table in profile_tables(data).items()})
    run_dir = None
    if results_root:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        run_dir = f"{results_root.rstrip('/')}/{settings['dataset']}/{stamp}"
        log = tables.get("frontier_log")
        identical = tables.get("identical_modes")
        write_run_tables(run_dir, {n: t for n, t in tables.items() if n not in ("frontier_log", "identical_modes")}, identical)
        if log is not None:
            write_frontier_log(log, run_dir)
    return Experiment(done.primary_mode, tables, run_dir, done.models)
