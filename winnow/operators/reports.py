"""Report tables. Inputs are importances, decisions and metrics: all bounded by features and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.scalars import gap_penalised
from winnow.operators.search import with_score


def label_merge(counts: DataFrame, container_labels: DataFrame | None, file_labels: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column_name, description, dtype, non_null_count); the file's labels override the container's."""
    named = F.create_map(*[part for c, t in types.items() for part in (F.lit(c), F.lit(t))])
    out = counts.withColumnRenamed("feature", "column_name")
    out = out.join(file_labels.select("column_name", F.col("label").alias("_file")), "column_name", "left")
    if container_labels is not None:
        out = out.join(container_labels.select("column_name", F.col("label").alias("_own")), "column_name", "left")
    else:
        out = out.withColumn("_own", F.lit(None).cast("string"))
    return out.select(
        "column_name",
        F.coalesce("_file", "_own", F.lit("")).alias("description"),
        named[F.col("column_name")].alias("dtype"),
        F.col("non_null").alias("non_null_count"),
    )


def importance_outer_lookup(ranked: DataFrame, permutation: DataFrame) -> DataFrame:
    """Deltas for every ranked feature, 0 where it was not shuffled."""
    return ranked.join(permutation.select("feature", "delta_mean", "delta_std"), "feature", "left").withColumns({
        "delta_mean": F.coalesce("delta_mean", F.lit(0.0)), "delta_std": F.coalesce("delta_std", F.lit(0.0)),
    })


def rest_features(ranked: DataFrame, permutation: DataFrame, demoted: DataFrame, dropped: DataFrame) -> DataFrame:
    """Ranked features that were not shuffled or were demoted, without the dropped ones."""
    shuffled = permutation.select("feature").join(demoted.select("feature"), "feature", "left_anti")
    return ranked.join(shuffled, "feature", "left_anti").join(dropped.select("feature"), "feature", "left_anti")


def overfit_union(shap_flags: DataFrame, gain_flags: DataFrame) -> DataFrame:
    return shap_flags.select("feature").union(gain_flags.select("feature")).distinct()


def kept_dropped_complement(features: DataFrame, kept: DataFrame) -> DataFrame:
    return features.select("feature").join(kept.select("feature"), "feature", "left_anti")


def with_descriptions(table: DataFrame, descriptions: DataFrame | None) -> DataFrame:
    if descriptions is None:
        return table.withColumn("description", F.lit(""))
    one = descriptions.groupBy("feature").agg(F.max("description").alias("description"))
    return table.join(one, "feature", "left").withColumn("description", F.coalesce("description", F.lit("")))


def feature_report(decisions: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Everything known about each feature, for one or more candidates."""
    flag = F.when(F.col("shap_flag") & F.col("gain_flag"), F.lit("SHAP, Gain")).when(
        F.col("shap_flag"), F.lit("SHAP")
    ).when(F.col("gain_flag"), F.lit("Gain")).otherwise(F.lit("-"))
    return with_descriptions(decisions, descriptions).select(
        "mode", "feature", "description", "kept", "permuted", "delta_mean", "delta_std",
        (F.col("delta_mean") - F.col("threshold")).alias("delta_minus_threshold"),
        "mean_abs_shap", "mean_gain", flag.alias("overfit_flag"),
    )


def top_permutation(permutation: DataFrame, n: int = 15) -> DataFrame:
    return permutation.orderBy(F.desc("delta_mean"), "feature").limit(n)


def top_overfit(report: DataFrame, kind: str = "shap", n: int = 20) -> DataFrame:
    """Flagged features of one candidate by the flagging importance, unknown values last."""
    metric, mark = ("mean_abs_shap", "SHAP") if kind == "shap" else ("mean_gain", "Gain")
    return (
        report.where(F.col("overfit_flag").contains(mark))
        .select("feature", "description", "delta_mean", "delta_std", F.col(metric).alias("metric"))
        .orderBy(F.desc_nulls_last(F.abs("metric")), "feature")
        .limit(n)
    )


def top_kept(report: DataFrame, n: int = 20) -> DataFrame:
    columns = ["feature", "description", "delta_mean", "delta_std", "mean_abs_shap", "mean_gain"]
    return report.where("kept").select(*columns).orderBy(F.desc_nulls_last("delta_mean"), "feature").limit(n)


def metrics_table(metrics: DataFrame) -> DataFrame:
    """One row per (mode, model): <split>_pr_auc and <split>_roc_auc from long metrics."""
    wide = metrics.groupBy("mode", "model").pivot("split", ["train", "val", "test"]).agg(
        F.first("pr_auc").alias("pr_auc"), F.first("roc_auc").alias("roc_auc")
    )
    return wide


def feature_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(~F.col("kept")).alias("n_dropped"),
        F.count_if("shap_flag").alias("n_shap_flags"),
        F.count_if("gain_flag").alias("n_gain_flags"),
    )


def mode_summary(sets: DataFrame, models: DataFrame, primary: str, weight: float = 0.0) -> DataFrame:
    """Thresholds, set sizes and performance of each mode's filtered model."""
    filtered = models.where(F.col("model") == "fs_filtered").select(
        "mode", "train_pr_auc", "val_pr_auc", "test_pr_auc"
    )
    joined = sets.select(
        "mode", "n_kept", "n_dropped", "delta_abs_min", "k_noise_std", "rest_policy"
    ).join(filtered, "mode", "left")
    return with_score(joined, weight).withColumn("is_primary", F.col("mode") == primary)


def mode_ranking(models: DataFrame, primary: str, weight: float = 0.0) -> DataFrame:
    """The all-features model of the primary mode as baseline, and every filtered model, best score first."""
    baseline = models.where((F.col("mode") == primary) & (F.col("model") == "all_features")).withColumn(
        "label", F.lit("all_features (baseline)")
    )
    rest = models.where(F.col("model") == "fs_filtered").withColumn("label", F.col("mode"))
    return baseline.unionByName(rest).select(
        "label", "feature_count", "train_pr_auc", "val_pr_auc",
        (F.col("train_pr_auc") - F.col("val_pr_auc")).alias("gap"),
        gap_penalised(F.col("train_pr_auc"), F.col("val_pr_auc"), weight).alias("score"),
    ).orderBy(F.desc("score"), "label")


def frontier_curve(evaluated: DataFrame, weight: float = 0.0) -> DataFrame:
    """Evaluated candidates by feature count with train and val, the best score marked.

    ``evaluated``: (candidate, mode, feature_count, train_pr_auc, val_pr_auc). A missing metric counts as 0.
    """
    train, val = F.coalesce("train_pr_auc", F.lit(0.0)), F.coalesce("val_pr_auc", F.lit(0.0))
    scored = evaluated.withColumn("score", val - F.lit(float(weight)) * (train - val))
    best = scored.agg(F.max_by("mode", F.struct("score", -F.col("feature_count"), -F.col("candidate")))).scalar()
    return scored.withColumn("is_best", F.col("mode") == best).orderBy("feature_count", "candidate")
