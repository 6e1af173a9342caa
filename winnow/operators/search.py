"""Comparing feature sets: duplicate sets, candidate cap, model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.scalars import gap_penalised


def _everything():
    """All candidates or modes: bounded by the configuration."""
    return Window.partitionBy(F.lit(1))


def mark_feature_sets(sets: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Number the distinct kept sets by first appearance and decide what is evaluated.

    Adds ``set_number``, ``set_mode`` (``frontier_<n>``), ``is_duplicate`` and
    ``skipped_due_to_limit``. Sets beyond the cap, first or repeated, are skipped; a repeat of an
    evaluated set is its duplicate. No cap, zero or less means no limit.
    """
    signature = F.sha2(F.to_json("kept_features"), 256)
    first = F.min("candidate").over(Window.partitionBy("_signature"))
    marked = sets.withColumn("_signature", signature).withColumn("first_candidate", first)
    marked = marked.withColumn("set_number", F.dense_rank().over(_everything().orderBy("first_candidate")))
    limit = F.lit(max_candidates) if max_candidates and max_candidates > 0 else F.col("set_number")
    inside = F.col("set_number") <= limit
    return marked.withColumns({
        "set_mode": F.when(inside, F.concat(F.lit("frontier_"), F.col("set_number").cast("string"))),
        "is_duplicate": inside & (F.col("candidate") != F.col("first_candidate")),
        "skipped_due_to_limit": ~inside,
    }).drop("_signature")


def frontier_counts(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(~F.col("is_duplicate") & ~F.col("skipped_due_to_limit")).alias("evaluated"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(~F.col("is_duplicate") & F.col("skipped_due_to_limit")).alias("skipped"),
    )


def with_score(models: DataFrame, weight: float) -> DataFrame:
    """Add ``score`` from ``train_pr_auc`` and ``val_pr_auc``."""
    return models.withColumn("score", gap_penalised(F.col("train_pr_auc"), F.col("val_pr_auc"), weight))


def _choose(models: DataFrame, tolerance: float, by: Sequence[str], order: Sequence) -> DataFrame:
    keys = [F.col(c) for c in by] or [F.lit(1)]
    best = F.max(F.nanvl("val_pr_auc", F.lit(None).cast("double"))).over(Window.partitionBy(*keys))
    eligible = F.coalesce(F.col("val_pr_auc") >= (F.lit(1.0) - F.lit(float(tolerance))) * F.col("_best"), F.lit(False))
    ranked = models.withColumn("_best", best).withColumn("_eligible", eligible)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_eligible"), *order))
    return ranked.withColumn("selected", F.col("_eligible") & (turn == 1)).drop("_best", "_eligible")


def select_model_within_tolerance(
    models: DataFrame, tolerance: float = 0.01, weight: float = 0.0, by: Sequence[str] = ("mode",)
) -> DataFrame:
    """Mark one model per mode: within tolerance of the best val, highest score, then fewer features, then val."""
    scored = with_score(models, weight)
    order = [F.desc("score"), F.asc("feature_count"), F.desc("val_pr_auc"), F.asc("model")]
    return _choose(scored, tolerance, by, order)


def smallest_within_tolerance(models: DataFrame, tolerance: float = 0.01, by: Sequence[str] = ("mode",)) -> DataFrame:
    """Mark the smallest feature set within tolerance of the best val."""
    return _choose(models, tolerance, by, [F.asc("feature_count"), F.desc("val_pr_auc"), F.asc("model")])


def select_frontier_primary(models: DataFrame, tolerance: float = 0.01, weight: float = 0.0) -> DataFrame:
    """The one best filtered model over all candidates; ties go by mode name as text."""
    scored = with_score(models.where(F.col("model") == "fs_filtered"), weight)
    order = [F.desc("score"), F.asc("feature_count"), F.desc("val_pr_auc"), F.asc("mode")]
    return _choose(scored, tolerance, (), order).where("selected")


def identical_modes(models: DataFrame, sets: DataFrame, primary: str) -> DataFrame:
    """Modes whose sets and models equal those of the primary mode.

    ``models`` has (mode, model, feature_count, selected, metric columns); importances are shared by
    all modes, so sets and models decide.
    """
    metrics = sorted(c for c in models.columns if c.endswith("_auc"))
    prints = models.groupBy("mode").agg(
        F.sort_array(F.collect_list(F.struct("model", "feature_count", "selected", *metrics))).alias("_models")
    )
    keyed = sets.select("mode", "kept_features", "dropped_features").join(prints, "mode")
    everything = F.struct("kept_features", "dropped_features", "_models")
    mine = F.max(F.when(F.col("mode") == primary, F.sha2(F.to_json(everything), 256))).over(_everything())
    return keyed.withColumn("_same", F.sha2(F.to_json(everything), 256) == mine).where(
        F.col("_same") & (F.col("mode") != primary)
    ).select("mode")
