"""Ranking metrics for many score columns at once, exact and without one task per model.

Scores are first reduced to (group, score, positives, rows); running totals along the score are
taken in two levels (:mod:`winnow.functions.running`), so a model with billions of distinct scores
is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.running import running_totals


def score_counts(df: DataFrame, group: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    return df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("n_pos"), F.count(F.lit(1)).alias("n_rows")
    )


def metrics_from_counts(counts: DataFrame, group: Sequence[str], few_groups: bool = True) -> DataFrame:
    """pr_auc (average precision: tied scores are one threshold) and roc_auc (NULL for a single class).

    Average precision without any positive is 0. Groups are models, splits and the like; for groups
    that grow with the data see ``few_groups`` of :func:`winnow.functions.running.running_totals`.
    """
    group = list(group)
    ranked = running_totals(counts, group, "score", ["n_pos", "n_rows"], descending=True, few_groups=few_groups)
    gained = F.col("n_pos") * (F.col("cum_n_pos") / F.col("cum_n_rows"))
    negatives = F.col("n_rows") - F.col("n_pos")
    area = negatives * (F.col("cum_n_pos") - F.col("n_pos") / 2)
    summed = ranked.groupBy(*group).agg(
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_rows").alias("n_rows"),
        F.sum(gained).alias("_gained"),
        F.sum(area).alias("_area"),
    )
    both = F.col("n_pos").cast("double") * (F.col("n_rows") - F.col("n_pos")).cast("double")
    return summed.select(
        *group,
        "n_rows",
        "n_pos",
        F.coalesce(F.try_divide(F.col("_gained"), F.col("n_pos").cast("double")), F.lit(0.0)).alias("pr_auc"),
        F.try_divide(F.col("_area").cast("double"), both).alias("roc_auc"),
    )


def ranking_metrics(
    df: DataFrame, group: Sequence[str] = (), label: str = "label", score: str = "score", few_groups: bool = True
) -> DataFrame:
    return metrics_from_counts(score_counts(df, list(group), label, score), group, few_groups)


def average_precision(
    df: DataFrame, group: Sequence[str] = (), label: str = "label", score: str = "score", few_groups: bool = True
) -> DataFrame:
    return ranking_metrics(df, group, label, score, few_groups).select(*group, "pr_auc")


def roc_auc(
    df: DataFrame, group: Sequence[str] = (), label: str = "label", score: str = "score", few_groups: bool = True
) -> DataFrame:
    return ranking_metrics(df, group, label, score, few_groups).select(*group, "roc_auc")


def metrics_by_split(
    df: DataFrame, group: Sequence[str] = ("model",), label: str = "label", score: str = "score", split: str = "split",
    few_groups: bool = True,
) -> DataFrame:
    """Both metrics for every model on every split, in one job."""
    return ranking_metrics(df, [*group, split], label, score, few_groups)
