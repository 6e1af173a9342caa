"""Exact-size random samples by cut point: nothing is ranked or shuffled but one hash prefix per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordering import hash_cuts, share_out
from winnow.functions.selecting import kth_smallest


def _take(df: DataFrame, label: str, key: str, salt: str, quota) -> DataFrame:
    """Keep, per class, the first rows of the random order; ``quota(class, sizes)`` gives the count."""
    cuts = hash_cuts(
        df, [label], key, salt, lambda sizes: {(c,): {"_take": quota(c, {k[0]: n for k, n in sizes.items()})} for (c,) in sizes}
    )
    return cuts.mark(df, ["_take"]).where("_take").drop("_take")


def fs_eval_sample(
    df: DataFrame, label: str = "label", key: str = "row_key", neg_pos_ratio: float = 5, seed: int = 42
) -> DataFrame:
    """All positives and ``int(positives * ratio)`` random negatives, or all of them if fewer."""

    def quota(value, sizes):
        return sizes[value] if value == 1 else min(sizes[value], int(sizes.get(1, 0) * neg_pos_ratio))

    return _take(df, label, key, f"eval-{seed}", quota)


def downsample_majority(df: DataFrame, label: str = "label", key: str = "row_key", seed: int = 42) -> DataFrame:
    """As many random negatives as positives; a table with fewer negatives passes unchanged."""

    def quota(value, sizes):
        return sizes[value] if value == 1 else min(sizes[value], sizes.get(1, 0))

    return _take(df, label, key, f"down-{seed}", quota)


def balanced_sample(
    df: DataFrame, label: str = "label", key: str = "row_key", train_fraction: float = 2 / 3, seed: int = 42
) -> DataFrame:
    """A 1:1 sample, shuffled and cut: adds ``part`` in {train, test}."""

    def quota(value, sizes):
        positives = sizes.get(1, 0)
        if positives == 0:
            raise ValueError("no positive rows to balance")
        if sizes.get(0, 0) < positives:
            raise ValueError("not enough negative rows for a 1:1 sample")
        return positives

    sample = _take(df, label, key, f"balance-{seed}", quota)
    cut = hash_cuts(
        sample, [], key, f"shuffle-{seed}", lambda sizes: {(): {"_head": int(sizes.get((), 0) * train_fraction)}}
    )
    part = F.when(F.col("_head"), F.lit("train")).otherwise(F.lit("test"))
    return cut.mark(sample, ["_head"]).withColumn("part", part).drop("_head")


def head_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first ``rows`` rows by key. Only the key column is searched; large counts stay distributed."""
    total = df.select(key).count()
    if rows <= 0:
        return df.limit(0)
    if rows >= total:
        return df
    return df.where(F.col(key) <= F.lit(kth_smallest(df, key, rows, total)))


def train_row_subsample(
    df: DataFrame, key: str = "row_key", rows: int = 100_000, strata: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """``rows`` random rows, all if there are fewer; with ``strata`` (time buckets, say) each stratum gives its
    proportional part by largest remainder, and at least one row while ``rows`` covers the strata.
    The number of strata must be small."""
    def quotas(sizes):
        parts = share_out(min(rows, sum(sizes.values())), sizes)
        for lost in sorted(g for g, n in parts.items() if n == 0):
            rich = max(parts, key=lambda g: (parts[g], g))
            if parts[rich] > 1:
                parts[rich], parts[lost] = parts[rich] - 1, 1
        return {g: {"_take": n} for g, n in parts.items()}

    cuts = hash_cuts(df, list(strata), key, f"rows-{seed}", quotas)
    return cuts.mark(df, ["_take"]).where("_take").drop("_take")
