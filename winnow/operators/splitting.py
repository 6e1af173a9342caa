"""TRAIN/VAL/TEST marking, inner holdout and folds.

A split is a ``split`` (or ``fold``) column on the one frame. Marking is a comparison of each row
with a few cut points, so the wide rows are never shuffled or sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordering import HashCuts, hash_cuts, share_out
from winnow.functions.running import running_totals
from winnow.functions.selecting import kth_smallest


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "row_key",
    test_size: float = 0.2,
    val_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Random split with class ratios kept: ceil(n * test) test rows, then ceil of the val share of the rest."""

    def quotas(sizes):
        test = share_out(math.ceil(sum(sizes.values()) * test_size), sizes)
        rest = {g: n - test[g] for g, n in sizes.items()}
        val = share_out(math.ceil(sum(rest.values()) * (val_size / (1.0 - test_size))), rest)
        return {g: {"_test": test[g], "_val": test[g] + val[g]} for g in sizes}

    cuts = hash_cuts(df, [label], key, f"split-{seed}", quotas)
    split = F.when(F.col("_test"), F.lit("test")).when(F.col("_val"), F.lit("val")).otherwise(F.lit("train"))
    return cuts.mark(df, ["_test", "_val"]).withColumn("split", split).drop("_test", "_val")


def inner_holdout_split(
    df: DataFrame, label: str = "label", key: str = "row_key", holdout_fraction: float = 0.25, seed: int = 42
) -> DataFrame:
    """Mark ``is_holdout``: a stratified ceil(n * fraction) of the rows."""

    def quotas(sizes):
        held = share_out(math.ceil(sum(sizes.values()) * holdout_fraction), sizes)
        return {g: {"is_holdout": held[g]} for g in sizes}

    return hash_cuts(df, [label], key, f"holdout-{seed}", quotas).mark(df, ["is_holdout"])


def fold_cuts(df: DataFrame, label: str = "label", key: str = "row_key", folds: int = 5, seed: int = 42) -> HashCuts:
    """Where the folds of each class end in its random order; may be kept and used again."""
    if folds < 2:
        raise ValueError("at least 2 folds are required")
    return hash_cuts(
        df, [label], key, f"fold-{seed}",
        lambda sizes: {g: {f"_end{i}": n * i // folds for i in range(1, folds)} for g, n in sizes.items()},
    )


def with_folds(df: DataFrame, cuts: HashCuts, folds: int, name: str = "fold") -> DataFrame:
    ends = [f"_end{i}" for i in range(1, folds)]
    fold = F.lit(0)
    for end in ends:
        fold = fold + (~F.col(end)).cast("int")
    return cuts.mark(df, ends).withColumn(name, fold).drop(*ends)


def stratified_kfold(
    df: DataFrame, label: str = "label", key: str = "row_key", folds: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Shuffled stratified folds 0..k-1: fold ``i`` is the ``i``-th of ``k`` equal stretches of the
    random order within a class, so fold sizes of a class differ by at most one."""
    return with_folds(df, fold_cuts(df, label, key, folds, seed), folds, name)


@dataclass(frozen=True)
class TimeCuts:
    """Where a chronological split cuts. All values are plain numbers, fixed once found."""

    rows: int
    train_end: int | float
    val_end: int | float
    val_end_key: int | float
    train_rows: int
    val_rows: int


def _time_value(df: DataFrame, time: str):
    """The time column as a plain number in the same order."""
    kind = df.schema[time].dataType.simpleString()
    if kind == "timestamp_ntz":
        # Field by field: a cast through the session's time zone could fold or skip hours.
        day = F.unix_date(F.col(time).cast("date")).cast("bigint")
        micros = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
        return ((day * 24 + F.hour(time)) * 60 + F.minute(time)) * 60_000_000 + micros
    if kind == "timestamp":
        return F.unix_micros(time)
    if kind == "date":
        return F.unix_date(time)
    return F.col(time)


def chronological_cuts(
    df: DataFrame, time: str, key: str = "row_key", test_size: float = 0.2, val_size: float = 0.2
) -> TimeCuts:
    """TRAIN ends on a whole timestamp and leaves at least two rows; VAL ends on an exact row count,
    inside a timestamp if need be, where rows follow their key."""
    if time not in df.columns:
        raise ValueError(f"timestamp column '{time}' not found")
    narrow = df.select(_time_value(df, time).alias("t"), F.col(key).alias("k"))
    facts = narrow.agg(
        F.count(F.lit(1)).alias("n"), F.count("t").alias("known"), F.min("t").alias("low"), F.max("t").alias("high")
    ).first()
    total = facts["n"]
    if total == 0:
        raise ValueError("cannot split an empty table")
    if facts["known"] < total:
        raise ValueError(f"timestamp column '{time}' has missing values")
    if facts["low"] == facts["high"]:
        raise ValueError("a chronological split needs at least two distinct timestamps")

    def count_upto(value) -> int:
        return narrow.where(F.col("t") <= F.lit(value)).count()

    wanted = max(1, round(total * max(0.0, 1.0 - val_size - test_size)))
    train_end = kth_smallest(narrow, "t", min(wanted, total), total)
    train_rows = count_upto(train_end)
    if train_rows > total - 2:
        # Step back to the last whole timestamp with two rows behind it.
        late = kth_smallest(narrow, "t", total - 1, total)
        train_end = narrow.where(F.col("t") < F.lit(late)).agg(F.max("t").alias("t")).first()["t"]
        if train_end is None:
            raise ValueError("not enough distinct timestamps for the requested sizes")
        train_rows = count_upto(train_end)
    rest = narrow.where(F.col("t") > F.lit(train_end))
    rest_rows = total - train_rows
    share = val_size / (val_size + test_size) if val_size + test_size > 0 else 0.5
    val_rows = min(max(round(rest_rows * share), 1), rest_rows - 1)
    val_end = kth_smallest(rest, "t", val_rows, rest_rows)
    sizes = rest.agg(
        F.count_if(F.col("t") < F.lit(val_end)).alias("before"), F.count_if(F.col("t") == F.lit(val_end)).alias("tied")
    ).first()
    tied = rest.where(F.col("t") == F.lit(val_end))
    val_end_key = kth_smallest(tied, "k", val_rows - sizes["before"], sizes["tied"])
    return TimeCuts(total, train_end, val_end, val_end_key, train_rows, val_rows)


def chronological_split(
    df: DataFrame, time: str, key: str = "row_key", test_size: float = 0.2, val_size: float = 0.2
) -> DataFrame:
    """Add ``split`` in time order. After the cuts are known this is a filter-like projection."""
    cuts = chronological_cuts(df, time, key, test_size, val_size)
    at = _time_value(df, time)
    in_val = (at < F.lit(cuts.val_end)) | ((at == F.lit(cuts.val_end)) & (F.col(key) <= F.lit(cuts.val_end_key)))
    return df.withColumn(
        "split",
        F.when(at <= F.lit(cuts.train_end), F.lit("train")).when(in_val, F.lit("val")).otherwise(F.lit("test")),
    )


def time_inner_split(df: DataFrame, time: str, holdout_fraction: float = 0.25) -> DataFrame:
    """Mark ``is_holdout``: the latest rows of TRAIN, cut on a whole timestamp."""
    at = _time_value(df, time)
    narrow = df.select(at.alias("t"))
    total = narrow.count()
    kept = max(1, math.floor(total * (1.0 - holdout_fraction)))
    end = kth_smallest(narrow, "t", kept, total)
    return df.withColumn("is_holdout", at > F.lit(end))


def timestamp_groups(df: DataFrame, time: str) -> DataFrame:
    """Runs of equal timestamps in time order with their row span [start_row, end_row)."""
    sizes = df.groupBy(F.col(time).alias("ts")).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.withColumn("_at", _time_value(sizes, "ts").cast("bigint"))
    spans = running_totals(sizes, [], "_at", ["n_rows"])
    return spans.select(
        "ts", "n_rows", (F.col("cum_n_rows") - F.col("n_rows")).alias("start_row"), F.col("cum_n_rows").alias("end_row")
    )


def stable_sort_time(df: DataFrame, time: str, key: str = "row_key") -> DataFrame:
    return df.orderBy(time, key)
