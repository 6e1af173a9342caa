"""Static filters that remove columns before any model is fitted. Each returns the columns to drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.scalars import ratio
from winnow.operators.cleaning import COLUMN_BATCH
from winnow.operators.profiling import nonnull_counts, value_counts


def filter_leakage_meta(df: DataFrame, leaky: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in leaky if c in df.columns])


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature) of columns with no variation among their known values."""
    found = None
    for start in range(0, len(columns), COLUMN_BATCH):
        batch = list(columns[start : start + COLUMN_BATCH])
        spread = df.agg(*[
            F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(c) for c in batch
        ]).unpivot([], batch, "feature", "constant").where("constant").select("feature")
        found = spread if found is None else found.unionByName(spread)
    return found


def quasi_constant_columns(
    df: DataFrame, columns: Sequence[str], top_share: float = 0.99, whitelist: Sequence[str] = ()
) -> DataFrame:
    """(feature, top_share): one value covers more than ``top_share`` of all rows."""
    watched = [c for c in columns if c not in whitelist]
    counts = value_counts(df, watched)
    shares = counts.groupBy("feature").agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_top"), F.sum("n").alias("_rows")
    )
    share = F.coalesce(ratio(F.col("_top"), F.col("_rows")), F.lit(0.0))
    return shares.select("feature", share.alias("top_share")).where(F.col("top_share") > top_share)


def extreme_missing_columns(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.98, whitelist: Sequence[str] = ()
) -> DataFrame:
    watched = [c for c in columns if c not in whitelist]
    rows = df.agg(F.count(F.lit(1))).scalar()
    share = F.lit(1.0) - ratio(F.col("non_null"), rows)
    return nonnull_counts(df, watched).select("feature", share.alias("missing_share")).where(
        F.col("missing_share") > threshold
    )


def column_signatures(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(feature, signature): an order-free hash of each column against the row key."""
    parts = []
    for start in range(0, len(columns), COLUMN_BATCH):
        batch = list(columns[start : start + COLUMN_BATCH])
        hashed = df.agg(*[
            F.bit_xor(F.xxhash64(F.col(key), F.col(f"`{c}`").cast("string"), F.col(f"`{c}`").isNull())).alias(c)
            for c in batch
        ])
        parts.append(hashed.unpivot([], batch, "feature", "signature"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def exact_duplicate_columns(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(feature, same_as): columns equal on every row to an alphabetically earlier one.

    Equal signatures nominate pairs, a few per schema; each is then compared value by value.
    """
    grouped = column_signatures(df, columns, key).groupBy("signature").agg(
        F.sort_array(F.collect_list("feature")).alias("names")
    )
    nominated = [r["names"] for r in grouped.where(F.size("names") > 1).collect()]  # column names only
    pairs = [(names[0], other) for names in nominated for other in names[1:]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "feature string, same_as string")
    checks = [
        F.coalesce(F.bool_and(F.col(f"`{a}`").cast("string").eqNullSafe(F.col(f"`{b}`").cast("string"))), F.lit(True)).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    held = df.agg(*checks).unpivot([], [f"p{i}" for i in range(len(pairs))], "_pair", "same").where("same")
    index = F.substring("_pair", 2, 9).cast("int")
    return held.select(
        F.array(*[F.lit(b) for _, b in pairs])[index].alias("feature"),
        F.array(*[F.lit(a) for a, _ in pairs])[index].alias("same_as"),
    )


def prefilter(
    df: DataFrame, columns: Sequence[str], key: str, leaky: Sequence[str] = (), whitelist: Sequence[str] = (),
    top_share: float = 0.995, missing: float = 0.98,
) -> list[str]:
    """The columns that survive all four filters, measured on ``df`` (TRAIN)."""
    left = [c for c in columns if c not in leaky]
    for found in (
        lambda: constant_columns(df, left),
        lambda: quasi_constant_columns(df, left, top_share, whitelist),
        lambda: extreme_missing_columns(df, left, missing, whitelist),
        lambda: exact_duplicate_columns(df, left, key),
    ):
        gone = {r["feature"] for r in found().select("feature").collect()}  # column names only
        left = [c for c in left if c not in gone]
    return left
