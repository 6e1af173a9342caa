"""Categorical encoders. Fitting reads the rows once for all columns; encoding adds lookups, no shuffle
unless a column has more categories than may be broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.ordering import HashCuts
from winnow.operators.cleaning import select_categorical
from winnow.operators.splitting import fold_cuts, with_folds
from winnow.session import materialise

MISSING = "__MISSING__"  # fixed value: the category that stands for NULL
BROADCAST_ROWS = 250_000
HOT_PART = 10_000  # keys with at least one row in so many are hot: there are at most that many of them


@dataclass(frozen=True)
class TargetEncoding:
    """How category means become numbers. ``smoothed`` shrinks towards the global mean."""

    folds: int = 5
    smoothing: float = 10.0
    min_category_size: int = 30
    seed: int = 42
    strategy: str = "smoothed"

    def __post_init__(self):
        if self.folds < 2:
            raise ValueError("target encoding needs at least 2 folds")
        if (self.strategy or "smoothed").lower() not in ("smoothed", "naive"):
            raise ValueError("strategy must be 'smoothed' or 'naive'")

    def value(self, positives: Column, rows: Column, overall: Column) -> Column:
        """Encoding of a category with these counts; a category without rows gets the global mean."""
        mean = F.try_divide(positives.cast("double"), rows.cast("double"))
        if (self.strategy or "smoothed").lower() == "naive":
            return F.coalesce(mean, overall)
        weight = F.try_divide(rows.cast("double"), rows.cast("double") + F.lit(float(self.smoothing)))
        shrunk = weight * mean + (F.lit(1.0) - weight) * overall
        if self.min_category_size > 0:
            shrunk = F.when(rows >= self.min_category_size, shrunk)
        return F.coalesce(shrunk, overall)


def category_stats(
    df: DataFrame, columns: Sequence[str], label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """(feature, category, by..., n_rows, n_pos) of all columns in one pass; hot categories combine map-side."""
    text = df.select(*by, F.col(label).alias("_y"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = text.unpivot([*by, "_y"], list(columns), "feature", "category")
    return long.groupBy("feature", "category", *by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_y").cast("bigint")).alias("n_pos")
    )


def lookup_encode(
    df: DataFrame, column: Column, mapping: DataFrame, value: str, name: str, default: Column,
    rows: int | None = None, on: Sequence[str] = (), key: str = "category", weight: str | None = None,
    total: int = 0, spread: str | None = None,
) -> DataFrame:
    """``name`` = mapped value of ``column``, or ``default`` where the mapping has none.

    ``rows`` is the counted size of the mapping: below the bound it is broadcast; above it Spark
    joins by shuffle. If the mapping tells how many rows each key has (``weight``, out of
    ``total``), the few keys with at least one row in ``HOT_PART`` are still broadcast, and their
    rows are spread over the shuffle by the column ``spread`` instead of meeting in one task.
    """
    side = mapping.select(
        F.col(key).alias("_k"), F.col(value).alias("_v"), *[F.col(o).alias(f"_o_{o}") for o in on],
        *([F.col(weight).alias("_w")] if weight else []),
    )

    def joined(left: DataFrame, probe: Column, right: DataFrame) -> DataFrame:
        same = probe == F.col("_k")
        for o in on:
            same = same & (F.col(o) == F.col(f"_o_{o}"))
        return left.join(right.drop("_w"), same, "left").drop("_k", *[f"_o_{o}" for o in on])

    if rows is not None and rows <= BROADCAST_ROWS:
        found = joined(df, column, F.broadcast(side))
    elif weight and total and spread:
        hot = F.col("_w") * HOT_PART >= F.lit(total)
        first = joined(df, column, F.broadcast(side.where(hot))).withColumnRenamed("_v", "_hot")
        aside = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread), F.lit(HOT_PART)).cast("string"))
        probe = F.when(F.col("_hot").isNull(), column).otherwise(aside)
        found = joined(first, probe, side.where(~hot)).withColumn("_v", F.coalesce("_hot", "_v")).drop("_hot")
    else:
        found = joined(df, column, side)
    return found.withColumn(name, F.coalesce(F.col("_v"), default)).drop("_v")


def binary_categories(stats: DataFrame) -> DataFrame:
    """(feature, negative, positive) of two-valued columns: the higher mean is positive, ties go to
    the alphabetically first."""
    mean = F.try_divide(F.sum("n_pos").cast("double"), F.sum("n_rows").cast("double"))
    per = stats.where(F.col("category").isNotNull()).groupBy("feature", "category").agg(mean.alias("_mean"))
    ordered = per.groupBy("feature").agg(
        # Two entries by construction: columns with any other number of categories are dropped below.
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct((-F.col("_mean")).alias("m"), "category")).alias("_best"),
        F.max(F.struct((-F.col("_mean")).alias("m"), "category")).alias("_worst"),
    )
    return ordered.where(F.col("_n") == 2).select(
        "feature", F.col("_worst.category").alias("negative"), F.col("_best.category").alias("positive")
    )


def binary_encode(column: str, negative: str, positive: str, missing: float = 0.5) -> Column:
    """1 for the positive category, 0 for the other, ``missing`` for NULL and unseen values."""
    value = F.col(f"`{column}`").cast("string")
    return F.when(value == positive, F.lit(1.0)).when(value == negative, F.lit(0.0)).otherwise(F.lit(float(missing)))


def target_mapping(stats: DataFrame, how: TargetEncoding, overall: Column) -> DataFrame:
    """(feature, category, encoding) from category statistics; NULL is a category of its own."""
    whole = _named_missing(stats).groupBy("feature", "category").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos")
    )
    return whole.withColumns({"encoding": how.value(F.col("n_pos"), F.col("n_rows"), overall), "n_total": F.col("n_rows")})


def out_of_fold_mapping(stats: DataFrame, how: TargetEncoding, overall: Column, fold: str = "fold") -> DataFrame:
    """(feature, category, fold, encoding): each fold encoded by the other folds, as total minus own.

    One pass over the statistics instead of one pass over the rows per fold.
    """
    named = _named_missing(stats).groupBy("feature", "category", fold).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos")
    )
    # At most one row per fold in each window.
    category = Window.partitionBy("feature", "category")
    rest = named.select(
        "feature", "category", fold,
        F.sum("n_rows").over(category).alias("n_total"),
        (F.sum("n_rows").over(category) - F.col("n_rows")).alias("n_rows"),
        (F.sum("n_pos").over(category) - F.col("n_pos")).alias("n_pos"),
    )
    return rest.withColumn("encoding", how.value(F.col("n_pos"), F.col("n_rows"), overall))


def _named_missing(stats: DataFrame) -> DataFrame:
    return stats.withColumn("category", F.coalesce("category", F.lit(MISSING)))


def _as_category(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


@dataclass(frozen=True)
class FeatureEncoder:
    """A fitted encoder. Holds routing on the driver and the category statistics as a stored table."""

    columns: tuple[str, ...]
    constants: dict[str, float]
    binary: dict[str, tuple[str, str]]
    target: dict[str, int]
    global_mean: float
    stats: DataFrame | None
    how: TargetEncoding
    missing: float
    label: str
    key: str
    n_rows: int = 0
    cuts: HashCuts | None = None

    def _plain(self, df: DataFrame) -> DataFrame:
        """Constants and two-valued columns: expressions, no lookup."""
        new = {c: F.lit(v) for c, v in self.constants.items() if c in df.columns}
        new |= {c: binary_encode(c, n, p, self.missing) for c, (n, p) in self.binary.items()}
        return df.withColumns(new) if new else df

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode new rows with the statistics of all training rows."""
        out = self._plain(df)
        if self.target:
            mapping = target_mapping(self.stats, self.how, F.lit(self.global_mean))
            for column, size in self.target.items():
                part = mapping.where(F.col("feature") == column)
                out = lookup_encode(
                    out, _as_category(column), part, "encoding", column, F.lit(self.global_mean), size,
                    weight="n_total", total=self.n_rows, spread=self.key,
                )
        return out.select(*df.columns)

    def transform_training(self, df: DataFrame) -> DataFrame:
        """Encode the training rows out of fold."""
        out = self._plain(df)
        if self.target:
            out = with_folds(out, self.cuts, self.how.folds, "_fold")
            mapping = out_of_fold_mapping(self.stats, self.how, F.lit(self.global_mean), "_fold")
            for column, size in self.target.items():
                part = mapping.where(F.col("feature") == column)
                out = lookup_encode(
                    out, _as_category(column), part, "encoding", column, F.lit(self.global_mean),
                    size * self.how.folds, on=["_fold"], weight="n_total", total=self.n_rows, spread=self.key,
                )
        return out.select(*df.columns)


def fit_encoder(
    train: DataFrame,
    columns: Sequence[str] | None = None,
    label: str = "label",
    key: str = "row_key",
    how: TargetEncoding | None = None,
    missing: float = 0.5,
) -> FeatureEncoder:
    """Route each categorical column by its distinct non-null values in TRAIN: none and one become
    constants, two an indicator, more an out-of-fold target encoding."""
    how = how or TargetEncoding()
    columns = [c for c in select_categorical(train, columns) if c not in (label, key)]
    if not columns:
        return FeatureEncoder((), {}, {}, {}, 0.0, None, how, missing, label, key)
    cuts = fold_cuts(train, label, key, how.folds, how.seed)
    folded = with_folds(train, cuts, how.folds, "_fold")
    stats = materialise(category_stats(folded, columns, label, ["_fold"]), "category-stats")
    facts = (
        stats.groupBy("feature", "category")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos"))
        .groupBy("feature")
        .agg(
            F.count("category").alias("seen"), F.count(F.lit(1)).alias("size"),
            F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos"),
        )
        .collect()  # one row per column
    )
    found = {r["feature"]: r for r in facts}
    constants = {c: (missing if found[c]["seen"] == 0 else 0.0) for c in columns if found[c]["seen"] < 2}
    two = [c for c in columns if found[c]["seen"] == 2]
    binary = {}
    if two:
        pairs = binary_categories(stats.where(F.col("feature").isin(two))).collect()  # one row per column
        binary = {r["feature"]: (r["negative"], r["positive"]) for r in pairs}
    target = {c: found[c]["size"] for c in columns if found[c]["seen"] > 2}
    one = facts[0]
    return FeatureEncoder(
        tuple(columns), constants, binary, target, one["n_pos"] / one["n_rows"], stats, how, missing, label, key,
        one["n_rows"], cuts,
    )


def encode_splits(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    label: str = "label",
    key: str = "row_key",
    how: TargetEncoding | None = None,
    missing: float = 0.5,
) -> tuple[DataFrame, FeatureEncoder]:
    """Fit on the ``train`` rows; encode them out of fold and the other splits with the full statistics."""
    columns = select_categorical(df.drop("split"), columns)
    train = df.where(F.col("split") == "train")
    encoder = fit_encoder(train, columns, label, key, how, missing)
    rest = encoder.transform(df.where(F.col("split") != "train"))
    return encoder.transform_training(train).unionByName(rest), encoder
