"""Exploratory profile: class balance, column summaries, quantiles and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.running import running_totals
from winnow.functions.scalars import numeric_columns, ratio
from winnow.operators.cleaning import COLUMN_BATCH

# Up to this many pairs one wide aggregate is cheapest; beyond it matrix products per batch are. Both give
# the same pairs: a column counts as constant where its smallest and largest value are one.
WIDE_PAIRS = 6


def _long(df: DataFrame, columns: Sequence[str], kind: str, ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., feature, value): one projection expanded in place, no shuffle."""
    cast = df.select(*ids, *[F.col(f"`{c}`").cast(kind).alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), "feature", "value")


def _by_kind(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by the type in which their values can share one long column without loss."""
    kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}
    types, found = dict(df.dtypes), {}
    for c in columns:
        found.setdefault(kinds.get(types[c], "string"), []).append(c)
    return found


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    counted = df.groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counted.agg(F.sum("n_rows")).scalar()
    return counted.withColumn("percent", ratio(F.col("n_rows") * 100, total))


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def nonnull_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, non_null): one row of counts turned on its side."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in columns])
    return counts.unpivot([], columns, "feature", "non_null")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, value, n) for all columns in one aggregate; frequent values combine before the shuffle."""
    columns = list(columns or df.columns)
    return _long(df, columns, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def column_summary(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: type, distinct non-null values, missing percent."""
    columns = list(columns or df.columns)
    if approximate:
        sketch = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns])
        distinct = sketch.unpivot([], columns, "feature", "n_unique")
        counts = nonnull_counts(df, columns).join(F.broadcast(distinct), "feature")
        rows = df.agg(F.count(F.lit(1))).scalar()
    else:
        # Numbers stay numbers: a shuffled double or long is a third of its text.
        parts = [
            _long(df, found, kind).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("feature").agg(
                F.count("value").alias("n_unique"),
                F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
                F.sum("n").alias("_rows"),
            )
            for kind, found in _by_kind(df, columns).items()
        ]
        counts = parts[0]
        for part in parts[1:]:
            counts = counts.unionByName(part)
        rows = F.col("_rows")
    types = dict(df.dtypes)
    named = F.create_map(*[part for c in columns for part in (F.lit(c), F.lit(types[c]))])
    return counts.select(
        "feature",
        named[F.col("feature")].alias("dtype"),
        "n_unique",
        ((F.lit(1.0) - ratio(F.col("non_null"), rows)) * 100).alias("missing_pct"),
    )


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """count, mean, sample std, min, linear quartiles and max of every numeric column.

    Exact quartiles are read off running counts of (feature, value), so that no task ever holds a
    whole column, which the built-in exact percentile would do.
    """
    columns = list(columns or numeric_columns(df))
    long = _long(df, columns, "double").where(F.col("value").isNotNull())
    basics = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *([F.percentile_approx("value", [0.25, 0.5, 0.75]).alias("_q")] if approximate else []),
    )
    if approximate:
        quartiles = {f"p{p}": F.col("_q")[i] for i, p in enumerate((25, 50, 75))}
        return basics.withColumns(quartiles).drop("_q")
    per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    running = running_totals(per_value, ["feature"], "value", ["n"]).join(
        F.broadcast(basics.select("feature", F.col("count").alias("_rows"))), "feature"
    )
    parts = []
    for p in (25, 50, 75):
        low = F.floor((F.col("_rows") - 1) * p / 100)
        high = F.ceil((F.col("_rows") - 1) * p / 100)
        parts.append(F.min(F.when(F.col("cum_n") > low, F.col("value"))).alias(f"_low{p}"))
        parts.append(F.min(F.when(F.col("cum_n") > high, F.col("value"))).alias(f"_high{p}"))
    picked = basics.join(F.broadcast(running.groupBy("feature").agg(*parts)), "feature")
    spot = {p: (F.col("count") - 1) * p / 100 for p in (25, 50, 75)}
    return picked.select(
        "feature", "count", "mean", "std", "min",
        *[
            (F.col(f"_low{p}") + (F.col(f"_high{p}") - F.col(f"_low{p}")) * (spot[p] - F.floor(spot[p]))).alias(f"p{p}")
            for p in (25, 50, 75)
        ],
        "max",
    )


def _pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation; NULL where a side is constant on the rows that know both."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def corr_with_target(
    df: DataFrame, columns: Sequence[str] | None = None, label: str = "label", top_n: int = 10
) -> DataFrame:
    columns = [c for c in (columns or numeric_columns(df)) if c != label]
    wide = df.agg(*[_pearson(F.col(f"`{c}`"), F.col(label)).alias(c) for c in columns])
    long = wide.unpivot([], columns, "feature", "corr").where(F.col("corr").isNotNull())
    return long.orderBy(F.desc(F.abs("corr")), "feature").limit(top_n)


def feature_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs of columns, in column order."""
    return list(combinations(columns, 2))


def feature_pairs_self_join(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(i, j, feature_a, feature_b, n_both): unordered column pairs and the rows that know both.

    The pairs come from the schema, not from a join; their counts are one aggregate per batch.
    """
    columns = list(columns or numeric_columns(df))
    places = list(combinations(range(len(columns)), 2))
    parts = []
    for start in range(0, len(places), COLUMN_BATCH):
        batch = places[start : start + COLUMN_BATCH]
        counted = df.agg(*[
            F.count_if(F.col(f"`{columns[i]}`").isNotNull() & F.col(f"`{columns[j]}`").isNotNull()).alias(f"{i},{j}")
            for i, j in batch
        ])
        parts.append(counted.unpivot([], [f"{i},{j}" for i, j in batch], "_pair", "n_both"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    at = F.split("_pair", ",")
    names = F.array(*[F.lit(c) for c in columns])
    numbered = whole.select(at[0].cast("int").alias("i"), at[1].cast("int").alias("j"), "n_both")
    return numbered.select("i", "j", names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"), "n_both")


def _pair_sums(df: DataFrame, columns: Sequence[str], means: np.ndarray) -> DataFrame:
    """Pairwise-complete sums around ``means``: matrix products per Arrow batch, added up by pair."""
    width = len(columns)
    left, right = np.triu_indices(width, 1)

    def products(batches):
        total = np.zeros((6, len(left)))
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            known = ~np.isnan(values)
            centred = np.where(known, values - means, 0.0)
            mask = known.astype(float)
            one, two = centred.T @ mask, (centred**2).T @ mask
            total += np.stack([
                (mask.T @ mask)[left, right], one[left, right], one[right, left],
                two[left, right], two[right, left], (centred.T @ centred)[left, right],
            ])
            for other in range(width):  # of every column, on the rows that know ``other`` too
                rows = values[known[:, other]]
                low[:, other] = np.fmin(low[:, other], np.fmin.reduce(rows, axis=0, initial=np.inf))
                high[:, other] = np.fmax(high[:, other], np.fmax.reduce(rows, axis=0, initial=-np.inf))
        edges = {"xlow": low[left, right], "xhigh": high[left, right], "ylow": low[right, left], "yhigh": high[right, left]}
        yield pd.DataFrame({"i": left, "j": right, **{s: total[k] for k, s in enumerate(_SUMS)}, **edges})

    fields = ", ".join(f"{s} double" for s in (*_SUMS, *_EDGES))
    narrow = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    sums = narrow.mapInPandas(products, f"i long, j long, {fields}")
    edges = [(F.min if s.endswith("low") else F.max)(s).alias(s) for s in _EDGES]
    return sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS], *edges)


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_EDGES = ("xlow", "xhigh", "ylow", "yhigh")


def correlations(df: DataFrame, columns: Sequence[str] | None = None, wide_pairs: int = WIDE_PAIRS) -> DataFrame:
    """(feature_a, feature_b, corr) for all pairs of numeric columns that have a correlation."""
    columns = list(columns or numeric_columns(df))
    pairs = feature_pairs(columns)
    if len(pairs) <= wide_pairs:
        named = {f"p{k}": _pearson(F.col(f"`{a}`"), F.col(f"`{b}`")) for k, (a, b) in enumerate(pairs)}
        wide = df.agg(*[c.alias(k) for k, c in named.items()])
        long = wide.unpivot([], list(named), "_pair", "corr")
        index = F.substring(F.col("_pair"), 2, 9).cast("int")
        first = F.array(*[F.lit(a) for a, _ in pairs])
        second = F.array(*[F.lit(b) for _, b in pairs])
        out = long.select(first[index].alias("feature_a"), second[index].alias("feature_b"), "corr")
    else:
        means = df.agg(*[F.avg(f"`{c}`").alias(c) for c in columns]).first()
        centre = np.array([0.0 if m is None else float(m) for m in means])
        sums = _pair_sums(df, columns, centre)
        covariance = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
        spread = F.sqrt(
            F.greatest(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.lit(0.0))
            * F.greatest(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.lit(0.0))
        )
        names = F.array(*[F.lit(c) for c in columns])
        out = sums.where("n > 1 AND xlow < xhigh AND ylow < yhigh").select(
            names[F.col("i").cast("int")].alias("feature_a"),
            names[F.col("j").cast("int")].alias("feature_b"),
            F.try_divide(covariance, spread).alias("corr"),
        )
    return out.where(F.col("corr").isNotNull())


def corr_top_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10, wide_pairs: int = WIDE_PAIRS
) -> DataFrame:
    strongest = correlations(df, columns, wide_pairs).withColumn("abs_corr", F.abs("corr")).drop("corr")
    return strongest.orderBy(F.desc("abs_corr"), "feature_a", "feature_b").limit(top_n)
