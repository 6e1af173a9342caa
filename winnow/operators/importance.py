"""Feature importance: Shapley values, split gain, and the drop in average precision when a column is shuffled."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.functions.ordering import order_hash
from winnow.operators.boosting import BoostedModel, _as_one, _matrix, feature_array
from winnow.operators.metrics import metrics_from_counts, score_counts

BLOCK_ROWS = 16_384
BASELINE = ""  # the "feature" under which unshuffled scores travel


# --- Shapley values ---------------------------------------------------------------------------


def shapley_values(df: DataFrame, model: BoostedModel, key: str = "row_key") -> DataFrame:
    """(key, phi array<double>, margin) per row, in the order of ``model.features``."""
    width = len(model.features)
    shared = df.sparkSession.sparkContext.broadcast(model.ensemble)

    def explain(batches):
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            phi = shared.value.shapley(x)
            offsets = pa.array(np.arange(0, phi.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.ListArray.from_arrays(offsets, pa.array(phi.ravel())), pa.array(shared.value.margin(x))],
                names=["_key", "phi", "margin"],
            )

    slim = df.select(F.col(key).alias("_key"), feature_array(model.features, model.fills))
    kind = df.schema[key].dataType.simpleString()
    return slim.mapInArrow(explain, f"_key {kind}, phi array<double>, margin double").withColumnRenamed("_key", key)


def _shared_shape(models: Sequence[BoostedModel]) -> BoostedModel:
    if len({(m.features, m.fills) for m in models}) != 1:
        raise ValueError("the models of an ensemble share their features")
    return models[0]


def shap_importance(df: DataFrame, models: Sequence[BoostedModel]) -> DataFrame:
    """(model, feature, mean_abs_shap). The rows are read once for all models; each task sends one sum
    per model and feature."""
    first = _shared_shape(models)
    return shap_of_arrays(df.select(feature_array(first.features, first.fills)), models)


def shap_of_arrays(df: DataFrame, models: Sequence[BoostedModel]) -> DataFrame:
    """:func:`shap_importance` of ``_x``, the filled features as an array."""
    first, count = _shared_shape(models), len(models)
    width = len(first.features)
    shared = df.sparkSession.sparkContext.broadcast([m.ensemble for m in models])

    def totals(batches):
        sums, rows = np.zeros((count, width)), 0
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            for m, ensemble in enumerate(shared.value):
                sums[m] += np.abs(ensemble.shapley(x)).sum(axis=0)
            rows += len(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(count, dtype=np.int32), width)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), count)),
                pa.array(sums.ravel()),
                pa.array(np.full(count * width, rows)),
            ],
            names=["m", "i", "total", "n"],
        )

    features = F.array(*[F.lit(c) for c in first.features])
    labels = F.array(*[F.lit(m.name) for m in models])
    sums = df.select("_x").mapInArrow(totals, "m int, i int, total double, n bigint")
    return sums.groupBy("m", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(
        labels[F.col("m")].alias("model"), features[F.col("i")].alias("feature"),
        F.try_divide(F.col("total"), F.col("n").cast("double")).alias("mean_abs_shap"),
    )


def linear_importance(df: DataFrame, weights: Mapping[str, Mapping[str, float]], features: Sequence[str]) -> DataFrame:
    """(model, feature, mean_abs_shap, mean_gain) of weighted-sum scorers, in closed form.

    The Shapley value of a weighted sum is ``w * (x - mean)``; as gain stands the variance that the
    term explains. Two wide aggregates, whatever the number of rows.
    """
    filled = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    facts = filled.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]
    ).first()
    away = filled.agg(*[F.avg(F.abs(F.col(f) - F.lit(facts[f"m_{f}"]))).alias(f) for f in features])
    long = away.unpivot([], list(features), "feature", "_away")
    cells = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.lit(f).alias("_f"), F.lit(abs(float(w.get(f, 0.0)))).alias("_w"),
            F.lit(float(w.get(f, 0.0)) ** 2 * facts[f"v_{f}"]).alias("mean_gain"),
        )
        for m, w in weights.items() for f in features
    ])
    return long.select("feature", "_away", F.explode(cells).alias("_c")).where("feature = _c._f").select(
        "_c.model", "feature", (F.col("_c._w") * F.col("_away")).alias("mean_abs_shap"), "_c.mean_gain"
    )


def shap_aggregate(per_model: DataFrame) -> DataFrame:
    """Mean over models, largest first."""
    mean = per_model.groupBy("feature").agg(F.avg("mean_abs_shap").alias("mean_abs_shap"))
    return mean.orderBy(F.desc("mean_abs_shap"), "feature")


def topk_shap(shap: DataFrame, k: int) -> DataFrame:
    return shap.orderBy(F.desc("mean_abs_shap"), "feature").limit(k)


# --- split gain -------------------------------------------------------------------------------


def gain_reindex(gains: DataFrame, features: DataFrame, value: str = "mean_gain") -> DataFrame:
    """Every feature, with 0 where the model has no gain for it."""
    return features.select("feature").join(gains, "feature", "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def gain_importance(models: Sequence[BoostedModel]) -> DataFrame:
    """(feature, mean_gain): the average gain of a feature's splits, averaged over models.

    The gain of a split is the squared error it takes off: the stored decrease per row times the rows.
    """
    spark = SparkSession.active()
    parts = []
    for model in models:
        names = F.array(*[F.lit(c) for c in model.features])
        gains = (
            spark.read.parquet(model.nodes_path)
            .where(F.col("nodeData.leftChild") >= 0)
            .groupBy(names[F.col("nodeData.split.featureIndex")].alias("feature"))
            .agg(F.avg(F.col("nodeData.gain") * F.col("nodeData.rawCount")).alias("mean_gain"))
        )
        listed = spark.createDataFrame([(c,) for c in model.features], "feature string")
        parts.append(gain_reindex(gains, listed))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("feature").agg(F.avg("mean_gain").alias("mean_gain")).orderBy(F.desc("mean_gain"), "feature")


# --- permutation ------------------------------------------------------------------------------


def with_blocks(df: DataFrame, key: str, seed: int, rows_per_block: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Add ``block``: random groups of about ``rows_per_block`` rows, the same for any partitioning.

    A column is shuffled inside blocks. A block is a random sample of the rows, so this is a random
    permutation of the whole column; a table up to one block in size is shuffled as one. ``rows`` is their number, where it is known.
    """
    blocks = max(1, math.ceil((df.count() if rows is None else rows) / rows_per_block))
    number = F.conv(F.substring(order_hash(key, "block", seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("block", (number % F.lit(blocks)).cast("int"))


def column_shuffle(
    df: DataFrame, columns: Sequence[str], key: str = "row_key", carry: Sequence[str] = (),
    models: Sequence[str] = ("m0",), seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """(model, feature, key, carry..., value, shuffled): each row takes the value of its successor in a
    salted random order, the last row that of the first: one random cycle per block, feature and model.

    One shuffle by block serves all features and models, since their windows only refine it.
    """
    blocked = with_blocks(df, key, seed, rows_per_block).select("block", key, *carry, *columns)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return _shuffled(blocked, cells, key, carry, models, seed)


def _shuffled(blocked: DataFrame, cells, key: str, carry: Sequence[str], models: Sequence[str], seed: int) -> DataFrame:
    copies = (
        blocked.repartition("block")
        .select("block", key, *carry, F.explode(cells).alias("_c"))
        .select("block", key, *carry, "_c.*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
        .withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), "feature", "model", F.lit(str(seed)))))
    )
    cell = F.struct("value")
    order = Window.partitionBy("block", "feature", "model").orderBy("_h", key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = F.coalesce(F.lead(cell).over(order), F.first(cell).over(whole))
    return copies.withColumn("shuffled", taken["value"]).select("model", "feature", key, *carry, "value", "shuffled")


#: Columns to shuffle one by one, or groups of columns to shuffle together, by name.
Groups = Sequence[str] | Mapping[str, Sequence[str]]


def named_groups(features: Groups) -> dict[str, tuple[str, ...]]:
    """A plain list is one group per column, under the column's name."""
    if isinstance(features, Mapping):
        return {name: tuple(members) for name, members in features.items()}
    return {f: (f,) for f in features}


def group_shuffle(
    df: DataFrame, groups: Mapping[str, Sequence[str]], key: str = "row_key", carry: Sequence[str] = (),
    models: Sequence[str] = ("m0",), seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """(model, feature, key, carry..., value, shuffled) like :func:`column_shuffle`, with arrays of a group's columns: one permutation
    moves whole rows of the group, so what its columns know of each other stays. ``feature`` is the group's name, which salts the order."""
    used = list(dict.fromkeys(c for members in groups.values() for c in members))
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.array(*[F.col(c).cast("double") for c in members]).alias("value")) for name, members in groups.items()
    ])
    return _shuffled(with_blocks(df, key, seed, rows_per_block).select("block", key, *carry, *used), cells, key, carry, models, seed)


def linear_permutation_scores(
    df: DataFrame, weights: Mapping[str, Mapping[str, float]], features: Groups,
    label: str = "label", key: str = "row_key", seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """(model, feature, _key, _y, score): plain and shuffled scores of weighted sums ``weights[model][feature]``.

    Only the score and the values of the shuffled columns travel, whatever the number of features.
    """
    groups = named_groups(features)
    used = sorted({f for w in weights.values() for f in w} | {f for g in groups.values() for f in g})
    filled = df.select(key, label, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in used])
    score_of = {}
    for name, w in weights.items():
        total = F.lit(0.0)
        for f in sorted(w):
            total = total + F.lit(float(w[f])) * F.col(f)
        score_of[name] = total
    scored = filled.withColumns({f"_s_{m}": s for m, s in score_of.items()})
    base_cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_s_{m}").alias("score")) for m in weights])
    base = scored.select(key, label, F.explode(base_cells).alias("_b")).select(
        "_b.model", F.lit(BASELINE).alias("feature"), F.col(key).alias("_key"), F.col(label).alias("_y"), "_b.score"
    )
    moved = group_shuffle(scored, groups, key, [label, *[f"_s_{m}" for m in weights]], list(weights), seed, rows_per_block)
    start, change = F.lit(None).cast("double"), F.lit(0.0)
    for m, w in weights.items():
        here = F.col("model") == m
        start = F.when(here, F.col(f"_s_{m}")).otherwise(start)
        for name, members in groups.items():
            steps = [F.lit(float(w[f])) * (F.col("shuffled")[k] - F.col("value")[k]) for k, f in enumerate(members) if f in w]
            if steps:
                change = F.when(here & (F.col("feature") == name), sum(steps[1:], steps[0])).otherwise(change)
    changed = moved.select("model", "feature", F.col(key).alias("_key"), F.col(label).alias("_y"), (start + change).alias("score"))
    return base.unionByName(changed)


def linear_permutation_counts(
    df: DataFrame, weights: Mapping[str, Mapping[str, float]], features: Groups,
    label: str = "label", key: str = "row_key", seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Shuffled-score counts for scorers that are weighted sums."""
    return score_counts(linear_permutation_scores(df, weights, features, label, key, seed, rows_per_block), ["model", "feature"], "_y")


def _tree_blocks(df: DataFrame, models: Sequence[BoostedModel], features: Groups, label: str, key: str, seed: int, rows_per_block: int, emit, schema: str) -> DataFrame:
    """What ``emit(model, feature, scores, block)`` makes of plain and shuffled scores of every block.

    The evaluation rows are shuffled once, by block; a task then holds one bounded block, moves each group of columns in it by one
    permutation and re-evaluates only the trees that use a column of the group.
    """
    first = _shared_shape(models)
    width, names = len(first.features), list(first.features)
    places = [(name, [names.index(f) for f in members]) for name, members in named_groups(features).items()]
    shared = df.sparkSession.sparkContext.broadcast([m.ensemble for m in models])
    labels = [m.name for m in models]

    def shuffle_block(block: pa.Table) -> pa.Table:
        block = block.sort_by("_key")
        x = _matrix(_as_one(block, "_x"), width)
        number = block.column("block")[0].as_py()
        out = []
        for m, ensemble in enumerate(shared.value):
            parts = ensemble.contributions(x)
            base = parts.sum(axis=1)
            out.append(emit(labels[m], BASELINE, base, block))
            for feature, columns in places:
                trees = np.unique(np.concatenate([ensemble.trees_using(c) for c in columns]))
                scores = base
                if len(trees):
                    moved = np.random.default_rng([seed, m, *columns, number]).permutation(len(x))
                    swapped = x.copy()
                    swapped[:, columns] = x[np.ix_(moved, columns)]
                    changed = parts.copy()
                    changed[:, trees] = ensemble.contributions(swapped, trees)
                    scores = changed.sum(axis=1)
                out.append(emit(labels[m], feature, scores, block))
        return pa.concat_tables(out)

    slim = with_blocks(df, key, seed, rows_per_block).select(
        "block", F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"),
        feature_array(first.features, first.fills),
    )
    return slim.groupBy("block").applyInArrow(shuffle_block, schema)


def tree_permutation_counts(
    df: DataFrame, models: Sequence[BoostedModel], features: Groups,
    label: str = "label", key: str = "row_key", seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Shuffled-score counts for tree ensembles; only counts leave a block."""
    def counts(model: str, feature: str, scores: np.ndarray, block: pa.Table) -> pa.Table:
        values, place = np.unique(scores, return_inverse=True)
        y = block.column("_y").to_numpy()
        return pa.table({
            "model": pa.array([model] * len(values)),
            "feature": pa.array([feature] * len(values)),
            "score": pa.array(values),
            "n_pos": pa.array(np.bincount(place, weights=y).astype(np.int64)),
            "n_rows": pa.array(np.bincount(place).astype(np.int64)),
        })

    per_block = _tree_blocks(
        df, models, features, label, key, seed, rows_per_block, counts, "model string, feature string, score double, n_pos bigint, n_rows bigint")
    return per_block.groupBy("model", "feature", "score").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_rows").alias("n_rows")
    )


def tree_permutation_scores(
    df: DataFrame, models: Sequence[BoostedModel], features: Groups,
    label: str = "label", key: str = "row_key", seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """(model, feature, _key, _y, score): the rows behind :func:`tree_permutation_counts`."""
    def rows(model: str, feature: str, scores: np.ndarray, block: pa.Table) -> pa.Table:
        return pa.table({
            "model": pa.array([model] * len(scores)), "feature": pa.array([feature] * len(scores)),
            "_key": block.column("_key"), "_y": pa.array(block.column("_y").to_numpy().astype(np.int32)), "score": pa.array(scores),
        })

    kind = df.schema[key].dataType.simpleString()
    return _tree_blocks(df, models, features, label, key, seed, rows_per_block, rows, f"model string, feature string, _key {kind}, _y int, score double")


def permutation_table(counts: DataFrame) -> DataFrame:
    """(feature, delta_mean, delta_std) from score counts: baseline minus shuffled average precision,
    mean and population deviation over models, largest first."""
    scored = metrics_from_counts(counts, ["model", "feature"])
    model = Window.partitionBy("model")  # one row per feature
    base = F.max(F.when(F.col("feature") == BASELINE, F.col("pr_auc"))).over(model)
    deltas = scored.withColumn("_delta", base - F.col("pr_auc")).where(F.col("feature") != BASELINE)
    table = deltas.groupBy("feature").agg(
        F.avg("_delta").alias("delta_mean"), F.stddev_pop("_delta").alias("delta_std")
    )
    return sort_permutation_table(table)


def sort_permutation_table(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("delta_mean"), "feature")


def permutation_importance(
    df: DataFrame, models: Sequence[BoostedModel], features: Groups, label: str = "label",
    key: str = "row_key", seed: int = 42, rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    return permutation_table(tree_permutation_counts(df, models, features, label, key, seed, rows_per_block))
