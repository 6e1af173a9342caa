"""Gradient-boosted trees: Spark ML trains them; the fitted trees are read back as small node tables
for scoring by prefix, Shapley values and gain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.trees import TreeEnsemble
from winnow.operators.cleaning import COLUMN_BATCH
from winnow.operators.metrics import metrics_from_counts
from winnow.session import scratch_path

# --- fixed values: names of boosting parameters users bring along, and what they set here ---
PARAMETER_NAMES = {
    "n_estimators": "rounds", "max_depth": "depth", "eta": "step", "learning_rate": "step",
    "min_child_weight": "min_rows", "subsample": "row_rate", "colsample_bytree": "column_rate",
    "early_stopping_rounds": "patience", "random_state": "seed", "max_bin": "bins",
}
# --- end of fixed values ---

FIRST_ROUNDS = 50  # trees of the first fit when a validation set may stop it early
DEEP = 10  # from this depth on, each row's node is kept between levels; above it, walking down from the root costs less


@dataclass(frozen=True)
class BoostParams:
    """``min_rows`` counts rows, not hessian weight, and there is no leaf penalty: Spark ML has neither."""

    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    min_rows: int = 10
    row_rate: float = 0.8
    column_rate: float = 0.8
    bins: int = 32
    seed: int = 42
    patience: int | None = None

    @classmethod
    def from_names(cls, given: Mapping[str, object], **extra) -> BoostParams:
        """From the parameter names common to boosting libraries; names without a counterpart are ignored."""
        known = {PARAMETER_NAMES[k]: v for k, v in given.items() if k in PARAMETER_NAMES}
        whole = {k: int(v) for k, v in known.items() if k in ("rounds", "depth", "min_rows", "seed", "bins", "patience") and v is not None}
        return cls(**{**known, **whole, **extra})


@dataclass(frozen=True)
class BoostedModel:
    """A fitted ensemble. ``used`` trees score; ``nodes_path`` is the stored node table of all trees."""

    features: tuple[str, ...]
    fills: tuple[float, ...]
    trees: TreeEnsemble = field(repr=False)
    nodes_path: str
    used: int
    name: str = "model"

    @property
    def ensemble(self) -> TreeEnsemble:
        return self.trees.first(self.used)


def fills_and_count(df: DataFrame, features: Sequence[str]) -> tuple[dict[str, float], int]:
    """The fill of every feature (see :func:`missing_fills`) and the number of rows, from one pass."""
    fills, rows = _fills_and_count(df, features)
    return dict(zip(features, fills)), rows


def missing_fills(df: DataFrame, features: Sequence[str]) -> tuple[float, ...]:
    """One value per feature, one below its smallest: missing values stay apart from all others."""
    return _fills_and_count(df, features)[0]


def _fills_and_count(df: DataFrame, features: Sequence[str]) -> tuple[tuple[float, ...], int]:
    lows, rows = [], 0
    for start in range(0, len(features), COLUMN_BATCH):
        batch = list(features[start : start + COLUMN_BATCH])
        *low, rows = df.agg(*[F.min(F.col(f"`{c}`").cast("double")) for c in batch], F.count(F.lit(1))).first()
        lows += low
    return tuple(-1.0 if low is None else float(low) - 1.0 for low in lows), rows


def _parts_for(rows: int) -> int:
    """Tasks of a pass over the training rows: every tree takes a pass for each of its levels, so a task should be worth its start."""
    return max(1, -(-rows // 250_000), min(24, -(-rows // 50_000)))


def _cells(features: Sequence[str], fills: Sequence[float]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v)) for c, v in zip(features, fills)]


def feature_array(features: Sequence[str], fills: Sequence[float]) -> Column:
    return F.array(*_cells(features, fills)).alias("_x")


@contextmanager
def _placed(df: DataFrame, features: Sequence[str], label: str, key: str, shape, known: tuple[tuple[float, ...], int] | None = None):
    """(rows, fills): the columns ``shape`` makes of the filled features, in a fixed placement and order, held while fits that share them run.

    Row sampling draws by position inside a partition, so the order makes a seed reproducible; the partitions follow the number of rows alone.
    ``known`` are the fills and the number of rows, where they need no pass.
    """
    fills, count = known or _fills_and_count(df, features)
    rows = (
        df.select(F.col(label).cast("double").alias("label"), F.col(key).alias("_key"), *shape(_cells(features, fills)))
        .repartition(_parts_for(count), "_key").sortWithinPartitions("_key").persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        yield rows, fills
    finally:
        rows.unpersist()


def training_rows(df: DataFrame, features: Sequence[str], label: str, key: str, known: tuple[tuple[float, ...], int] | None = None):
    """(rows, fills): feature vectors, placed and held."""
    return _placed(df, features, label, key, lambda cells: [array_to_vector(F.array(*cells)).alias("features")], known)


def train_gbt(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    key: str = "row_key",
    params: BoostParams | None = None,
    validation: DataFrame | None = None,
    name: str = "model",
) -> BoostedModel:
    """Fit on ``df``. With ``validation`` and ``params.patience`` the prefix of trees with the best
    average precision is used, looking no further than ``patience`` trees past the best so far."""
    with training_rows(df, list(features), label, key) as (rows, fills):
        return fit_rows(rows, fills, features, label, params, validation, name)


def fit_rows(
    rows: DataFrame, fills: Sequence[float], features: Sequence[str], label: str = "label", params: BoostParams | None = None, validation: DataFrame | None = None,
    name: str = "model",
) -> BoostedModel:
    """:func:`train_gbt` on rows held by :func:`training_rows`."""
    return _fit_and_stop(rows, tuple(fills), tuple(features), label, params or BoostParams(), validation, name)


@contextmanager
def fits_on(
    df: DataFrame, features: Sequence[str], label: str = "label", key: str = "row_key", params: BoostParams | None = None, validation: DataFrame | None = None,
):
    """``fit(name, features)``, what :func:`train_gbt` fits for any of these features. The rows are read, placed and held once, with all
    columns; a fit makes its vectors of them."""
    every = list(dict.fromkeys(features))
    with _placed(df, every, label, key, lambda cells: [c.alias(f"_f{i}") for i, c in enumerate(cells)]) as (held, fills):

        def fit(name: str, chosen: Sequence[str]) -> BoostedModel:
            at = [every.index(f) for f in chosen]
            rows = held.select("label", "_key", array_to_vector(F.array(*[f"_f{i}" for i in at])).alias("features"))
            rows.persist(StorageLevel.MEMORY_AND_DISK)  # a fit reads its vectors several times
            try:
                return _fit_and_stop(rows, tuple(fills[i] for i in at), tuple(chosen), label, params or BoostParams(), validation, name)
            finally:
                rows.unpersist()

        yield fit


def train_sets(
    df: DataFrame,
    sets: Mapping[str, Sequence[str]],
    label: str = "label",
    key: str = "row_key",
    params: BoostParams | None = None,
    validation: DataFrame | None = None,
    parallel: int = 4,
) -> dict[str, BoostedModel]:
    """What :func:`train_gbt` fits for each named feature set, on rows that are placed once (:func:`fits_on`)."""
    with fits_on(df, [f for features in sets.values() for f in features], label, key, params, validation) as fit, ThreadPoolExecutor(max(1, min(parallel, len(sets)))) as pool:
        return dict(pool.map(inheritable_thread_target(df.sparkSession)(lambda item: (item[0], fit(*item))), sets.items()))


def _fit_and_stop(rows, fills, features, label, params: BoostParams, validation: DataFrame | None, name: str) -> BoostedModel:
    stops = validation is not None and bool(params.patience)
    rounds = min(params.rounds, max(2 * params.patience, FIRST_ROUNDS)) if stops else params.rounds
    while True:
        model = _fit(rows, replace(params, rounds=rounds), features, fills, name)
        if not stops:
            return model
        # Trees do not depend on how many follow, so a longer fit repeats and extends this one.
        best, settled = best_prefix(validation, model, label, params.patience)
        if settled or rounds >= params.rounds:
            return replace(model, used=best)
        rounds = min(params.rounds, 2 * rounds)


def _fit(rows: DataFrame, params: BoostParams, features: tuple[str, ...], fills: tuple[float, ...], name: str) -> BoostedModel:
    learner = GBTClassifier(
        maxIter=params.rounds, maxDepth=params.depth, stepSize=params.step, maxBins=params.bins,
        minInstancesPerNode=max(1, int(params.min_rows)), subsamplingRate=params.row_rate,
        featureSubsetStrategy="all" if params.column_rate >= 1 else str(float(params.column_rate)),
        seed=params.seed, cacheNodeIds=params.depth >= DEEP, checkpointInterval=10, maxMemoryInMB=512,
    )
    fitted = learner.fit(rows)
    path = scratch_path(rows.sparkSession, "trees")
    fitted.write().save(path)
    trees = _read_trees(rows.sparkSession, path, fitted.treeWeights)
    return BoostedModel(features, fills, trees, f"{path}/data", trees.size, name)


def _read_trees(spark, path: str, weights) -> TreeEnsemble:
    """Node tables to arrays: at most rounds * 2**(depth + 1) rows."""
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.rawCount").cast("double").alias("cover"),
    )
    return TreeEnsemble.from_nodes([r.asDict() for r in nodes.collect()], weights)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A fixed-width Arrow list column as rows x width, without touching single rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _as_one(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def predict_score(df: DataFrame, model: BoostedModel, name: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the positive-class probability. Only ``keep`` (default: all columns) crosses to Python beside the features."""
    keep = list(df.columns if keep is None else keep)
    ensemble, width = model.ensemble, len(model.features)
    shared = df.sparkSession.sparkContext.broadcast(ensemble)

    def scores(batches):
        for batch in batches:
            margin = shared.value.margin(_matrix(batch.column("_x"), width))
            columns = [batch.column(c) for c in keep] + [pa.array(1.0 / (1.0 + np.exp(-2.0 * margin)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    slim = df.select(*keep, feature_array(model.features, model.fills))
    schema = df.select(*keep).schema.add(name, "double")
    return slim.mapInArrow(scores, schema)


def model_score_counts(df: DataFrame, models: Mapping[str, BoostedModel], group: str, label: str = "label") -> DataFrame:
    """(model, group, score, n_pos, n_rows): the scores of :func:`predict_score` for all models, counted, from one pass over the rows."""
    cells = list(dict.fromkeys(cell for m in models.values() for cell in zip(m.features, m.fills)))
    places = {name: [cells.index(cell) for cell in zip(m.features, m.fills)] for name, m in models.items()}
    shared = df.sparkSession.sparkContext.broadcast({name: m.ensemble for name, m in models.items()})
    kind, width = df.schema[group].dataType, len(cells)

    def counted(batches):
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            parts = batch.column(group).dictionary_encode(null_encoding="encode")
            member = parts.indices.to_numpy(zero_copy_only=False)
            for name, ensemble in shared.value.items():
                scores = 1.0 / (1.0 + np.exp(-2.0 * ensemble.margin(x[:, places[name]])))
                for code in range(len(parts.dictionary)):
                    here = member == code
                    values, place = np.unique(scores[here], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(values), pa.string()),
                            parts.dictionary.take(pa.array(np.full(len(values), code))),
                            pa.array(values),
                            pa.array(np.bincount(place, weights=y[here]).astype(np.int64)),
                            pa.array(np.bincount(place).astype(np.int64)),
                        ],
                        names=["model", group, "score", "n_pos", "n_rows"],
                    )

    known = F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_y")
    slim = df.select(group, known, feature_array(*zip(*cells)))
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField(group, kind), T.StructField("score", T.DoubleType()),
                           T.StructField("n_pos", T.LongType()), T.StructField("n_rows", T.LongType())])
    return slim.mapInArrow(counted, schema).groupBy("model", group, "score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_rows").alias("n_rows"))


def prefix_metrics(df: DataFrame, model: BoostedModel, label: str = "label") -> DataFrame:
    """(trees, n_rows, n_pos, pr_auc, roc_auc) of the first 1, 2, ... trees: all prefixes in one job."""
    width, total = len(model.features), model.trees.size
    shared = df.sparkSession.sparkContext.broadcast(model.trees)

    def prefixes(batches):
        for batch in batches:
            margins = np.cumsum(shared.value.contributions(_matrix(batch.column("_x"), width)), axis=1)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for t in range(total):
                values, place = np.unique(margins[:, t], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(values), t + 1, np.int32)),
                        pa.array(values),
                        pa.array(np.bincount(place, weights=y).astype(np.int64)),
                        pa.array(np.bincount(place).astype(np.int64)),
                    ],
                    names=["trees", "score", "n_pos", "n_rows"],
                )

    slim = df.select(F.col(label).cast("double").alias("_y"), feature_array(model.features, model.fills))
    counts = (
        slim.mapInArrow(prefixes, "trees int, score double, n_pos bigint, n_rows bigint")
        .groupBy("trees", "score")
        .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_rows").alias("n_rows"))
    )
    return metrics_from_counts(counts, ["trees"])


def best_prefix(df: DataFrame, model: BoostedModel, label: str = "label", patience: int = 50) -> tuple[int, bool]:
    """Trees to use: the best average precision seen before ``patience`` trees bring no better one.
    Also whether patience ran out, so that more trees could not change the answer."""
    curve = [r["pr_auc"] for r in prefix_metrics(df, model, label).orderBy("trees").collect()]  # one row per tree
    best = 0
    for t, value in enumerate(curve):
        if value > curve[best]:
            best = t
        elif t - best >= patience:
            return best + 1, True
    return best + 1, False


def fs_ensemble(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    key: str = "row_key",
    models: int = 3,
    params: BoostParams | None = None,
    validation: DataFrame | None = None,
    parallel: int = 3,
) -> list[BoostedModel]:
    """``models`` fits with seeds ``seed + 0, 1, ...`` on one held copy of the rows. Fits are
    independent, so a few run side by side to fill the cluster while another waits for its driver."""
    params = params or BoostParams()
    with training_rows(df, list(features), label, key) as (rows, fills):

        def fit(m: int) -> BoostedModel:
            mine = replace(params, seed=params.seed + m)
            return _fit_and_stop(rows, fills, tuple(features), label, mine, validation, f"m{m}")

        with ThreadPoolExecutor(max(1, min(parallel, models))) as pool:
            return list(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(models)))
