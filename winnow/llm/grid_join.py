"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart: epsilon. Equal vectors are one class from the start. Classes are sorted by their grid cell on
the leading principal directions, and the sequence is cut into intervals of ``BLOCK_BYTES``. Every interval has a box: the
range of its members along ``BOX`` leading directions and of what is left of their length besides. Two boxes more than epsilon apart hold no link.
Intervals of ``FAN`` intervals, and so on, have boxes too, so the join starts with the whole sequence against itself and
refines only pairs of intervals that are near enough: one join of small tables a level. What is left are pairs of blocks; a task that gets one goes on
halving both sides and dropping members too far from the other side's box, and multiplies what remains.

Directions come from ``SAMPLE`` vectors at most; they decide how much is skipped, never what is found: the boxes bound distances for any
directions, and every class is in the order. A task sends a count of links for each class and, for components, one link for
each class that it joined, so near copies are never expanded into pairs. Links on the edge (within 1e-12 of the threshold) are
computed again by exactly rounded sums, so that no link depends on how blocks are cut.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of
different lengths; equal vectors link; a row without id takes part in links but cannot name a component; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.llm.components import components
from winnow.llm.ordered import numbered
from winnow.session import materialise

SAMPLE = 2_048
CELLS, BOX = 8, 16  # leading directions that order, and that bound
FAN = 8
BLOCK_BYTES = 2 << 20
LEAST = 256  # members below which a side is not halved further
EDGE, SLACK = 1e-12, 1e-9
NO_ID = (1 << 63) - 1


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision; None if it has no direction."""
    if vector is None or not len(vector):
        return None
    x = np.array(vector, dtype=np.float64)  # None becomes nan
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(math.fsum(x * x))


def keyed(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, vec): key names the vector (null if it has no direction), vec is its components in double precision as bytes."""
    @F.pandas_udf("key binary, dim int, vec binary")
    def named(vectors: pd.Series) -> pd.DataFrame:
        out = []
        for v in vectors:
            found = unit(v)
            raw = None if found is None else (np.array(v, dtype=np.float64) + 0.0).tobytes()
            out.append((None, None, None) if raw is None else (xxhash.xxh3_128_digest(raw), len(found), raw))
        return pd.DataFrame(out, columns=["key", "dim", "vec"])

    made = rows.select(F.col(id_col).alias("id"), named.asNondeterministic()(vector_col).alias("v"))
    return made.select("id", "v.key", "v.dim", "v.vec")


def directions(sample: list, most: int = BOX) -> dict[int, np.ndarray]:
    """Leading principal directions for each length of vectors in the sample, as columns."""
    found = {}
    for dim in {len(v) for v in sample}:
        units = np.array([unit(v) for v in sample if len(v) == dim])
        _, _, axes = np.linalg.svd(units - units.mean(axis=0), full_matrices=True)
        found[dim] = np.ascontiguousarray(axes[:most].T)
    return found


def along(units: np.ndarray, axes: dict[int, np.ndarray], most: int = BOX) -> np.ndarray:
    """Coordinates on the directions, padded with zeros, and what is left of the length."""
    dim = units.shape[1]
    at = units @ axes.get(dim, np.eye(dim)[:, :most])
    rest = np.sqrt(np.maximum(0.0, 1.0 - (at * at).sum(axis=1)))
    out = np.zeros((len(units), most + 1))
    out[:, :at.shape[1]], out[:, most] = at, rest
    return out


def _in_cells(axes: dict[int, np.ndarray], epsilon: float):
    def cells(vecs: pd.Series) -> pd.Series:
        units = [unit(np.frombuffer(v)) for v in vecs]
        return pd.Series([np.floor(along(u[None], axes)[0, :CELLS] / (epsilon / 2)).astype(np.int32) for u in units], dtype=object)
    return cells


_BLOCK = f"dim int, b long, n int, {', '.join(f'l{k} double, h{k} double' for k in range(BOX + 1))}, ids binary, cs binary, ms binary, units binary"


def _one_block(axes: dict[int, np.ndarray]):
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        units = np.array([unit(np.frombuffer(v)) for v in rows["vec"]])
        at = along(units, axes)
        box = {f"{s}{k}": [float(v)] for s, side in (("l", at.min(axis=0)), ("h", at.max(axis=0))) for k, v in enumerate(side)}
        packed = {"ids": rows["low"].to_numpy(np.int64), "cs": rows["c"].to_numpy(np.int64), "ms": rows["m"].to_numpy(np.int64), "units": units}
        return pd.DataFrame({"dim": [key[0]], "b": [key[1]], "n": [len(rows)], **box, **{k: [v.tobytes()] for k, v in packed.items()}})[[c.split()[0] for c in _BLOCK.split(", ")]]
    return block


def near_blocks(boxes: DataFrame, epsilon: float) -> DataFrame:
    """(dim, a, b): pairs of blocks, a <= b, whose boxes are within epsilon. ``boxes``: (dim, b, l0, h0, ...), numbered along the order."""
    levels = [boxes]
    while (levels[-1].agg(F.max("b")).first()[0] or 0) > 0:
        ends = [f(f"{s}{k}").alias(f"{s}{k}") for k in range(BOX + 1) for s, f in (("l", F.min), ("h", F.max))]
        levels.append(materialise(levels[-1].groupBy("dim", F.expr(f"b div {FAN}").alias("b")).agg(*ends), "boxes"))
    pairs = levels[-1].select("dim", F.col("b").alias("a"), "b")
    for level in reversed(levels[:-1]):
        left, right = (level.select("dim", F.col("b").alias(side), F.expr(f"b div {FAN}").alias(f"p{side}"), *[F.col(f"{s}{k}").alias(f"{side}_{s}{k}") for k in range(BOX + 1) for s in "lh"])
                       for side in ("x", "y"))
        gaps = [f"pow(greatest(0D, x_l{k} - y_h{k}, y_l{k} - x_h{k}), 2)" for k in range(BOX + 1)]
        near = pairs.withColumnsRenamed({"a": "px", "b": "py"}).join(left, ["dim", "px"]).join(right, ["dim", "py"])
        near = near.where(f"x <= y AND {' + '.join(gaps)} <= {epsilon * epsilon + SLACK}D")
        pairs = materialise(near.select("dim", F.col("x").alias("a"), F.col("y").alias("b")), "near-blocks")
    return pairs


def _apart(at: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Squared distance of members from a box."""
    gap = np.maximum(0.0, np.maximum(box.min(axis=0) - at, at - box.max(axis=0)))
    return (gap * gap).sum(axis=1)


def joined(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with cosine of at least ``least``; i < j where both sides are the same interval."""
    most = 2 - 2 * least + SLACK
    todo = [(np.arange(len(x)), np.arange(len(y)), same)]
    while todo:
        i, j, one = todo.pop()
        if not one:
            i = i[_apart(at_x[i], at_y[j]) <= most]
            j = j[_apart(at_y[j], at_x[i]) <= most] if len(i) else i
        if not len(i) or not len(j):
            continue
        if max(len(i), len(j)) > LEAST:
            halves = [np.array_split(side, 2) if len(side) > LEAST else [side] for side in (i, j)]
            if one:
                a, b = halves[0]
                todo += [(a, a, True), (a, b, False), (b, b, True)]
            else:
                todo += [(a, b, False) for a in halves[0] for b in halves[1]]
            continue
        found = x[i] @ y[j].T
        p, q = np.nonzero(found >= least - EDGE)
        if one:
            p, q = p[p < q], q[p < q]
        for e in np.flatnonzero(found[p, q] < least + EDGE):  # the edge: exactly rounded
            found[p[e], q[e]] = math.fsum(x[i[p[e]]] * y[j[q[e]]])
        good = found[p, q] >= least
        yield i[p[good]], j[q[good]]


def _lowest(i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` places the smallest place that links join it with."""
    low = np.arange(count)
    while True:
        before = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(low, i, both)
        np.minimum.at(low, j, both)
        low = low[low]
        if (low == before).all():
            return low


_LINKED = "c long, low long, links long, to_c long, to_low long"


def _tiles(axes: dict[int, np.ndarray], least: float):
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                same = pair.a == pair.b
                sides = [[np.frombuffer(v, dtype=np.int64) for v in side] + [np.frombuffer(units).reshape(-1, pair.dim)] for side, units in (
                    ((pair.a_ids, pair.a_cs, pair.a_ms), pair.a_units), ((pair.b_ids, pair.b_cs, pair.b_ms), pair.b_units))]
                (low_x, c_x, m_x, x), (low_y, c_y, m_y, y) = sides
                found = list(joined(x, y, along(x, axes), along(y, axes), least, same))
                if not any(len(i) for i, _ in found):
                    continue
                i, j = (np.concatenate(side) for side in zip(*found))
                j = j if same else j + len(x)
                low, c, m = (x_side if same else np.concatenate([x_side, y_side]) for x_side, y_side in ((low_x, low_y), (c_x, c_y), (m_x, m_y)))
                links = np.zeros(len(c), dtype=np.int64)
                np.add.at(links, i, m[j])
                np.add.at(links, j, m[i])
                to, at = _lowest(i, j, len(c)), np.flatnonzero(links)
                yield pd.DataFrame({"c": c[at], "low": low[at], "links": links[at], "to_c": c[to[at]], "to_low": low[to[at]]})
    return look


def near_vectors(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: the id, n_links, component_id, kept."""
    spark = rows.sparkSession
    epsilon = math.sqrt(2 - 2 * least)
    named = materialise(keyed(rows, id_col, vector_col), "vectors")
    classes = named.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("low"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = materialise(classes.select("key", F.coalesce("low", F.lit(NO_ID)).cast("long").alias("low"), "m", "dim", "vec", F.monotonically_increasing_id().alias("c")), "classes")
    sample = [np.frombuffer(r["vec"]) for r in classes.select("key", "vec").orderBy("key").limit(SAMPLE).collect()]
    axes = directions(sample)

    cells = F.pandas_udf(_in_cells(axes, epsilon), "array<int>")
    placed = numbered(classes.select("dim", "low", "c", "m", "vec", "key", cells.asNondeterministic()("vec").alias("cell")), "dim", ["cell", "key"], "grid-order")
    per_block = F.greatest(F.lit(LEAST), F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
    cut = placed.select("dim", F.floor(F.col("_at") / F.floor(per_block)).alias("b"), "_at", "low", "c", "m", "vec")
    blocks = materialise(cut.groupBy("dim", "b").applyInPandas(_one_block(axes), _BLOCK), "blocks")
    pairs = near_blocks(blocks.drop("n", "ids", "cs", "ms", "units"), epsilon)

    left, right = (blocks.select("dim", F.col("b").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "cs", "ms", "units")]) for s in "ab")
    tiles = pairs.join(left, ["dim", "a"]).join(right, ["dim", "b"])
    with workers.batches_of(spark, 4):
        found = materialise(tiles.mapInPandas(_tiles(axes, least), _LINKED), "links")

    def node(low, c):
        return F.struct(F.col(low).alias("low"), F.col(c).alias("c"))

    known = components(found.where("c <> to_c").select(node("low", "c").alias("a"), node("to_low", "to_c").alias("b")), "vector-links")
    known = known.select("id.c", F.col("component.low").alias("to"))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    judged = materialise(classes.join(counts, "c", "left").join(known, "c", "left").select(
        "key", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.nullif(F.coalesce("to", "low"), F.lit(NO_ID)).alias("to")), "judged")

    # A vector with a thousandth of all rows or more is joined by broadcast: there are a thousand of them at most.
    often = judged.select(F.coalesce(F.sum("m"), F.lit(0)).alias("all")).first()["all"] / 1_000
    hot = F.broadcast(judged.where(F.col("m") > often).select("key", F.col("n_links").alias("hot_links"), F.col("to").alias("hot_to"), F.lit(True).alias("hot")))
    marked = named.select("id", "key").join(hot, "key", "left")
    rest = marked.where("hot IS NULL").select("id", "key").join(judged.where(F.col("m") <= often), "key", "left").select("id", "n_links", "to")
    out = marked.where("hot").select("id", F.col("hot_links").alias("n_links"), F.col("hot_to").alias("to")).unionByName(rest)
    component = F.coalesce("to", "id").alias("component_id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))
