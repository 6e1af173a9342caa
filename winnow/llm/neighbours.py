"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree halves the space by random hyperplanes (at the median of a bounded sample of vectors) down to leaves of the sample's
size ``LEAF``. Every vector is put into one leaf of each tree. A query walks all trees at once through one priority queue, always
going on at the smallest detour of any tree, and collects leaves until they hold the wanted number of members. The
candidates in these leaves are ranked exactly, in double precision.

For inner products, vectors get one more component that makes their lengths equal, so near in angle means large in product.

The forest is the only thing broadcast; its size is bounded by the sample. Leaves are joined with the queries that visit
them as Spark groups; a leaf is cut into slices of at most about ``SLICE`` vectors and its queries are sent to every slice, so a leaf with
a third of all rows is many groups. A slice sends its best ``k`` per query, and Spark takes the best of those.
Equal vectors share every leaf; only the ``k + 1`` smallest ids of equal vectors can be among the nearest ``k``, so the others
need not be compared, and nothing is lost.

Defined cases: vectors that are null, empty, zero, of another length than the first row's (by the smallest id), or that hold null or
non-finite components take no part, as query or candidate; rows with a null id neither. Repeated ids are one row if
their vectors are equal. Ties go to the smaller id. With fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.session import materialise

TREES = 12
LEAF = 64
SAMPLE = 4_096
#: Members of the visited leaves, a vector counting once per tree that offers it, as a share of all vectors.
SHARE = 1.0
SLICE = 2_048


class Forest:
    """Trees as arrays: node k has planes[k], offsets[k], children[k]; a child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.roots, self.children = [], []
        planes, offsets = [], []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= leaf:
                self.leaves += 1
                return -self.leaves
            plane = draw.normal(size=sample.shape[1])
            side = sample[rows] @ plane
            middle = float(np.median(side))
            left, right = rows[side <= middle], rows[side > middle]
            if not len(left) or not len(right):
                self.leaves += 1
                return -self.leaves
            at = len(planes)
            planes.append(plane / np.linalg.norm(plane))
            offsets.append(middle / np.linalg.norm(plane))
            self.children.append((0, 0))
            self.children[at] = (grow(left), grow(right))
            return at

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        self.planes = np.array(planes).reshape(-1, sample.shape[1])
        self.offsets = np.array(offsets)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int32)
        for tree, root in enumerate(self.roots):
            stack = [(root, np.arange(len(vectors)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, tree] = -node - 1
                elif len(rows):
                    right = vectors[rows] @ self.planes[node] > self.offsets[node]
                    stack += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def visit(self, vector: np.ndarray, held: dict[int, int], wanted: float) -> list[int]:
        """Leaves in order of the smallest detour over all trees, until they hold ``wanted`` vectors."""
        sides = self.planes @ vector - self.offsets if len(self.planes) else None
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, total = [], 0
        while queue and total < wanted:
            detour, node = heapq.heappop(queue)
            while node >= 0:
                left, right = self.children[node]
                side = sides[node]
                near, far = (right, left) if side > 0 else (left, right)
                heapq.heappush(queue, (max(detour, abs(side)), far))
                node = near
            found.append(-node - 1)
            total += held.get(-node - 1, 0)
        return found


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) rows that take part, equal vectors cut to what a search can return: see ``search``."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.size(vec) > 0
    good &= F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & good)
    return rows.dropDuplicates(["id", "vec"])


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           share: float = SHARE, trees: int = TREES) -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialise(usable(vectors, id_col, vec_col), "vectors")
    first = rows.orderBy("id").limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema)
    size = len(first[0]["vec"])
    rows = rows.where(F.size("vec") == size)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    total, longest = rows.agg(F.count("*"), F.max(norm)).first()
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()])
    forest = Forest(_equal_lengths(sample, longest), trees)
    shared, name = spark.sparkContext.broadcast(forest), workers.token()

    # Equal vectors: the k + 1 smallest ids stand for all.
    rank = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("id"))
    again = F.row_number().over(Window.partitionBy("_same").orderBy("id"))
    same = rows.select("id", F.sha2(F.array_join("vec", ",").cast("binary"), 256).alias("_same"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("_part"))
    chosen = same.withColumn("_r", rank).where(F.col("_r") <= k + 1).withColumn("_r", again).where(F.col("_r") <= k + 1).select("id")
    base = rows.join(chosen, "id", "left_semi")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_ = workers.once(name, lambda: shared.value)
        for batch in batches:
            if len(batch):
                leaves = trees_.place(_equal_lengths(np.stack(batch["vec"].to_numpy()), longest))
                n = leaves.shape[1]
                yield pd.DataFrame({"leaf": leaves.reshape(-1), "id": np.repeat(batch["id"].to_numpy(), n), "vec": [v for v in batch["vec"] for _ in range(n)]})

    members = materialise(base.mapInPandas(placed, "leaf int, id long, vec array<double>"), "leaves")
    held = {r["leaf"]: r["n"] for r in members.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most the forest's leaves
    population = spark.sparkContext.broadcast(held)
    wanted = max(share * total, 40 * k)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_, sizes = workers.once(name, lambda: shared.value), population.value
        for batch in batches:
            for q, vec in zip(batch["id"], batch["vec"]):
                plain = np.concatenate([vec / (np.linalg.norm(vec) or 1), [0.0]]) * longest**0.5
                leaves = [x for x in trees_.visit(plain, sizes, wanted) if x in sizes]
                yield pd.DataFrame([(x, s, q, vec) for x in leaves for s in range(-(-sizes[x] // SLICE))], columns=["leaf", "slice", "q", "qvec"])

    slices = F.ceil(F.element_at(F.create_map(*[F.lit(x) for leaf, n in held.items() if n > SLICE for x in (leaf, n)]), F.col("leaf")) / SLICE) if any(n > SLICE for n in held.values()) else F.lit(None)
    members = members.withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce(slices, F.lit(1)).cast("long")).cast("int"))
    queries = rows.where(F.col("id") % every == 0).mapInPandas(visits, "leaf int, slice int, q long, qvec array<double>")

    def best(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        there = there.sort_values("id", kind="stable")
        ids, matrix = there["id"].to_numpy(), np.stack(there["vec"].to_numpy())
        out = []
        for at in range(0, len(asked), 512):
            part = asked.iloc[at:at + 512]
            scores = np.stack(part["qvec"].to_numpy()) @ matrix.T
            scores[ids[None, :] == part["q"].to_numpy()[:, None]] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["q"].to_numpy(), order.shape[1]), "vec_id": ids[order].reshape(-1), "score": np.take_along_axis(scores, order, 1).reshape(-1)}))
        found = pd.concat(out)
        return found[np.isfinite(found["score"])]

    found = queries.groupBy("leaf", "slice").cogroup(members.groupBy("leaf", "slice")).applyInPandas(best, "query_id long, vec_id long, score double")
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _equal_lengths(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all rows have the greatest length."""
    rest = np.sqrt(np.maximum(0, longest - (vectors**2).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)
