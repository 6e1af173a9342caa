"""Sharding by minimax contiguous partition.

Documents with equal texts form an atomic group. The groups stand in a fixed order (a hash of the text), and the shards
are contiguous runs of that order. The smallest feasible shard capacity is found by binary search; a capacity is
feasible when filling shards greedily in order needs no more than the allowed number.

The group sizes never come to the driver. It holds *cells* of the order (all groups whose key starts with the same
bits), bounds the greedy cuts from both sides (a cell cut anywhere, a cell cut nowhere), and asks Spark to split only
the cells in which a cut can still fall. The number of cells held depends on the number of shards, not on the input.

Defined cases: a null text has no bytes and weighs ``OVERHEAD``; null texts form one group; its crc is null. Repeated rows
are rows like any other. An empty table gives no rows. A null doc_id is placed by its text. A group larger than the mean
makes its size the capacity; no rule can cut equal texts apart. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import materialise

OVERHEAD = 8
KEY_BITS = 52
FIRST_BITS, STEP_BITS = 12, 8
ROWS_PER_BUCKET = 20_000


class Cells:
    """The order of all groups at the resolution known so far."""

    def __init__(self, start, bits, size, groups):
        self.start, self.bits, self.size, self.groups = (np.asarray(x, dtype=np.int64) for x in (start, bits, size, groups))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.whole = (self.groups <= 1) | (self.bits >= KEY_BITS)  # cannot be cut
        self.total = int(self.end[-1]) if len(self.end) else 0

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[tuple[int, int]]:
        """Greedy cut positions in bytes, and the cell each falls into (or the next one)."""
        at, found = 0, []
        for _ in range(shards):
            target = at + capacity
            if target >= self.total:
                at = self.total
            else:
                cell = int(np.searchsorted(self.end, target, side="right"))
                stop = target if divisible and not self.whole[cell] else int(self.begin[cell])
                at = max(at, stop)
            found.append((at, int(np.searchsorted(self.end, at, side="right"))))
        return found

    def feasible(self, capacity: int, shards: int, divisible: bool) -> bool:
        return self.cuts(capacity, shards, divisible)[-1][0] >= self.total

    def smallest(self, low: int, high: int, shards: int, divisible: bool) -> int:
        """The smallest feasible capacity in [low, high]; high + 1 if there is none."""
        high += 1
        while low < high:
            mid = (low + high) // 2
            if self.feasible(mid, shards, divisible):
                high = mid
            else:
                low = mid + 1
        return low


def _cells_of(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None = None):
    """Sums per key prefix; ``within``: (start, bits) of the cells to split."""
    if within is not None:
        wanted = None
        for old in sorted({b for _, b in within}):
            starts = [s >> (KEY_BITS - old) for s, b in within if b == old]
            here = F.shiftright("_key", KEY_BITS - old).isin(starts)
            wanted = here if wanted is None else wanted | here
        groups = groups.where(wanted)
    prefix = F.shiftright("_key", KEY_BITS - bits).alias("prefix")
    sums = groups.groupBy(prefix).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"))
    found = sums.toPandas().sort_values("prefix")
    return [(int(p) << (KEY_BITS - bits), bits, int(b), int(n)) for p, b, n in zip(found["prefix"], found["b"], found["n"])]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the keys at which shards 1, 2, ... begin. ``groups``: (_key, _bytes), unique keys."""
    cells = Cells(*zip(*(_cells_of(groups, FIRST_BITS) or [(0, KEY_BITS, 0, 1)])))
    largest = groups.agg(F.max("_bytes")).first()[0] or 0
    low, high = max(-(-cells.total // shards), largest), max(cells.total, 1)
    while True:
        low = cells.smallest(low, high, shards, divisible=True)
        high = min(high, cells.smallest(low, high, shards, divisible=False))
        early, late = cells.cuts(low, shards, False), cells.cuts(high, shards, True)
        open_cells: set[int] = set()
        for (_, a), (_, b) in zip(early, late):
            inside = np.arange(a, min(b + 1, len(cells.size)))
            inside = inside[~cells.whole[inside]]
            # While the bounds are far apart, both ends and the largest cells between say the most.
            if len(inside) > 64:
                biggest = inside[np.argsort(-cells.size[inside], kind="stable")[:32]]
                inside = np.unique(np.concatenate([inside[:16], inside[-16:], biggest]))
            open_cells.update(inside.tolist())
        if not open_cells:
            break
        split = sorted(open_cells)
        rows = [(int(cells.start[i]), int(cells.bits[i]), int(cells.size[i]), int(cells.groups[i]))
                for i in range(len(cells.size)) if i not in open_cells]
        for old in sorted({int(cells.bits[i]) for i in split}):
            within = [(int(cells.start[i]), old) for i in split if cells.bits[i] == old]
            rows += _cells_of(groups, min(KEY_BITS, old + STEP_BITS), within)
        cells = Cells(*zip(*sorted(rows)))
    capacity = cells.smallest(low, high, shards, divisible=False)
    return capacity, [int(cells.start[c]) if c < len(cells.start) else 1 << KEY_BITS
                      for _, c in cells.cuts(capacity, shards, False)[:-1]]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its shard and its slot within the shard.

    ``slot`` is gapless per shard. It is the row's rank in one of many small hash buckets plus the rows of the buckets
    before, so no task ranks a whole shard.
    """
    text = F.col(text_col)
    slim = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("_key"),
    ), "shard-rows")
    groups = materialise(slim.groupBy("_key").agg(F.sum("size").alias("_bytes")), "shard-groups")
    _, begins = minimax_cuts(groups, shards)
    shard = sum(((F.col("_key") >= F.lit(b)).cast("int") for b in begins), F.lit(0))
    buckets = max(1, -(-slim.count() // (shards * ROWS_PER_BUCKET)) * 2)
    placed = slim.withColumn("shard", shard).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_key", "size"), F.lit(buckets)))
    ahead = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_bucket").count().select(
        "shard", "_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_key", "size"))
    return (
        placed.withColumn("_rank", rank).join(offsets, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
