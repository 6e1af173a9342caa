"""Positions of rows along an order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import materialise

_BITS = 33  # monotonically_increasing_id() holds the row's number inside its partition in the low 33 bits


def parts_for(rows: int) -> int:
    """Tasks for ``rows`` small rows: half a million each, fewer where that leaves cores idle."""
    return max(1, -(-rows // 500_000), min(64, -(-rows // 5_000)))


def numbered(rows: DataFrame, group: str, order: Sequence[str], label: str = "numbered") -> DataFrame:
    """Adds ``_at`` (from 0, gapless along ``order`` inside ``group``) and ``_n`` (rows of the group). ``group`` holds no nulls.

    Rows are dealt by range of (group, order), so a group with a third of all rows is spread over as many tasks; a row's place is its
    place in its task and what earlier tasks hold of its group. Ties in ``order`` are broken by a number each row gets where it is read,
    so equal rows spread as well and which of them comes first is open.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    placed = dealt.repartitionByRange(parts_for(rows.count()), *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = materialise(placed.withColumn("_place", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftright("_place", _BITS)).withColumn("_place", F.col("_place").bitwiseAND((1 << _BITS) - 1))
    # One row for each task and each group in it.
    held = placed.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count("*").alias("_held"))
    along = Window.partitionBy(group).orderBy("_part")
    before = F.coalesce(F.sum("_held").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_held").over(Window.partitionBy(group))
    held = held.select("_part", group, (before - F.col("_first")).alias("_shift"), total.alias("_n"))
    return placed.join(held, ["_part", group]).withColumn("_at", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
