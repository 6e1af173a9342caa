"""Running totals along an order inside large groups, in two levels.

One window per group would put the whole group into one task. Instead each group's order is cut
at approximate quantiles into slices; a slice is windowed on its own and shifted by the total of
the slices ahead of it. The edges only balance the work: the totals are exact for any edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 16
SLICES = FAN * FAN


def _count_upto(edges: Column, value: Column, start: Column, stride: int, low: int, high: int) -> Column:
    """How many of the edges ``low..high-1`` (times stride, from start) are at or below ``value``."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    here = F.coalesce(F.get(edges, start + F.lit(middle * stride)) <= value, F.lit(False))
    return F.when(here, _count_upto(edges, value, start, stride, middle + 1, high)).otherwise(
        _count_upto(edges, value, start, stride, low, middle)
    )


def with_slice(df: DataFrame, edges: str, value: str, name: str = "_slice") -> DataFrame:
    """Add how many of the ``SLICES - 1`` sorted edges are at or below ``value``.

    A two-step search of nested conditions, 16 ways each, which compiles; a lambda over the array
    would be interpreted for every row.
    """
    coarse = _count_upto(F.col(edges), F.col(value), F.lit(FAN - 1), FAN, 0, FAN - 1)
    fine = _count_upto(F.col(edges), F.col(value), F.col("_coarse") * FAN, 1, 0, FAN - 1)
    return df.withColumn("_coarse", coarse).withColumn(name, F.col("_coarse") * FAN + fine).drop("_coarse")


def running_totals(
    per_value: DataFrame,
    group: Sequence[str],
    order: str,
    totals: Sequence[str],
    descending: bool = False,
    few_groups: bool = True,
) -> DataFrame:
    """Add ``cum_<t>`` for every total, running along ``order`` within ``group``.

    ``per_value`` has one row per (group, order value). Groups are features, models or splits:
    their number is set by the configuration, so the edges (2 kB per group) and the slice totals
    are bounded and broadcast. Where groups come from the data and may be many, pass
    ``few_groups=False``: Spark then joins by the sizes it meets.
    """
    group, totals = list(group), list(totals)
    side = F.broadcast if few_groups else (lambda frame: frame)
    # The condition holds for every row. It keeps all columns in the input of the sketch and of the
    # slice totals, so that these and the windows read the same two shuffles.
    present = F.hash(order).cast("bigint") + F.lit(2**31) >= 0
    for name in totals:
        present = present & (F.col(name) >= 0)
    sketch = F.percentile_approx(
        F.when(present, F.col(order)), [i / SLICES for i in range(1, SLICES)], 8 * SLICES
    ).alias("_edges")
    if group:
        with_edges = per_value.join(side(per_value.groupBy(*group).agg(sketch)), group)
    else:
        with_edges = per_value.withColumn("_edges", per_value.agg(sketch).scalar())
    # One placement by slice serves the totals and the windows.
    sliced = with_slice(with_edges, "_edges", order).drop("_edges").repartition(*group, "_slice")
    turn = F.desc if descending else F.asc
    # At most SLICES rows per group.
    ahead = Window.partitionBy(*(group or [F.lit(1)])).orderBy(turn("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(*[F.sum(F.when(present, F.col(t))).alias(t) for t in totals])
        .select(*group, "_slice", *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(f"_ahead_{t}") for t in totals])
    )
    within = Window.partitionBy(*group, "_slice").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumns({f"cum_{t}": F.sum(t).over(within) for t in totals}).join(
        side(offsets), [*group, "_slice"]
    )
    out = out.withColumns({f"cum_{t}": F.col(f"cum_{t}") + F.col(f"_ahead_{t}") for t in totals})
    return out.drop("_slice", *[f"_ahead_{t}" for t in totals])
