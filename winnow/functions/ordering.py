"""Deterministic random order by hash, and exact cut points in it.

Sampling and splitting never rank every row. A row belongs to the first ``k`` rows of its group
iff its ``(hash, key)`` is at or below that of the ``k``-th row, so it is enough to find that one
row. Hash prefixes are counted (a small aggregate over the key column alone), the prefix holding
the ``k``-th row is read off the counts, and prefixes are lengthened until few rows are left. The
cut points are then plain values: marking rows is a comparison inside the scan, without a join, a
shuffle or a sort of the wide rows, and it gives the same answer however often it is recomputed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP_DIGITS = 3  # hex digits per round: 4,096 counts per group
FEW_ROWS = 50_000  # rows of one prefix that may be put in order
LITERAL_GROUPS = 64

Group = tuple
Quotas = Callable[[dict[Group, int]], dict[Group, dict[str, int]]]


def order_hash(key: str | Column, *salt: object) -> Column:
    """Hex md5 of the row key and a salt: a reproducible shuffle order for any seed."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", column.cast("string"), *[F.lit(str(s)) for s in salt]))


@dataclass(frozen=True)
class HashCuts:
    """Cut points per group. Groups are class labels or time buckets, never row keys."""

    group: tuple[str, ...]
    key: str
    salt: str
    sizes: Mapping[Group, int]
    points: Mapping[Group, Mapping[str, tuple[str, object] | None]]

    def mark(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Add a boolean column per cut: whether the row is among those the cut admits."""
        hashed = df.withColumn("_hash", order_hash(self.key, self.salt))
        if len(self.points) <= LITERAL_GROUPS:
            marks = {n: self._literal(n) for n in names}
            return hashed.withColumns(marks).drop("_hash")
        fields = [df.schema[g] for g in self.group]
        for n in names:
            fields += [T.StructField(f"_h_{n}", T.StringType()), T.StructField(f"_k_{n}", df.schema[self.key].dataType)]
        rows = [(*g, *[part for n in names for part in (p[n] or (None, None))]) for g, p in self.points.items()]
        side = df.sparkSession.createDataFrame(rows, T.StructType(fields))
        marks = {n: _at_or_below(self.key, F.col(f"_h_{n}"), F.col(f"_k_{n}")) for n in names}
        joined = hashed.join(F.broadcast(side), list(self.group), "left").withColumns(marks)
        return joined.select(*df.columns, *names)

    def _literal(self, name: str) -> Column:
        mark = F.lit(False)
        for group, cuts in self.points.items():
            point = cuts[name]
            if point is None:
                continue
            here = F.lit(True)
            for column, value in zip(self.group, group):
                here = here & F.col(column).eqNullSafe(F.lit(value))
            mark = F.when(here, _at_or_below(self.key, F.lit(point[0]), F.lit(point[1]))).otherwise(mark)
        return mark


def _at_or_below(key: str, cut_hash: Column, cut_key: Column) -> Column:
    below = (F.col("_hash") < cut_hash) | ((F.col("_hash") == cut_hash) & (F.col(key) <= cut_key))
    return F.coalesce(below, F.lit(False))


def hash_cuts(df: DataFrame, group: Sequence[str], key: str, salt: object, quotas: Quotas) -> HashCuts:
    """Find, per group, the last row each cut admits.

    ``quotas`` receives the group sizes and returns how many rows, in hash order, each named cut
    of each group admits; zero gives a cut that admits nothing.
    """
    group, salt = list(group), str(salt)
    keyed = df.select(*group, F.col(key).alias("_key"), order_hash(key, salt).alias("_hash"))
    width = STEP_DIGITS
    prefix = F.substring("_hash", 1, width)
    counts = _count(keyed, group, prefix)
    sizes: dict[Group, int] = {}
    for (g, _), n in counts.items():
        sizes[g] = sizes.get(g, 0) + n
    wanted = quotas(dict(sizes))
    points = {g: {name: None for name in cuts} for g, cuts in wanted.items()}
    searches = [
        (g, name, "", min(int(q), sizes[g])) for g, cuts in wanted.items() for name, q in cuts.items() if q > 0
    ]
    spark, fields = df.sparkSession, [df.schema[g] for g in group]
    while searches:
        ordered = sorted(counts.items(), key=lambda item: item[0][1])
        narrowed, largest = [], 0
        for g, name, start, nth in searches:
            for (owner, at), n in ordered:
                if owner != g or not at.startswith(start):
                    continue
                if nth <= n:
                    narrowed.append((g, name, at, nth))
                    largest = max(largest, n)
                    break
                nth -= n
        searches = narrowed
        schema = T.StructType([*fields, T.StructField("_prefix", T.StringType())])
        held = spark.createDataFrame(sorted({(*g, at) for g, _, at, _ in searches}, key=str), schema)
        inside = keyed.withColumn("_prefix", F.substring("_hash", 1, width)).join(
            F.broadcast(held), [*group, "_prefix"]
        )
        if largest <= FEW_ROWS:
            break
        width += STEP_DIGITS
        counts = _count(inside, group, F.substring("_hash", 1, width))
    if searches:
        place = F.row_number().over(Window.partitionBy(*group, "_prefix").orderBy("_hash", "_key"))
        places = sorted({nth for _, _, _, nth in searches})
        rows = inside.withColumn("_place", place).where(F.col("_place").isin(places)).collect()  # a few per cut
        found = {(tuple(r[c] for c in group), r["_prefix"], r["_place"]): (r["_hash"], r["_key"]) for r in rows}
        for g, name, at, nth in searches:
            points[g][name] = found[(g, at, nth)]
    return HashCuts(tuple(group), key, salt, sizes, points)


def _count(keyed: DataFrame, group: list[str], prefix: Column) -> dict[tuple[Group, str], int]:
    """Rows per group and prefix: at most 4,096 numbers per group and round."""
    rows = keyed.groupBy(*group, prefix.alias("_p")).count().toPandas()
    keys = zip(*[rows[c].tolist() for c in group]) if group else [()] * len(rows)
    return {(tuple(g), p): int(n) for g, p, n in zip(keys, rows["_p"], rows["count"])}


def share_out(total: int, sizes: Mapping[Group, int]) -> dict[Group, int]:
    """Stratify ``total`` rows over groups by largest remainder; the parts add up exactly and each
    is within one row of proportional."""
    whole = sum(sizes.values())
    parts = {g: (n * total) // whole for g, n in sizes.items()}
    turns = sorted(sizes, key=lambda g: (-((sizes[g] * total) % whole), g))
    for g in turns[: total - sum(parts.values())]:
        parts[g] += 1
    return parts
