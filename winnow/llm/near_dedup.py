"""Near-duplicates by MinHash: 16 bands of 4 values name the candidates, full sets confirm them.

Documents with equal shingle sets are one class from the start. A class has 64 minhash values; each of ``ORDERS`` bands of ``LEAST`` values puts it
into one region, and all classes of a region are candidates of each other, however many they are.

Regions of at most ``FEW`` classes give their pairs by a join; a pair is confirmed once. Larger regions, the crowded ones, never become rows of pairs: a region is
cut into parts of about ``ROWS_PER_PART`` classes (or ``SHINGLES_PER_PART`` shingles), a task takes two parts with their full sets, counts the shingles that
every two of their classes share, and gives the links that join what all links there join, at most one for each class.

The regions of the first ``FIRST`` bands are compared part by part; that joins most of what is linked at all. Of the other crowded regions, and of those with
several parts, only what is not one component by then is left: there, every two parts are compared that are not of one and the same component, so no pair of a region is
left out. Parts hold whole components where these are small enough. This is quadratic only in what shares a region without being linked.

Defined cases: a text without words, or null, has an empty set and is linked with nothing (component: itself); fewer than five words are one
shingle; repeated rows are equal sets and link; a row without id takes part in links but cannot name a component; ties cannot
arise, as only the smallest id counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.llm.components import components
from winnow.llm.shingles import mixed, shingle_set
from winnow.session import materialise

VALUES, ORDERS, LEAST = 64, 16, 4
FEW, FIRST = 8, 4
ROWS_PER_PART, SHINGLES_PER_PART = 2_048, 2_000_000
SPARSE, COLUMNS = 32, 2_048
_DRAW = np.random.default_rng(20240229)
_TIMES = _DRAW.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 minhash values of 16 bits."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2_048):
        low = np.minimum(low, (shingles[at:at + 2_048, None] * _TIMES + _PLUS).min(axis=0))
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(">u2")


def regions_of(sig: np.ndarray) -> np.ndarray:
    """One number per band: classes with the same number share the band's values (or, by a rare chance, are compared without need)."""
    return mixed(sig.view(">u8").astype(np.uint64) + np.arange(ORDERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, n_shingles, class, regions): class is a digest of the full set, null for empty sets."""
    @F.pandas_udf("n long, class binary, regions array<long>")
    def digested(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingle_set(text)
            rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), regions_of(signature(found))) if len(found) else (0, None, None))
        return pd.DataFrame(rows, columns=["n", "class", "regions"])

    rows = docs.select("doc_id", *more, digested.asNondeterministic()("text").alias("d"))
    return rows.select("doc_id", *more, F.col("d.n").alias("n_shingles"), F.col("d.class").alias("class"), F.col("d.regions").alias("regions"))


def shared_counts(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """How many shingles each of the first ``cut`` sets shares with each of the others; with ``cut`` of 0: every set with every other."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(starts, len(values)))
    size, column = np.repeat(sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
    high, wide = cut or len(sets), len(sets) - cut
    out = np.zeros((high, wide), dtype=np.int32)
    # A shingle of few sets: their pairs. Rows ascend within a column.
    few = (size > 1) & (size <= SPARSE)
    r, c = rows[few], column[few]
    for by in range(1, SPARSE):
        same = np.flatnonzero(c[by:] == c[:-by])
        if not len(same):
            break
        i, j = r[same], r[same + by]
        if cut:
            across = (i < cut) & (j >= cut)
            i, j = i[across], j[across] - cut
        out += np.bincount(i * wide + j, minlength=high * wide).reshape(high, wide).astype(np.int32)
    if not cut:
        out += out.T.copy()
    # A shingle of many: a column of zeros and ones.
    many = size > SPARSE
    r, c = rows[many], np.unique(column[many], return_inverse=True)[1]
    for low in range(0, int(c.max()) + 1 if len(c) else 0, COLUMNS):
        at = slice(*np.searchsorted(c, [low, low + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[r[at], c[at] - low] = 1
        out += (held[:high] @ held[cut:].T).astype(np.int32)
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a symmetric matrix that join what all its links join, at most one for each row."""
    left, ones, others = linked.any(axis=1), [], []
    while left.any():
        front = np.array([left.argmax()])
        left[front] = False
        while len(front):
            reach = linked[front] & left
            new = np.flatnonzero(reach.any(axis=0))
            ones.append(front[reach[:, new].argmax(axis=0)] if len(new) else new), others.append(new)
            left[new] = False
            front = new
    none = np.empty(0, dtype=int)
    return np.concatenate([none, *ones]), np.concatenate([none, *others])


def linked_in(sets: list[np.ndarray], component: np.ndarray, cut: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components that join what all such links join: among all sets, or (``cut``) from the first ones to the others."""
    size, linked = np.array([len(s) for s in sets], dtype=np.int64), np.zeros((len(sets), len(sets)), dtype=bool)
    shared = shared_counts(sets, cut)
    for i in range(len(shared)):
        both = shared[i].astype(np.int64)
        linked[i, cut:] = (100 * both >= percent * (size[i] + size[cut:] - both)) & (component[i] != component[cut:])
    return forest(linked | linked.T if cut else linked)


def compared(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the classes of two parts of a region. ``parts``: (region, x, y, part, id, c), part one of x and y, c the component known so far."""
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].iat[0], rows["y"].iat[0]
        if x != y:
            rows = pd.concat([rows[rows["part"] == x], rows[rows["part"] == y]], ignore_index=True)
        cut = 0 if x == y else int((rows["part"] == x).sum())
        i, j = linked_in([np.frombuffer(s, dtype=np.uint64) for s in rows["set"]], pd.factorize(rows["c"])[0], cut, percent)
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    rows = parts.join(sets, "id")
    return rows.groupBy("region", "x", "y").applyInPandas(links, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                out.append(False)
                continue
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(linked("set_a", "set_b")).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) for the classes of ``wanted`` (id, doc_id): from the text of one document each."""
    @F.pandas_udf("class binary, set binary")
    def made(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t).tobytes() for t in texts]
        return pd.DataFrame({"class": [xxhash.xxh3_128_digest(f) for f in found], "set": found})

    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("id", made.asNondeterministic()("text").alias("d"))
    return rows.where(F.col("d.class") == F.col("id")).select("id", F.col("d.set").alias("set")).dropDuplicates(["id"])


def _parts(rows: str, shingles: str):
    return F.ceil(F.greatest(F.col(rows) / ROWS_PER_PART, F.col(shingles) / SHINGLES_PER_PART))


def unsettled(crowded: DataFrame, known: DataFrame) -> DataFrame:
    """What ``compared`` takes: every two parts of crowded regions, but for those of one component. ``crowded``: (region, id, n, m, w)."""
    rows = crowded.join(known, "id", "left").withColumn("c", F.coalesce("component", "id"))
    open_ = rows.groupBy("region").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low <> _high").select("region")
    rows = materialise(rows.join(open_, "region").select("region", "id", "c", "n", "m", "w"), "open")
    sizes = rows.groupBy("region", "c").agg(F.count("*").alias("_rows"), F.sum("n").alias("_shingles"), F.first("m").alias("m"), F.first("w").alias("w"))
    sizes = sizes.select("region", "c", _parts("_rows", "_shingles").alias("_own"), _parts("m", "w").alias("_all"))
    part = F.when(F.col("_own") > 1, F.xxhash64("c", F.pmod(F.xxhash64("id"), "_own"))).otherwise(F.pmod(F.xxhash64("c"), "_all"))
    rows = materialise(rows.join(sizes, ["region", "c"]).select("region", part.alias("part"), "id", "c"), "parts")
    parts = rows.groupBy("region", "part").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    one, other = (parts.select("region", *[F.col(c).alias(f"{c}_{side}") for c in ("part", "low", "high")]) for side in "xy")
    two = one.join(other, "region").where("part_x <= part_y AND NOT (low_x = high_x AND low_y = high_y AND low_x = low_y)")
    two = two.select("region", F.col("part_x").alias("x"), F.col("part_y").alias("y"), F.explode(F.array_distinct(F.array("part_x", "part_y"))).alias("part"))
    return two.join(rows, ["region", "part"]).select("region", "x", "y", "part", "id", "c")


def grouped(docs: DataFrame, percent: int, *carried: str) -> DataFrame:
    """(doc_id, *carried, n_shingles, _group): rows of one group are near-duplicates, directly or through others; null for empty sets."""
    workers.small_batches(docs.sparkSession)
    rows = materialise(signed(docs, *carried), "signatures")
    classes = materialise(rows.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("class").alias("id")).agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("regions").alias("regions")), "classes")
    members = classes.select("id", "n", F.posexplode("regions").alias("band", "region"))
    shared = materialise(members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1"), "regions")
    members = materialise(members.join(shared, "region"), "members")
    few, crowded = members.where(F.col("m") <= FEW), members.where(F.col("m") > FEW)
    left, right = (few.select("region", F.col("id").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    pairs = left.join(right, "region").where(f"a < b AND 100 * least(na, nb) >= {int(percent)} * greatest(na, nb)").select("a", "b").distinct()
    sets = materialise(full_sets(docs, classes.join(members.select("id").distinct(), "id").select("id", "doc_id")), "sets")
    links = confirmed(pairs, sets, percent)
    part = F.pmod(F.xxhash64("id"), _parts("m", "w"))
    first = crowded.where(F.col("band") < FIRST).select("region", *[part.alias(c) for c in ("x", "y", "part")], "id", F.col("id").alias("c"))
    known = materialise(components(links.unionByName(compared(first, sets, percent))), "components")
    rest = crowded.where((F.col("band") >= FIRST) | (_parts("m", "w") > 1))
    new = materialise(compared(unsettled(rest, known), sets, percent), "links")
    if not new.isEmpty():
        # Components as links to their smallest member join what the links so far join, in one step.
        stars = known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        known = materialise(components(stars.unionByName(new)), "components")

    return rows.select("doc_id", *carried, "n_shingles", "class").join(known.withColumnRenamed("id", "class"), "class", "left").select(
        "doc_id", *carried, "n_shingles", F.coalesce("component", "class").alias("_group"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: n_shingles, component_id, kept."""
    keyed = grouped(docs, percent)
    lowest = keyed.where("_group IS NOT NULL").groupBy("_group").agg(F.min("doc_id").alias("_low"))
    out = keyed.join(lowest, "_group", "left").withColumn("component_id", F.coalesce("_low", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group, and all rows without words; columns as given.

    It is the row with the smallest id (a row without id only where no other is), of several such rows the one with the smallest digest. Rows are told
    apart by id and digest, not by id alone: another text under the same id is judged by itself, and of equal rows one stays.
    """
    digest = F.concat_ws("-", F.sha2(F.col("text").cast("binary"), 256), F.hex(F.xxhash64(*docs.columns)))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", digest.alias("key"))
    marked = materialise(grouped(docs.select("doc_id", "text", digest.alias("key")), percent, "key").where("_group IS NOT NULL"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    # Partial sums first: a group of a third of all rows is one row per task.
    winners = marked.groupBy("_group").agg(F.min(place).alias("p")).select("p.doc_id", "p.key")
    counts = marked.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    told = materialise(counts.alias("c").join(winners.alias("w"), _same("c", "w"), "left").select("c.*", F.col("w.key").isNotNull().alias("wins")), "winners")
    left = rows.alias("r").join(told.where("NOT wins").alias("g"), _same("r", "g"), "left_anti")
    repeated = told.where("wins AND n > 1")
    if not repeated.isEmpty():
        once = left.alias("r").join(repeated.alias("g"), _same("r", "g"), "left_semi").dropDuplicates(["doc_id", "key"])
        left = left.alias("r").join(repeated.alias("g"), _same("r", "g"), "left_anti").unionByName(once)
    return left.select("row.*")


def _same(one: str, other: str):
    return F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col(f"{one}.key") == F.col(f"{other}.key"))
