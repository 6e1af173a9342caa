"""Periodic runs of words, by way of a grammar.

A run with period q and at least ``max(shortest, 2 * q)`` words has that many less q words in a row which equal the word q further on, so at least
``shortest // 2``: every word of a run stands in a window of so many words that occurs again in its text. Words in no such window are
outside all runs; the stretches of the others are compressed:

* Re-Pair replaces the most frequent pair of neighbouring symbols by a new one until no pair occurs twice. A symbol (nonterminal) has two
  parts and thus one boundary; the symbols that are left are joined two by two, so every inner boundary of a stretch belongs to one node.
* For each node once: the periodic stretches that cross its boundary, as far as the node reaches. Where windows next to the boundary occur
  again in the node, the distance is a period to try, and the longest common extensions both ways give the stretch. Common
  extensions are compared by the exact names of all substrings of 1, 2, 4, ... words.
* What a nonterminal has is translated to all places that it derives. The node that just covers a run has it whole; nodes below have parts of it,
  which merging drops, along with multiples of the smallest period.

Defined cases: null and texts with fewer than ``shortest`` words have no runs; rows are judged on their own, whatever their id or repeats;
columns other than the text are not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.llm.shingles import hashed, runs, words_of

SHORTEST = 12
TRIES = 1 << 20  # candidate periods handled at once; bounds memory, not results
Rule = tuple[int, int]


def stretches(words: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal stretches of words that stand in a window occurring again. ``words``: 64-bit numbers."""
    windows = runs(words, width)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return []
    step = np.zeros(len(words) + 1, dtype=np.int64)
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    step[again] += 1
    step[again + width] -= 1
    edges = np.flatnonzero(np.diff(np.cumsum(step) > 0, prepend=False, append=False))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def re_pair(symbols: list[int], first_new: int) -> tuple[dict[int, int], list[Rule], list[int]]:
    """(what is left, as place: symbol in order; the two parts of each new symbol; a place where each new symbol stood).

    Negative symbols are borders: no pair holds one. A new symbol stands where its first word stood.
    """
    symbols, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[Rule, set[int]] = defaultdict(set)
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if pair[0] >= 0 and pair[1] >= 0:
            places[pair].add(i)
    queue = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(queue)
    rules: list[Rule] = []
    stood: list[int] = []
    while queue:
        count, pair = heapq.heappop(queue)
        found = sorted(places[pair])
        if pair[0] == pair[1]:  # of overlapping places every other one
            apart, end = [], -1
            for i in found:
                if i >= end:
                    apart.append(i)
                    end = after[after[i]]
            found = apart
        if len(found) < 2:
            continue
        if len(found) < -count:
            heapq.heappush(queue, (-len(found), pair))
            continue
        new, touched = first_new + len(rules), set()
        for i in found:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0 and symbols[left] >= 0:
                places[symbols[left], pair[0]].discard(left)
                places[symbols[left], new].add(left)
                touched.add((symbols[left], new))
            if right < n:
                if symbols[right] >= 0:
                    places[pair[1], symbols[right]].discard(j)
                    places[new, symbols[right]].add(i)
                    touched.add((new, symbols[right]))
                before[right] = i
            symbols[i], symbols[j], after[i] = new, -1, right
        del places[pair]
        rules.append(pair)
        stood.append(found[0])
        for near in touched:
            if len(places[near]) > 1:
                heapq.heappush(queue, (-len(places[near]), near))
    left, i = {}, 0
    while i < n:
        left[i] = symbols[i]
        i = after[i]
    return left, rules, stood


class Names:
    """Exact names of all substrings of 1, 2, 4, ... words: equal names, equal words."""

    def __init__(self, ids: np.ndarray):
        self.levels = [ids]
        while 1 << len(self.levels) <= len(ids):
            last, size = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[:-size] * np.int64(len(ids) + 1) + last[size:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1])

    def windows(self, width: int) -> np.ndarray:
        """Names of all windows of ``width`` words."""
        level = width.bit_length() - 1
        last, rest = self.levels[level], width - (1 << level)
        count = len(self.levels[0]) - width + 1
        return np.unique(last[:count] * np.int64(len(self.levels[0]) + 1) + last[rest:rest + count], return_inverse=True)[1]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from x and y on (forward), or before x and y (back), are equal: ``most`` at the most."""
        done = np.zeros(len(x), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            size, names = 1 << level, self.levels[level]
            fits = np.flatnonzero(done + size <= most)
            a, b = (x[fits] + done[fits], y[fits] + done[fits]) if forward else (x[fits] - done[fits] - size, y[fits] - done[fits] - size)
            done[fits[names[a] == names[b]]] += size
        return done


def across(names: Names, low: np.ndarray, cut: np.ndarray, high: np.ndarray, shortest: int) -> np.ndarray:
    """(node, start, end, period) of the periodic stretches that cross each node's ``cut``, clipped to the node, with smallest periods."""
    width, total = shortest // 2, len(names.levels[0])
    if total < width:
        return np.empty((0, 4), dtype=np.int64)
    windows = names.windows(width)
    keys = windows * np.int64(total) + np.arange(len(windows))
    keys.sort()
    found = [np.empty((0, 4), dtype=np.int64)]
    node = np.flatnonzero(high - low >= shortest)
    for by in range(width + 1):  # windows that start ``by`` words before the cut
        at = cut[node] - by
        near = node[(at >= low[node]) & (at + width <= high[node])]
        at, half = cut[near] - by, (high[near] - low[near]) // 2
        start = np.searchsorted(keys, windows[at] * total + np.maximum(low[near], at - half))
        count = np.searchsorted(keys, windows[at] * total + np.minimum(high[near] - width, at + half), side="right") - start
        for block in np.split(np.arange(len(near)), np.searchsorted(np.cumsum(count) // TRIES, np.arange(1, count.sum() // TRIES + 1))):
            each = np.repeat(block, count[block])
            place = np.arange(len(each)) - np.repeat(np.cumsum(count[block]) - count[block], count[block]) + start[each]
            who, here, other = near[each], at[each], keys[place] % total
            fresh = other != here
            # The window one word earlier has shown the same distance.
            if by < width:
                earlier = (here > low[who]) & (other > low[who])
                earlier[earlier] = windows[here[earlier] - 1] == windows[other[earlier] - 1]
                fresh &= ~earlier
            who, here, other = who[fresh], here[fresh], other[fresh]
            period = np.abs(other - here)
            x = np.where(other > here, cut[who], cut[who] - period)  # x and x + period stand beside the cut
            ahead = names.common(x, x + period, high[who] - x - period, True)
            back = names.common(x, x + period, x - low[who], False)
            begin, end = x - back, x + period + ahead
            good = (end - begin >= np.maximum(shortest, 2 * period)) & (begin < cut[who]) & (end > cut[who])
            found.append(np.stack([who[good], begin[good], end[good], period[good]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])] if len(rows) else rows


def merged(rows: np.ndarray, total: int) -> np.ndarray:
    """Of (start, end, period): those within no other of the same period, and of equal stretches the smallest period; by start, then period."""
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    reach = rows[:, 1] + rows[:, 2] * np.int64(total + 1)
    rows = rows[reach > np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(words: list[bytes], shortest: int = SHORTEST) -> np.ndarray:
    """(start, end, period) of all runs of a word sequence, by start, then period."""
    empty = np.empty((0, 3), dtype=np.int64)
    if len(words) < shortest:
        return empty
    parts = stretches(hashed(words), shortest // 2)
    if not parts:
        return empty
    # The stretches in one sequence of exact word numbers, a border of its own after each.
    number: dict[bytes, int] = {}
    symbols, shift = [], []
    for low, high in parts:
        shift.append((len(symbols), low))
        symbols += [number.setdefault(w, len(number)) for w in words[low:high]]
        symbols.append(-1)
    ids = np.array(symbols, dtype=np.int64)
    borders = ids < 0
    ids[borders] = len(number) + np.arange(borders.sum())
    names = Names(ids)

    left, rules, stood = re_pair(symbols, len(number))
    first = len(number)
    size = [1] * first
    for a, b in rules:
        size.append(size[a] + size[b])
    nodes = [(at, at + size[a], at + size[a] + size[b]) for at, (a, b) in zip(stood, rules)]
    nodes += _joined(left)
    low, cut, high = np.array(nodes, dtype=np.int64).reshape(-1, 3).T
    rows = across(names, low, cut, high, shortest)

    # From the nodes to the places that they derive, larger symbols before their parts.
    bounds = np.searchsorted(rows[:, 0], np.arange(len(rules) + 1))
    found = [rows[bounds[-1]:, 1:]]
    bears = []
    for k, pair in enumerate(rules):
        bears.append(bool(bounds[k + 1] > bounds[k]) or any(part >= first and bears[part - first] for part in pair))
    there: dict[int, list] = defaultdict(list)
    for at, symbol in left.items():
        if symbol >= first and bears[symbol - first]:
            there[symbol - first].append(np.array([at]))
    for k in range(len(rules) - 1, -1, -1):
        if k in there:
            at, own, (a, b) = np.concatenate(there.pop(k)), rows[bounds[k]:bounds[k + 1], 1:], rules[k]
            moved = np.repeat(own, len(at), axis=0)
            moved[:, :2] += np.tile(at - stood[k], len(own))[:, None]
            found.append(moved)
            for part, ahead in ((a, 0), (b, size[a])):
                if part >= first and bears[part - first]:
                    there[part - first].append(at + ahead)
    whole = np.concatenate(found)
    if not len(whole):
        return empty
    whole = merged(whole, len(ids))
    bases, starts = np.array(shift, dtype=np.int64).T
    whole[:, :2] += (starts - bases)[np.searchsorted(bases, whole[:, 0], side="right") - 1][:, None]
    return whole


def _joined(left: dict[int, int]) -> list[tuple[int, int, int]]:
    """Nodes (start, boundary, end) that join the symbols of each stretch two by two."""
    nodes, stretch = [], []
    for at, symbol in left.items():
        stretch.append(at)
        if symbol < 0:
            todo = [(0, len(stretch) - 1)]
            while todo:
                a, b = todo.pop()
                if b - a >= 2:
                    middle = (a + b) // 2
                    nodes.append((stretch[a], stretch[middle], stretch[b]))
                    todo += [(a, middle), (middle, b)]
            stretch = []
    return nodes


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words outside what any run holds after its first period."""
    if not len(found):
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]


def with_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", shortest: int = SHORTEST) -> DataFrame:
    """Documents with their runs (start, length, period in words, by start, then period) and the text without what runs repeat."""
    workers.small_batches(docs.sparkSession)

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def judged(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text, lower=False)
            found = runs_of(words, shortest)
            rows = [(start, end - start, period) for start, end, period in found.tolist()]
            out.append((rows, b" ".join(collapsed(words, found)).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["runs", "collapsed"])

    names = [c for c in docs.columns if c not in (runs_col, collapsed_col)]
    # A struct of its own, so that no column of the documents can clash.
    made = docs.select(F.struct(*names).alias("row"), judged.asNondeterministic()(F.col(text_col)).alias("found"))
    return made.select("row.*", F.col("found.runs").alias(runs_col), F.col("found.collapsed").alias(collapsed_col))


def drilled(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where 10 divides crc32 of the id, words from some place on repeat with a period that the id gives; ids of null never do."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document, after :func:`drilled`: n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    found = with_runs(drilled(docs))
    # The largest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    longest = found.withColumn("best", best)
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
