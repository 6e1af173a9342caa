"""Evaluation of small decision-tree ensembles on one batch of rows (numpy, used inside tasks)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import factorial

import numpy as np

ROW_CHUNK = 4096


@dataclass
class TreeEnsemble:
    """Padded node arrays, one line per tree. ``feature`` is -1 at leaves; rows go left iff x <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: np.ndarray

    @classmethod
    def from_nodes(cls, nodes: list[dict], weights) -> TreeEnsemble:
        """``nodes``: dicts with tree, id, feature, threshold, left, right, value, cover."""
        trees, width = len(weights), 1 + max(n["id"] for n in nodes)
        shape = (trees, width)
        made = cls(
            np.full(shape, -1), np.zeros(shape), np.zeros(shape, int), np.zeros(shape, int),
            np.zeros(shape), np.zeros(shape), np.asarray(weights, float),
        )
        for n in nodes:
            at = (n["tree"], n["id"])
            made.value[at], made.cover[at] = n["value"], n["cover"]
            if n["left"] >= 0:
                made.feature[at], made.threshold[at] = n["feature"], n["threshold"]
                made.left[at], made.right[at] = n["left"], n["right"]
        return made

    @property
    def size(self) -> int:
        return len(self.weight)

    def first(self, trees: int) -> TreeEnsemble:
        return TreeEnsemble(
            self.feature[:trees], self.threshold[:trees], self.left[:trees], self.right[:trees],
            self.value[:trees], self.cover[:trees], self.weight[:trees],
        )

    def trees_using(self, feature: int) -> np.ndarray:
        return np.flatnonzero((self.feature == feature).any(axis=1))

    def contributions(self, x: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Weighted output of each tree for each row, rows x trees."""
        chosen = np.arange(self.size) if trees is None else np.asarray(trees)
        out = np.empty((len(x), len(chosen)))
        for start in range(0, len(x), ROW_CHUNK):
            rows = x[start : start + ROW_CHUNK]
            node = np.zeros((len(rows), len(chosen)), int)
            line = np.arange(len(rows))[:, None]
            while True:
                split = self.feature[chosen, node]
                inner = split >= 0
                if not inner.any():
                    break
                goes_left = rows[line, np.maximum(split, 0)] <= self.threshold[chosen, node]
                step = np.where(goes_left, self.left[chosen, node], self.right[chosen, node])
                node = np.where(inner, step, node)
            out[start : start + ROW_CHUNK] = self.value[chosen, node] * self.weight[chosen]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.contributions(x).sum(axis=1)

    def expected_margin(self) -> float:
        """Cover-weighted mean output: the base value that Shapley values add up from."""
        total = 0.0
        for tree in range(self.size):
            leaves = (self.feature[tree] < 0) & (self.cover[tree] > 0)
            covers = self.cover[tree][leaves]
            total += self.weight[tree] * float((self.value[tree][leaves] * covers).sum() / self.cover[tree][0])
        return total

    def _leaf_paths(self, tree: int):
        """For each leaf: its value and, per feature on the way, the interval kept and the share of cover kept."""
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            split = int(self.feature[tree, node])
            if split < 0:
                yield float(self.value[tree, node]), path
                continue
            edge, here = self.threshold[tree, node], self.cover[tree, node]
            for child, is_left in ((self.left[tree, node], True), (self.right[tree, node], False)):
                low, high, kept = path.get(split, (-np.inf, np.inf, 1.0))
                share = kept * (self.cover[tree, child] / here if here else 0.0)
                bounds = (low, min(high, edge), share) if is_left else (max(low, edge), high, share)
                stack.append((int(child), {**path, split: bounds}))

    @cached_property
    def _leaf_tables(self) -> list[tuple[dict, np.ndarray]]:
        """For each leaf that counts: its path, and Shapley values by feature of the path and pattern; a task works them out once."""
        tables = []
        for tree in range(self.size):
            for value, path in self._leaf_paths(tree):
                if path and value != 0.0:
                    kept = np.array([share for _, _, share in path.values()])
                    tables.append((path, (self.weight[tree] * value * _pattern_values(kept)).T.copy()))
        return tables

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the margin, rows x features.

        A leaf with ``d`` features on its path sees only which of them a row satisfies, one of
        ``2**d`` patterns. The values are worked out once per pattern and looked up for the rows.
        """
        leaves = self._leaf_tables
        phi = np.empty(x.shape)
        for start in range(0, len(x), ROW_CHUNK):
            # Columns lie in one piece, and a comparison is made once for all leaves that share it.
            columns = x[start : start + ROW_CHUNK].T.copy()
            sums, sides = np.zeros(columns.shape), {}

            def side(f: int, edge: float, left: bool) -> np.ndarray:
                if (f, edge, left) not in sides:
                    goes = columns[f] <= edge
                    sides[f, edge, True], sides[f, edge, False] = goes.view(np.uint8), (~goes).view(np.uint8)
                return sides[f, edge, left]

            for path, table in leaves:
                pattern = np.zeros(columns.shape[1], np.uint8 if len(path) <= 8 else np.intp)
                for bit, (f, (low, high, _)) in enumerate(path.items()):
                    kept = [side(f, edge, left) for edge, left in ((low, False), (high, True)) if np.isfinite(edge)]
                    pattern |= (kept[0] if len(kept) == 1 else kept[0] & kept[1]).astype(pattern.dtype, copy=False) << bit
                pattern = pattern.astype(np.intp)
                for j, f in enumerate(path):
                    sums[f] += table[j].take(pattern)
            phi[start : start + ROW_CHUNK] = sums.T
        return phi


def _pattern_values(kept: np.ndarray) -> np.ndarray:
    """Shapley values of a unit leaf for all 2**d patterns, patterns x features.

    A feature inside the coalition contributes whether the row satisfies it (0/1), outside it the
    share of training rows ``kept`` that does.
    """
    d = len(kept)
    satisfied = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    out = np.zeros((2**d, d))
    for j in range(d):
        others = [i for i in range(d) if i != j]
        # by_size[:, s]: sum over coalitions of s others of the product of their contributions.
        by_size = np.zeros((2**d, d))
        by_size[:, 0] = 1.0
        for i in others:
            joined = np.zeros_like(by_size)
            joined[:, 1:] = by_size[:, :-1] * satisfied[:, i : i + 1]
            by_size = by_size * kept[i] + joined
        weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
        out[:, j] = (by_size @ weights) * (satisfied[:, j] - kept[j])
    return out
