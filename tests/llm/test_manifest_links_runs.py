"""The Merkle manifest, the epsilon grid join and periodic runs, on awkward rows against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import grid_join, merkle, ordered, periodic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _g string, _at long, runs int, key string, leaf int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes, fanout=2):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(levels, at, fanout=2):
    for level in levels[:-1]:
        first = at - at % fanout
        yield "".join(level[first:at]), "".join(level[at + 1:first + fanout])
        at //= fanout


def manifest_rows():
    draw = random.Random(1)
    rows = [(i, f"t{i}\né" * draw.randrange(3), "en", "s", i) for i in draw.sample(range(1_000), 67)]
    rows += [(2_000 + i, "x", None, None, None) for i in range(5)] + [(3_000, "y" * 50_000, "zz", "", 2), (3_001, "", "", "s", 0), (None, None, "en", "s", 1), (7, None, "d", None, None)]
    rows += [(5_000 + i, "c", lang, "s", 1) for lang, n in (("p", 16), ("q", 17), ("r", 33)) for i in range(n)]
    return rows + [(9_000, "twice", "p", "s", 5)] * 2


def expected_manifest(rows, fanout=2):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: sha(*map(field, (i, s, g, n, t)))
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = levels_of([leaf(*r) for r in groups[g]], fanout)
    crown = levels_of([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for at, (i, t, _, s, n) in enumerate(groups[g]):
            path = [*siblings(trees[g], at, fanout), *siblings(crown, k, fanout)]
            tampered = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            root = leaf(i, t, g, s, n + 1 if tampered else n)
            for left, right in path:
                root = sha(left, root, right)
            out.append((i, trees[g][0][at], trees[g][-1][0], crown[-1][0], sha(*[a + b for a, b in path]), root, root == crown[-1][0]))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_manifest(spark, parts):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "g", 1, 2, "k", 3) for r in rows], SCHEMA).repartition(parts)
    found = merkle.tampering_found(docs).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected_manifest(rows), key=repr)
    assert any(not r["verified"] for r in found) and any(r["verified"] for r in found)


def test_manifest_of_little(spark):
    docs = spark.createDataFrame([(*r, "g", 1, 2, "k", 3) for r in manifest_rows()], SCHEMA)
    assert merkle.tampering_found(docs.limit(0)).count() == 0
    for few in (docs.where("doc_id = 3000"), docs.where("lang IS NULL")):
        rows = [tuple(r)[:5] for r in few.collect()]
        assert sorted(map(tuple, merkle.tampering_found(few).collect()), key=repr) == sorted(expected_manifest(rows), key=repr)


def test_wider_runs(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "g", 1, 2, "k", 3) for r in rows], SCHEMA)
    found = merkle.manifest(docs, fanout=3).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded("leaf", "path"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, a, b, c, d, c) for i, a, b, c, d, *_ in expected_manifest(rows, 3)), key=repr)


def test_numbers_along_an_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "parts_for", lambda rows: 7)
    rows = [("a", i % 10) for i in range(500)] + [("b", 3)] * 40 + [("c", 1)]
    found = ordered.numbered(spark.createDataFrame(rows, "g string, v int").repartition(4), "g", ["v"]).collect()
    for g, n in (("a", 500), ("b", 40), ("c", 1)):
        own = sorted((r["_at"], r["v"]) for r in found if r["g"] == g)
        assert [at for at, _ in own] == list(range(n)) and [v for _, v in own] == sorted(v for _, v in own) and {r["_n"] for r in found if r["g"] == g} == {n}


def vectors():
    draw = np.random.default_rng(4)
    base = draw.normal(size=(12, 16))
    made = [v + draw.normal(scale=s, size=16) for v in base for s in (0.01, 0.1, 0.2, 0.25, 0.3) for _ in range(12)]
    made += [base[0]] * 200 + [3 * base[0], -base[0], base[1] * 1e300, base[2] * 1e-300]
    rows = [(i, [float(x) for x in v], 1, 2) for i, v in enumerate(made)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0], [2.0], [1.0, 0.0]]
    rows += [(5_000 + i, v, 1, 2) for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1], 1, 2), (3, rows[40][1], 1, 2), (3, rows[3][1], 1, 2)]


def expected_links(rows, least):
    units = []
    for _, v, *_ in rows:
        x = np.array(v if v else [0.0], dtype=float)
        top = np.abs(x).max()
        units.append(None if not v or not np.isfinite(top) or top == 0 else x / top / np.linalg.norm(x / top))
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
              and math.fsum(units[i] * units[j]) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,least", [(2 << 20, 256), (16 * 8 * 20, 8)])
def test_near_vectors(spark, monkeypatch, block, least):
    rows = vectors()
    monkeypatch.setattr(grid_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(grid_join, "LEAST", least)  # many blocks and many halvings in the second case
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int, c int").repartition(3)
    found = sorted(map(tuple, grid_join.near_vectors(table, 0.95).collect()), key=repr)
    assert found == expected_links(rows, 0.95)
    assert len({r[1] for r in found}) > 5
    assert grid_join.near_vectors(table.limit(0)).count() == 0


def test_boxes_skip_only_distant_blocks(spark, monkeypatch):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 24))
    made = [centres[i % 30] + draw.normal(scale=0.02, size=24) for i in range(1_500)]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    seen = []
    plain = grid_join.near_blocks
    monkeypatch.setattr(grid_join, "near_blocks", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(grid_join, "BLOCK_BYTES", 24 * 8 * 25)
    monkeypatch.setattr(grid_join, "LEAST", 25)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in grid_join.near_vectors(table).collect()}
    assert found == {i: (49, i % 30) for i in range(1_500)}
    assert seen[0].count() < 60 * 61 / 2 / 3  # of all pairs of 60 blocks


def brute_runs(words, shortest=12):
    ids, best = np.unique(np.array(words, dtype=str), return_inverse=True)[1], {}
    for q in range(1, len(ids) // 2 + 1):
        turns = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(turns == 1).tolist(), (np.flatnonzero(turns == -1) + q).tolist()):
            if e - s >= max(shortest, 2 * q):
                best.setdefault((s, e), q)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic_words(draw):
    words = [f"w{draw.randrange(draw.choice([1, 2, 3, 5, 30]))}" for _ in range(draw.randrange(140))]
    for _ in range(draw.randrange(4)):
        block, at = [f"x{draw.randrange(draw.choice([1, 2, 8, 50]))}" for _ in range(draw.randrange(1, 20))], draw.randrange(len(words) + 1)
        words[at:at] = (block * 60)[:draw.randrange(60)]
    return words + words[:draw.randrange(1, 30)] * draw.randrange(5)


def test_runs_against_all_periods():
    draw = random.Random(8)
    for _ in range(400):
        words = periodic_words(draw)
        assert list(map(tuple, periodic.runs_of([w.encode() for w in words]).tolist())) == brute_runs(words), words


def test_runs_with_few_candidates_at_once(monkeypatch):
    monkeypatch.setattr(periodic, "TRIES", 3)
    draw = random.Random(9)
    for _ in range(40):
        words = periodic_words(draw)
        assert list(map(tuple, periodic.runs_of([w.encode() for w in words]).tolist())) == brute_runs(words)


def test_grammar_derives_the_words_and_repeats_no_pair():
    draw = random.Random(2)
    for _ in range(60):
        symbols = [draw.choice([0, 1, 2, 3, -1]) for _ in range(draw.randrange(1, 200))]
        left, rules, stood = periodic.re_pair(symbols, 4)

        def derived(symbol):
            return [symbol] if symbol < 4 else [w for part in rules[symbol - 4] for w in derived(part)]

        assert [w for s in left.values() for w in derived(s)] == symbols
        assert all(symbols[at:at + len(derived(4 + k))] == derived(4 + k) for k, at in enumerate(stood))
        rest, seen = list(left.values()), {}
        for i, pair in enumerate(zip(rest, rest[1:])):
            if min(pair) >= 0:
                assert i - seen.setdefault(pair, i) in (0, 1), "a pair occurs twice apart"


def test_run_report(spark):
    draw = random.Random(5)
    texts = [" ".join(periodic_words(draw)) for _ in range(60)] + ["", None, " \t\n", "a " * 11, "a\x0ba " * 6, "é x " * 20, "z " * 30_000, " ".join(f"v{i % 4_001}" for i in range(20_000))]
    rows = [(i, t, "en", "s", 0, "g", 1, 2, "k", 3) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "b " * 20, None, None, None, None, None, None, None, None)]
    expected = []
    for i, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if n > 5_000:  # too long for all periods: known by construction
            assert h % 10 or len(set(words)) == 1
            found = [(0, n, len(set(words)))]
        else:
            found = brute_runs(words)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        expected.append((i, len(found), *longest, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, periodic.run_report(docs).collect()), key=repr) == sorted(expected, key=repr)
    assert periodic.run_report(docs.limit(0)).count() == 0
    kept = periodic.with_runs(docs)
    assert set(kept.columns) == {*docs.columns, "collapsed"} and kept.where("key = 'k'").count() == len(rows) - 1
