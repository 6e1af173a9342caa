"""Substring dedup by relative Lempel-Ziv parsing.

All texts are the reference. It is indexed in blocks that the text itself delimits: every window of ``WIDTH`` words picks its smallest run of
``SEED`` words as anchor, and the windows that pick the same anchor make one block, a stretch of ``WIDTH`` to ``WIDTH + WIDTH - SEED`` words.
Two occurrences of one window pick the same anchor at the same place, wherever they stand. A block is known by its anchor and a
fingerprint of all its windows.

Parsing: a block that the index holds from elsewhere is matched whole; blocks overlap by ``WIDTH - 1`` words, so a run of matched blocks is one
factor, as long as the matches go on, and every window in it is a duplicate. At the boundaries of factors, where an anchor occurs
elsewhere but in another block, single windows are checked against the blocks of that anchor. Windows whose anchor occurs nowhere
else cannot be duplicates. So exactly the windows that start anywhere else are found.

A block that a document holds twice matches within it, whatever others hold. A stretch of a few words said over and over has a block at every
repeat; so each document sends every kind of block once, with its number, and keeps the places of those it holds more often.

Only anchors are shuffled at first (about one per twelve words); hot ones are counted before the shuffle and joined by parts. Windows are
made just for factor boundaries, and one block stands for all equal ones there. Texts are never grouped.

Defined cases: null or fewer than ``WIDTH`` words: nothing is removed; repeated rows are other occurrences, so both lose what they share; a window
repeated in its own document counts, too, also where the repeats overlap; a text without words keeps the empty string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.llm.shingles import hashed, mixed, runs, words_of
from winnow.session import materialise

WIDTH, SEED = 35, 12
_SPAN = 64  # a block's first window and number of windows in one number: first * _SPAN + count


def text_key(col: str):
    """Names a text by its content, so that repeated or missing ids do not matter."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit(""))))


def blocks_of(words: np.ndarray, width: int, seed: int):
    """(span, anchor, fingerprint) of all blocks, and the windows."""
    windows = runs(words, width)
    if not len(windows):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    seeds = runs(words, seed)
    reach = width - seed + 1
    chosen = np.lib.stride_tricks.sliding_window_view(seeds, reach).argmin(axis=1) + np.arange(len(windows))
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    count = np.diff(np.append(first, len(windows)))
    within = (np.arange(len(windows)) - np.repeat(first, count)).astype(np.uint64)
    marks = np.add.reduceat(mixed(windows + within * np.uint64(0x9E3779B97F4A7C15)), first)
    marks = mixed(marks + (chosen[first] - first).astype(np.uint64) * np.uint64(_SPAN) + count.astype(np.uint64))
    return first * _SPAN + count, seeds[chosen[first]].view(np.int64), marks.view(np.int64), windows.view(np.int64)


def kinds_of(spans: np.ndarray, anchors: np.ndarray, marks: np.ndarray):
    """(span, anchor, fingerprint, number) of each kind's first block in one text, and the spans of all blocks whose kind it holds again."""
    order = np.lexsort((anchors, marks))
    s, f = anchors[order], marks[order]
    start = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (f[1:] != f[:-1]))[:len(order)])
    number = np.diff(np.append(start, len(order)))
    first = order[start]
    return spans[first], anchors[first], marks[first], number, np.sort(spans[order[np.repeat(number > 1, number)]])


def index(docs: DataFrame, text_col: str, width: int, seed: int) -> DataFrame:
    """(rid, t, spans, anchors, marks, numbers, own): the kinds of blocks of every row that has any, and its matches within itself."""
    @F.pandas_udf("spans array<long>, anchors array<long>, marks array<long>, numbers array<long>, own array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = [kinds_of(*blocks_of(hashed(words_of(t, lower=False)), width, seed)[:3]) for t in texts]
        return pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(("spans", "anchors", "marks", "numbers", "own"))})

    rows = docs.select(text_key(text_col).alias("t"), made.asNondeterministic()(text_col).alias("d")).where(F.size("d.spans") > 0)
    return materialise(rows.select(F.monotonically_increasing_id().alias("rid"), "t", "d.*"), "blocks")


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(t, *other columns, z): texts compressed for the shuffle."""
    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=1)
        return pd.Series([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return docs.withColumn("_t", text_key(text_col)).withColumn("_z", squeeze(F.col(text_col))).drop(text_col)


def unpacked(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def duplicate_spans(docs: DataFrame, text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(t, spans): per text with duplicates, its duplicate windows as first * 64 + number of windows."""
    workers.small_batches(docs.sparkSession)
    table = index(docs, text_col, width, seed)
    blocks = table.select("rid", F.explode(F.arrays_zip("spans", "anchors", "marks", "numbers")).alias("b")).select(
        "rid", F.col("b.spans").alias("span"), F.col("b.anchors").alias("s"), F.col("b.marks").alias("f"), F.col("b.numbers").alias("number"))
    shared = blocks.groupBy("s").agg(F.count("*").alias("n"), (F.min("f") == F.max("f")).alias("alike")).where("n > 1").select("s", "alike")
    shared = materialise(shared, "anchors")  # a plain table, so that Spark can split the join at hot anchors
    known = materialise(blocks.join(shared, "s"), "shared")

    # Anchors with several kinds of blocks: kinds met twice match whole, the others are boundaries. What matches within its text needs no join.
    mixed_ = known.where(~F.col("alike"))
    kinds = materialise(mixed_.groupBy("s", "f").agg(F.count("*").alias("n"), F.min(F.struct("rid", "span")).alias("first")), "kinds")
    whole = known.where("alike AND number = 1").select("rid", "span").unionByName(
        mixed_.where("number = 1").join(kinds.where("n > 1").select("s", "f"), ["s", "f"], "left_semi").select("rid", "span"))
    asked = kinds.groupBy(F.col("first.rid").alias("rid")).agg(F.collect_list(F.struct(F.col("first.span").alias("span"), "s")).alias("asked"))

    # One block of every kind shows its windows; those that another kind has as well are duplicates.
    @F.pandas_udf("w array<long>, s array<long>, span array<long>")
    def shown(data: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for z, wanted in zip(data, lists):
            windows = runs(hashed(words_of(unpacked(z), lower=False)), width).view(np.int64)
            spans = np.array([b["span"] for b in wanted], dtype=np.int64)
            count = spans % _SPAN
            at = np.repeat(spans // _SPAN - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows.append((windows[at], np.repeat(np.array([b["s"] for b in wanted], dtype=np.int64), count), at * _SPAN + 1))
        return pd.DataFrame(rows, columns=["w", "s", "span"])

    texts = packed(docs.select(F.col(text_col).alias("_text")), "_text")
    wanted = asked.join(table.select("rid", F.col("t").alias("_t")), "rid")
    rows = texts.join(wanted, "_t").select("rid", shown.asNondeterministic()("_z", "asked").alias("d"))
    rows = rows.select("rid", F.explode(F.arrays_zip("d.w", "d.s", "d.span")).alias("x")).select("rid", "x.*")
    rows = materialise(rows.dropDuplicates(["rid", "span"]), "windows")
    twice = rows.groupBy("s", "w").agg(F.count("*").alias("n")).where("n > 1").select("s", "w")
    single = rows.join(twice, ["s", "w"], "left_semi").select("rid", "span")

    spans = whole.unionByName(single).groupBy("rid").agg(F.collect_list("span").alias("spans"))
    rows = table.select("rid", "t", "own").join(spans, "rid", "left").select("t", F.concat("own", F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"))
    return rows.where(F.size("spans") > 0).groupBy("t").agg(F.max("spans").alias("spans"))


def gone_words(spans, count: int, width: int) -> np.ndarray:
    """Which words the duplicate windows cover."""
    change = np.zeros(count + 1, dtype=np.int32)
    spans = np.asarray([] if spans is None else spans, dtype=np.int64)
    np.add.at(change, spans // _SPAN, 1)
    np.add.at(change, spans // _SPAN + spans % _SPAN - 1 + width, -1)
    return np.cumsum(change[:-1]) > 0


def kept_words(text: str | None, spans, width: int) -> tuple[list[bytes], int]:
    words = words_of(text, lower=False)
    if spans is None or not len(spans):
        return words, len(words)
    gone = gone_words(spans, len(words), width)
    return [w for w, g in zip(words, gone.tolist()) if not g], len(words)


def _with_spans(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    return packed(docs, text_col).join(duplicate_spans(docs, text_col, width).withColumnsRenamed({"t": "_t", "spans": "_spans"}), "_t", "left").drop("_t")


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256."""
    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digested(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for z, there in zip(data, spans):
            kept, count = kept_words(unpacked(z), there, width)
            rows.append((count, count - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    found = _with_spans(docs.select("doc_id", "text"), "text", width)
    return found.select("doc_id", digested.asNondeterministic()("_z", "_spans").alias("d")).select("doc_id", "d.*")


def remove_repeats(docs: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """Documents whose texts have lost the repeated words; texts that lose none stay as they are, columns as given."""
    @F.pandas_udf("string")
    def cut(data: pd.Series, spans: pd.Series, missing: pd.Series) -> pd.Series:
        out = []
        for z, there, null in zip(data, spans, missing):
            text = unpacked(z)
            if there is not None and len(there):
                text = b" ".join(kept_words(text, there, width)[0]).decode("utf-8", "surrogatepass")
            out.append(None if null else text)
        return pd.Series(out, dtype=object)

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(text_col).alias("text"), F.col(text_col).isNull().alias("missing"), F.struct(*others or [F.lit(None)]).alias("row"))
    whole = cut.asNondeterministic()("_z", "_spans", "missing")
    return _with_spans(rows, "text", width).select(*[whole.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
