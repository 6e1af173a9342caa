"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised (A-Z lower-cased, runs of other ASCII than letters and digits become one space), cut into
windows of ``width`` words (shorter items are one window), and compiled into an automaton. Every document is normalised
alike and scanned once; hits are mapped to words, and to byte spans of the original text.

The benchmark is a curated table, but its size is still checked: it is cut into blocks of at most ``BLOCK_BYTES`` of text. Usually there is one
block, one automaton and one scan. Of several blocks each is a pass of its own over the stored texts, which writes the documents it hits; the
word spans of all passes are united per document. So a worker holds one automaton and builds it once a pass, and time is in
proportion to the blocks.

Defined cases: a null or empty text has no words and no hits; a benchmark text without words gives no window; repeated items
and equal windows of several items count for every item; an item without id counts as ``null``; an empty benchmark hits
nothing. Documents' further columns are kept by ``scan`` and not read.
"""

from __future__ import annotations

import functools
import itertools

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import workers
from winnow.session import materialise

WIDTH = 10
BLOCK_BYTES = 16 << 20

#: Byte to byte: A-Z lowered, ASCII other than letters and digits to a space, the bytes of other characters as they are.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_LISTS = ("words", "starts", "ends", "items")
_SCAN = "n_words long, words array<int>, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int):
    """(window, items) lists of bounded size, streamed from Spark partition by partition."""
    block: dict[bytes, set[str]] = {}
    held = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        for window in windows_of(words_of(text), width):
            block.setdefault(window, set()).add("null" if item is None else item)
            held += len(window)
        if held > BLOCK_BYTES:
            yield block
            block, held = {}, 0
    if block:
        yield block


def automaton_of(block: dict[bytes, set[str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for window, items in block.items():
        machine.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, window.count(b" ") + 1, sorted(items)))
    machine.make_automaton()
    return machine


def scan_text(machine: ahocorasick.Automaton, text: str | None):
    """Number of words, hit word numbers, their byte spans in the original, items."""
    if not text:
        return 0, [], [], [], []
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    words = folded.split()
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(machine.iter(line)) if words and len(machine) else []
    if not found:
        return len(words), [], [], [], []
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    places = np.concatenate([[0], np.cumsum(lengths + 1)])  # of each word's leading space in line
    hit = np.zeros(len(words) + 1, dtype=np.int32)
    items: set[str] = set()
    for end, (length, width, ids) in found:
        first = int(np.searchsorted(places, end - length + 1))
        hit[first] += 1
        hit[first + width] -= 1
        items.update(ids)
    numbers = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    raw = np.frombuffer(folded, dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], raw, [False]]).astype(np.int8)))
    return len(words), numbers.tolist(), edges[0::2][numbers].tolist(), edges[1::2][numbers].tolist(), sorted(items)


def _scanner(spark: SparkSession, block: dict[bytes, set[str]]):
    shared, name = spark.sparkContext.broadcast(block), workers.token()

    @F.pandas_udf(_SCAN)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        machine = workers.once(name, lambda: automaton_of(shared.value), most=1)
        return pd.DataFrame([scan_text(machine, t) for t in texts], columns=["n_words", "words", "starts", "ends", "items"])

    return scanned.asNondeterministic()


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", into: str = "hits") -> DataFrame:
    """Documents with a struct ``into``: n_words, hit words with their byte spans in the original text, and items."""
    spark = docs.sparkSession
    workers.small_batches(spark)
    passes = blocks(benchmark, item_col, item_text_col, width)
    first, second = next(passes, {}), next(passes, None)
    if second is None:
        return docs.withColumn(into, _scanner(spark, first)(F.col(text_col)))

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = materialise(rows, "texts")  # so that a row keeps its number
    found = [materialise(rows.select("at", _scanner(spark, first)("text").alias("h")), "hits")]  # of every row, for the number of words
    for block in itertools.chain([second], passes):
        hits = rows.select("at", _scanner(spark, block)("text").alias("h")).where(F.size("h.words") > 0)
        found.append(materialise(hits, "hits"))
    hits = functools.reduce(DataFrame.unionByName, found).groupBy("at").agg(
        F.max("h.n_words").alias("n_words"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"h.{f}")))).alias(f) for f in _LISTS])
    return rows.drop("text").join(hits.select("at", F.struct("n_words", *_LISTS).alias("h")), "at").select("row.*", F.col("h").alias(into))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = scan(docs.select("doc_id", "text"), benchmark, width)
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), F.size("hits.words").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Documents without those that hold a benchmark window; columns as given."""
    rows = docs.select(F.struct("*").alias("row"))  # whatever the columns are named
    return scan(rows, benchmark, width, text_col="row.text", into="hits").where(F.size("hits.words") == 0).select("row.*")
