"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams in order of frequency. A document's own list is compared
with every profile: each of its n-grams adds how far its rank is from the profile's rank (out of place), or the profile's
length if the profile has it not. The nearest profile names the language.

A text is lower-cased and each stretch of other things than letters becomes one mark; n-grams are one to three characters that do
not reach over a mark. An n-gram is one whole number, three code points of 21 bits, so numpy counts them by sorting, in pieces
of ``PIECE`` characters; number order is text order.

Profiles are counted over all learning rows: tasks send one row per n-gram; Spark adds them up. A document's list is counted
over its whole text. Only the profiles (``LENGTH`` n-grams per language) are broadcast; more than ``MAX_LANGUAGES``
languages are an error, not a cut.

Defined cases: null text, or text without a letter, is ``und`` with score 0; equal distances go to the language first in
order; equally frequent n-grams are ordered by themselves; without learning rows everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm import workers

LENGTH = 400
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
MARK = ord("_")
PIECE = 1 << 18
FLUSH = 1 << 21
_BITS = 21

Counts = tuple[np.ndarray, np.ndarray]
NOTHING: Counts = (np.empty(0, np.int64), np.empty(0, np.int64))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    known = np.zeros(0x110000, bool)
    for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        known[run.start():run.end()] = True
    return known


def marked(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, with one mark for every stretch between, and at both ends; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([MARK], np.where(_letters()[codes], codes, MARK), [MARK])).astype(np.int64)
    mark = codes == MARK
    codes = codes[np.concatenate(([True], ~(mark[1:] & mark[:-1])))]
    return codes if len(codes) > 1 else codes[:0]


def added(parts: list[Counts]) -> Counts:
    """Counts of the same n-gram put together, in order of n-grams."""
    keys, counts = (np.concatenate(x) for x in zip(NOTHING, *parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(codes: np.ndarray) -> Counts:
    """N-grams of marked text and how often each stands there, in order of n-grams."""
    found = []
    for at in range(0, len(codes), PIECE):
        here = codes[at:at + PIECE + 2]
        own = min(PIECE, len(codes) - at)
        letter = here != MARK
        one = here[:own] << 2 * _BITS
        two = one[:len(here) - 1] | here[1:own + 1] << _BITS
        three = two[:len(here) - 2] | here[2:own + 2]
        keys = np.sort(np.concatenate((one[letter[:own]], two, three[letter[1:len(three) + 1]])))
        first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
        found.append((keys[first], np.diff(first, append=len(keys))))
    return found[0] if len(found) == 1 else added(found)


def ranked(counts: Counts, length: int) -> np.ndarray:
    keys, n = counts
    return keys[np.argsort(-n, kind="stable")[:length]]


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting: dict[str, list[np.ndarray]] = {}
    sums: dict[str, Counts] = {}
    held = 0

    def settle() -> int:
        for lang, texts in waiting.items():
            sums[lang] = added([sums.get(lang, NOTHING), counted(np.concatenate(texts))])
        waiting.clear()
        return sum(len(keys) for keys, _ in sums.values())

    def rows() -> Iterator[pd.DataFrame]:
        for lang, (keys, n) in sums.items():
            yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            codes = marked(text)
            if len(codes):
                texts = waiting.setdefault(lang, [])
                texts.append(codes[1:] if texts else codes)
                held += len(codes)
            if held > FLUSH:
                held = 0
                if settle() > FLUSH:
                    yield from rows()
    settle()
    yield from rows()


def learn(labelled: DataFrame, length: int = LENGTH) -> dict[str, list[int]]:
    """Profiles, as n-gram numbers in order, from (lang, text) rows."""
    workers.small_batches(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = rows.mapInPandas(_partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).where(F.col("place") <= length)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram")))["gram"].alias("grams"))
    found = lists.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: list(r["grams"]) for r in sorted(found, key=lambda r: r["lang"])}


class Judge:
    """Distances of one document to all profiles."""

    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.names, self.length = list(profiles), length
        entries = sorted((gram, k, place) for k, grams in enumerate(profiles.values()) for place, gram in enumerate(grams))
        self.grams, self.owner, self.place = np.array(entries, np.int64).reshape(-1, 3).T.copy()

    def judge(self, text: str | None) -> tuple[str, float]:
        codes = marked(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(counted(codes), self.length)
        start, end = np.searchsorted(self.grams, own, "left"), np.searchsorted(self.grams, own, "right")
        n = end - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        moved = np.abs(np.repeat(np.arange(len(own)), n) - self.place[at]) - self.length
        away = self.length * len(own) + np.bincount(self.owner[at], moved, len(self.names))
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.length * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], length: int = LENGTH, text_col: str = "text", into: str = "language") -> DataFrame:
    """Documents with a struct ``into``: lang_pred, score."""
    workers.small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(profiles), workers.token()

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        judge = workers.once(name, lambda: Judge(shared.value, length))
        return pd.DataFrame([judge.judge(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(into, judged.asNondeterministic()(F.col(text_col)))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred, score; learned from the rows that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    profiles = learn(docs.where(~held))
    found = predict(docs.select("doc_id", "text", held.alias("held_out")), profiles)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")
