"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover it wholly. In each chunk, learned filters look at
windows of ``WIDTH`` embedded bytes, every ``STRIDE`` bytes; the largest response per filter stands for the chunk. Mean and maximum
of these over all chunks go through one logistic layer to a probability.

Training takes at most ``SAMPLE_PER_LABEL`` labelled rows per label, drawn by a hash of the id over all labelled rows, and at
most ``TRAIN_CHUNKS`` random chunks of each (both bound the driver's memory); scoring always covers whole texts, in blocks
of bounded size. Training is seeded, so a rerun gives the same network.

Defined cases: null counts as empty; an empty text has one chunk of padding and so gets a score too; repeated labels of a document count as
rows; labels other than 0 and 1 or null are not used; without both labels every score is the mean label (0.5 if none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers

WIDTH, STRIDE, EMBEDDED, FILTERS = 8, 4, 8, 24  # WIDTH and CHUNK are multiples of STRIDE
CHUNK, OVERLAP = 512, 64  # bytes
BLOCK = 64  # chunks at once
SAMPLE_PER_LABEL = 1_500
PIECES, PIECE_CHARS = 10, 2_000  # of one learning row, spread evenly when its text is longer
TRAIN_CHUNKS = 6
EPOCHS = 12
PAD = 256


def chunks_of(text: str | None) -> np.ndarray:
    """Bytes as (chunks, CHUNK) codes, padded at the end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.full(OVERLAP + count * step, PAD, dtype=np.int16)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Network:
    """Embedding, filters, and the logistic layer over pooled responses."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embed = draw.normal(0, 0.5, (257, EMBEDDED)).astype(np.float32)
        self.filters = draw.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH * EMBEDDED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, dtype=np.float32)
        self.out = draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.out, self.bias]

    @staticmethod
    def windows(codes: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH) byte codes."""
        return np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=1)[:, ::STRIDE]

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, places, filters). Windows overlap, so each stretch of ``STRIDE`` bytes meets every part of the filters once, in one product."""
        parts, stretch = WIDTH // STRIDE, STRIDE * EMBEDDED
        sides = self.filters.reshape(parts, stretch, FILTERS).transpose(1, 0, 2).reshape(stretch, parts * FILTERS)
        met = (self.embed[codes].reshape(-1, stretch) @ sides).reshape(len(codes), CHUNK // STRIDE, parts, FILTERS)
        places = met.shape[1] - parts + 1
        raw = met[:, :places, 0]
        for part in range(1, parts):
            raw = raw + met[:, part:part + places, part]
        return raw

    def respond(self, codes: np.ndarray):
        """The largest response of every filter per chunk, and its place."""
        raw = self.responses(codes)
        place = raw.argmax(axis=1)
        return np.take_along_axis(raw, place[:, None, :], 1)[:, 0] + self.shift, place

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        total, top = np.zeros(FILTERS), np.full(FILTERS, -np.inf)
        for at in range(0, len(codes), BLOCK):
            found = np.tanh(self.responses(codes[at:at + BLOCK]).max(axis=1) + self.shift)
            total += found.sum(axis=0)
            top = np.maximum(top, found.max(axis=0))
        return np.concatenate([total / len(codes), top])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(chunks_of(text)) @ self.out + self.bias[0], -30, 30))))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Adam on the log loss, documents in small batches, both labels weighted alike."""
    net, draw = Network(seed), np.random.default_rng(seed)
    truth = np.asarray(labels, dtype=np.float64)
    share = truth.mean() if len(truth) else 0.5
    if share in (0.0, 1.0) or not len(truth):
        net.out[:] = 0
        net.bias[:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return net
    documents = [chunks_of(t) for t in texts]
    weight = np.where(truth == 1, 0.5 / share, 0.5 / (1 - share))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    tick = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = draw.permutation(len(documents))
        for at in range(0, len(order), 32):
            batch = order[at:at + 32]
            parts = [documents[i][draw.permutation(len(documents[i]))[:TRAIN_CHUNKS]] for i in batch]
            owner = np.repeat(np.arange(len(batch)), [len(p) for p in parts])
            codes = np.concatenate(parts)
            tick += 1
            for p, g, (m, v) in zip(net.parameters(), _gradients(net, codes, owner, truth[batch], weight[batch]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, codes, owner, truth, weight):
    raw, place = net.respond(codes)
    active = np.tanh(raw)
    n, counts = len(truth), np.bincount(owner, minlength=len(truth))[:, None]
    starts = np.concatenate([[0], np.cumsum(counts[:-1, 0])])
    mean = np.add.reduceat(active, starts, axis=0) / counts
    top = np.maximum.reduceat(active, starts, axis=0)
    pooled = np.concatenate([mean, top], axis=1)
    off = (1 / (1 + np.exp(-(pooled @ net.out + net.bias[0]))) - truth) * weight / n
    d_pooled = off[:, None] * net.out
    d_active = (d_pooled[:, :FILTERS] / counts)[owner] + np.where(active == top[owner], d_pooled[:, FILTERS:][owner], 0)
    d_raw = d_active * (1 - active**2)
    windows = net.windows(codes)
    picked = windows[np.arange(len(codes))[:, None], place]  # (chunks, filters, WIDTH)
    seen = net.embed[picked].reshape(len(codes), FILTERS, -1)
    d_filters = np.einsum("cf,cfw->wf", d_raw, seen)
    d_seen = d_raw[:, :, None] * net.filters.T[None]
    at, flat = picked.reshape(-1), d_seen.reshape(-1, EMBEDDED)
    d_embed = np.stack([np.bincount(at, weights=flat[:, e], minlength=len(net.embed)) for e in range(EMBEDDED)], axis=1)
    return d_embed, d_filters, d_raw.sum(axis=0), pooled.T @ off, np.array([off.sum()])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, label_col: str = "quality") -> Network:
    """A network from a bounded hash sample of the labelled rows that are not held out."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("_label")).where(~held_out())
    drawn = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        drawn = part if drawn is None else drawn.unionByName(part)
    size = F.length("text")
    spread = [F.substring(F.col("text"), (F.lit(1) + F.floor((size - PIECE_CHARS) * (k / (PIECES - 1)))).cast("int"), F.lit(PIECE_CHARS)) for k in range(PIECES)]
    texts = docs.select("doc_id", F.when(size <= PIECES * PIECE_CHARS, F.col("text")).otherwise(F.concat(*spread)).alias("_text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "_text", "_label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_label).collect()
    return fit([r["_text"] for r in rows], [r["_label"] for r in rows])


def with_score(docs: DataFrame, net: Network, text_col: str = "text", into: str = "score") -> DataFrame:
    """Documents with the probability of label 1, from their whole texts."""
    workers.small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(net.parameters()), workers.token()

    def built() -> Network:
        made = Network()
        made.embed, made.filters, made.shift, made.out, made.bias = shared.value
        return made

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        there = workers.once(name, built)
        return pd.Series([there.score(t) for t in texts], dtype="float64")

    return docs.withColumn(into, scored.asNondeterministic()(F.col(text_col)))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted."""
    found = with_score(docs.select("doc_id", "text", held_out().alias("held_out")), train(docs, labels))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score ``threshold`` or more; columns as given."""
    rows = docs.select(F.struct("*").alias("row"))  # whatever the columns are named
    return with_score(rows, train(docs, labels), text_col="row.text", into="score").where(F.col("score") >= threshold).select("row.*")
