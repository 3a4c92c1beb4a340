"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Pass one reads all documents.  Every word has a slot by hash and every slot a sparse random index
vector of signs; the context vector of a slot sums the index vectors of its neighbours over the
whole corpus.  Counts are whole numbers, so their sums do not depend on the order of tasks.  A
document is the mean and the spread of its words' vectors.  The network is trained in numpy on at
most ``TRAIN_ROWS`` labelled documents (those with the smallest hash of their id), and the
temperature of its probabilities is set on a fifth of them that training leaves out.  The last pass
scores every document.

Defined cases: null and empty texts pool to zeros and get the score of that; null labels are not
learnt from; with labels of one class or none, every score is that class's smoothed share; repeated
rows are scored alike; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import query, table, tidy
from skyframe.llm.tokens import PIECES, buffers, mix64, token_hashes

SLOTS = 8192
DIM = 32
#: Signs in an index vector.
NONZERO = 2
#: Labelled documents that the network is trained on, at most.
TRAIN_ROWS = 20_000
HIDDEN = 16
EPOCHS = 30
BATCH = 128
RATE = 0.002
DECAY = 1e-3
KEEP = 0.7


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each slot's index vector."""
    draw = mix64(np.arange(1, SLOTS * NONZERO + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(SLOTS, NONZERO)
    return (draw % np.uint64(DIM)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)


def _slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, begins = token_hashes(raw, offsets, PIECES)
    return (hashes >> np.uint64(51)).astype(np.int64), begins


def context_sums(docs: DataFrame) -> np.ndarray:
    """Sums of neighbours' index vectors per slot, over all of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(SLOTS * DIM)
        for batch in batches:
            for _, _, raw, offsets in buffers(batch.column(0)):
                slot, begins = _slots(raw, offsets)
                if len(slot) < 2:
                    continue
                pair = np.ones(len(slot) - 1, bool)
                inner = begins[1:-1]
                pair[inner[(inner > 0) & (inner < len(slot))] - 1] = False
                left, right = slot[:-1][pair], slot[1:][pair]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIM + place[b, k], weights=sign[b, k], minlength=SLOTS * DIM)
        sums = total.astype(np.int64).reshape(SLOTS, DIM)
        used = np.flatnonzero(sums.any(axis=1))
        if len(used):
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIM), pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used), vectors], ["slot", "v"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "slot bigint, v array<bigint>")
    sums = sums.groupBy("slot").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v"))
    out = np.zeros((SLOTS, DIM))
    for slot, v in sums.collect():  # one row per slot
        out[slot] = v
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors per slot without their common part; slots without context keep their index vector."""
    place, sign = index_vectors()
    own = np.zeros((SLOTS, DIM))
    np.add.at(own, (np.arange(SLOTS)[:, None], place), sign)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    weight = np.sqrt(np.abs(sums).sum(axis=1))
    ctx = unit(sums)
    if weight.sum():
        ctx = ctx - (weight @ ctx) / weight.sum()
    return (unit(np.where(sums.any(axis=1, keepdims=True), ctx, 0)) + 0.5 * unit(own)).astype(np.float32)


#: Distances, in words, over which the steps between word vectors are pooled.
LAGS = (1, 2, 4)
#: Pooled values of a document: mean and spread per dimension, their sizes, and the mean steps.
POOLED = 2 * DIM + 2 + len(LAGS)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and how far they step from word to word."""
    out = np.zeros((len(texts), POOLED), np.float64)
    for i, j, raw, offsets in buffers(texts):
        slot, begins = _slots(raw, offsets)
        count = np.diff(begins)
        rows = np.flatnonzero(count)
        if not len(rows):
            continue
        n = count[rows, None]
        each = vectors[slot]
        mean = np.add.reduceat(each, begins[rows], axis=0) / n
        text = np.repeat(np.arange(len(rows)), count[rows])
        for at, lag in enumerate(LAGS):
            step = np.zeros(len(slot))
            if len(slot) > lag:
                inside = text[lag:] == text[:-lag]
                step[:-lag] = np.square(each[lag:] - each[:-lag]).sum(axis=1) * inside
            out[i + rows, 2 * DIM + 2 + at] = np.add.reduceat(step, begins[rows]) / np.maximum(1, count[rows] - lag)
        square = np.add.reduceat(np.square(each, out=each), begins[rows], axis=0) / n
        out[i + rows, :DIM] = mean
        spread = np.sqrt(np.maximum(square - mean**2, 0))
        out[i + rows, DIM : 2 * DIM] = spread
        out[i + rows, 2 * DIM] = np.sqrt((mean**2).sum(axis=1))
        out[i + rows, 2 * DIM + 1] = spread.mean(axis=1)
    return out


@dataclass
class Network:
    """Two layers, standardised inputs and a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.shift) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on log loss; the temperature minimises the log loss of the fifth that is left out."""
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    net = Network(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.where(scale > 1e-6, scale, 1), [])
    if len(set(y.tolist())) < 2:
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net.layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    slow, fast, step = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for _ in range(max(EPOCHS, 1500 * BATCH // max(1, len(used)))):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            w1, b1, w2, b2 = net.layers
            a = (x[part] - net.shift) / net.scale
            h = np.tanh(a @ w1 + b1)
            d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -500, 500))) - y[part]) / len(part)
            dh = np.outer(d, w2) * (1 - h * h)
            grads = [a.T @ dh + DECAY * w1, dh.sum(axis=0), h.T @ d + DECAY * w2, np.array([d.sum()])]
            step += 1
            for p, g, s, f in zip(net.layers, grads, slow, fast):
                s += 0.1 * (g - s)
                f += 0.001 * (g * g - f)
                p -= RATE * (s / (1 - 0.9**step)) / (np.sqrt(f / (1 - 0.999**step)) + 1e-8)
    if len(held):
        z, grid = net.logits(x[held]), np.geomspace(0.5, 8, 61)
        net.temperature = float(grid[np.argmin([_loss(z / t, y[held]) for t in grid])])
    return net


def held_out() -> Column:
    """Whether a document belongs to the quarter that is never learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of ``docs`` and a network for ``labels`` (doc_id, quality)."""
    vectors = word_vectors(context_sums(docs))
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * POOLED), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "y", "x"])

    # at most TRAIN_ROWS rows
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    got = rows.mapInArrow(tidy(run), "doc_id bigint, y double, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, POOLED)
    return vectors, train(x, np.asarray(got.column("y")))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` that they must not have yet; other columns pass through."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.scores(pooled(batch.column(at), vectors)))], [*names, name])

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with the same columns."""
    vectors, net = fit(docs, labels.where(~held_out()))
    name = "_quality_score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, vectors, net, name).where(F.col(f"`{name}`") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, net = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, vectors, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
