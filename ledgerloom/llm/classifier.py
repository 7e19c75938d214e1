"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

* Pieces: runs of letters and digits (all of non-ASCII counts as letters) or of other signs, between white
  space; case counts. A piece's 64-bit hash names one of BUCKETS vectors, whatever the piece: rare ones share one.
* Random indexing: each bucket has a fixed sparse index vector of NONZERO entries +1 or -1. A bucket's
  context vector is the sum of the index vectors within WINDOW pieces of it, in the same text, over all texts:
  sums of integers, so they are the same in any order. Tasks send one row for each bucket they met, and Spark adds them.
  A bucket's word vector is its mean context less that of all pieces, shrunk for few occurrences.
* A document's input is the mean of its pieces' vectors, their deviation, and the size of the steps from one piece
  to the next over that deviation (near 0 where pieces repeat): one row of INPUTS.
* A network of one hidden and one output layer is fitted in numpy on at most SAMPLE labelled documents
  (a documented bound), chosen by a hash of their identifiers. A fifth of them decides when fitting
  ends and the temperature by which the output is divided before the logistic function.

To the driver: the table of BUCKETS x DIMS sums and the sample's inputs, both of fixed size.

Defined cases: null or empty texts have inputs of zero and get the network's score for them; texts of any length are
read whole, in stretches; repeated rows get equal scores; a null doc_id is held out and never learned from; of several labels of a
document the largest counts, and null ones don't; of several documents with one doc_id one's text is learned from;
without labels of both kinds every score is the labels' smoothed share of good; empty tables give empty
results; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, ship
from .shingles import mixed, portions

DIMS, NONZERO, BITS, WINDOW = 32, 4, 15, 2
BUCKETS = 1 << BITS
#: A document's input: three blocks of DIMS.
INPUTS = 3 * DIMS
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, PATIENCE = 32, 80, 256, 0.01, 1e-4, 12
FEW = 5.0
#: Bytes hashed at once, contexts summed at once, vectors pooled at once.
STRETCH, SLICE, SHORT = 1 << 20, 1 << 16, 1 << 12

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_BYTE = np.random.RandomState(20240301).randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C13)


def stretches(data: bytes) -> Iterator[bytes]:
    """data in parts of about STRETCH bytes that end at white space; a longer piece stays whole."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + STRETCH) if at + STRETCH < len(data) else None
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end


def pieces(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pieces of several texts, and the number of pieces before each text (and in all)."""
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buckets, begins_at, base = [], [], 0
    for part in stretches(b"\n".join(raw) + b"\n"):
        text = np.frombuffer(part, np.uint8)
        kind = _KIND[text]
        begins = np.flatnonzero((kind > 0) & (kind != np.concatenate([[0], kind[:-1]]).astype(np.uint8)))
        if len(begins):
            letters = np.flatnonzero(kind)
            first = np.searchsorted(letters, begins)
            n = np.diff(np.append(first, len(letters)))
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.full(int(n.max()), _STEP), dtype=np.uint64)
                sums = np.add.reduceat(_BYTE[text[letters]] * powers[letters - np.repeat(begins, n)], first)
                buckets.append((mixed(sums ^ mixed(n.astype(np.uint64))) >> np.uint64(64 - BITS)).astype(np.uint16))
            begins_at.append(begins + base)
        base += len(part)
    if not buckets:
        return np.empty(0, np.uint16), np.zeros(len(raw) + 1, np.int64)
    return np.concatenate(buckets), np.searchsorted(np.concatenate(begins_at), starts)


@functools.cache
def index_vectors() -> np.ndarray:
    """The fixed index vector of each bucket, and a row of zeros."""
    r = np.random.RandomState(20240302)
    out = np.zeros((BUCKETS + 1, DIMS), np.int16)
    places = np.argsort(r.rand(BUCKETS, DIMS), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:-1], places, r.choice([-1, 1], size=(BUCKETS, NONZERO)).astype(np.int16), axis=1)
    return out


def contexts(b: np.ndarray, bounds: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds to sums (BUCKETS + 1 rows of DIMS) the index vectors within WINDOW of each piece of its text, to counts the pieces.

    WINDOW empty places stand around each text, so that no piece sees another text's; they add up in the last row.
    """
    index = index_vectors()
    counts += np.bincount(b, minlength=BUCKETS + 1)
    text = np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    row = np.full(len(b) + WINDOW * len(bounds), BUCKETS, np.uint16)
    row[np.arange(len(b)) + WINDOW * text] = b
    for a in range(WINDOW, len(row) - WINDOW, SLICE):
        z = min(a + SLICE, len(row) - WINDOW)
        rows = index[row[a - WINDOW : z + WINDOW]]
        here = np.zeros((z - a, DIMS), np.int16)
        for k in range(2 * WINDOW + 1):
            if k != WINDOW:
                here += rows[k : k + z - a]
        order = np.argsort(row[a:z], kind="stable")
        there, starts = np.unique(row[a:z][order], return_index=True)
        sums[there] += np.add.reduceat(here[order].astype(np.int32), starts, axis=0)


def context_sums(docs: DataFrame) -> DataFrame:
    """docs (text) to one row for each bucket met: bucket, n, and DIMS sums, over all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((BUCKETS + 1, DIMS), np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            raw = [x or b"" for x in batch.column(0).to_pylist()]
            for part in portions(raw, STRETCH):
                contexts(*pieces(raw[part]), sums, counts)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), *[pa.array(sums[met, i]) for i in range(DIMS)]], names=["bucket", "n", *[f"s{i}" for i in range(DIMS)]])

    rows = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "bucket int, n long, " + ", ".join(f"s{i} long" for i in range(DIMS)))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS)])


def word_vectors(sums: DataFrame) -> np.ndarray:
    """The table of all buckets' word vectors, of one size at any size of the corpus; each dimension has a deviation of 1 over all pieces."""
    table = sums.toArrow()
    at = table.column("bucket").to_numpy()
    n, s = np.zeros(BUCKETS), np.zeros((BUCKETS, DIMS))
    n[at] = table.column("n").to_numpy()
    for i in range(DIMS):
        s[at, i] = table.column(f"s{i}").to_numpy()
    if not n.sum():
        return np.zeros((BUCKETS, DIMS), np.float32)
    mean = s.sum(axis=0) / n.sum()
    v = (s - n[:, None] * mean) / (n[:, None] + FEW)
    deviation = np.sqrt((n[:, None] * v**2).sum(axis=0) / n.sum())
    return (v / np.where(deviation > 0, deviation, 1)).astype(np.float32)


def pooled(raw: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row for each text: the mean and the deviation of its pieces' vectors, and the root mean square of their steps over that deviation; zeros without pieces."""
    sums, n = np.zeros((len(raw), INPUTS)), np.zeros(len(raw), np.int64)
    for part in portions(raw, STRETCH):
        b, bounds = pieces(raw[part])
        n[part] = np.diff(bounds)
        for row, begin, end in zip(sums[part], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for a in range(begin, end, SHORT):
                v = vectors[b[a : min(a + SHORT + 1, end)]]
                step = v[1:] - v[:-1]
                v = v[:SHORT]
                row[:DIMS] += v.sum(axis=0)
                row[DIMS : 2 * DIMS] += np.einsum("ij,ij->j", v, v)
                row[2 * DIMS :] += np.einsum("ij,ij->j", step, step)
    mean = sums[:, :DIMS] / np.maximum(n, 1)[:, None]
    deviation = np.sqrt(np.maximum(sums[:, DIMS : 2 * DIMS] / np.maximum(n, 1)[:, None] - mean**2, 0))
    steps = np.sqrt(sums[:, 2 * DIMS :] / np.maximum(n - 1, 1)[:, None])
    return np.hstack([mean, deviation, steps / (deviation + 0.05)])


@dataclass
class Network:
    """Inputs are moved and scaled, pass one hidden layer, and the output is divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """x (rows in a fixed order), y (0 or 1): every fifth row is kept for the end of fitting and the temperature."""
    r = np.random.RandomState(seed)
    if len(y) < 10 or len(np.unique(y)) < 2:
        good = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(good / (1 - good))))
    held = np.arange(len(y)) % 5 == 0
    xt, yt, xv, yv = x[~held], y[~held], x[held], y[held]
    net = Network(xt.mean(axis=0), xt.std(axis=0) + 1e-3, r.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), r.randn(HIDDEN) / np.sqrt(HIDDEN), 0.0)
    xs = (xt - net.centre) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    best, best_loss, since, step = [w.copy() for w in weights], np.inf, 0, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(yt))
        for a in range(0, len(order), BATCH):
            rows, step = order[a : a + BATCH], step + 1
            h = np.tanh(xs[rows] @ weights[0] + weights[1])
            d = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -60, 60))) - yt[rows]) / len(rows)
            back = np.outer(d, weights[2]) * (1 - h * h)
            grads = [xs[rows].T @ back + DECAY * weights[0], back.sum(axis=0), h.T @ d + DECAY * weights[2], d.sum()]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                weights[i] = weights[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3])
        now, since = loss(net.logits(xv), yv), since + 1
        if now < best_loss:
            best, best_loss, since = [w.copy() for w in weights], now, 0
        if since >= PATIENCE:
            break
    net.w1, net.b1, net.w2, net.b2 = best[0], best[1], best[2], float(best[3])
    logits = net.logits(xv)
    low, high = -3.0, 3.0  # of the temperature's logarithm: the loss falls, then rises
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(logits / np.exp(a), yv) < loss(logits / np.exp(b), yv) else (a, high)
    net.temperature = float(np.exp((low + high) / 2))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """labels (doc_id, quality) of documents that may be learned from: one row each, at most `rows` of them, chosen by a hash."""
    doc_id = F.col("doc_id").cast("long")
    some = labels.select(doc_id.alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = some.count()
    if n > rows:
        some = some.filter(F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 < 0.9 * rows / n).limit(rows)
    return some


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, rows: int = SAMPLE) -> Network:
    """Fits the network on the documents of the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled([v or b"" for v in batch.column(2).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), INPUTS).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    some = named.join(F.broadcast(sample(labels, rows)), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>")
    table = some.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x")).toArrow().sort_by("doc_id")
    order = np.argsort(mixed(table.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, INPUTS)
    return fit(x[order], table.column("quality").to_numpy().astype(np.float64)[order])


def classify(docs: DataFrame, vectors: np.ndarray, net: Network, cut: float = 0.3) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, net = shared.value
            p = net.probability(pooled([v or b"" for v in batch.column(2).to_pylist()], vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = word_vectors(context_sums(docs))
    return classify(docs, vectors, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vectors))
