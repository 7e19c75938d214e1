"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

x = floor(256 c) of each entry c is a whole number. The fit list holds each distinct x once, n rows with
sums S. A is the list less its mean. From a start v1 the method alternates u = Av and v = A'u:

    A V = U B,  A'U = V B' + beta v e',  B upper bidiagonal,

with full reorthogonalisation of both sides. The small B's singular values and right vectors give the components: the
eigenvalues of the covariance are their squares over n.

The fit list lies in the shared folder as blocks of whole numbers. Each step is one Spark job over the blocks: a
task multiplies its rows by v, takes off the former u's, and returns A'u, U'u and u'u, sums of a few
hundred numbers, which Spark adds. A column u is never stored: u = Ap for a vector p of one entry for each dimension,
so the job recomputes whatever part of U it needs. The driver holds vectors of one entry for each dimension
alone, whatever the number of rows. There are as many steps as dimensions, unless `steps` asks for fewer; where the method
breaks down (an invariant subspace, such as equal eigenvalues give) it goes on from a new vector at right angles to the others.

Defined cases: rows whose vector is null, or holds null, NaN, an infinity or an entry whose x leaves 53 bits are
left out; so are vectors of another length than the commonest one (of equally common ones the longest), empty ones
too; repeated rows are fitted once and returned each; a null vec_id stays null. Components whose eigenvalue is 0 up to
rounding don't exist (a single distinct vector has none), so their rows are missing. A deviation beyond 63 bits is null. Empty tables
give empty results; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Work, ship

COMPONENTS = 4
#: Vectors in a block.
BLOCK = 8192
LARGEST = float(2**53)


@dataclass
class Whitening:
    """What was fitted: n distinct vectors with sums, eigenvalues (falling), unit components as columns, the trace of the covariance, and the largest error of whitened's covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def scaled(embedding: Column) -> Column:
    """floor(256 c) of each entry as long; null for vectors that don't count."""
    wide = F.transform(embedding, lambda c: F.lit(256.0) * c.cast("double"))
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return F.when(embedding.isNotNull() & ~bad, F.transform(wide, lambda c: F.floor(c)))


def valid(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, x: those of the commonest length that isn't 0."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("x")).filter("size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    return rows if common is None else rows.filter(F.size("x") == common.d)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(rows: DataFrame, work: Work) -> DataFrame:
    """Each distinct x once, in blocks: k rows of d entries as bytes, their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            m = np.ascontiguousarray(np.concatenate(parts), np.int64)
            total = m.sum(axis=0) if abs(m).max() < 2**62 // len(m) else sum(m.astype(object))
            return pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int64()), pa.array([m.tobytes()]), pa.array([[str(x) for x in total]])], names=["k", "data", "sums"])

        parts, held = [], 0
        for batch in batches:
            m = matrix(batch.column(0))
            for a in range(0, len(m), BLOCK):
                parts.append(m[a : a + BLOCK])
                held += len(parts[-1])
                if held >= BLOCK:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return work.table(rows.select("x").distinct().mapInArrow(run, "k long, data binary, sums array<string>"), "blocks")


class Centred:
    """The blocks as a matrix less its mean; products are Spark jobs that return small sums."""

    def __init__(self, table: DataFrame):
        self.table = table
        row = table.select("k", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("k").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
        self.n, self.sums = int(row[0].n), [int(r.s) for r in row]
        self.d = len(self.sums)
        self.mean = np.array([s / self.n for s in self.sums])

    def reduced(self, body, size: int) -> np.ndarray:
        """The sum of body(rows less the mean), arrays of `size` numbers, over all blocks."""
        mean, d = self.mean, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for data in batch.column(0):
                    total += body(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, d) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

        rows = self.table.select("data").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(size)
        for i, v in rows.collect():
            out[i] = v
        return out

    def products(self, p: np.ndarray, former: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """For u = Ap and the former columns U = A * former: A'u, u'u, U'u."""
        d, k = self.d, former.shape[1]

        def body(a: np.ndarray) -> np.ndarray:
            u = a @ p
            return np.concatenate([a.T @ u, [u @ u], (a @ former).T @ u])

        out = self.reduced(body, d + 1 + k)
        return out[:d], float(out[d]), out[d + 1 :]


def bidiagonalise(a: Centred, steps: int | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """V (one column a step) and B, with full reorthogonalisation on both sides.

    A'U is known from former steps, so taking U(U'u) off a new u takes (A'U)(U'u) off A'u without another pass.
    """
    r, d = np.random.RandomState(seed), a.d
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, the p of U = Ap, A'U
    b = np.zeros((0, 0))
    size = 0.0  # the largest entry of B so far

    def orthogonal(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    v, beta = r.randn(d), 0.0
    v /= np.linalg.norm(v)
    for k in range(min(d, steps or d)):
        p = v - beta * left[:, -1] if k else v
        image, square, dots = a.products(p, left)
        p, image, square = p - left @ dots, image - images @ dots, square - float(dots @ dots)
        alpha = float(np.sqrt(max(square, 0.0)))
        right = np.column_stack([right, v])
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = b
        if k:
            grown[k - 1, k] = beta
        size = max(size, alpha)
        null = alpha <= 1e-10 * size or size == 0.0
        grown[k, k] = 0.0 if null else alpha
        b = grown
        # where Av vanishes u is no column of A: it stays out (p = 0), and the next v is a new one
        p, image = (np.zeros(d), np.zeros(d)) if null else (p / alpha, image / alpha)
        left, images = np.column_stack([left, p]), np.column_stack([images, image])
        w = orthogonal(image - b[k, k] * v)
        beta = float(np.linalg.norm(w))
        if null or beta <= 1e-10 * size:
            w, beta = orthogonal(r.randn(d)), 0.0
            if np.linalg.norm(w) < 1e-8:
                break
        v = orthogonal(w / np.linalg.norm(w))
        v /= np.linalg.norm(v)
    return right, b


def fit(rows: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """rows (x) to the whitening by their leading components; None without rows."""
    table = blocks(rows, Work(rows.sparkSession, "whitening"))
    if table.isEmpty():
        return None
    a = Centred(table)
    right, b = bidiagonalise(a, steps)
    _, singular, small = np.linalg.svd(b)
    values = singular**2 / a.n
    keep = int(np.sum(values[:components] > 1e-18 * max(values[0], 1e-300) * a.d)) if singular[0] > 0 else 0
    directions = right @ small.T[:, :keep]
    directions /= np.linalg.norm(directions, axis=0)
    directions *= np.where(directions[np.argmax(abs(directions), axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    values = values[:keep]
    trace = float(a.reduced(lambda m: np.array([np.einsum("ij,ij->", m, m)]), 1)[0]) / a.n
    error = 0.0
    if keep:
        project = directions / np.sqrt(values)
        mean = a.reduced(lambda m: (m @ project).sum(axis=0), keep) / a.n

        def products(m: np.ndarray) -> np.ndarray:
            z = m @ project - mean
            return (z.T @ z).ravel()

        error = float(abs(a.reduced(products, keep * keep).reshape(keep, keep) / a.n - np.eye(keep)).max())
    return Whitening(a.n, a.sums, values, directions, trace, error)


def whiten(rows: DataFrame, found: Whitening) -> DataFrame:
    """rows (vec_id, x) to one row for each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    n, mean = found.n, np.array([s / found.n for s in found.sums])
    project, keep = found.components / np.sqrt(found.values), len(found.values)
    explained = found.values / found.trace if keep else found.values
    sums = found.sums

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact: in 64 bits where no sum can leave them, else in whole numbers of any length."""
        most = int(abs(x).max()) * n + max(abs(s) for s in sums) if len(x) else 0
        if most * most * x.shape[1] < 2**63:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            z = (x - mean) @ project
            at = np.repeat(np.arange(len(x)), keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(at)), pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), found.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding), fitted and whitened."""
    ship(vectors.sparkSession)
    rows = valid(vectors)
    found = fit(rows, components, steps)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if found is None else whiten(rows, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
