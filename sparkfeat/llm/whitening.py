"""Embedding whitening from a weighted multiplicity covariance.

Identical integer vectors are grouped first. The covariance is a sum over the *distinct* vectors,
each weighing its number of rows (or one): every task multiplies its centred vectors with their
weights into one small matrix, and the cells of these matrices are added by Spark. The
eigenvectors of the sum come from the driver (dims x dims numbers, whatever the table's size), each
distinct vector is whitened once, and the rows get their vector's result by a join, which Spark
splits where one vector holds many rows.

Defined results: rows whose vector is null, has a null, non-finite or too large component
(``vectors.integer_vectors``) or another length than most are dropped; a null or repeated id is an
ordinary row; an empty table gives an empty result. A component without variance (equal vectors, fewer
distinct vectors than dimensions) has a null ``whitened`` and takes no part in ``identity_error``.
``deviation`` is exact; it is null where it has more than 38 digits. Eigenvectors are
signed so that their entry of largest magnitude is positive. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import stored
from sparkfeat.llm.vectors import integer_vectors, lists, matrix


def _cells(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str) -> np.ndarray:
    """Sums over all batches of vectors of ``size`` numbers: one vector a task, added cell by cell
    with Spark's partial aggregation; ``size`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = of_batch(b) if total is None else total + of_batch(b)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(size, dtype=np.int32), "v": total})
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in df.mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


def weighted_sums(df: DataFrame, col: str, dims: int, weight: str, kind: str = "long") -> np.ndarray:
    dtype = np.int64 if kind == "long" else np.float64
    return _cells(df, lambda b: b.column(weight).to_numpy().astype(dtype) @ matrix(b.column(col), dims, dtype), dims, kind)


def weighted_covariance(df: DataFrame, col: str, weight: str, centred: Callable[[np.ndarray], np.ndarray],
                        dims: int, n: int, dtype=np.int64) -> np.ndarray:
    """Sum of w * (x - mean)(x - mean)' over the rows, divided by n. ``centred`` maps vectors to their
    differences from the mean, before anything is multiplied."""
    upper = np.triu_indices(dims)

    def product(b: pa.RecordBatch) -> np.ndarray:
        m = centred(matrix(b.column(col), dims, dtype))
        return ((m * b.column(weight).to_numpy()[:, None]).T @ m)[upper]
    out = np.zeros((dims, dims))
    out[upper] = _cells(df, product, len(upper[0]), "double") / n
    return out + np.triu(out, 1).T


@dataclass(frozen=True)
class Whitening:
    """n rows of the fit with per-dimension sums; eigenvectors (columns) and eigenvalues of their
    covariance by falling eigenvalue, and its trace."""
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def used(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without cancellation: the whole part of the mean goes off as an integer."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - self.n * whole) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.used, self.values, 1))
        return np.where(self.used, self.centred(x) @ self.vectors / scale, np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 over the dimensions, exact: squares of 52-bit numbers in two halves,
        larger ones in Python's integers."""
        most = max(int(np.abs(x).max(initial=0)), 1)
        if self.n * most + int(np.abs(self.sums).max(initial=0)) >= 2**52 or x.shape[1] > 1024:
            s = [int(v) for v in self.sums]
            return [sum((self.n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
        d = np.abs(self.n * x - self.sums)
        high, low = d >> 26, d & (2**26 - 1)
        parts = ((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]


def fit(distinct: DataFrame, dims: int, components: int = 8, col: str = "x", weight: str = "w") -> Whitening | None:
    """Mean, covariance and its first eigenvectors of the distinct vectors under their weights."""
    n = distinct.agg(F.sum(weight)).first()[0]
    if not n:
        return None
    start = Whitening(int(n), weighted_sums(distinct, col, dims, weight), np.eye(dims), np.ones(dims), 1.0)
    cov = weighted_covariance(distinct, col, weight, start.centred, dims, start.n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Whitening(start.n, start.sums, vectors, values, float(np.trace(cov)))


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest entry by magnitude of the whitened vectors' covariance minus the identity, over the
    components with variance."""
    used, k = model.used, len(model.values)
    if not used.any():
        return 0.0
    filled = whitened.select("w", F.transform("z", lambda v: F.coalesce(v, F.lit(0.0))).alias("z"))
    mean = weighted_sums(filled, "z", k, "w", "double") / model.n
    cov = weighted_covariance(filled, "z", "w", lambda z: z - mean, k, model.n, np.float64)
    return float(np.abs(cov - np.eye(k))[np.ix_(used, used)].max())


def whiten_embeddings(df: DataFrame, *, components: int = 8, scale: float = 1024, offset: int = 100_000,
                      weights: str = "counts", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``df`` and component: vec_id, component (from 1), n, deviation
    (decimal), whitened, explained, identity_error. ``weights``: "counts" fits on all rows, "one" on
    each distinct vector once; n and the mean follow the fit list."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, dims = integer_vectors(df, id_col=id_col, vec_col=vec_col, scale=scale, offset=offset)
    w = F.count(F.lit(1)) if weights == "counts" else F.max(F.lit(1))
    distinct = stored(rows.groupBy("x").agg(w.cast("long").alias("w")), "distinct-vectors")
    model = fit(distinct, dims, components) if dims else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), dims)
                dev = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
                yield pa.RecordBatch.from_pydict({"x": b.column("x"), "w": b.column("w"), "z": lists(model.whiten(x)),
                                                  "deviation": pa.array(dev, pa.decimal128(38, 0))})
    nan_to_null = F.transform("z", lambda v: F.when(~F.isnan(v), v)).alias("z")
    whitened = stored(distinct.mapInArrow(whiten, "x array<int>, w long, z array<double>, deviation decimal(38,0)")
                      .select("x", "w", nan_to_null, "deviation"), "whitened-vectors")
    error = identity_error(whitened, model)
    explained = F.array(*(F.lit(float(v / model.trace)) if model.trace else F.lit(None).cast("double") for v in model.values))
    return (rows.join(whitened.select("x", "z", "deviation"), "x")
            .select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"),
                    F.lit(error).alias("identity_error")))
