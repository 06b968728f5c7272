"""Embedding whitening (operator 11): MLlib's computeSVD on centred rows, singular values rescaled by the divisor n, total variance from exact deviations.

An entry c becomes the whole number floor(1024 c) + 100000, so that counts, sums and deviations are exact: n x - S is a whole number for every row, and centred rows are it over n,
rounded once. MLlib's distributed row matrix of the centred rows gives right singular vectors and values; value squared over n is a variance, and the share that it explains is taken of the total
that the deviations add up to, not of the values found. Nothing but sums by dimension (one number each), the basis and the error's sums of pairs of components comes to the driver.

Defined cases: a row whose vector is null, empty or holds null, NaN, infinite or huge (``HUGE`` or more) entries is left out; so is one whose length isn't the commonest (of equals the longest);
a null or repeated vec_id keeps its row, repeated rows count as often as they come; components of no variance (under ``FLAT`` of the first) are left out, so a lone or constant vector gives no rows,
and there are at most as many components as dimensions; an empty table gives no rows; a deviation beyond a long is null, ``exact_deviation`` has it; columns besides vec_id and embedding aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STEP, SHIFT = 1024, 100_000
HUGE, FLAT, COMPONENTS = float(1 << 24), 1e-12, 8
#: Dimensions up to which all singular vectors are asked for, so that MLlib decomposes the Gramian directly; beyond, only the components wanted, iteratively.
DIRECT = 1024
#: Entries that a task works on at once.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Whitener:
    """A fitted transform: n rows, exact sums by dimension, components as columns, their variances (falling) and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that are whitened."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < HUGE))
    rows = vectors.select("vec_id", v.alias("embedding")).filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count()
    common_size = sizes.agg(F.max_by("size", F.struct("count", "size"))).first()[0]
    return rows.filter(F.size("embedding") == (common_size or 0))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of ``batch`` in blocks, each with its whole numbers (rows x dimensions)."""
    if not batch.num_rows:
        return
    size = len(batch.column(1)[0])
    each = max(1, BLOCK // size)
    for i in range(0, batch.num_rows, each):
        part = batch.slice(i, each)
        yield part, np.floor(STEP * part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums by dimension: a row for each dimension leaves a block, and one comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch):  # under 2**35 each, so a block's sums fit
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(x.sum(0)), pa.array(np.full(x.shape[1], part.num_rows))], ["at", "s", "n"])

    got = rows.mapInArrow(add, "at long, s long, n long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    return (got[0]["n"], tuple(int(r["s"]) for r in got)) if got else (0, ())


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(exact deviations, x - S / n). Sums are taken off as n * base + rest, so that products stay within a long for any n up to 2**28; Python's integers beyond."""
    if n < 1 << 28 and max(map(abs, sums)) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if d.size and int(np.abs(d).max()) ** 2 * x.shape[1] < 1 << 62:
            return (d * d).sum(1), d / n
    else:
        d = n * x.astype(object) - np.array(sums, object)
    exact = d.astype(object)
    return (exact * exact).sum(1), (d / n).astype(np.float64)


def centred(rows: DataFrame, n: int, sums: tuple[int, ...]) -> DataFrame:
    """(vec_id, exact_deviation, centred) of every row."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch):
                deviation, c = _centred(x, n, sums)
                flat = pa.ListArray.from_arrays(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(c).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)), flat], ["vec_id", "exact_deviation", "centred"])

    return rows.mapInArrow(run, f"vec_id {kind}, exact_deviation decimal(38,0), centred array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fitted on all ``rows`` of ``usable``; None without rows or variance."""
    n, sums = _sums(rows)
    if not n:
        return None
    moved = centred(rows, n, sums)
    # exact: the sum over dimensions of (n x - S)^2, over all rows, is n^3 times the total variance
    total = float(int(moved.agg(F.sum("exact_deviation")).first()[0])) / float(n) ** 3
    if not total:
        return None
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(moved.select(array_to_vector("centred").alias("v")), "v"), n, len(sums))
    wanted = len(sums) if len(sums) <= DIRECT else min(components, len(sums) - 1)
    svd = matrix.computeSVD(wanted, computeU=False)
    variances = np.asarray(svd.s.toArray()) ** 2 / n
    keep = np.flatnonzero(variances > FLAT * variances[0])[:components]
    return Whitener(n, sums, svd.V.toArray()[:, keep], variances[keep], total)


def whitened(rows: DataFrame, by: Whitener) -> DataFrame:
    """(vec_id, exact_deviation, whitened): each row on the components, every one of variance 1."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, sums, basis = by.n, by.sums, by.components / np.sqrt(by.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch):
                deviation, c = _centred(x, n, sums)
                w = c @ basis
                flat = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(w).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)), flat], ["vec_id", "exact_deviation", "whitened"])

    return rows.mapInArrow(run, f"vec_id {kind}, exact_deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity. Blocks are centred by their own means, and their sums of products put together from those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            m, k = w.mean(0), w.shape[1]
            i, j = (a.ravel() for a in np.indices((k, k)))
            inner = ((w - m).T @ (w - m)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, inner, m[i] * m[j] * len(w), m[i] * len(w), m[j] * len(w), np.full(len(i), len(w)))], ["i", "j", "inner", "outer", "si", "sj", "n"])

    parts = rows.select("whitened").mapInArrow(run, "i long, j long, inner double, outer double, si double, sj double, n long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("inner", "outer", "si", "sj", "n")])
    cov = (F.col("inner") + F.col("outer") - F.col("si") * F.col("sj") / F.col("n")) / F.col("n")
    return float(sums.agg(F.max(F.abs(cov - (F.col("i") == F.col("j")).cast("double")))).first()[0])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitener | None]:
    """(vec_id, exact_deviation, whitened) of every usable row, fitted on all of them, and the transform (None if there is nothing to whiten: then no rows)."""
    rows = usable(vectors)
    by = fit(rows, components)
    if by is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, exact_deviation decimal(38,0), whitened array<double>"), None
    return whitened(rows, by), by


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    error = identity_error(rows) if by else math.nan
    shares = F.array(*[F.lit(float(e / by.total)) for e in by.variances]) if by else F.array().cast("array<double>")
    return rows.select("vec_id", "exact_deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(by.n if by else 0).cast("long").alias("n"), F.col("exact_deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "exact_deviation",
    )
