"""Whitening of embeddings from exact covariances.

Components become whole numbers. Their sums and the number of distinct vectors are exact; the rounded mean is taken off before anything is multiplied, and the rest
of the mean is accounted for in whole numbers afterwards. The products of a block of vectors are made by slices: each number is split into limbs so small that
the float64 matrix products of two limb matrices, summed over the block, stay below 2**53 and are exact whatever the order of addition. The limb products are
put together as big integers, a task adds up those of its blocks, Spark merges tasks' sums (limbs as longs), and the driver gets one d x d matrix, exact. Its
eigenvectors come from LAPACK, refined once in extended precision against the exact matrix.

Fit vectors are distinct, found by a grouping that combines in tasks first, so a vector that a third of the rows share costs one row for each task. Rows are
whitened in one pass over the table, without a join.

Defined results: rows whose vector is null, empty, of another length than most, or holding null or non-finite components take no part; components x scale beyond
2**62 in magnitude count as that; rows that repeat an identifier and vectors that are equal are rows of their own in the result, and one vector in the fit; null
identifiers are kept; directions without variance (RANK of the largest or below) have no component, so there may be fewer than asked for, none for one distinct
vector; a deviation that a long can't hold is null; extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact
from .cluster import durable

BLOCK = 8192  # vectors of a product: 2**13, so limbs of 20 bits keep sums of products below 2**53
LIMB = 20
RANK = 1e-15  # of the largest variance; extended precision tells smaller ones from none
EDGE = 2.0**62


class Whitening(NamedTuple):
    n: int  # distinct vectors
    sums: np.ndarray  # of their whole components, Python's integers
    vectors: np.ndarray  # d x components, of unit length
    values: np.ndarray  # variances along them, falling
    explained: np.ndarray  # their shares of all variance
    identity_error: float


def whole(v: np.ndarray, scale: float, shift: int) -> np.ndarray:
    x = np.clip(np.floor(scale * v), -EDGE, EDGE)
    return exact.integers(x) + shift


def slices(z: np.ndarray) -> list[np.ndarray]:
    """Limbs of whole numbers as float64 matrices: z is the sum of limb k x 2**(LIMB k), limbs at most 2**(LIMB - 1) in magnitude."""
    out = []
    while z.size and exact.largest(z):
        half = 1 << (LIMB - 1)
        low = ((z + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> LIMB
    return out


def products(z: np.ndarray) -> np.ndarray:
    """z' z of whole numbers, exact, as Python's integers. At most BLOCK rows."""
    d = z.shape[1]
    limbs, out = slices(z), np.zeros((d, d), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out = out + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Equal rows of whole numbers as equal bytes: a row is kept in the narrowest type that holds it, named by the first byte."""
    if x.dtype == object:
        return [b"," + ",".join(map(str, r)).encode() for r in x.tolist()]
    most, out = np.abs(x).max(1, initial=0), [b""] * len(x)
    least = np.zeros(len(x), bool)
    for kind in "bhiq":
        here = ~least & (most < (1 << (8 * np.dtype(kind).itemsize - 1)))
        least |= here
        at = np.flatnonzero(here)
        raw, step = x[at].astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
        for k, row in enumerate(at):
            out[row] = kind.encode() + raw[k * step : (k + 1) * step]
    return out


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    rows = column.to_pylist()
    kinds = {r[:1] for r in rows}
    if b"," in kinds:
        return np.array([[int(v) for v in r[1:].split(b",")] if r[:1] == b"," else np.frombuffer(r[1:], r[:1].decode()).tolist() for r in rows], object).reshape(-1, d)
    out = np.empty((len(rows), d), np.int64)
    for kind in kinds:
        at = [k for k, r in enumerate(rows) if r[:1] == kind]
        out[at] = np.frombuffer(b"".join(rows[k][1:] for k in at), kind.decode()).reshape(-1, d)
    return out


def refined(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors q of the symmetric v (both extended precision) after one step of Ogita and Aishima's refinement, and the eigenvalues; vectors of close eigenvalues are only made orthogonal."""
    r = np.eye(len(q)) - q.T @ q
    s = q.T @ v @ q
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    close = 2 * (np.sqrt((off**2).sum()) + np.sqrt((v**2).sum()) * np.sqrt((r**2).sum()))
    gap = e[None] - e[:, None]
    apart = np.abs(gap) > close
    step = np.where(apart, (s + e[None] * r) / np.where(apart, gap, 1), r / 2)
    return q + q @ step, e


def fit(table: DataFrame, vec_col: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> Whitening | None:
    """What whitens the vectors of table. None if there is no vector."""
    rows = exact.usable(table, vec_col)

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(whole(exact.matrix(b.column("v")), scale, 0)), pa.binary())], ["x"])

    distinct = durable(rows.mapInArrow(pack, "x binary").distinct())
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return None
    d = first.d

    def add(batches):
        total = np.zeros(d + 1, object)
        for b in batches:
            x = unpacked(b.column("x"), d)
            total[:d] = total[:d] + (x if exact.largest(x) < 1 << 40 else x.astype(object)).sum(0).astype(object)
            total[d] += len(x)
        yield exact.cells(total)

    total = exact.merged(distinct.mapInArrow(add, exact.CELLS), d + 1)
    n, sums = int(total[d]), total[:d]
    mean = np.array([(2 * int(s) + n) // (2 * n) for s in sums], object)  # rounded
    upper = np.triu_indices(d)

    def multiply(batches):
        total = np.zeros(len(upper[0]), object)
        for b in exact.blocks(batches, BLOCK):
            total = total + products(centred(unpacked(b.column("x"), d), mean))[upper]
        yield exact.cells(total)

    gram = np.zeros((d, d), object)
    gram[upper] = exact.merged(distinct.mapInArrow(multiply, exact.CELLS), len(upper[0]))
    gram = np.where(np.tri(d, dtype=bool), gram.T, gram)
    rest = sums - n * mean
    top = n * gram - np.outer(rest, rest)  # n x n x covariance
    exactly = lambda v: np.longdouble(str(v // (n * n))) + np.longdouble(v % (n * n)) / np.longdouble(n * n)
    cov = np.array([[exactly(int(v)) for v in row] for row in top], np.longdouble).reshape(d, d)
    values, vectors = np.linalg.eigh(cov.astype(np.float64))
    vectors, values = refined(cov, vectors.astype(np.longdouble))
    vectors = vectors / np.sqrt((vectors**2).sum(0))
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    order = order[values[order] > max(values[order].max(initial=0), 0) * RANK]
    explained = (values[order] / np.trace(cov)).astype(np.float64) if len(order) else np.zeros(0)
    out = Whitening(n, sums + n * shift, vectors[:, order].astype(np.float64), values[order].astype(np.float64), explained, 0.0)
    return out._replace(identity_error=_identity_error(distinct, out, d, shift))


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Whole numbers less the rounded mean, as int64 where they fit."""
    fits = x.dtype != object and max(exact.largest(x), exact.largest(mean)) < 1 << 61
    return x - mean.astype(np.int64) if fits else x.astype(object) - mean


def whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Rows x components, of whole vectors with their shift."""
    return (_deviations(x, w) / w.n).astype(np.float64) @ (w.vectors / np.sqrt(w.values))


def _deviations(x: np.ndarray, w: Whitening) -> np.ndarray:
    """n x - S, exact."""
    far = w.n * exact.largest(x) + exact.largest(w.sums)
    kind = np.int64 if far < 1 << 62 else object
    return x.astype(kind) * w.n - w.sums.astype(kind)


def _identity_error(distinct: DataFrame, w: Whitening, d: int, shift: int) -> float:
    """The largest entry of the whitened fit vectors' covariance less the identity: blocks are centred by their own means and merged with what the means differ by."""
    k = len(w.values)

    def measure(batches):
        for b in exact.blocks(batches, BLOCK):
            y = whitened(unpacked(b.column("x"), d) + shift, w)
            m = y.mean(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([m.tolist()], pa.list_(pa.float64())), pa.array([((y - m).T @ (y - m)).ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "products"])

    def merge(batches):
        n, mean, total = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for c, m, p in zip(b.column("n").to_pylist(), exact.matrix(b.column("mean")), exact.matrix(b.column("products")), strict=True):
                gap = m - mean
                total += p.reshape(k, k) + np.outer(gap, gap) * (n * c / (n + c))
                mean, n = mean + gap * (c / (n + c)), n + c
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "products"])

    if not k:
        return 0.0
    kind = "n long, mean array<double>, products array<double>"
    # a task's blocks are one row before the rows of all tasks meet: k x k numbers each
    parts = distinct.mapInArrow(lambda t: merge(measure(t)), kind)
    (_, _, total), = [(r.n, r.mean, r.products) for r in parts.repartition(1).mapInArrow(merge, kind).collect()]
    return float(np.abs(np.array(total).reshape(k, k) / w.n - np.eye(k)).max())


def whiten(table: DataFrame, w: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """_id, deviation (long), whitened (array of double) of each row with a usable vector."""
    rows = exact.usable(table, vec_col, F.col(f"`{id_col}`").alias("_id"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = whole(exact.matrix(b.column("v")), scale, shift)
            gap = _deviations(x, w)
            far = exact.largest(gap)
            square = gap.astype(exact.widened(gap[:0], (far * far * gap.shape[1]).bit_length()).dtype)
            far_off = [int(v) if v < 1 << 63 else None for v in (square * square).sum(1).tolist()]
            y = pa.array(whitened(x, w).ravel())
            k = len(w.values)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(far_off, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), y)], ["_id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"_id {kind}, deviation long, whitened array<double>")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of all vectors and up to 16 components."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = fit(table)
    if w is None or not len(w.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(v)) for v in w.explained])
    rows = whiten(table, w).select(F.col("_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return rows.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
