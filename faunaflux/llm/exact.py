"""Integer vectors and exact sums of integers over a cluster: big integers travel as limbs, which Spark adds as longs, and are put together on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 32  # bits of a limb: 2**31 tasks can add theirs in a long
CELLS = "cell long, limb int, value long"


def usable(table: DataFrame, vec_col: str, *kept: Column) -> DataFrame:
    """The columns kept, and v (array of doubles), of rows whose vector is not null, holds no null or non-finite component and has the length of most (the shortest of lengths equally common)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(*kept, F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", fine))
    # one row
    common = rows.groupBy(F.size("v").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).select("_d")
    return rows.join(F.broadcast(common), F.size("v") == F.col("_d")).drop("_d")


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of doubles of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python's integers where one of them is too large."""
    if not x.size or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def widened(x: np.ndarray, bits: int) -> np.ndarray:
    """x in the cheapest type that holds integers of so many bits exactly: float64 up to 53, int64 up to 62, else Python's."""
    return x.astype(np.float64) if bits <= 53 else x.astype(np.int64 if bits <= 62 else object)


def cells(total: np.ndarray) -> pa.RecordBatch:
    """Numbered limbs of the integers of total that are not 0; all but the top one are not negative."""
    at, limb, value = [], [], []
    for k, v in enumerate(total.ravel().tolist()):
        n = 0
        while v:
            low = v if -(1 << (LIMB - 1)) <= v < 1 << (LIMB - 1) else v & ((1 << LIMB) - 1)
            at.append(k)
            limb.append(n)
            value.append(low)
            v, n = (v - low) >> LIMB, n + 1
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["cell", "limb", "value"])


def merged(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all parts' totals, as Python's integers; the driver sees size x limbs rows."""
    out = np.zeros(size, object)
    for r in parts.groupBy("cell", "limb").agg(F.sum("value").alias("value")).toArrow().to_pylist():
        out[r["cell"]] += r["value"] << (LIMB * r["limb"])
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined into ones of so many rows, the last one shorter."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
