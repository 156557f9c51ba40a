"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are centred, rotated and projected; each curve takes its own projection of a few dimensions and a random shift, and orders the vectors along a
Hilbert curve. Spark range-partitions and sorts each ordering; a row's rank in it, cut into blocks, is what neighbours are joined on: a query meets the
block that holds its rank and those within `reach` blocks of it, candidates of all curves merge, and exact distances rank them.

Equal vectors are one point of the index that keeps its least identifiers, as many as an answer can need; so a vector that a third of the rows share
costs one row. Points, curves and blocks are all rows; the driver sees row counts of partitions, the recall of a sample, and nothing else.

The reach is found by measuring: the true neighbours of a bounded, documented sample of queries (CALIBRATION, by brute force), and how far from the query their
ranks are on the curve that brings them closest; the least reach that meets the target is taken. Vectors without structure need a large part of the data for
that, and get it: the work is then that of the queries against most rows, in blocks.

Defined results: vectors that are null, empty, zero, of another length than most, or holding null or non-finite components take no part; fewer candidates than k
give fewer rows; ties go to the smaller identifier; null identifiers take no part; rows that repeat identifier and vector are one; an identifier with two vectors
is a candidate and a query with both; extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .cluster import durable, partitions
from .jaccard_join import grouped

CURVES, DIMS, BITS = 12, 6, 10
BLOCK = 512  # ranks in a block
FIT_ROWS = 4096  # rows that centre and axes are fitted on
CALIBRATION = 64  # queries whose recall is measured
TARGET = 0.95


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of x, unsigned integers below 2**bits (Skilling's transform; at most 63 bits in all)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    data, at = bs.buffers(column)
    return np.frombuffer(data.tobytes(), np.float64).reshape(len(column), -1)


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, v (packed doubles), d: rows that take part."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("_id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    common = rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).select("d")
    rows = rows.join(F.broadcast(common), "d")

    def pack(batches):
        for b in batches:
            flat = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64)
            d = len(flat) // max(1, b.num_rows)
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([raw[i * d * 8 : (i + 1) * d * 8] for i in range(b.num_rows)], pa.binary())], ["_id", "v"])

    return rows.select("_id", "v").mapInArrow(pack, "_id long, v binary")


def nearest(table: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, target: float = TARGET, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows of table whose identifier satisfies the condition queries(column), the k nearest other rows found."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    # each distinct vector, with its k + 1 least identifiers: row_number below a bound is applied before the shuffle too
    least = Window.partitionBy("v").orderBy("_id")
    rows = valid_vectors(table, id_col, vec_col)
    ids = rows.distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    points = durable(ids.groupBy("v").agg(F.array_sort(F.collect_list("_id")).alias("ids")).withColumn("point", F.xxhash64("v")))
    total = points.count()
    if not total:
        return spark.createDataFrame([], schema)
    asked = durable(rows.where(queries(F.col("_id"))).distinct())
    sample = points.orderBy(F.xxhash64(F.lit(seed), "point")).limit(FIT_ROWS).select("v").toArrow()
    fit = _matrix(sample.column("v").combine_chunks())
    d = fit.shape[1]
    centre = fit.mean(0)
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(fit - centre, full_matrices=True)
    dims = min(DIMS, d)
    planes, shifts, lows, widths = [], [], [], []
    for _ in range(CURVES):
        # orthonormal axes, the leading ones of the data mixed with random ones
        turn, _ = np.linalg.qr(rng.normal(size=(d, dims)))
        p = axes.T @ turn
        y = (fit - centre) @ p
        planes.append(p)
        lows.append(y.min(0))
        widths.append(np.maximum(y.max(0) - y.min(0), 1e-12) * 2)
        shifts.append(rng.uniform(0, 0.5, size=dims))

    def keys_of(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), CURVES), np.int64)
        for c in range(CURVES):
            cell = (((x - centre) @ planes[c] - lows[c]) / widths[c] + shifts[c]) * (1 << BITS)
            out[:, c] = hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64), BITS)
        return out

    def curves(batches):
        for b in batches:
            key = keys_of(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("point").to_numpy(), CURVES)), pa.array(np.tile(np.arange(CURVES, dtype=np.int32), len(key))), pa.array(key.ravel())], ["point", "curve", "key"])

    placed = points.select("point", "v").mapInArrow(curves, "point long, curve int, key long")
    ordered = placed.repartitionByRange(partitions(spark), "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    ordered = durable(ordered.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1)))
    counted = sorted(ordered.groupBy("part").count().collect())  # a row for each partition
    before, offsets = 0, []
    for part, n in counted:
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets, "part long, off long")
    # ranks run through all curves one after the other; every curve has all points
    ranked = ordered.join(F.broadcast(offset), "part").select("point", "curve", ((F.col("off") + F.col("at")) % total).alias("rank"))
    ranked = durable(ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)))
    blocks = -(-total // BLOCK)
    asked_points = durable(asked.join(points.select("v", "point"), "v").select(F.col("_id").alias("q"), "point", "v"))

    def answer(who: DataFrame, reach: int) -> DataFrame:
        near = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))))
        here = who.join(ranked, "point").select("curve", near.alias("block"), F.lit(0).alias("kind"), F.array("q").alias("ids"), "v")
        there = ranked.join(here.select("curve", "block").distinct(), ["curve", "block"], "left_semi").join(points, "point")
        cells = here.unionByName(there.select("curve", "block", F.lit(1).alias("kind"), "ids", "v"))
        cells = cells.repartition("curve", "block").sortWithinPartitions("curve", "block", "kind")

        def run(batches):
            best: dict[int, list[tuple[float, int]]] = {}
            for b, starts in grouped(batches, ["curve", "block"]):
                kind, x, ids = b.column("kind").to_numpy(), _matrix(b.column("v")), b.column("ids").to_pylist()
                for g, e in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
                    cut = g + int(np.searchsorted(kind[g:e], 1))
                    _nearest_into(best, [i[0] for i in ids[g:cut]], x[g:cut], ids[cut:e], x[cut:e], k)
                if len(best) > 20_000:
                    yield _rows(best)
                    best = {}
            yield _rows(best)

        return _merged(cells.mapInArrow(run, _FOUND), k)

    def exact(who: DataFrame) -> DataFrame:
        rows = who.select("q", "v").toArrow()  # CALIBRATION rows
        asked_ids, x = rows.column("q").to_pylist(), _matrix(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((0, d))

        def run(batches):
            best: dict[int, list[tuple[float, int]]] = {}
            for b in batches:
                _nearest_into(best, asked_ids, x, b.column("ids").to_pylist(), _matrix(b.column("v")), k)
            yield _rows(best)

        return _merged(points.select("ids", "v").mapInArrow(run, _FOUND), k)

    # the reach that recall needs: of each true neighbour of a sample of queries, the blocks between it and its query on the curve where they are closest
    probe = durable(asked_points.orderBy(F.xxhash64(F.lit(seed), "q")).limit(CALIBRATION))
    truth = exact(probe).select(F.col("query_id").alias("q"), F.col("vec_id").alias("_id"))
    pairs = truth.join(rows.join(F.broadcast(truth.select("_id").distinct()), "_id").join(points.select("v", F.col("point").alias("other")), "v").select("_id", "other"), "_id").join(probe.select("q", "point"), "q")
    a, b = (ranked.join(F.broadcast(pairs.select(F.col(c).alias("point")).distinct()), "point").select(F.col("point").alias(c), "curve", F.col("block").alias(f"{c}_block")) for c in ("point", "other"))
    apart = pairs.join(a, "point").join(b, ["other", "curve"]).groupBy("q", "_id").agg(F.min(F.abs(F.col("point_block") - F.col("other_block"))).alias("blocks"))
    needed = sorted(r.blocks for r in apart.collect())  # CALIBRATION x k rows
    reach = int(needed[min(len(needed) - 1, -int(-target * len(needed) // 1) - 1)]) if needed else 0
    return answer(asked_points, reach)


_FOUND = "query_id long, vec_id long, score double"


def _nearest_into(best: dict, asked: list[int], q: np.ndarray, ids: list[list[int]], x: np.ndarray, k: int) -> None:
    """Merges into best, by query, the k nearest of points x, each standing for several identifiers."""
    if not len(asked) or not len(x):
        return
    step = max(1, (4 << 20) // max(1, x.size))
    for at in range(0, len(q), step):
        dist = np.sqrt(((q[at : at + step, None, :] - x[None]) ** 2).sum(2))
        n = min(len(x), k + 1)
        # all points up to the n-th distance, so that ties are whole
        bound = np.partition(dist, n - 1, axis=1)[:, n - 1]
        for r, (row, top) in enumerate(zip(dist, bound, strict=True)):
            me = asked[at + r]
            new = [(float(row[c]), i) for c in np.flatnonzero(row <= top) for i in ids[c] if i != me]
            best[me] = sorted({*best.get(me, ()), *new})[:k]


def _rows(best: dict) -> pa.RecordBatch:
    flat = [(q, i, s) for q, found in best.items() for s, i in found]
    q, i, s = zip(*flat, strict=True) if flat else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of each vector whose vec_id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)
