"""Exact nearest neighbours within groups by a k-d partition.

A sample of a group's points cuts space into leaves of about LEAF points each. Every point is first compared with those of its own leaf; how far its k-th neighbour there is bounds the
ball that can hold nearer ones, and only leaves that the ball reaches are asked then. So a row is copied a few times, whatever the size of its group, and a task holds one leaf.
The sample only decides how even the leaves are: results are exact for any.

Equal points are one place, known by its least row; places are searched, and rows are put in their stead afterwards, so a place that a third of the rows share costs one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SEED, d
from ..lineage import durable
from .trees import chunked

LEAF = 256
PER_LEAF = 16  # sample points for each leaf
MOST_LEAVES = 1 << 16  # of a group; leaves get larger beyond


def kd_tree(x: np.ndarray, leaves: int) -> dict[str, list]:
    """Nodes that halve the points at the median of their widest axis; axis -1 is a leaf."""
    axis, at, left, right = [-1], [0.0], [0], [0]
    todo = [(0, np.arange(len(x)), leaves)]
    while todo:
        node, rows, n = todo.pop()
        if n < 2 or len(rows) < 2:
            continue
        spread = x[rows].max(0) - x[rows].min(0)
        a = int(spread.argmax())
        v = np.sort(x[rows, a])[(len(rows) - 1) // 2]
        low = x[rows, a] <= v
        if spread[a] <= 0 or low.all():
            continue
        axis[node], at[node], left[node], right[node] = a, float(v), len(axis), len(axis) + 1
        todo += [(len(axis), rows[low], n // 2), (len(axis) + 1, rows[~low], n - n // 2)]
        axis += [-1, -1]
        at += [0.0, 0.0]
        left += [0, 0]
        right += [0, 0]
    return {"axis": axis, "at": at, "left": left, "right": right}


def leaf_of(x: np.ndarray, tree: dict) -> np.ndarray:
    axis, at, left, right = (np.asarray(tree[k]) for k in ("axis", "at", "left", "right"))
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(x) and (axis[node] >= 0).any():
        a = axis[node]
        node = np.where(a < 0, node, np.where(x[rows, np.maximum(a, 0)] > at[node], right[node], left[node]))
    return node


def reached(x: np.ndarray, radius: np.ndarray, own: np.ndarray, tree: dict, manhattan: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves, other than their own, that their balls reach."""
    out_rows, out_leaves = [], []
    todo = [(0, np.arange(len(x)), np.zeros_like(x))]  # node, rows, how far each row is from the node's box along each axis
    while todo:
        node, rows, gap = todo.pop()
        far = gap.sum(1) if manhattan else np.sqrt((gap * gap).sum(1))
        near = far <= radius[rows] * (1 + 1e-12)
        rows, gap = rows[near], gap[near]
        if not len(rows):
            continue
        a = tree["axis"][node]
        if a < 0:
            other = rows[own[rows] != node]
            out_rows.append(other)
            out_leaves.append(np.full(len(other), node))
            continue
        over = x[rows, a] - tree["at"][node]
        for side, away in ((tree["left"][node], np.maximum(over, 0)), (tree["right"][node], np.maximum(-over, 0))):
            g = gap.copy()
            g[:, a] = np.maximum(g[:, a], away)
            todo.append((side, rows, g))
    return (np.concatenate(out_rows), np.concatenate(out_leaves)) if out_rows else (np.zeros(0, int), np.zeros(0, int))


def _stack(t: pd.DataFrame, width: int) -> np.ndarray:
    return np.stack(t["v"].to_list()) if len(t) else np.zeros((0, width))


def _best(asks: np.ndarray, points: np.ndarray, k: int, manhattan: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest points (sorted: ties go to the earlier one) of each ask."""
    step = max(1, (1 << 21) // max(1, points.size))
    at, far = [], []
    for i in range(0, len(asks), step):
        gap = asks[i : i + step, None, :] - points[None]
        dist = np.abs(gap).sum(2) if manhattan else np.sqrt((gap * gap).sum(2))
        best = np.argsort(dist, 1, kind="stable")[:, :k]
        at.append(best)
        far.append(np.take_along_axis(dist, best, 1))
    return np.concatenate(at), np.concatenate(far)


def vectors(df: DataFrame, keys: list[str], row: str, axes: list[str]) -> DataFrame:
    """keys, row, v: written once, as values that are made anew (means, say) may differ in their last digit."""
    return durable(df.select(*keys, F.col(row).alias("row"), F.array(*[F.col(a).cast("double") + d(0) for a in axes]).alias("v")))


def places(t: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, v, point (the least row there), rows (the k + 1 least): distinct points of vectors()."""
    least = Window.partitionBy(*keys, "v").orderBy("row")
    t = t.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    return t.groupBy(*keys, "v").agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("point", F.get("rows", F.lit(0)))


def search(points: DataFrame, asks: DataFrame, keys: list[str], k: int, manhattan: bool = False) -> DataFrame:
    """keys, ask, point, dist: of each ask (keys, v, ask) the k nearest points (keys, v, point), its own place too if it is one, ties to the lesser point."""
    kinds = dict(points.dtypes) | {"ask": dict(asks.dtypes)["ask"]}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    points, asks = durable(points.select(*keys, "v", "point")), durable(asks.select(*keys, "v", "ask"))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("leaves", F.least(F.greatest(F.ceil(F.col("n") / LEAF), F.lit(1)), F.lit(MOST_LEAVES)).cast("int"))
    dealt = (F.pmod(F.xxhash64("point", F.lit(SEED)), F.lit(1 << 30)) / d(1 << 30)) * F.col("n") < F.col("leaves") * PER_LEAF
    sample = points.join(sizes, keys).where(dealt | (F.col("n") <= PER_LEAF * LEAF))

    def plant(t: pd.DataFrame) -> pd.DataFrame:
        tree = kd_tree(_stack(t, 0), int(t["leaves"].iloc[0]))
        return pd.DataFrame({**{c: [t[c].iloc[0]] for c in keys}, **{c: [v] for c, v in tree.items()}})

    trees = durable(sizes.select(*keys).join(sample.groupBy(*keys).applyInPandas(plant, f"{head}, axis array<int>, at array<double>, left array<int>, right array<int>"), keys, "left"))

    def node(t: pd.DataFrame) -> dict:
        # a group whose sample is empty has one leaf
        return {c: np.asarray(t[c].iloc[0]) for c in ("axis", "at", "left", "right")} if len(t) and t["axis"].iloc[0] is not None else {"axis": np.array([-1]), "at": np.zeros(1), "left": np.zeros(1, int), "right": np.zeros(1, int)}

    def with_tree(rows: DataFrame, run, schema: str) -> DataFrame:
        a, b = chunked(rows, trees, keys)
        by = [*keys, "__chunk"]
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(run, schema)

    def placing(name: str):
        def run(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            out = rows[[*keys, "v", name]].copy()
            out["leaf"] = leaf_of(_stack(rows, 0), node(tree))
            return out

        return run

    where = lambda t, name: with_tree(t, placing(name), f"{head}, v array<double>, {name} {kinds[name]}, leaf int")
    placed = durable(where(points, "point"))
    # a group without points has no neighbours
    asked = where(asks.join(sizes.select(*keys), keys, "left_semi"), "ask")

    def look(a: pd.DataFrame, p: pd.DataFrame, whole: bool) -> pd.DataFrame:
        p = p.sort_values("point")
        x = _stack(p, 0)
        best, far = (_best(_stack(a, 0), x, k, manhattan) if len(p) else (np.zeros((len(a), 0), int), np.zeros((len(a), 0)))) if len(a) else (np.zeros((0, 0), int),) * 2
        names = p["point"].to_numpy()
        out = a[[*keys, "v", "ask", "leaf"] if whole else [*keys, "ask"]].copy()
        lists = lambda x: pd.Series([v.tolist() for v in x], out.index, dtype=object)
        if not whole:
            keep = far <= a["radius"].to_numpy()[:, None] * (1 + 1e-12) if len(a) else far
            out["points"], out["dists"] = lists(names[b[m]] for b, m in zip(best, keep, strict=True)), lists(f[m] for f, m in zip(far, keep, strict=True))
            return out
        out["radius"] = far[:, k - 1] if far.shape[1] >= k else np.inf
        out["points"], out["dists"] = lists(names[b] for b in best), lists(far)
        return out

    by = [*keys, "leaf"]
    found = f"points array<{kinds['point']}>, dists array<double>"
    first = durable(asked.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(lambda a, p: look(a, p, True), f"{head}, v array<double>, ask {kinds['ask']}, leaf int, radius double, {found}"))

    def widen(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        r, leaf = reached(_stack(rows, 0), rows["radius"].to_numpy(), rows["leaf"].to_numpy(), node(tree), manhattan)
        out = rows.iloc[r][[*keys, "v", "ask", "radius"]].copy()
        out["leaf"] = leaf
        return out

    wider = with_tree(first.select(*keys, "v", "ask", "radius", "leaf"), widen, f"{head}, v array<double>, ask {kinds['ask']}, radius double, leaf int")
    more = wider.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(lambda a, p: look(a, p, False), f"{head}, ask {kinds['ask']}, {found}")
    pairs = first.select(*keys, "ask", "points", "dists").unionByName(more).select(*keys, "ask", F.explode(F.arrays_zip("points", "dists")).alias("z")).select(*keys, "ask", F.col("z.points").alias("point"), F.col("z.dists").alias("dist"))
    w = Window.partitionBy(*keys, "ask").orderBy("dist", "point")
    return durable(pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r"))


def nearest_rows(points: DataFrame, found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, ask, near: for each ask its k nearest (dist, row), in order, from the places that were found for it."""
    t = found.join(points.select(*keys, "point", "rows"), [*keys, "point"]).select(*keys, "ask", F.col("dist"), F.explode("rows").alias("row"))
    w = Window.partitionBy(*keys, "ask").orderBy("dist", "row")
    t = t.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return t.groupBy(*keys, "ask").agg(F.array_sort(F.collect_list(F.struct("dist", "row"))).alias("near"))


def between(df: DataFrame, keys: list[str], row: str, axes: list[str], k: int) -> DataFrame:
    """keys, src, dst, dist, rank: the k nearest other rows of each row of its group, ties to the lesser row."""
    t = vectors(df, keys, row, axes)
    points = durable(places(t, keys, k))
    # k + 1 rows of the nearest places, as the row itself is among them or is beaten by rows at its own place
    near = nearest_rows(points, search(points, points.withColumn("ask", F.col("point")), keys, k + 1), keys, k + 1)
    t = t.join(points.select(*keys, "v", F.col("point").alias("ask")), [*keys, "v"]).drop("v").join(near, [*keys, "ask"])
    others = F.slice(F.filter("near", lambda z: z["row"] != F.col("row")), 1, k)
    t = t.select(*keys, F.col("row").alias("src"), F.posexplode(others).alias("i", "z"))
    return t.select(*keys, "src", F.col("z.row").alias("dst"), F.col("z.dist").alias("dist"), (F.col("i") + 1).alias("rank"))


def of_rows(train: DataFrame, test: DataFrame, keys: list[str], row: str, axes: list[str], k: int, manhattan: bool = True) -> DataFrame:
    """keys, row, near: for each row of test its k nearest rows (dist, row) of train."""
    t = vectors(test, keys, row, axes)
    points = durable(places(vectors(train, keys, row, axes), keys, k - 1))
    asks = durable(places(t, keys, 0)).select(*keys, "v", F.col("point").alias("ask"))
    near = nearest_rows(points, search(points, asks, keys, k, manhattan), keys, k)
    return t.join(asks, [*keys, "v"]).join(near, [*keys, "ask"]).select(*keys, F.col("row").alias(row), "near")
