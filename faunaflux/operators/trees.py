"""Decision trees, forests and boosting of all groups at once, on features binned by quantiles.

What is learned from is always a table of sums by (model, leaf, feature, bin). A group of up to ONE_TASK values (rows x features) makes it within a task, all such groups side by
side in one grouped map; in a larger group every batch of rows sends its sums and Spark adds them, so rows stay where they are and the driver sees tables of bins only. All ways run
the same growing code and give the same trees. Draws (bootstrap, bags, features at a leaf) are arithmetic on a hash of the row, so reruns agree and SQL can make them, too.

Within a task, rows that fall into the same bins of all features are one cell: forests send cells down their trees, and boosting, where the features span few cells, sums boxes of a
grid of them. So a tree costs what its cells cost, and they get no more once a group has filled them.

A model is a row for each tree of each group: arrays of its nodes, thresholds in the features' own units. Missing and non-finite values go to the lower side of every split.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SEED, d, finite, md5_int
from ..lineage import durable

ONE_TASK = 12_000_000  # values (training rows x features) of a group that a task takes, packed
FEW_ROWS = 20_000  # of a group whose boosting looks at rows, not at cells
GRID = 1 << 20  # cells of a grid
BINS = 64
PRIME = (1 << 31) - 1  # of the draws
AT_ONCE = 1 << 21  # numbers in a table of bins, and rows x trees, that are kept at once
TREE = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, cover array<double>, base double"
FIELDS = ("feature", "threshold", "left", "right", "value", "cover")
KINDS = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]


class Spec(NamedTuple):
    trees: int = 1
    splits: int | None = None  # of a tree, the best leaf first; None: every leaf that gains, level by level
    depth: int = 5
    boost: bool = False
    adaptive: bool = False  # trees that vote, each on rows weighed by how wrong those before were
    rate: float = 0.1
    folds: int = 0  # held-out parts that choose the number of boosted trees; 0: all trees
    step: int = 50  # trees between looks at the held-out parts
    draw: str = "all"  # rows of a tree: all, bag (a share without replacement), poisson (bootstrap), balanced (bootstrap of as many rows of each class as there are presences)
    bag: float = 0.75
    features: int | None = None  # tried at a leaf; None: all
    extra: bool = False  # one cut of each feature at a leaf, drawn among its bins
    leaf: float = 1.0  # least weight of a leaf
    bins: int = BINS
    seed: int = SEED


def draw_numbers(seed: int, tree: int) -> tuple[int, int]:
    """Multiplier and shift of a tree's draw: the row with hash h gets (h x multiplier + shift) modulo PRIME."""
    h = lambda k: (seed * 1_000_003 + tree * 7919 + k * 104_729 + 12_345) % PRIME
    return pow(48_271, 1 + h(1) % (PRIME - 2), PRIME), h(2)


def row_hash(row: str, seed: int = SEED) -> Column:
    """A number below PRIME for each row, by md5."""
    return (md5_int(F.lit(seed), F.col(row)) % PRIME).cast("long")


def uniform(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    a, c = draw_numbers(seed, tree)
    return ((h * a + c) % PRIME + 0.5) / PRIME


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Counts of a Poisson distribution by inversion, up to 20."""
    p = np.exp(-mean)
    total, out = p.copy(), np.zeros(len(u))
    for k in range(1, 21):
        out += u >= total
        p = p * mean / k
        total = total + p
    return out


def drawn(spec: Spec, tree: int, h: np.ndarray, y: np.ndarray, presences: float, background: float) -> np.ndarray:
    """How many times a tree takes each row."""
    if spec.draw == "all":
        return np.ones(len(h))
    u = uniform(h, spec.seed, tree)
    if spec.draw == "bag":
        return (u < spec.bag).astype(float)
    if spec.draw == "poisson":
        return poisson(u, np.ones(len(h)))
    return poisson(u, np.where(y == 1, 1.0, presences / max(background, 1.0)))


class Forest:
    """Trees of several models side by side, as arrays (model, node); feature -1 is a leaf, others' values are kept for explanations."""

    def __init__(self, models: int, nodes: int):
        self.feature = np.full((models, nodes), -1, np.int32)
        self.cut, self.left, self.right = (np.zeros((models, nodes), np.int32) for _ in range(3))
        self.value, self.cover = np.zeros((models, nodes)), np.zeros((models, nodes))
        self.used = np.ones(models, np.int64)
        self.level = np.zeros((models, nodes), np.int32)

    def step(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows' nodes (model, row) one level down."""
        m = np.arange(len(node))[:, None]
        f = self.feature[m, node]
        over = codes[np.arange(codes.shape[0])[None], np.maximum(f, 0)] > self.cut[m, node]
        return np.where(f < 0, node, np.where(over, self.right[m, node], self.left[m, node]))

    def walk(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros((len(self.feature), len(codes)), np.int64)
        for _ in range(int(self.level.max()) + 1):
            node = self.step(codes, node)
        return node

    def widen(self, nodes: int) -> None:
        if nodes > self.feature.shape[1]:
            for name in ("feature", "cut", "left", "right", "value", "cover", "level"):
                x = getattr(self, name)
                more = np.full((len(x), nodes), -1 if name == "feature" else 0, x.dtype)
                more[:, : x.shape[1]] = x
                setattr(self, name, more)

    def tree(self, m: int, edges: list, scale: float = 1.0) -> dict:
        n = int(self.used[m])
        f, cut = self.feature[m, :n], self.cut[m, :n]
        at = [float(edges[a][b]) if a >= 0 else 0.0 for a, b in zip(f, cut, strict=True)]
        return {"feature": f.tolist(), "threshold": at, "left": self.left[m, :n].tolist(), "right": self.right[m, :n].tolist(), "value": (self.value[m, :n] * scale).tolist(), "cover": self.cover[m, :n].tolist()}


def sums(codes: np.ndarray, place: np.ndarray, asked: np.ndarray, stats: list[np.ndarray], bins: int) -> np.ndarray:
    """Sums of each statistic by (model, leaf, asked feature, bin). place: (model, row), -1 for rows that are in no leaf asked for; asked: features (model, leaf, place)."""
    models, leaves, width = asked.shape
    out = np.zeros((len(stats), models, leaves, width, bins))
    m, r = np.nonzero(place >= 0)
    at = place[m, r]
    base = (m * leaves + at) * bins
    for f in range(width):
        key = base + codes[r, asked[m, at, f]]
        for s, x in enumerate(stats):
            out[s, :, :, f] = np.bincount(key, x[m, r], models * leaves * bins).reshape(models, leaves, bins)
    return out


def _chance(seed: int, trees: list[int], nodes: np.ndarray, width: int) -> np.ndarray:
    """A number in [0, 1) for each (model, leaf, feature)."""
    a, c = (np.array(v, np.int64)[:, None, None] for v in zip(*(draw_numbers(seed, t) for t in trees), strict=True))
    place = (np.maximum(nodes, 0)[:, :, None] * 131 + np.arange(1, width + 1)) % PRIME
    return ((place * a + c) % PRIME * 48_271 % PRIME) / PRIME


def tried(spec: Spec, trees: list[int], nodes: np.ndarray, width: int) -> np.ndarray:
    """The features (model, leaf, place) that are tried at each leaf, rising."""
    if spec.features and spec.features < width:
        rank = _chance(spec.seed + 1, trees, nodes, width).argsort(2, kind="stable").argsort(2)
        return np.nonzero(rank < spec.features)[2].reshape(*nodes.shape, spec.features)
    return np.broadcast_to(np.arange(width), (*nodes.shape, width))


def best_splits(hist: np.ndarray, spec: Spec, trees: list[int], nodes: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, place among the asked features and cut of each (model, leaf) from sums of weight and statistic; gain 0: none. Ties go to the lower feature, then the lower cut."""
    w, s = np.cumsum(hist[0], -1), np.cumsum(hist[1], -1)
    all_w, all_s = w[..., -1:], s[..., -1:]
    wl, sl = w[..., :-1], s[..., :-1]
    wr, sr = all_w - wl, all_s - sl
    ok = (wl >= spec.leaf - 1e-9) & (wr >= spec.leaf - 1e-9)
    cuts = ok.shape[3]
    if spec.extra:
        may = ok & (hist[0, ..., :-1] > 0)
        one = (np.take_along_axis(_chance(spec.seed + 2, trees, nodes, width), asked, 2) * may.sum(-1)).astype(np.int64)
        ok = may & (np.cumsum(may, -1) == one[..., None] + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, sl * sl / wl + sr * sr / wr - all_s * all_s / all_w, 0.0).reshape(*nodes.shape, -1)
    # sums that were added in another order differ in the last digits only
    at = np.round(gain / np.maximum(gain.max(-1, keepdims=True), 1e-300), 9).argmax(-1)
    top = np.take_along_axis(gain, at[..., None], -1)[..., 0]
    return np.where((nodes >= 0) & (top > 1e-9), top, 0.0), at // cuts, at % cuts


def grow(tally, spec: Spec, trees: list[int], width: int) -> Forest:
    """One tree for each model. tally(forest, leaves, asked) gives sums (statistic, model, leaf, asked feature, bin) for leaves (model, place) of node numbers, -1 for none."""
    models = len(trees)
    forest, leaves = Forest(models, 1), np.zeros((models, 1), np.int64)
    known: list[list[tuple]] = [[] for _ in range(models)]  # of the best leaf first: splits of leaves that are not split yet
    while (leaves >= 0).any() or any(known):
        found = []
        if (leaves >= 0).any():
            asked = tried(spec, trees, leaves, width)
            hist = tally(forest, leaves, asked)
            total = hist[:, :, :, 0].sum(-1)
            if not forest.cover.any():
                _set(forest, np.arange(models), 0, total[:, :, 0], spec)
            gain, best, cut = best_splits(hist, spec, trees, leaves, asked, width)
            m, k = np.nonzero(gain > 0)
            at, c = best[m, k], cut[m, k]
            f = asked[m, k, at]
            low = np.where(np.arange(hist.shape[-1]) <= c[:, None], hist[:, m, k, at], 0).sum(-1)
            found = [m, leaves[m, k], f, c, low, total[:, m, k] - low]
            if spec.splits is not None:
                for i, g in enumerate(gain[m, k].tolist()):
                    known[m[i]].append((-g, int(found[1][i]), int(f[i]), int(c[i]), low[:, i], found[5][:, i]))
        if spec.splits is not None:
            best = []
            for m, splits in enumerate(known):
                if splits and forest.used[m] < 2 * spec.splits:
                    splits.sort(key=lambda x: x[:2])
                    best.append((m, *splits.pop(0)[1:]))
                else:
                    splits.clear()
            found = [np.array(v).T if i > 3 else np.array(v) for i, v in enumerate(zip(*best, strict=True))]
        if not len(found) or not len(found[0]):
            break
        leaves = _divide(forest, *found, spec)
    return forest


def _divide(forest: Forest, m: np.ndarray, node: np.ndarray, f: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, spec: Spec) -> np.ndarray:
    """Splits nodes of models (sorted by model); gives the new leaves (model, place) that can be split further."""
    of = np.bincount(m, minlength=len(forest.used))
    rank = np.arange(len(m)) - np.repeat(np.cumsum(of) - of, of)
    left = forest.used[m] + 2 * rank
    forest.widen(int((forest.used + 2 * of).max()))
    forest.feature[m, node], forest.cut[m, node], forest.left[m, node], forest.right[m, node] = f, c, left, left + 1
    level = forest.level[m, node] + 1
    leaves = np.full((len(of), 2 * int(of.max())), -1, np.int64)
    for side, sums_ in ((0, low), (1, high)):
        forest.level[m, left + side] = level
        _set(forest, m, left + side, sums_, spec)
        leaves[m, 2 * rank + side] = np.where(level < spec.depth, left + side, -1) if spec.splits is None else left + side
    forest.used += 2 * of
    if spec.splits is not None:
        leaves[forest.used >= 2 * spec.splits] = -1
    return leaves


def _set(forest: Forest, m: np.ndarray, node, total: np.ndarray, spec: Spec) -> None:
    """Nodes' values: the weighted mean, or of boosting a Newton step; and their weights."""
    below = total[2] if spec.boost else total[0]
    forest.value[m, node] = np.where(below > 1e-12, total[1] / np.where(below > 1e-12, below, 1), 0.0)
    forest.cover[m, node] = total[0]


def _places(node: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Each row's place among the leaves of its model; -1 where it is in none of them."""
    where = np.full((len(node), int(max(node.max(initial=0), leaves.max(initial=0))) + 1), -1)
    m, k = np.nonzero(leaves >= 0)
    where[m, leaves[m, k]] = k
    return np.take_along_axis(where, node, 1)


class Local:
    """Rows in memory: codes (row, feature), presence or not, weights, hashes. Of boosting, model m leaves out the rows of fold m, and the last model none."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, h: np.ndarray, spec: Spec, models: int, counts: tuple[float, float] | None = None):
        self.codes, self.y, self.weight, self.h, self.spec, self.models = codes, y == 1, weight, h, spec, models
        self.counts = counts or (float(self.y.sum()), float((~self.y).sum()))
        folds = np.arange(models)[:, None]
        self.held = (h[None] % spec.folds == folds) if spec.folds else np.zeros((models, len(h)), bool)

    def classes(self) -> np.ndarray:
        """Weights of background and presences of each model."""
        w = ~self.held * self.weight
        return np.stack([(w * ~self.y).sum(1), (w * self.y).sum(1)], 1)

    def begin(self, base: np.ndarray) -> None:
        self.margin = np.repeat(base[:, None], len(self.y), 1)

    def start(self, trees: list[int]) -> None:
        draw = lambda t: drawn(self.spec, t, self.h, self.y, *self.counts)
        if self.spec.adaptive:
            w = self.weight * np.exp(-np.clip((2 * self.y - 1) * self.margin, -300, 300))
            self.stats = [w, w * self.y]
            self.node, self.looks = np.zeros(w.shape, np.int64), 0
            return
        w = self.weight * (draw(trees[0])[None] * ~self.held if self.spec.boost else np.stack([draw(t) for t in trees]))
        if self.spec.boost:
            p = 1 / (1 + np.exp(-np.clip(self.margin, -35, 35)))
            self.stats = [w, w * (self.y - p), w * p * (1 - p)]
        else:
            self.stats = [w, w * self.y]
        self.node, self.looks = np.zeros(w.shape, np.int64), 0

    def tally(self, forest: Forest, leaves: np.ndarray, asked: np.ndarray) -> np.ndarray:
        # a look is at leaves that the splits since the last one have made, or at the root
        self.node = forest.step(self.codes, self.node) if self.looks else self.node
        self.looks += 1
        return sums(self.codes, _places(self.node, leaves), asked, self.stats, self.spec.bins)

    def add(self, forest: Forest) -> None:
        self.margin += (1.0 if self.spec.adaptive else self.spec.rate) * np.take_along_axis(forest.value, forest.walk(self.codes), 1)

    def deviance(self) -> np.ndarray:
        """Of each fold, the loss of its held-out rows, and their weight."""
        z = self.margin[:-1]
        w = self.weight * self.held[:-1]
        return np.stack([(w * (np.maximum(z, 0) - z * self.y + np.log1p(np.exp(-np.abs(z))))).sum(1), w.sum(1)])


class Rows(NamedTuple):
    """Rows in memory by cells: codes (cell, feature), each row's cell, class, weight and hash; sizes: cells of a grid along each feature."""

    codes: np.ndarray
    cell: np.ndarray
    y: np.ndarray
    w: np.ndarray | None  # None: all 1
    h: np.ndarray | None
    sizes: tuple[int, ...]

    def sums(self, times: np.ndarray | None, key: np.ndarray, size: int) -> np.ndarray:
        """Weights of rows, times how often they are drawn, by key."""
        if self.w is not None:
            return np.bincount(key, self.w if times is None else self.w * times, size)
        return np.bincount(key, times, size).astype(float)


def below_prime(v: np.ndarray) -> np.ndarray:
    """Modulo PRIME (a power of two less one) of numbers below 2 ** 62."""
    v = (v & PRIME) + (v >> 31)
    v = (v & PRIME) + (v >> 31)
    return np.where(v == PRIME, 0, v)


def least_drawn(bounds: np.ndarray) -> np.ndarray:
    """For bounds of uniform(): the least draw whose number is not below each."""
    at = np.clip(np.ceil(bounds * PRIME - 0.5), 0, PRIME).astype(np.int64)
    for _ in range(2):
        at = np.where((at > 0) & ((at - 1 + 0.5) / PRIME >= bounds), at - 1, at)
    for _ in range(2):
        at = np.where((at < PRIME) & ((at + 0.5) / PRIME < bounds), at + 1, at)
    return at


class Draws:
    """drawn() of the same rows for tree after tree, by comparing whole numbers."""

    def __init__(self, spec: Spec, h: np.ndarray | None, y: np.ndarray, presences: float, background: float):
        self.spec, self.h = spec, h
        if spec.draw == "bag":
            self.parts = [(slice(None), least_drawn(np.array([spec.bag])))]
        elif spec.draw != "all":
            means = [1.0, presences / max(background, 1.0)] if spec.draw == "balanced" else [1.0]
            self.parts = [(np.flatnonzero(y == 1 - i) if len(means) > 1 else slice(None), least_drawn(self._bounds(m))) for i, m in enumerate(means)]

    @staticmethod
    def _bounds(mean: float) -> np.ndarray:
        p = total = np.exp(-np.array([mean]))
        out = [total[0]]
        for k in range(1, 20):
            p = p * mean / k
            total = total + p
            out.append(total[0])
        return np.array(out)

    def __call__(self, tree: int) -> np.ndarray | None:
        """How many times the tree takes each row; None: each once."""
        if self.spec.draw == "all":
            return None
        a, c = draw_numbers(self.spec.seed, tree)
        v = below_prime(self.h * a + c).astype(np.uint32)
        if self.spec.draw == "bag":
            return v < np.uint32(self.parts[0][1][0])
        out = np.zeros(len(v), np.uint8)
        for rows, bounds in self.parts:
            own = v[rows]
            n = np.zeros(len(own), np.uint8)
            for b in bounds:
                over = own >= np.uint32(b)
                if not over.any():
                    break
                n += over
            out[rows] = n
        return out


class Cells:
    """Rows of a forest by cells: those that a tree draws go down it level by level, and those in leaves that are not split are left behind."""

    PACK, STEP = float(1 << 26), 1 << 13  # steps that stay in the processor's cache

    def __init__(self, rows: Rows, spec: Spec, models: int):
        self.rows, self.spec = rows, spec
        self.draws = Draws(spec, rows.h, rows.y, float(rows.y.sum()), float((~rows.y).sum()))
        self.flat, self.width, self.cells = rows.codes.ravel(), rows.codes.shape[1], len(rows.codes)
        self.key = rows.y * self.cells + rows.cell
        # whole weights of both classes fit one number
        self.packed = rows.w is None and 20 * len(rows.cell) < self.PACK

    def _of(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        times = self.draws(tree)
        if times is None and hasattr(self, "all"):
            return self.all
        n = self.rows.sums(times, self.key, 2 * self.cells).reshape(2, -1)
        out = n[0] + n[1], n[1]
        if times is None:
            self.all = out
        return out

    def start(self, trees: list[int]) -> None:
        cell, place, w = [], [], []
        for i, t in enumerate(trees):
            a, b = self._of(t)
            at = np.flatnonzero(a)
            cell.append(at * self.width)
            place.append(np.full(len(at), i))
            w.append([a[at] + b[at] * self.PACK] if self.packed else [a[at], b[at]])
        self.cell, self.place, *self.w = (np.concatenate(x) for x in (cell, place, *zip(*w, strict=True)))
        self.leaves = None

    def tally(self, forest: Forest, leaves: np.ndarray, asked: np.ndarray) -> np.ndarray:
        models, count = leaves.shape
        if self.leaves is not None:
            # from places among the leaves of the last look to those of their children
            m, k = np.nonzero(self.leaves >= 0)
            node = self.leaves[m, k]
            f, at = forest.feature[m, node], m * self.leaves.shape[1] + k
            where = np.full((models, forest.feature.shape[1] + 1), -1)
            i, j = np.nonzero(leaves >= 0)
            where[i, leaves[i, j]] = i * count + j
            feature, cut = np.zeros(self.leaves.size, np.int64), np.zeros(self.leaves.size, np.uint8)
            feature[at], cut[at] = np.maximum(f, 0), forest.cut[m, node]
            child = np.full((self.leaves.size, 2), -1)
            child[at, 0], child[at, 1] = (np.where(f < 0, -1, where[m, side[m, node]]) for side in (forest.left, forest.right))
            child, kept = child.ravel(), 0
            for i in range(0, len(self.place), self.STEP):
                part = slice(i, i + self.STEP)
                cell, at, values = self.cell[part], self.place[part], [x[part] for x in self.w]
                at = child.take(2 * at + (self.flat.take(cell + feature.take(at)) > cut.take(at)))
                keep = np.flatnonzero(at >= 0)
                if len(keep) < len(at):
                    cell, at, values = cell.take(keep), at.take(keep), [x.take(keep) for x in values]
                to = slice(kept, kept + len(at))
                for whole, x in zip((self.cell, self.place, *self.w), (cell, at, *values), strict=True):
                    whole[to] = x
                kept += len(at)
            self.cell, self.place, self.w = self.cell[:kept], self.place[:kept], [x[:kept] for x in self.w]
        self.leaves = leaves
        bins, width = self.spec.bins, asked.shape[2]
        out = np.zeros((2, models, count, width, bins))
        size, names, key = models * count * bins, asked.reshape(-1, width), np.empty(len(self.place), np.int64)
        for t in range(width):
            own = np.ascontiguousarray(names[:, t])
            for i in range(0, len(key), self.STEP):
                at = self.place[i : i + self.STEP]
                np.add(at * bins, self.flat.take(self.cell[i : i + self.STEP] + own.take(at)), out=key[i : i + self.STEP])
            first = np.bincount(key, self.w[0], size)
            second = np.floor(first / self.PACK) if self.packed else np.bincount(key, self.w[1], size)
            out[0, :, :, t] = (first - second * self.PACK if self.packed else first).reshape(models, count, bins)
            out[1, :, :, t] = second.reshape(models, count, bins)
        return out


class Grid:
    """Rows of boosting by cells of a whole grid: a node is a box of it, whose sums are sums of slices, and a tree moves the margins of its leaves' boxes."""

    def __init__(self, rows: Rows, spec: Spec, models: int):
        self.rows, self.spec, self.models, self.sizes = rows, spec, models, rows.sizes
        self.draws = Draws(spec, rows.h, rows.y, float(rows.y.sum()), float((~rows.y).sum()))
        self.cells = int(np.prod(rows.sizes))
        strides = np.cumprod([1, *rows.sizes[:0:-1]])[::-1]
        cell = (rows.codes.astype(np.int64) @ strides)[rows.cell]
        self.parts = max(spec.folds, 1)
        self.key = ((rows.h % self.parts if spec.folds else 0) * 2 + rows.y) * self.cells + cell
        # a weight for each class, where rows of a class weigh the same
        self.scale = np.ones(2)
        if rows.w is not None:
            ends = [(rows.w[rows.y == c].min(initial=np.inf), rows.w[rows.y == c].max(initial=-np.inf)) for c in (0, 1)]
            if all(a >= b for a, b in ends):
                self.scale = np.array([b if np.isfinite(b) else 1.0 for _, b in ends])
                self.rows = rows._replace(w=None)
        self.whole = self._sums(None)

    def _sums(self, times) -> np.ndarray:
        """(part, class, cell)"""
        if self.rows.w is None and times is not None:
            n = np.bincount(self.key[times], minlength=2 * self.parts * self.cells).astype(float) if times.dtype == bool else self.rows.sums(times, self.key, 2 * self.parts * self.cells)
        else:
            n = self.rows.sums(times, self.key, 2 * self.parts * self.cells)
        return n.reshape(self.parts, 2, self.cells) * self.scale[:, None]

    def _of_models(self, n: np.ndarray):
        """(class, cell) of each model in turn."""
        total = n.sum(0) if self.parts > 1 else n[0]
        for m in range(self.models):
            yield total - n[m] if m < self.spec.folds else total

    def classes(self) -> np.ndarray:
        return np.stack([x.sum(1) for x in self._of_models(self.whole)])

    def begin(self, base: np.ndarray) -> None:
        self.margin = np.repeat(base[:, None], self.cells, 1)
        self.odds = np.exp(self.margin)
        self.trees = 0

    def start(self, trees: list[int]) -> None:
        self.trees += 1
        if self.trees % 64 == 0:  # products drift in their last digits
            self._odds()
        times = self.draws(trees[0])
        n = self.whole if times is None else self._sums(times)
        stats = []
        for m, (w0, w1) in enumerate(self._of_models(n)):
            odds = self.odds[m]
            if self.spec.adaptive:
                b = w1 / odds
                stats.append(np.stack([w0 * odds + b, b]))
                continue
            w, p = w0 + w1, odds / (1 + odds)
            wp = w * p
            stats.append(np.stack([w, w1 - wp, wp * (1 - p)]))
        self.stats = [x.reshape(-1, *self.sizes) for x in stats]
        self.boxes = [[tuple((0, n) for n in self.sizes)] for _ in range(self.models)]

    def _box(self, forest: Forest, m: int) -> list[tuple]:
        boxes, n = self.boxes[m], int(forest.used[m])
        boxes += [()] * (n - len(boxes))
        for node in range(n):  # parents come before their children
            f = int(forest.feature[m, node])
            if f >= 0 and not boxes[forest.left[m, node]]:
                low, high = boxes[node][f]
                cut = min(max(int(forest.cut[m, node]) + 1, low), high)
                for side, ends in ((forest.left, (low, cut)), (forest.right, (cut, high))):
                    boxes[side[m, node]] = (*boxes[node][:f], ends, *boxes[node][f + 1 :])
        return boxes

    def tally(self, forest: Forest, leaves: np.ndarray, asked: np.ndarray) -> np.ndarray:
        models, count, width = asked.shape
        out = np.zeros((len(self.stats[0]), models, count, width, self.spec.bins))
        axes = len(self.sizes)
        for m in range(models):
            boxes = self._box(forest, m)
            for k in range(count):
                if leaves[m, k] < 0:
                    continue
                box = boxes[leaves[m, k]]
                x = self.stats[m][(slice(None), *(slice(a, b) for a, b in box))]
                by: list = [None] * axes
                for f in range(axes - 1, 0, -1):  # the last feature's sums, then those without it
                    by[f] = x.sum(tuple(range(1, f + 1)))
                    x = x.sum(-1)
                by[0] = x
                for t, f in enumerate(asked[m, k]):
                    out[:, m, k, t, box[f][0] : box[f][1]] = by[f]
        return out

    def add(self, forest: Forest) -> None:
        rate = 1.0 if self.spec.adaptive else self.spec.rate
        for m in range(self.models):
            margin, odds = self.margin[m].reshape(self.sizes), self.odds[m].reshape(self.sizes)
            for node, box in enumerate(self._box(forest, m)):
                if forest.feature[m, node] < 0:
                    at, step = tuple(slice(a, b) for a, b in box), rate * forest.value[m, node]
                    margin[at] += step
                    odds[at] *= np.exp(step)
        if max(self.margin.max(), -self.margin.min()) > 35:
            self._odds()

    def _odds(self) -> None:
        most = 300 if self.spec.adaptive else 35
        self.odds = np.exp(np.clip(self.margin, -most, most))

    def deviance(self) -> np.ndarray:
        out = []
        for m in range(self.spec.folds):
            z, (w0, w1) = self.margin[m], self.whole[m]
            out.append([((w0 + w1) * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))) - w1 * z).sum(), (w0 + w1).sum()])
        return np.array(out).T


class Setting(NamedTuple):
    spec: Spec
    models: int
    counts: tuple[float, float]
    base: np.ndarray | None = None
    since: tuple[Forest, ...] = ()  # boosted trees that the rows' margins do not hold yet

    def rows(self, b: pa.RecordBatch) -> Local:
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        out = Local(codes, *(b.column(c).to_numpy() for c in ("y", "w", "h")), self.spec, self.models, self.counts)
        if self.base is not None:
            out.begin(self.base)
            if "margin" in b.schema.names:
                out.margin = b.column("margin").flatten().to_numpy().reshape(b.num_rows, -1).T.copy()
            for forest in self.since:
                out.add(forest)
        return out


class Spread:
    """The rows of one large group, in partitions: tasks send sums, Spark adds them. Margins of boosting are written into the rows at every `step` trees."""

    def __init__(self, rows: DataFrame, spec: Spec, models: int):
        first = rows.agg(F.sum("y"), F.count("*")).first()
        self.table, self.now, self.width = rows, Setting(spec, models, (float(first[0]), float(first[1] - first[0]))), rows.select(F.octet_length("codes")).first()[0]

    def _sum(self, shape: tuple[int, ...], of) -> np.ndarray:
        """Sum over all batches of of(their rows), arrays of this shape."""
        now = self.now

        def run(batches):
            total = np.zeros(shape)
            for b in batches:
                total += of(now.rows(b)) if b.num_rows else 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "value"])

        out = np.zeros(shape)
        for r in self.table.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            out.ravel()[r.cell] = r.value
        return out

    def classes(self) -> np.ndarray:
        return self._sum((self.now.models, 2), lambda r: r.classes())

    def begin(self, base: np.ndarray) -> None:
        self.now = self.now._replace(base=base)

    def start(self, trees: list[int]) -> None:
        self.trees = trees

    def tally(self, forest: Forest, leaves: np.ndarray, asked: np.ndarray) -> np.ndarray:
        spec, trees = self.now.spec, self.trees

        def look(r: Local) -> np.ndarray:
            r.start(trees)
            return sums(r.codes, _places(forest.walk(r.codes), leaves), asked, r.stats, spec.bins)

        return self._sum((3 if spec.boost else 2, *asked.shape, spec.bins), look)

    def add(self, forest: Forest) -> None:
        self.now = self.now._replace(since=(*self.now.since, forest))
        if len(self.now.since) < self.now.spec.step:
            return
        now = self.now

        def margins(batches):
            for b in batches:
                m = now.rows(b).margin.T.ravel()
                at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * now.models)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("codes", "y", "w", "h")), pa.ListArray.from_arrays(at, pa.array(m))], ["codes", "y", "w", "h", "margin"])

        self.table, self.now = durable(self.table.mapInArrow(margins, "codes binary, y double, w double, h long, margin array<double>")), now._replace(since=())

    def deviance(self) -> np.ndarray:
        return self._sum((2, self.now.models - 1), lambda r: r.deviance())


def planted(source_of, spec: Spec, rows: int, width: int):
    """Trees that do not depend on each other, as many side by side as memory allows."""
    per = max(1, min(spec.trees, AT_ONCE // max(min(rows, AT_ONCE), min(rows, 1 << spec.depth) * (spec.features or width) * spec.bins)))
    source = None
    for at in range(0, spec.trees, per):
        ids = list(range(at, min(at + per, spec.trees)))
        source = source_of(len(ids)) if source is None or not isinstance(source, Cells) else source
        source.start(ids)
        yield grow(source.tally, spec, ids, width)


def forests(source_of, spec: Spec, rows: int, width: int, edges: list) -> tuple[list[dict], float]:
    return [forest.tree(m, edges, 1 / spec.trees) for forest in planted(source_of, spec, rows, width) for m in range(len(forest.used))], 0.0


def boosted(source, spec: Spec, width: int, edges: list) -> tuple[list[dict], float]:
    """Trees one after another, for all folds and the whole at the same time. With folds, the number of trees is that of the look with least held-out deviance; the search ends
    when the mean of the last ten looks is not below that of the ten before."""
    classes = np.maximum(source.classes(), 1e-9)
    base = np.log(classes[:, 1] / classes[:, 0])
    source.begin(base)
    models, trees, looks = spec.folds + 1, [], []
    for t in range(spec.trees):
        source.start([t] * models)
        forest = grow(source.tally, spec, [t] * models, width)
        source.add(forest)
        trees.append(forest.tree(models - 1, edges, spec.rate))
        if spec.folds and (t + 1) % spec.step == 0:
            loss, weight = source.deviance()
            looks.append(float(np.mean(loss / np.maximum(weight, 1e-300))))
            if len(looks) >= 20 and np.mean(looks[-10:]) >= np.mean(looks[-20:-10]):
                break
    keep = (int(np.argmin(looks)) + 1) * spec.step if looks else len(trees)
    return trees[:keep], float(base[-1])


def adaptive(source, spec: Spec, width: int, edges: list) -> tuple[list[dict], float]:
    """Votes of trees: a tree's weight is half the log-odds of its being right on the weighed rows; it ends with a tree that is never wrong, or no better than chance. Values are shares of all votes."""
    source.begin(np.zeros(1))
    forests_, votes = [], []
    for t in range(spec.trees):
        source.start([t])
        forest = grow(source.tally, spec, [t], width)
        n = int(forest.used[0])
        leaf = forest.feature[0, :n] < 0
        cover, value = forest.cover[0, :n][leaf], forest.value[0, :n][leaf]
        wrong = float((cover * np.minimum(value, 1 - value)).sum() / max(cover.sum(), 1e-300))
        if wrong >= 0.5 - 1e-12:
            break
        vote = 0.5 * np.log((1 - wrong) / max(wrong, 1e-12))
        forest.value[0, :n] = np.where(forest.value[0, :n] > 0.5, vote, -vote)
        source.add(forest)
        forests_.append(forest)
        votes.append(vote)
        if wrong <= 1e-12:
            break
    if not forests_:  # not one tree is better than chance: even odds, as a tree of one leaf
        return [{"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0], "cover": [0.0]}], 0.0
    return [f.tree(0, edges, 2 / sum(votes)) for f in forests_], 0.0


def grown(source_of, spec: Spec, rows: int, width: int, edges: list) -> tuple[list[dict], float]:
    if spec.adaptive:
        return adaptive(source_of(1), spec, width, edges)
    return boosted(source_of(spec.folds + 1), spec, width, edges) if spec.boost else forests(source_of, spec, rows, width, edges)


def edges_of(train: DataFrame, keys: list[str], features: list[str], bins: int = BINS) -> DataFrame:
    """keys, __e: of each feature its cuts, rising: the values at so many quantiles (the k-th is at place ceil(k n / bins) of n); the greatest value cuts nothing.

    Values are sorted into ranges over all tasks, and places counted from where a range begins, so no task holds a group."""
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), finite(c).alias("x")) for i, c in enumerate(features)])).alias("z")
    t = train.select(*keys, x).select(*keys, "z.f", "z.x").where("x is not null").groupBy(*keys, "f", "x").agg(F.count("*").alias("n"))
    parts = 4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "f"]
    t = durable(t.repartitionByRange(parts, *by, "x").withColumn("__part", F.spark_partition_id()))
    n = t.groupBy(*by, "__part").agg(F.sum("n").alias("own"))
    n = n.withColumns({"before": F.sum("own").over(Window.partitionBy(*by).orderBy("__part")) - F.col("own"), "all": F.sum("own").over(Window.partitionBy(*by))}).drop("own")
    t = t.join(n, [*by, "__part"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "__part").orderBy("x")))
    place = lambda c: F.least(F.floor(c * bins / F.col("all")), F.lit(bins - 1))
    t = t.where((place(F.col("upto")) > place(F.col("upto") - F.col("n"))) & (F.col("upto") < F.col("all")))
    found = t.groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("cuts")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", "cuts"))).alias("m"))
    own = [F.coalesce(F.col("m")[F.lit(i)], F.array().cast("array<double>")) for i in range(len(features))]
    none = F.array(*[F.array().cast("array<double>")] * len(features))
    return train.select(*keys).distinct().join(found.select(*keys, F.array(*own).alias("__e")), keys, "left").select(*keys, F.coalesce("__e", none).alias("__e"))


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """edges_of() one feature in memory."""
    v = np.sort(x[np.isfinite(x)])
    if not len(v):
        return v
    at = np.unique(v[-(-np.arange(1, bins) * len(v) // bins) - 1])
    return at[at < v[-1]]


def digits(x: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Codes (row, feature): how many cuts lie below; missing and non-finite values go to the lowest bin."""
    return np.stack([np.where(np.isfinite(v), np.searchsorted(e, v), 0) for v, e in zip(x, edges, strict=True)], 1).astype(np.uint8)


def cells_of(codes: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and each row's place among them."""
    if float(np.prod([float(n) for n in sizes])) >= 2.0**62:
        return codes, np.arange(len(codes))
    key = np.zeros(len(codes), np.int64)
    for f, n in enumerate(sizes):
        key = key * n + codes[:, f]
    _, first, cell = np.unique(key, return_index=True, return_inverse=True)
    return codes[first], cell


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(float)


def _source(t: pa.Table, features: list[str], spec: Spec):
    """Of a group's rows: what gives a source of so many models, the edges, and the number of rows."""
    x = [numbers(t, f) for f in features]
    edges = [cuts_of(v, spec.bins) for v in x]
    codes, sizes = digits(x, edges), tuple(len(e) + 1 for e in edges)
    y, h = numbers(t, "y") == 1, t.column("h").to_numpy()
    w = numbers(t, "w") if "w" in t.column_names else None
    grid = len(y) > FEW_ROWS and np.prod([float(n) for n in sizes]) <= min(GRID, 16 * len(y))
    if (spec.boost or spec.adaptive) and not grid:
        order = np.lexsort([y, *codes.T[::-1], h])  # sums in one order
        w = np.ones(len(y)) if w is None else w
        return (lambda models: Local(codes[order], y[order].astype(float), w[order], h[order], spec, models)), edges, len(y)
    if w is not None:
        order = np.lexsort([w, y, *codes.T[::-1], h])
        codes, y, h, w = codes[order], y[order], h[order], w[order]
    rows = Rows(*cells_of(codes, sizes), y, w, h, sizes)
    if spec.boost or spec.adaptive or spec.splits is not None and grid:
        return (lambda models: Grid(rows, spec, models)), edges, len(y)
    return (lambda models: Cells(rows, spec, models)), edges, len(y)


def _packed(train: DataFrame, keys: list[str], features: list[str], row: str, spec: Spec, y: str, weight: Column | None) -> DataFrame:
    own = [finite(x).alias(f"__x{i}") for i, x in enumerate(features)]
    return train.select(*keys, *own, (F.col(y) == 1).cast("double").alias("y"), *([weight.cast("double").alias("w")] if weight is not None else []), row_hash(row, spec.seed).alias("h"))


def _sizes(train: DataFrame, keys: list[str], features: list[str], one_task: int | None) -> tuple[DataFrame, int]:
    """keys and __n, the rows of each group; and how many a task takes."""
    most = ONE_TASK // max(1, len(features)) if one_task is None else one_task
    return durable(train.groupBy(*keys).agg(F.count("*").alias("__n"))), most


def fit(train: DataFrame, keys: list[str], features: list[str], row: str, spec: Spec, y: str = "occ", weight: Column | None = None, one_task: int | None = None) -> DataFrame:
    """keys and the columns of TREE: a row for each tree of each group's model. Values of trees are ready to be added up: shares of a probability, or steps of a log-odds from base on."""
    train = train.na.drop(subset=keys)
    sizes, most = _sizes(train, keys, features, one_task)
    kinds = dict(train.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), TREE])
    names = [f"__x{i}" for i in range(len(features))]

    def one(t: pa.Table) -> pa.Table:
        source, edges, n = _source(t, names, spec)
        trees, base = grown(source, spec, n, len(names), edges)
        head = {k: t.column(k).take(np.zeros(len(trees), np.int64)) for k in keys}
        return pa.table({**head, "tree": pa.array(range(len(trees)), pa.int32()), **{f: pa.array([x[f] for x in trees], kind) for f, kind in zip(FIELDS, KINDS, strict=True)}, "base": pa.array([base] * len(trees), pa.float64())})

    # groups are few bytes and much work: partitions of a set number are not merged for being small
    parts = 4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = sizes.where(F.col("__n") > most).collect()  # few, as each of them has more rows than that
    small = train.join(sizes.where(F.col("__n") <= most).select(*keys), keys, "left_semi") if large else train
    found = _packed(small, keys, features, row, spec, y, weight).repartition(parts, *keys).groupBy(*keys).applyInArrow(one, schema)
    if large:
        edges = durable(edges_of(train.join(sizes.where(F.col("__n") > most).select(*keys), keys, "left_semi"), keys, features, spec.bins))
        code = lambda i, x: F.unhex(F.lpad(F.hex(F.coalesce(F.size(F.filter(F.get("__e", F.lit(i)), lambda e: e < finite(x))), F.lit(0))), 2, "0"))
        rows = train.join(edges, keys).select(*keys, F.concat(*[code(i, x) for i, x in enumerate(features)]).alias("codes"), (F.col(y) == 1).cast("double").alias("y"), (weight if weight is not None else d(1)).alias("w"), row_hash(row, spec.seed).alias("h"))
        of = {tuple(r[k] for k in keys): r["__e"] for r in edges.collect()}
    for g in large:
        own = rows
        for k in keys:
            own = own.where(F.col(k) == F.lit(g[k]))
        own = durable(own.select("codes", "y", "w", "h"))
        trees, base = grown(lambda models, own=own: Spread(own, spec, models), spec, g["__n"], len(features), [np.asarray(e) for e in of[tuple(g[k] for k in keys)]])
        found = found.unionByName(train.sparkSession.createDataFrame([(*[g[k] for k in keys], i, *[x[f] for f in FIELDS], base) for i, x in enumerate(trees)], schema))
    return durable(found)


def scored(x: np.ndarray, trees: pd.DataFrame) -> np.ndarray:
    """The base plus the values of the leaves that rows of x end in."""
    out, rows = np.full(len(x), float(trees["base"].iloc[0])), np.arange(len(x))
    for feature, at, left, right, value in zip(*(trees[f] for f in FIELDS[:5]), strict=True):
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            if (f < 0).all():
                break
            node = np.where(f < 0, node, np.where(x[rows, np.maximum(f, 0)] > at[node], right[node], left[node]))
        out += value[node]
    return out


def chunked(rows: DataFrame, model: DataFrame, keys: list[str], chunk: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Both with column __chunk: rows of a group are dealt into parts of about so many, and its model goes to each, so that neither is joined row by row."""
    parts = durable(rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("__parts")))
    a = rows.join(parts, keys).withColumn("__chunk", F.floor(F.rand(SEED) * F.col("__parts")).cast("int")).drop("__parts")
    b = model.join(parts, keys).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    # columns of their own, where both come from one table
    return a, b.select(*[F.col(f"`{c}`").alias(c) for c in b.columns])


def matrix(t: pd.DataFrame, features: list[str]) -> np.ndarray:
    x = t[features].to_numpy(float)
    return np.where(np.isfinite(x), x, -np.inf)


def apply(model: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, spec: Spec) -> DataFrame:
    """keys, row, p of all rows of test whose group has a model."""
    t, m = chunked(test.select(*dict.fromkeys([*keys, row, *features])), model, keys)
    kinds = dict(test.dtypes)

    def score(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, row]].copy()
        # trees in their order, so that sums are the same in every run
        z = scored(matrix(rows, features), of.sort_values("tree")) if len(of) else np.full(len(rows), np.nan)
        out["p"] = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if spec.boost or spec.adaptive else z
        return out if len(of) else out.iloc[:0]

    by = [*keys, "__chunk"]
    return t.groupBy(*by).cogroup(m.groupBy(*by)).applyInPandas(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"`{row}` {kinds[row]}", "p double"]))


#: Settings of models: those of the protocol, where it has any; trees without limit of depth are cut at DEPTH levels.
DEPTH = 12
SPECS = {
    "decision-tree": Spec(depth=5),
    "random-forest-mllib": Spec(trees=100, depth=5, draw="poisson", features=-1),
    "random-forest": Spec(trees=1000, depth=DEPTH, draw="balanced", features=-1),
    "extra-trees": Spec(trees=1000, depth=DEPTH, extra=True, features=-1),
    "gradient-boosting": Spec(trees=50, depth=5, boost=True, rate=0.1),
    "adaboost": Spec(trees=50, depth=1, adaptive=True, leaf=1e-6),
    "brt": Spec(trees=10_000, splits=5, boost=True, rate=0.001, folds=5, draw="bag", leaf=10.0),
}


def _leaf_values(trees: list[dict], edges: list, codes: np.ndarray) -> np.ndarray:
    """Sums of the values of leaves that codes (cell, feature) end in, tree after tree."""
    flat, base, out = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.zeros(len(codes))
    for t in trees:
        feature, left = np.asarray(t["feature"]), np.asarray(t["left"])
        leaf = feature < 0
        # a leaf leads to itself; the right side of a node follows its left side
        cut = np.full(len(feature), 255, np.uint8)
        for f, e in enumerate(edges):
            at = feature == f
            cut[at] = np.searchsorted(e, np.asarray(t["threshold"])[at])
        left, feature = np.where(leaf, np.arange(len(feature)), left), np.maximum(feature, 0)
        node = np.zeros(len(codes), np.int64)
        while not leaf[node].all():
            node = left[node] + (flat[base + feature[node]] > cut[node])
        out += np.asarray(t["value"])[node]
    return out


def _forest_values(forest: Forest, codes: np.ndarray, scale: float) -> np.ndarray:
    """_leaf_values() of trees as they are grown."""
    flat, base, out = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.zeros(len(codes))
    for m in range(len(forest.used)):
        n = int(forest.used[m])
        feature = forest.feature[m, :n]
        leaf = feature < 0
        left, cut = np.where(leaf, np.arange(n), forest.left[m, :n]), np.where(leaf, 255, forest.cut[m, :n]).astype(np.uint8)
        feature, node = np.maximum(feature, 0).astype(np.int64), np.zeros(len(codes), np.int64)
        for _ in range(int(forest.level[m, :n].max())):
            node = left[node] + (flat[base + feature[node]] > cut[node])
        out += (forest.value[m, :n] * scale)[node]
    return out


def fit_predict(name: str, train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, y: str = "occ", one_task: int | None = None, **options) -> DataFrame:
    """keys, row, p by a model of SPECS. Boosted regression trees split once where a group has fewer than 50 presences, else five times, and weigh background to the presences' sum.

    Where a task takes a group, its model scores the test rows there and is never written."""
    spec = SPECS[name]._replace(**options)
    if spec.features == -1:  # the usual root
        spec = spec._replace(features=max(1, int(len(features) ** 0.5)))
    weight = None
    if name == "brt":
        n = train.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("__p"), F.count_if(F.col(y) != 1).alias("__b"))
        train = train.join(durable(n), keys)
        weight = F.when((F.col(y) == 1) | (F.col("__p") == 0), d(1)).otherwise(F.col("__p") / F.col("__b"))
    sizes, most = _sizes(train, keys, features, one_task)
    asked = sizes.join(test.groupBy(*keys).agg(F.count("*").alias("__asked")), keys)
    fits = (F.col("__n") <= most) & (F.col("__asked") <= most)
    kinds = dict(test.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"`{row}` {kinds[row]}", "p double"])
    names = [f"__x{i}" for i in range(len(features))]

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        own = spec._replace(splits=1) if name == "brt" and numbers(a, "y").sum() < 50 else spec
        source, edges, n = _source(a, names, own)
        codes, cell = cells_of(digits([numbers(b, f) for f in names], edges), tuple(len(e) + 1 for e in edges))
        if own.boost or own.adaptive:
            trees, base = grown(source, own, n, len(names), edges)
            p = 1 / (1 + np.exp(-np.clip(base + _leaf_values(trees, edges, codes), -500, 500)))
        else:
            p = sum(_forest_values(f, codes, 1 / own.trees) for f in planted(source, own, n, len(names)))
        return pa.table([*(b.column(k) for k in keys), b.column(row), pa.array(p[cell])], [*keys, row, "p"])

    parts = 4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = asked.where(fits).select(*keys)
    a = _packed(train, keys, features, row, spec, y, weight).join(groups, keys, "left_semi").repartition(parts, *keys)
    # columns of their own, where both come from one table
    b = test.select(*[F.col(f"`{c}`").alias(c) for c in [*keys, row]], *[finite(x).alias(n) for n, x in zip(names, features, strict=True)]).join(groups, keys, "left_semi").repartition(parts, *keys)
    out = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(one, schema)
    rest = asked.where(~fits).select(*keys)
    if rest.isEmpty():
        return out
    train = train.join(rest, keys, "left_semi")
    for few in (True, False) if name == "brt" else (None,):
        part, t = (spec, train) if few is None else (spec._replace(splits=1 if few else spec.splits), train.where((F.col("__p") < 50) == few))
        out = out.unionByName(apply(fit(t, keys, features, row, part, y, weight, one_task), test, keys, features, row, part))
    return out
