"""Learners of grouped fits: support vectors with a Gaussian kernel or none, maximum entropy with L1 penalties, additive models of splines.

Each gives one array for a group, which holds what prediction needs. x: (row, feature), y: 0 or 1, w: weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SEED, d
from . import grouped

RIDGE = 1e-9


def expit(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _filled(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), mean, x)


class Svm:
    """Squared hinge and ridge by Newton steps, on z-scores or on cosines of random projections of them, whose products approach the kernel exp(-gamma |a - b|^2) as they get more
    (gamma 1 / features: "scale" for z-scores). p is a sigmoid of the margin, as no calibration is part of the fit."""

    def __init__(self, c: float = 1.0, kernel: bool = True, cosines: int = 256, seed: int = SEED, rounds: int = 50):
        self.c, self.kernel, self.cosines, self.seed, self.rounds = c, kernel, cosines, seed, rounds

    def projections(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same in every group and process."""
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(width, self.cosines)) * np.sqrt(2 / width), rng.uniform(0, 2 * np.pi, self.cosines)

    def features(self, z: np.ndarray) -> np.ndarray:
        if not self.kernel:
            return z
        a, b = self.projections(z.shape[1])
        return np.cos(z @ a + b) * np.sqrt(2 / self.cosines)

    def design(self, x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
        z = np.where(sd > 0, (_filled(x, mean) - mean) / np.where(sd > 0, sd, 1), 0)
        return np.column_stack([np.ones(len(x)), self.features(z)])

    def fit(self, data) -> np.ndarray:
        mean, sd = data.info.mean, data.info.sd
        n = 1 + (self.cosines if self.kernel else len(mean))
        beta, ridge = np.zeros(n), np.r_[RIDGE, np.ones(n - 1)]

        def loss(b):
            def of(x, y, w):
                gap = np.maximum(1 - (2 * y - 1) * (self.design(x, mean, sd) @ b), 0)
                return np.array([(w * gap * gap).sum()])

            return self.c * data.total(of)[0] + (ridge * b * b).sum() / 2

        value = loss(beta)
        for _ in range(self.rounds):

            def of(x, y, w, beta=beta):
                f, s = self.design(x, mean, sd), 2 * y - 1
                gap = 1 - s * (f @ beta)
                inside = w * (gap > 0)
                return np.column_stack([f.T @ (f * inside[:, None]), f.T @ (inside * gap * s)])

            t = data.total(of)
            step = np.linalg.solve(2 * self.c * t[:, :-1] + np.diag(ridge), 2 * self.c * t[:, -1] - ridge * beta)
            scale = 1.0
            while scale > 1e-6 and loss(beta + scale * step) > value:
                scale /= 2
            beta = beta + scale * step
            before, value = value, loss(beta)
            if before - value <= 1e-12 * max(1.0, abs(before)):
                break
        return np.r_[mean, sd, beta]

    def margin(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        k = x.shape[1]
        return self.design(x, model[:k], model[k : 2 * k]) @ model[2 * k :]

    def predict(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        return expit(self.margin(model, x))


#: Fixed values of the published defaults: penalties of kinds of features by number of presences.
LINEAR = ((0, 10, 30, 100), (1, 1, 0.2, 0.05))
QUADRATIC = ((0, 10, 17, 30, 100), (1.3, 0.8, 0.5, 0.25, 0.05))
PRODUCT = ((0, 10, 17, 30, 100), (2.6, 1.6, 0.9, 0.55, 0.05))
HINGE = ((0, 1), (0.5, 0.5))
THRESHOLD = ((0, 100), (2, 1))
KNOTS = 50
BACKGROUND = 100.0  # weight of a background row


class Maxnet:
    """Maximum entropy as logistic regression with weights of 100 for background, presences counted among it: linear, quadratic, product, hinge and threshold features, each with an L1
    penalty of its own. Proximal Newton steps over a falling series of penalties: a step's sums come from the rows, coordinates move on the sums alone. p is the complementary log-log."""

    def __init__(self, classes: str = "lqpht", multiplier: float = 1.0, series: tuple[float, ...] = (64.0, 16.0, 4.0, 2.0, 1.0), rounds: int = 30):
        self.classes, self.multiplier, self.series, self.rounds = classes, multiplier, series, rounds

    def expand(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k, parts = x.shape[1], []
        if "l" in self.classes:
            parts.append(x)
        if "q" in self.classes:
            parts.append(x * x)
        if "p" in self.classes:
            parts += [x[:, i : i + 1] * x[:, i + 1 :] for i in range(k - 1)]
        wide = np.where(high > low, high - low, 1)
        z = ((x - low) / wide)[:, :, None]
        if "h" in self.classes:
            at = np.linspace(0, 1, KNOTS)
            parts.append(np.clip((z - at[:-1]) / (1 - at[:-1]), 0, 1).reshape(len(x), -1))
            parts.append(np.clip((at[1:] - z) / at[1:], 0, 1).reshape(len(x), -1))
        if "t" in self.classes:
            at = np.linspace(0, 1, KNOTS + 2)[1:-1]
            parts.append((z > at).reshape(len(x), -1).astype(float))
        return np.concatenate(parts, 1)

    def kinds(self, k: int) -> np.ndarray:
        count = {"l": k, "q": k, "p": k * (k - 1) // 2, "h": 2 * k * (KNOTS - 1), "t": k * KNOTS}
        return np.concatenate([[c] * count[c] for c in "lqpht" if c in self.classes])

    def fit(self, data) -> np.ndarray:
        info = data.info
        low, high = info.low, info.high
        ends = data.total(lambda x, y, w: np.stack([(f := self.expand(x, low, high)).max(0), (-f).max(0)]), greatest=True)
        least, wide = -ends[1], ends[0] + ends[1]
        wide = np.where(wide > 0, wide, 1)
        pieces = Pieces(self, low, high, least, wide)
        scaled = lambda x: np.column_stack([np.ones(len(x)), (self.expand(x, low, high) - least) / wide])
        moments = data.total(lambda x, y, w: np.stack([(f := scaled(x)[y == 1]).sum(0), (f * f).sum(0)]))[:, 1:]
        penalty = np.r_[0, self.penalties(moments, info.presences)]
        beta = np.zeros(len(penalty))
        beta[0] = np.log(max(info.presences, 1) / (BACKGROUND * max(info.presences + info.background, 1)))

        def loss(b, pen):
            def of(x, y, w):
                z = pieces.score(x, b)
                soft = np.logaddexp(0, z)
                return np.array([(y * (soft - z) + BACKGROUND * soft).sum()])

            return data.total(of)[0] + (pen * np.abs(b)).sum()

        for times in self.series:
            pen = penalty * times * self.multiplier
            value = loss(beta, pen)
            for _ in range(self.rounds):

                def of(x, y, w, beta=beta):
                    p = expit(pieces.score(x, beta))
                    return pieces.gram(x, (y + BACKGROUND) * p * (1 - p), y - (y + BACKGROUND) * p)

                t = pieces.lift(data.total(of))
                hess, grad = t[:, :-1] + np.diag(np.full(len(beta), 1e-10)), t[:, -1]
                if kkt(beta, grad, pen) <= 1e-7 * max(info.presences, 1):
                    break
                step = descend(hess, grad, beta, pen) - beta
                scale = 1.0
                while scale > 1e-6 and (now := loss(beta + scale * step, pen)) > value:
                    scale /= 2
                if scale <= 1e-6:
                    break
                beta, value = beta + scale * step, now
        # over all of the background: the log of the sum of exponentials, and the entropy of their shares
        ends = data.total(lambda x, y, w: np.array([pieces.score(x, beta).max()]), greatest=True)[0]
        parts = data.total(lambda x, y, w: np.array([(e := np.exp((z := pieces.score(x, beta)) - ends)).sum(), (e * z).sum()]))
        log_sum = ends + np.log(parts[0])
        entropy = log_sum - parts[1] / parts[0]
        return np.r_[low, high, info.mean, least, wide, beta, log_sum, entropy]

    def penalties(self, moments: np.ndarray, n: float) -> np.ndarray:
        """n x the published default of each feature, features scaled to [0, 1]. moments: sums and squares over presences."""
        k = self.kinds_cache(moments.shape[1])
        n = max(n, 1.0)
        base = PRODUCT if "p" in self.classes else QUADRATIC if "q" in self.classes else LINEAR
        mean = moments[0] / n
        sd = np.sqrt(np.maximum(moments[1] - n * mean * mean, 0) / max(n - 1, 1))
        at = lambda table: np.interp(n, *table) / np.sqrt(n)
        out = np.maximum(0.001, sd * np.select([k == "h", k == "t"], [at(HINGE), at(THRESHOLD)], at(base)))
        out = np.where(k == "h", np.maximum(out, np.maximum(sd, 1 / np.sqrt(n)) * 0.5 / np.sqrt(n)), out)
        never = (moments[0] <= 0) | (moments[0] >= n)
        return n * np.where((k == "t") & never, np.maximum(out, 1.0), out)

    def kinds_cache(self, size: int) -> np.ndarray:
        k = 1
        while len(self.kinds(k)) < size:
            k += 1
        return self.kinds(k)

    def parts(self, model: np.ndarray, k: int) -> tuple:
        n = len(self.kinds(k))
        at = np.cumsum([0, k, k, k, n, n, n + 1, 1, 1])
        return tuple(model[a:b] for a, b in zip(at, at[1:], strict=False))

    def design(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        low, high, mean, least, wide, *_ = self.parts(model, x.shape[1])
        return np.column_stack([np.ones(len(x)), (self.expand(_filled(x, mean), low, high) - least) / wide])

    def predict(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        *_, beta, log_sum, entropy = self.parts(model, x.shape[1])
        return 1 - np.exp(-np.exp(np.clip(self.design(model, x) @ beta - log_sum[0] + entropy[0], -700, 30)))


class Pieces:
    """Scores and Gram matrices of Maxnet's scaled features (the intercept first) without the features.

    Between the knots of one variable, hinges and thresholds are straight lines in it: they are combinations of a one and the variable in each interval, and linear, quadratic and
    product features of those themselves. A row has a few of such pieces that are not 0, so sums over pairs of intervals stand for the products of hundreds of features."""

    def __init__(self, learner: Maxnet, low: np.ndarray, high: np.ndarray, least: np.ndarray, wide: np.ndarray):
        self.learner, self.low, self.wide, k = learner, low, np.where(high > low, high - low, 1), len(low)
        self.knots = np.unique(np.r_[np.linspace(0, 1, KNOTS), np.linspace(0, 1, KNOTS + 2)[1:-1]])
        self.knots = self.knots[np.r_[True, np.diff(self.knots) > 1e-12]][1:-1]
        self.n = len(self.knots) + 1
        kinds = learner.kinds(k)
        self.smooth = np.flatnonzero(np.isin(kinds, ["l", "q", "p"]))
        self.plain = len(self.smooth) + 1
        # columns: one, smooth features, and of each variable and interval a one and the variable
        self.to = np.zeros((self.plain + 2 * k * self.n, len(kinds) + 1))
        self.to[0, 0] = 1.0
        self.to[1 + np.arange(len(self.smooth)), 1 + self.smooth] = 1.0
        ends = np.r_[0.0, self.knots, 1.0]
        at = ends[:-1] + np.diff(ends) / np.array([[3.0], [1.5]])
        values = [learner.expand(low + self.wide * z[:, None], low, high) for z in at]
        slope = (values[1] - values[0]) / (at[1] - at[0])[:, None]
        start = values[0] - slope * at[0][:, None]
        count = {c: int((kinds == c).sum()) // k for c in "ht"}
        first = len(self.smooth)
        for c, times in (("h", 2), ("t", 1)):
            each = count[c] // times
            for _ in range(times):
                for i in range(k if each else 0):
                    f, row = slice(first + i * each, first + (i + 1) * each), self.plain + 2 * i * self.n
                    self.to[row : row + self.n, 1 + f.start : 1 + f.stop] = start[:, f]
                    self.to[row + self.n : row + 2 * self.n, 1 + f.start : 1 + f.stop] = slope[:, f]
                first += k * each
        self.to[:, 1:] /= wide
        self.to[0, 1:] -= least / wide

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One and smooth features (row, column); variables between 0 and 1, and their intervals."""
        z = (x - self.low) / self.wide
        smooth = Maxnet("".join(c for c in self.learner.classes if c in "lqp"))
        plain = np.column_stack([np.ones(len(x)), smooth.expand(x, self.low, self.low)]) if smooth.classes else np.ones((len(x), 1))
        return plain, z, np.stack([np.searchsorted(self.knots, v) for v in z.T])

    def score(self, x: np.ndarray, beta: np.ndarray) -> np.ndarray:
        plain, z, at = self.parts(x)
        b = self.to @ beta
        out = plain @ b[: self.plain]
        for i, j in enumerate(at):
            own = b[self.plain + 2 * i * self.n :]
            out += own[: self.n].take(j) + own[self.n : 2 * self.n].take(j) * z[:, i]
        return out

    def gram(self, x: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        """(piece, piece + 1): sums of products, weighed by v, and of pieces times r; see lift()."""
        plain, z, at = self.parts(x)
        n, p = self.n, self.plain
        g, right = np.zeros((len(self.to),) * 2), np.zeros(len(self.to))
        weighed = plain * v[:, None]
        g[:p, :p], right[:p] = plain.T @ weighed, plain.T @ r
        for i, a in enumerate(at):
            row = p + 2 * i * n
            one, var = slice(row, row + n), slice(row + n, row + 2 * n)
            count = lambda w, key=a: np.bincount(key, w, n)
            right[one], right[var] = count(r), count(r * z[:, i])
            for c in range(p):
                g[c, one], g[c, var] = count(weighed[:, c]), count(weighed[:, c] * z[:, i])
            for j in range(i + 1):
                col, key = p + 2 * j * n, a * n + at[j]
                for s, left in enumerate((v, v * z[:, i])):
                    for t, w in enumerate((left, left * z[:, j])):
                        g[row + s * n : row + (s + 1) * n, col + t * n : col + (t + 1) * n] = np.bincount(key, w, n * n).reshape(n, n)
        g[p:, :p] = g[:p, p:].T
        for i in range(len(at)):
            for j in range(i):
                a, b = slice(p + 2 * i * n, p + 2 * (i + 1) * n), slice(p + 2 * j * n, p + 2 * (j + 1) * n)
                g[b, a] = g[a, b].T
        return np.column_stack([g, right])

    def lift(self, total: np.ndarray) -> np.ndarray:
        """(feature, feature + 1) of the pieces' sums."""
        return np.column_stack([self.to.T @ total[:, :-1] @ self.to, self.to.T @ total[:, -1]])


def kkt(beta: np.ndarray, grad: np.ndarray, penalty: np.ndarray) -> float:
    """How far the gradient of the likelihood is from what the penalties allow."""
    return float(np.where(beta != 0, np.abs(grad - penalty * np.sign(beta)), np.maximum(np.abs(grad) - penalty, 0)).max())


def descend(hess: np.ndarray, grad: np.ndarray, start: np.ndarray, penalty: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """The least of the quadratic around start plus penalties, coordinate by coordinate; those that are not 0 or pull at 0 are swept until they rest, then all are looked at."""
    beta, left = start.copy(), grad.copy()
    diag = np.diag(hess)
    for _ in range(50):
        active = np.flatnonzero((beta != 0) | (np.abs(left) > penalty * (1 + 1e-12)))
        for _ in range(sweeps):
            most = 0.0
            for j in active:
                pull = left[j] + diag[j] * beta[j]
                new = np.sign(pull) * max(abs(pull) - penalty[j], 0.0) / diag[j]
                move = new - beta[j]
                if move:
                    left -= hess[:, j] * move
                    beta[j] = new
                    most = max(most, move * move * diag[j])
            if most < 1e-14:
                break
        if kkt(beta, left, penalty) <= 1e-9 * max(1.0, float(penalty.max())):
            break
    return beta


class Gam:
    """Logistic additive model: a cubic B-spline of each feature with a penalty on second differences, by iterated weighted least squares. Smoothness is chosen in each iteration by
    generalised cross-validation, feature by feature, from the same sums. A feature of fewer than three distinct values (a range of 0) adds nothing."""

    def __init__(self, k: int = 10, rounds: int = 40, grid: tuple[float, ...] = tuple(10.0**e for e in range(-4, 9))):
        self.k, self.rounds, self.grid = k, rounds, grid

    def basis(self, z: np.ndarray) -> np.ndarray:
        """k cubic B-splines of evenly spaced knots over [0, 1]; beyond it they go on in straight lines."""
        inside = np.clip(z, 0, 1)
        segments = self.k - 3
        u = inside * segments
        at = np.minimum(np.floor(u), segments - 1).astype(int)
        t = u - at
        pieces = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6
        slopes = np.stack([-((1 - t) ** 2), 3 * t**2 - 4 * t, -3 * t**2 + 2 * t + 1, t**2]) / 2 * segments * (z - inside)
        out = np.zeros((len(z), self.k))
        for i in range(4):
            out[np.arange(len(z)), at + i] = pieces[i] + slopes[i]
        return out

    def design(self, x: np.ndarray, info) -> np.ndarray:
        mean, low, high = info
        z = np.where(high > low, (_filled(x, mean) - low) / np.where(high > low, high - low, 1), 0.5)
        # each feature's splines sum to one: the last one is left out, for the intercept
        return np.column_stack([np.ones(len(x)), *[self.basis(z[:, i])[:, :-1] - self.basis(np.array([0.5]))[:, :-1] for i in range(x.shape[1])]])

    def penalty(self, features: int) -> np.ndarray:
        """(feature, coefficient, coefficient): sums of squared second differences, the last coefficient 0."""
        m = self.k - 1
        diff = np.diff(np.eye(self.k), 2, axis=0)[:, :-1]
        out = np.zeros((features, 1 + features * m, 1 + features * m))
        for i in range(features):
            out[i, 1 + i * m : 1 + (i + 1) * m, 1 + i * m : 1 + (i + 1) * m] = diff.T @ diff
        return out

    def fit(self, data) -> np.ndarray:
        info = data.info
        ends = (info.mean, info.low, info.high)
        n, pen = len(info.mean), self.penalty(len(info.mean))
        p = pen.shape[1]
        beta, strength = np.zeros(p), np.ones(n)
        settled = False
        for r in range(self.rounds):

            def of(x, y, w, beta=beta):
                f = self.design(x, ends)
                z = np.clip(f @ beta, -30, 30)
                q = expit(z)
                v = np.maximum(w * q * (1 - q), 1e-12)
                work = z + (y - q) * w / v
                g = np.column_stack([f, work])
                return np.vstack([g.T @ (g * v[:, None]), np.r_[len(y), np.zeros(p)][None]])

            t = data.total(of)
            gram, right, square, rows = t[:p, :p], t[:p, p], t[p, p], t[p + 1, 0]
            ridge = np.eye(p) * 1e-8 * max(np.trace(gram) / p, 1e-12)

            def solve(s, gram=gram, right=right, ridge=ridge):
                return np.linalg.solve(gram + np.tensordot(s, pen, 1) + ridge, np.column_stack([right, gram]))

            def score(s, gram=gram, right=right, square=square, rows=rows):
                x = solve(s)
                b, edf = x[:, 0], np.trace(x[:, 1:])
                return rows * max(square - 2 * b @ right + b @ gram @ b, 0) / max(rows - edf, 1) ** 2

            # smoothness is settled after a few rounds, so that the last ones converge
            if r < self.rounds // 4:
                for i in range(n):
                    strength[i] = min(self.grid, key=lambda v, i=i: (score(np.r_[strength[:i], v, strength[i + 1 :]]), -v))
            new = solve(strength)[:, 0]
            move = np.abs(new - beta).max()
            beta = new
            settled = settled or r >= self.rounds // 4
            if settled and move <= 1e-9 * max(1.0, np.abs(beta).max()):
                break
        return np.r_[info.mean, info.low, info.high, strength, beta]

    def parts(self, model: np.ndarray, k: int) -> tuple:
        return (model[:k], model[k : 2 * k], model[2 * k : 3 * k]), model[3 * k : 4 * k], model[4 * k :]

    def predict(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        ends, _, beta = self.parts(model, x.shape[1])
        return expit(self.design(x, ends) @ beta)


LEARNERS = {"svm": Svm, "linear-svc": lambda **o: Svm(**({"kernel": False} | o)), "maxnet": Maxnet, "gam": Gam}


def fit_predict(name: str, train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, y: str = "occ", **options) -> DataFrame:
    """keys, row, p by a learner of LEARNERS. The additive model weighs background to the presences' sum."""
    learner = LEARNERS[name](**options)
    weight = None
    if name == "gam":
        n = train.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("__np"), F.count_if(F.col(y) != 1).alias("__nb"))
        train = train.join(n, keys)
        weight = F.when((F.col(y) == 1) | (F.col("__np") == 0), d(1)).otherwise(F.col("__np") / F.col("__nb"))
    return grouped.apply(grouped.fit(train, keys, features, learner, y, weight), test, keys, features, row, learner)
