import math
from fractions import Fraction

import numpy as np

from faunaflux.llm import whitening

SF = "/root/testdata/sf0.001"
CLASH = ", _id string, v int, d int, x int, n int, c int, component int, whitened int, deviation int, explained int, __v int, __d int, mean int, products int"
ODD = ("i", *range(13))


def brute(vectors, components=16):
    """n, sums, covariance over the distinct whole vectors, as fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(r[k] for r in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n for j in range(d)] for i in range(d)]
    return x, n, sums, cov


def test_odd_rows_equal_brute_force(spark, table):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=6) * [5, 1, 1, 3, 0.1, 20]).tolist()) for i in range(80)]
    good += [(3, good[3][1])] * 40 + [(None, good[4][1])] * 2 + [(None, [0.0] * 6)]
    odd = [(90, None), (91, []), (92, [1.0] * 5 + [None]), (93, [float("nan")] * 6), (94, [1.0] * 5 + [float("-inf")])]
    d = table([(*r, *ODD) for r in good + odd], "vec_id long, embedding array<double>" + CLASH, "embeddings")
    got = whitening.op13_whitening(spark, d).collect()
    x, n, sums, cov = brute([v for _, v in good])
    assert len(got) == len(good) * 6 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 7))
    want = sorted(((i is None, i or 0), sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _), r in zip(good, x))
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.deviation) for r in got if r.component == 1) == want
    value, vector = np.linalg.eigh(np.array(cov, float))
    value, vector = value[::-1], vector[:, ::-1]
    plain = ((np.array(x, float) - np.array(sums, float) / n) @ vector) / np.sqrt(value)
    for c in range(6):
        mine = sorted((r.vec_id is None, r.vec_id or 0, abs(r.whitened)) for r in got if r.component == c + 1)
        theirs = sorted((i is None, i or 0, abs(w)) for (i, _), w in zip(good, plain[:, c]))
        assert np.allclose([m[2] for m in mine], [t[2] for t in theirs], atol=1e-8)
        assert abs(next(r.explained for r in got if r.component == c + 1) / (value[c] / value.sum()) - 1) < 1e-9
    assert max(r.identity_error for r in got) < 1e-10


def test_slices_are_exact_for_any_width():
    rng = np.random.default_rng(5)
    for bits in (3, 19, 20, 40, 61, 90):
        z = np.array([[int(v) * (1 << max(0, bits - 30)) - 1 for v in r] for r in rng.integers(-(1 << min(bits, 30)), 1 << min(bits, 30), size=(50, 4))], object)
        z = z.astype(np.int64) if bits < 62 else z
        back = sum(np.vectorize(int, otypes=[object])(s) << (whitening.LIMB * k) for k, s in enumerate(whitening.slices(z)))
        assert back.tolist() == z.astype(object).tolist()
        want = z.astype(object).T.dot(z.astype(object))
        assert (whitening.products(z) == want).all()


def test_a_wide_spread_of_variances(spark):
    """Scales from 1 to 1e6 around a far mean: plain double products would lose the small ones."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 5)) @ np.linalg.qr(rng.normal(size=(5, 5)))[0] * [1, 10, 1e3, 1e5, 1e6] + 1e9
    w = whitening.fit(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"))
    assert len(w.values) == 5 and w.identity_error < 1e-4
    _, _, _, cov = brute(v.tolist())
    cov = np.array(cov, np.longdouble)
    residual = cov @ w.vectors.astype(np.longdouble) - w.vectors * w.values
    assert np.abs(residual).max() < 1e-14 * w.values[0]


def test_directions_without_variance_and_empty_tables(spark, table):
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    d = table(flat, "vec_id long, embedding array<double>", "embeddings")
    got = whitening.op13_whitening(spark, d)
    assert {r.component for r in got.collect()} == {1} and got.count() == 20
    for rows in ([], [(1, [1.0, 2.0])] * 5):
        d = table(rows, "vec_id long, embedding array<double>", "embeddings")
        none = whitening.op13_whitening(spark, d)
        assert none.columns == got.columns and not none.collect()


def test_huge_components(spark):
    rows = [(i, [1e300 if i == 0 else -1e25 * i, float(i)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w = whitening.fit(frame)
    assert w.n == 12 and len(w.values) >= 1
    assert whitening.whiten(frame, w).where("deviation is null").count() > 0
