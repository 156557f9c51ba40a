"""Distribution functions that Spark lacks, in plain Python; used on one row per comparison, never on data rows."""

from __future__ import annotations

import math
from functools import lru_cache


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, dd = 1.0, 1 - (a + b) * x / (a + 1)
    dd = 1 / (dd if abs(dd) > tiny else tiny)
    value = dd
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            dd = 1 + num * dd
            dd = 1 / (dd if abs(dd) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * dd
            value *= step
        if abs(step - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: int) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=4096)
def t_critical(df: int, confidence: float = 0.95) -> float:
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - confidence:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - confidence else (low, mid)
    return (low + high) / 2


def wilcoxon_p(differences: list[float], exact_up_to: int = 50) -> tuple[float | None, float | None]:
    """W and its two-sided p. Zeros go; exact for small samples without ties, else the normal approximation with tie correction and no continuity correction."""
    x = [v for v in differences if v]
    n = len(x)
    if not n:
        return None, None
    order = sorted(range(n), key=lambda i: abs(x[i]))
    ranks, ties, i = [0.0] * n, 0.0, 0
    while i < n:
        j = i
        while j + 1 < n and abs(x[order[j + 1]]) == abs(x[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus = sum(r for r, v in zip(ranks, x, strict=True) if v > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if not ties and n == len(differences) and n <= exact_up_to:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return w, math.erfc(abs(z) / math.sqrt(2))


def paired_t_p(differences: list[float]) -> float | None:
    n = len(differences)
    if n < 2:
        return None
    mean = sum(differences) / n
    var = sum((v - mean) ** 2 for v in differences) / (n - 1)
    return t_two_sided(mean / math.sqrt(var / n), n - 1) if var > 0 else None
