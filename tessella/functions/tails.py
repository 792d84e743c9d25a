"""Tail probabilities and exact tests of a few numbers, in plain Python: for results, not for rows."""

from __future__ import annotations

import math
from collections.abc import Sequence


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return tail if t >= 0 else 1 - tail


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_cdf(x / 2, df / 2)


def t_quantile(p: float, df: float) -> float:
    """The t value that a share p lies below."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _binomial(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == (n if p else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_test(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided: the probability of all counts that are no more likely than k."""
    at = _binomial(k, n, p) * (1 + 1e-7)
    return min(1.0, sum(x for x in (_binomial(i, n, p) for i in range(n + 1)) if x <= at))


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact, of the pairs that differ; 1 without any."""
    return binomial_test(min(only_a, only_b), only_a + only_b) if only_a + only_b else 1.0


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a two by two table."""
    row, col, n = a + b, a + c, a + b + c + d

    def p(x: int) -> float:
        return math.exp(sum(math.lgamma(v + 1) for v in (row, n - row, col, n - col)) - math.lgamma(n + 1) - sum(math.lgamma(v + 1) for v in (x, row - x, col - x, n - row - col + x)))

    at = p(a) * (1 + 1e-7)
    return min(1.0, sum(x for x in (p(i) for i in range(max(0, row + col - n), min(row, col) + 1)) if x <= at))


def wilcoxon(differences: Sequence[float]) -> tuple[float, float]:
    """Signed rank statistic (the smaller sum) and two-sided p: exact without ties up to 25 differences, else by the normal distribution. Zeros go."""
    d = [x for x in differences if x]
    n = len(d)
    if not n:
        return 0.0, 1.0
    order = sorted(range(n), key=lambda i: abs(d[i]))
    rank = [0.0] * n
    ties, i = 0.0, 0
    while i < n:
        j = i
        while j + 1 < n and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            rank[order[k]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus = sum(r for r, x in zip(rank, d, strict=True) if x > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if not ties and n <= 25:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return w, min(1.0, 2 * normal_sf(abs(z)))


def paired_t(differences: Sequence[float], test_train: float = 0.0) -> tuple[float, float]:
    """t and two-sided p of paired differences, corrected for overlapping training sets by the ratio of test to training size; NaN below two or without variance."""
    n = len(differences)
    if n < 2:
        return math.nan, math.nan
    mean = sum(differences) / n
    var = sum((x - mean) ** 2 for x in differences) / (n - 1)
    if var == 0:
        return math.nan, math.nan
    t = mean / math.sqrt((1 / n + test_train) * var)
    return t, 2 * t_sf(abs(t), n - 1)


def marker(p: float | None) -> str:
    """Stars of a p value."""
    if p is None or math.isnan(p):
        return "n/a"
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"


def logistic_deviance(x: Sequence[Sequence[float]], y: Sequence[int], rounds: int = 50) -> float:
    """-2 log-likelihood of an unpenalised logistic regression, by Newton's method; a constant column is the caller's."""
    import numpy as np

    a, b = np.asarray(x, float), np.asarray(y, float)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (b - p))
        w += step
        if np.abs(step).max() < 1e-10:
            break
    z = a @ w
    return float(-2 * (b * z - np.logaddexp(0, z)).sum())


def likelihood_ratio(small: float, large: float, added: int) -> tuple[float, float]:
    """Drop of the deviance by so many added columns, and its p."""
    drop = max(0.0, small - large)
    return drop, chi2_sf(drop, added)


def t_quantile(p: float, df: int) -> float:
    """The point below which Student's t lies with probability p, for p of 0.5 or more."""
    low, high = 0.0, 1.0
    while t_sf(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_sf(middle, df) > 1 - p else (low, middle)
    return (low + high) / 2
