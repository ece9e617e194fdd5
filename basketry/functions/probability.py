"""Tail probabilities for a handful of test statistics.

Every function takes plain numbers that Spark has already reduced to one row
per test, so nothing here grows with the data.
"""

from __future__ import annotations

import math


def chi_square_one_df(x: float) -> float:
    return math.erfc(math.sqrt(x / 2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"No convergence of the incomplete beta function at a={a}, b={b}, x={x}.")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    return student_t_two_sided(rho * math.sqrt((n - 2) / (1.0 - rho * rho)), n - 2)


def mann_whitney_p(u1: float, n1: int, n2: int, tie_term: float, method: str = "auto") -> float:
    """Two-sided p of U. ``method``: "exact", "normal", or "auto".

    "auto" is the test's usual definition: exact where the smaller group has at
    most 8 members and no value is tied, else normal. The exact tail costs time
    in proportion to the larger group. ``tie_term`` is the sum of t^3 - t over
    tied values.
    """
    if n1 == 0 or n2 == 0:
        return float("nan")
    if method == "exact" or method == "auto" and min(n1, n2) <= 8 and tie_term == 0:
        return _mann_whitney_exact(u1, n1, n2)
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def _partitions(k: int):
    """The number of ways to write n with parts 1, 1, 2, .., k, as a function of n.

    With L a multiple of all parts the generating function is a polynomial over
    (1 - x^L)^(k + 1), so a value is a sum of at most k + 1 binomials, whatever n.
    """
    parts = [1, *range(1, k + 1)]
    step = math.lcm(*parts)
    top = [1] + [0] * (step * len(parts))
    for d in parts:  # times (1 - x^step) / (1 - x^d)
        for i in range(len(top) - 1, step - 1, -1):
            top[i] -= top[i - step]
        for i in range(d, len(top)):
            top[i] += top[i - d]

    def count(n: int) -> int:
        if n < 0:
            return 0
        return sum(top[j] * math.comb((n - j) // step + k, k) for j in range(n % step, min(n, len(top) - 1) + 1, step))

    return count


def _mann_whitney_exact(u1: float, n1: int, n2: int) -> float:
    """Twice the lower tail, in exact integers; memory follows the smaller group alone.

    The counts of U are the coefficients of a Gaussian binomial, the product of
    (1 - x^(large + i)) / (1 - x^i) for i up to the smaller group. Their sums up
    to a place follow from the numerator's 2^small terms and from partitions
    into small parts.
    """
    small, large = min(n1, n2), max(n1, n2)
    # The null counts are symmetric: the upper tail equals the lower one.
    last = int(min(u1, small * large - u1))
    count = _partitions(small)
    terms = {0: 1}  # the numerator, without the powers beyond the last place
    for i in range(1, small + 1):
        for power, sign in list(terms.items()):
            if power + large + i <= last:
                terms[power + large + i] = terms.get(power + large + i, 0) - sign
    tail = sum(sign * count(last - power) for power, sign in terms.items())
    return min(1.0, 2.0 * tail / math.comb(n1 + n2, small))
