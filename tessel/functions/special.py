"""Special functions as Column expressions, and their twins in plain Python for the driver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7 (fixed values).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
NEG_INF = float("-inf")


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def digamma(x: float) -> float:
    """Derivative of ln Gamma, by recurrence and the asymptotic series."""
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def log_of(p: Column) -> Column:
    """ln p with ln 0 = -infinity, where Spark's own gives null."""
    return F.when(p <= 0, F.lit(NEG_INF)).otherwise(F.ln(p))


def log_sum_exp(*terms: Column) -> Column:
    """ln of a sum of exponentials; -infinity where every term is."""
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = sum((F.exp(t - top) for t in terms), F.lit(0.0))
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.ln(total))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution."""
    return 1.0 if x <= 0 else 1 - _gamma_p(df / 2, x / 2)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
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
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def normal_cdf_column(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 7.5e-8 (a rational approximation)."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def _mills(a: float) -> float:
    """(1 - distribution) / density of the standard normal at a >= 0."""
    if a < 25:
        return 0.5 * math.erfc(a / math.sqrt(2)) * math.exp(a * a / 2) * math.sqrt(2 * math.pi)
    s = 1 / (a * a)
    return (1 - s * (1 - 3 * s * (1 - 5 * s * (1 - 7 * s)))) / a


def _mills_polynomial(degree: int = 24) -> list[float]:
    """Coefficients, highest first, of a polynomial in y = 2 t - 1, t = 1 / (1 + a / 2), for Mills' ratio over t."""
    t = (np.cos(np.pi * (np.arange(200) + 0.5) / 200) + 1) / 2
    values = [_mills(2 / u - 2) / u for u in t]
    fitted = np.polynomial.chebyshev.chebfit(2 * t - 1, values, degree)
    return np.polynomial.chebyshev.cheb2poly(fitted)[::-1].tolist()


_MILLS = _mills_polynomial()


def normal_log_cdf_column(x: Column) -> Column:
    """ln of the standard normal distribution function, also where the function itself is no more than 0."""
    a = F.abs(x)
    t = 1 / (1 + a / 2)
    poly = F.lit(_MILLS[0])
    for c in _MILLS[1:]:
        poly = poly * (2 * t - 1) + c
    tail = -a * a / 2 - 0.5 * math.log(2 * math.pi) + F.ln(t * poly)
    return F.when(x < 0, tail).otherwise(F.log1p(-F.exp(tail)))


#: Argument below which `log_bessel` takes its power series, that series' terms, and the corrections of the expansion above.
_FAR, _TERMS, _CORRECTIONS = 24, 44, 9


def _debye(most: int) -> list[list[float]]:
    """Of each correction of the uniform expansion its coefficients of the powers of v = order^2 / r^2, lowest first."""
    u, out = [Fraction(1)], []
    for k in range(most):
        # u_k is t^k times a polynomial in t^2; u_(k+1) = t^2 (1 - t^2) u_k' / 2 + the integral of (1 - 5 t^2) u_k / 8.
        new = [Fraction(0)] * (len(u) + 1)
        for j, c in enumerate(u):
            at = k + 2 * j
            new[j] += c * at / 2 + c / (8 * (at + 1))
            new[j + 1] -= c * at / 2 + 5 * c / (8 * (at + 3))
        u = new
        out.append([float(c) for c in u])
    return out


_DEBYE = _debye(_CORRECTIONS)


def _horner(coefficients: list, x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        total = total * x + c
    return total


def log_bessel(order: Column | int, z: Column) -> Column:
    """ln I(order, z) of the modified Bessel function, order 0, 1, 2 ..., z >= 0, within 1e-10 (relative beyond 1).

    Below 24 by its power series, from there on by the uniform expansion with nine corrections: a fixed
    number of products and sums a row, fewer where the order is a plain number.
    """
    h, s = z * z / 4, F.lit(1.0)
    if isinstance(order, int):
        for m in range(_TERMS, 0, -1):
            s = s * h * (1.0 / (m * (m + order))) + 1.0
        r = F.sqrt(z * z + float(order * order)) if order else z.cast("double")
        start = (order * log_of(z / 2) if order else F.lit(0.0)) - math.lgamma(order + 1)
        lead = r + order * F.ln(z / (order + r)) if order else r
        corrections = [_horner(c, float(order * order) / (r * r)) if order else F.lit(c[0]) for c in _DEBYE]
    else:
        order = order.cast("double")
        for m in range(_TERMS, 0, -1):
            s = s * h / (float(m) * (order + float(m))) + 1.0
        r = F.sqrt(order * order + z * z)
        start = F.when(order > 0, order * log_of(z / 2)).otherwise(0.0) - lgamma(order + 1)
        lead = r + order * F.ln(z / (order + r))
        corrections = [_horner(c, order * order / (r * r)) for c in _DEBYE]
    far = lead - 0.5 * F.ln(2 * math.pi * r) + F.ln(_horner([F.lit(1.0), *corrections], 1 / r))
    return F.when(z < _FAR, start + F.ln(s)).otherwise(far)
