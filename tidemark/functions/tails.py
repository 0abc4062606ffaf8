"""Tail probabilities and exact tests for the few rows that aggregation leaves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def chi2_tail(x: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


@F.pandas_udf(DoubleType())
def kolmogorov_tail(x: pd.Series) -> pd.Series:
    """Asymptotic two-sided tail of the Kolmogorov-Smirnov statistic times the root of the effective size."""

    return x.map(_kolmogorov, na_action="ignore")


def _kolmogorov(v: float) -> float:
    if v < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * v * v) for k in range(1, 101))))


def smirnov_two_sided(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of the two-sample statistic over all orders of n1 + n2 different values: lattice paths that leave the band, a row of it at a time."""
    few, many = sorted((n1, n2))
    band = (0.5 + math.floor(d * few * many - 1e-7)) / (few * many)
    j = np.arange(many + 1) / many
    paths, log = (j <= band).astype(float), 0.0  # to (i, j), over the exponential of ``log``
    for i in range(1, few + 1):
        within = np.abs(i / few - j) <= band
        paths = np.where(within, np.cumsum(np.where(within, paths, 0.0)), 0.0)
        most = paths.max()
        if not most:
            return 1.0
        paths, log = paths / most, log + math.log(most)
    if not paths[-1]:
        return 1.0
    every = math.lgamma(few + many + 1) - math.lgamma(few + 1) - math.lgamma(many + 1)
    return min(1.0, max(0.0, 1.0 - math.exp(math.log(paths[-1]) + log - every)))


def rank_sum_two_sided(u: float, n1: int, n2: int) -> float:
    """P of a U as far from its mean over all orders of different values: counts of U are the coefficients of a Gaussian binomial."""
    few, many = sorted((n1, n2))
    far = math.ceil(max(u, n1 * n2 - u) - 1e-9)
    size = n1 * n2 + 1
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, few + 1):
        if many + i < size:
            ways[many + i :] -= ways[: -(many + i)].copy()
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    return min(1.0, 2 * float(ways[: size - far].sum() / ways.sum()))


#: Up to what size of the larger sample D's p, and of the smaller one U's, are those of all orders.
EXACT_D, EXACT_U = 10_000, 8


@F.pandas_udf(DoubleType())
def smirnov_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """p of D: of all orders up to EXACT_D values in either sample, asymptotic beyond; null without values."""

    def p(d: float, n1: int, n2: int) -> float | None:
        if not n1 or not n2 or d != d:
            return None
        return smirnov_two_sided(d, n1, n2) if max(n1, n2) <= EXACT_D else _kolmogorov(d * math.sqrt(n1 * n2 / (n1 + n2)))

    return pd.Series([p(*map(float, t[:1]), *map(int, t[1:])) for t in zip(d.fillna(math.nan), n1.fillna(0), n2.fillna(0))], dtype=float)


@F.pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, otherwise: pd.Series) -> pd.Series:
    """p of U without ties: of all orders if a sample has EXACT_U values at most, else what is given."""
    return pd.Series([rank_sum_two_sided(a, int(b), int(c)) if 0 < min(b, c) <= EXACT_U and a == a else o for a, b, c, o in zip(u, n1.fillna(0), n2.fillna(0), otherwise)], dtype=float)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of all two-by-two tables with these margins that are no likelier than this one.

    Probabilities rise to the mode and fall after it: the last table of each tail is found by bisection, and a tail is summed from there until what
    is left is nothing, so the steps grow with the deviation and not with the counts.
    """
    row, col, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(k + 1)
    fixed = log(row) + log(n - row) + log(col) + log(n - col) - log(n)
    p = lambda x: fixed - log(x) - log(row - x) - log(col - x) - log(n - row - col + x)
    least, most = max(0, row + col - n), min(row, col)
    bound, mode = p(a) + 1e-7, min(max((row + 1) * (col + 1) // (n + 2), least), most)

    def bisected(low: int, high: int, rising: bool) -> int:
        """The place nearest to the mode that is within the bound."""
        while low < high:
            middle = (low + high + rising) // 2
            if (p(middle) <= bound) == rising:
                low = middle if rising else middle + 1
            else:
                high = middle - 1 if rising else middle
        return low

    total = 0.0
    for low, high, step in ((least, mode, -1), (mode + 1, most, 1)):
        if low <= high and p(low if step < 0 else high) <= bound:
            x = bisected(low, high, step < 0)
            while least <= x <= most and (v := p(x)) > bound - 60:
                total += math.exp(v)
                x += step
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, t)) for t in zip(a, b, c, d)], dtype=float)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 10_000):
        before = out
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + top * d, 1.0 + top / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(out - before) < 1e-15 * abs(out):
            break
    return out


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the incomplete beta function of df / (df + t * t) with df / 2 and 1 / 2."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if t == 0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - a * math.log1p(t * t / df) + b * math.log(t * t / (df + t * t)))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def student_two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
    """p of a correlation r over n pairs, by Student's t with n - 2 degrees of freedom."""

    def tail(r: float, n: float) -> float:
        df = n - 2
        if df <= 0 or r != r:
            return 1.0
        if abs(r) >= 1:
            return 0.0
        return student_tail(abs(r) * math.sqrt(df / (1 - r * r)), df)

    return pd.Series([tail(a, b) for a, b in zip(r, n)], dtype=float)
