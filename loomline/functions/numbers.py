"""Scalar numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers from 0 on: Stirling's series of ten more, less the logarithms of what was added."""
    x = n.cast("double") + 11
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    added = sum((F.log(n.cast("double") + k) for k in range(2, 11)), F.log(n.cast("double") + 1))
    return series - added


def sign_tail(wins: Column, n: Column) -> Column:
    """The chance of `wins` or more heads in n throws of a fair coin.

    Terms are summed from the largest outward by their ratios: from wins on if that is over half, else the other side, taken from 1. Terms beyond
    40 standard deviations are under the least double and add nothing, so no more of them are visited.
    """
    upper = 2 * wins > n
    first = F.when(upper, wins).otherwise(n - wins + 1)  # by symmetry the lower tail is an upper one
    term = F.exp(log_factorial(n) - log_factorial(first) - log_factorial(n - first) - n * math.log(2))
    last = F.least(n, first + F.ceil(20 * F.sqrt(n.cast("double"))) + 50)
    start = F.struct(F.lit(0.0).alias("sum"), term.alias("term"))
    step = lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (n - k) / (k + 1)).alias("term"))
    tail = F.when(first > n, 0.0).otherwise(F.aggregate(F.sequence(F.least(first, n), last), start, step, lambda a: a["sum"]))
    return F.when(upper, tail).otherwise(1 - tail)
