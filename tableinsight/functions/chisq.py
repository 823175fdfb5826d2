"""Chi-squared goodness of fit against equal frequencies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNIFICANCE_LEVEL = 0.05  # fixed value
MANY = 10_000


def uniform_statistic(k: Column, total: Column, sum_of_squares: Column) -> Column:
    """Sum over categories of (n - e)^2 / e with e = total / k, from three mergeable sums.

    The numerator k * sum(n^2) - total^2 stays in DECIMAL, so nothing cancels when counts are
    large and nearly equal.
    """
    exact = sum_of_squares.cast("decimal(38,0)")
    numerator = k.cast("decimal(10,0)") * exact - total.cast("decimal(19,0)") * total.cast(
        "decimal(19,0)"
    )
    return numerator.cast("double") / total.cast("double")


def _log_gamma_plus_one(degrees: Column) -> Column:
    """ln Gamma(degrees/2 + 1): a product down to Gamma(1) = 1 or Gamma(1/2) = sqrt(pi)."""
    odd = degrees % 2 == 1
    factors = F.sequence(F.lit(1), F.ceil(degrees / 2).cast("int"))
    start = F.when(odd, F.log(F.lit(3.141592653589793)) / 2).otherwise(F.lit(0.0))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.aggregate(factors, start, lambda acc, i: acc + F.log(i - shift))


def _normal_tail(statistic: Column, degrees: Column) -> Column:
    """Wilson-Hilferty: the cube root of X / k is nearly normal, for many degrees to six decimals."""
    spread = 2 / (9 * degrees.cast("double"))
    z = (F.pow(statistic / degrees, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Polynomial for the error function, good to 1.5e-7.
    total = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        total = (total + c) * t
    half = total * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def upper_tail(statistic: Column, degrees: Column) -> Column:
    """P(X >= statistic) for a chi-squared variable, as 1 minus the lower incomplete gamma series.

    The series has about as many terms as the statistic; from ``MANY`` degrees on the normal form
    is exact to more decimals than are reported.
    """
    a = degrees.cast("double") / 2
    y = statistic / 2
    # Beyond this point the tail is below 1e-40.
    negligible = statistic > degrees + 20 * F.sqrt(2.0 * degrees) + 400
    # Once the term ratio y / (a + n) is under one half, a hundred more terms are plenty.
    terms = F.sequence(F.lit(1), F.ceil(F.when(negligible, 0.0).otherwise(2 * y) + 100).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * y / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(terms, start, step, lambda acc: acc["total"])
    lower = F.exp(a * F.log(y) - y - _log_gamma_plus_one(degrees)) * series
    return (
        F.when(statistic <= 0, F.lit(1.0))
        .when(negligible, F.lit(0.0))
        .when(degrees > MANY, _normal_tail(statistic, degrees))
        .otherwise(F.greatest(F.lit(0.0), 1 - lower))
    )
