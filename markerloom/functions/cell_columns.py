"""Statistics of 2x2 tables as columns: what ``kernels`` computes for one cell, for a frame of cells and without leaving the JVM.

A value that is used more than once is bound as the variable of a lambda rather than a column of its own: where the optimiser
moves a filter on a p-value below projections, it puts every column's expression in place of its name, and polynomials of
polynomials would never end. erfc comes from rational approximations, log factorials of over 20 from Stirling's series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.functions.kernels import FLOOR, MOST_LOG_FACTOR, MOST_ODDS, SAME_LOG
from markerloom.types import Test

# W. J. Cody's rational Chebyshev approximations of the error function (1969), highest power first, for
# arguments up to 0.46875 (of erf), up to 4 and beyond (of erfc).
SMALL = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
SMALL_BELOW = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MIDDLE = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MIDDLE_BELOW = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
LARGE = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
LARGE_BELOW = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)

#: A chi-squared whose tail is below the floor (6e-17).
FAR = 70.0


def _polynomial(x: Column, factors: Sequence[float]) -> Column:
    return reduce(lambda total, f: total * x + f, factors[1:], F.lit(factors[0]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there and wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def erfc(x: Column) -> Column:
    """Of a column that is 0 or more."""

    def of(y: Column, z: Column, w: Column) -> Column:
        small = 1 - y * _polynomial(z, SMALL) / _polynomial(z, SMALL_BELOW)
        middle = F.exp(-z) * _polynomial(y, MIDDLE) / _polynomial(y, MIDDLE_BELOW)
        large = F.exp(-z) / F.greatest(y, F.lit(4.0)) * (1 / math.sqrt(math.pi) - w * _polynomial(w, LARGE) / _polynomial(w, LARGE_BELOW))
        return F.when(y <= 0.46875, small).when(y <= 4, middle).otherwise(large)

    return bound(x, lambda y: bound(y * y, lambda z: bound(1 / F.greatest(z, F.lit(16.0)), lambda w: of(y, z, w))))


def log_factorial(n: Column) -> Column:
    """Of whole numbers from 0."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series)


def _tail(x: Column) -> Column:
    """The upper tail of chi-squared with one degree of freedom, from the floor to 1; that of null and NaN is 1."""
    known = bound(x, lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (v > 0), v).otherwise(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), erfc(F.sqrt(known / 2))))


def _chi_squared(a: Column, b: Column, t1: int, t2: int) -> Column:
    n = t1 + t2
    present = a + b
    below = F.lit(float(t1 * t2)) * (present * (n - present)).cast("double")
    over = F.greatest(F.abs(a * (t2 - b) - b * (t1 - a)).cast("double") - n / 2, F.lit(0.0))
    x = F.try_divide(n * over * over, below)
    return F.when((x > FAR) & ~F.isnan(x), F.lit(FLOOR)).otherwise(_tail(x))  # most cells of a large grid


def _g_test(a: Column, b: Column, t1: int, t2: int) -> Column:
    n = t1 + t2
    if not n:
        return F.lit(1.0)

    def term(observed: Column, row: int, column: Column) -> Column:
        expected = row * column.cast("double") / n
        return F.when((observed > 0) & (expected > 0), observed * F.log(F.try_divide(observed, expected))).otherwise(0.0)

    terms = [term(a, t1, a + b), term(t1 - a, t1, n - a - b), term(b, t2, a + b), term(t2 - b, t2, n - a - b)]
    return _tail(2 * reduce(lambda x, y: x + y, terms))


def _fisher(a: Column, b: Column, t1: int, t2: int) -> Column:
    """Logs of all tables with a cell's margins, up to what doesn't depend on the table; then those that are no likelier."""
    present = a + b
    low, high = F.greatest(F.lit(0), present - t2), F.least(present, F.lit(t1))

    def log(i: Column) -> Column:
        return -(log_factorial(i) + log_factorial(t1 - i) + log_factorial(present - i) + log_factorial(t2 - present + i))

    whole = log_factorial(present) + log_factorial(t1 + t2 - present) - (math.lgamma(t1 + t2 + 1) - math.lgamma(t1 + 1) - math.lgamma(t2 + 1))

    def total(logs: Column, own: Column, whole: Column) -> Column:
        return F.aggregate(F.filter(logs, lambda x: x <= own + SAME_LOG), F.lit(0.0), lambda sum, x: sum + F.exp(x + whole))

    own = F.when((a >= low) & (a <= high), log(a))  # null for what is no table
    p = bound(whole, lambda w: bound(own, lambda o: total(F.transform(F.sequence(low, high), log), o, w)))
    return F.when(own.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), p)))


_P_OF = {Test.CHISQ: _chi_squared, Test.GTEST: _g_test, Test.FISHER: _fisher}


def _cell() -> tuple[Column, Column]:
    return F.col("g1").cast("bigint"), F.col("g2").cast("bigint")


def with_p(rows: DataFrame, t1: int, t2: int, test: Test) -> DataFrame:
    """``rows`` (with g1, g2) with ``p``."""
    return rows.withColumn("p", _P_OF[test](*_cell(), t1, t2))


def _log_binomial(k: Column, n: int, p: float, choices: Column) -> Column:
    """``choices`` is the log of the binomial coefficient."""
    if p <= 0 or p >= 1:
        return F.when(k == (0 if p <= 0 else n), 0.0).otherwise(-math.inf)
    return choices + k * math.log(p) + (n - k) * math.log1p(-p)


def _posterior(a: Column, b: Column, t1: int, t2: int, prior: float, linked: float) -> Column:
    if prior <= 0 or prior >= 1:
        return F.lit(float(prior >= 1))

    def odds(choices1: Column, choices2: Column) -> Column:
        def both(p1: float, p2: float) -> Column:
            return _log_binomial(a, t1, p1, choices1) + _log_binomial(b, t2, p2, choices2)

        def either(x: Column, y: Column, top: Column) -> Column:
            return F.when(top == -math.inf, top).otherwise(top + F.log(F.exp(x - top) + F.exp(y - top))) - math.log(2)

        linked_to = bound(both(linked, 1 - linked), lambda x: bound(both(1 - linked, linked), lambda y: bound(F.greatest(x, y), lambda top: either(x, y, top))))
        return math.log(prior) - math.log1p(-prior) + linked_to - both(0.5, 0.5)

    def choices(k: Column, n: int) -> Column:
        return math.lgamma(n + 1) - log_factorial(k) - log_factorial(n - k)

    all_odds = bound(choices(a, t1), lambda c1: bound(choices(b, t2), lambda c2: odds(c1, c2)))
    return bound(all_odds, lambda o: F.when(o > MOST_ODDS, 1.0).when(o < -MOST_ODDS, 0.0).otherwise(1 / (1 + F.exp(-o))))


def with_bayes(rows: DataFrame, t1: int, t2: int, prior: float, linked: float) -> DataFrame:
    """``rows`` (with g1, g2) with ``bayes_factor`` and ``posterior``."""
    a, b = _cell()
    factor = log_factorial(a) + log_factorial(t1 - a) + log_factorial(b) + log_factorial(t2 - b) - log_factorial(a + b) - log_factorial(t1 + t2 - a - b)
    factor = factor - (math.lgamma(t1 + 2) + math.lgamma(t2 + 2) - math.lgamma(t1 + t2 + 2))
    return rows.withColumns({"bayes_factor": F.exp(F.least(F.lit(MOST_LOG_FACTOR), factor)), "posterior": _posterior(a, b, t1, t2, prior, linked)})
