"""Expressions on ARRAY<DOUBLE> columns. All are plain Spark SQL functions; indices count from 0.

Empty arrays give null for means, extremes and positions; divisions by zero
give null where the text says so and infinity nowhere (ANSI mode raises on a
plain division by zero, so ``try_divide`` is used).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: an expression that a lambda uses would be computed again for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def bound(f: Callable) -> Callable:
    """Makes the first argument of an array function a column that is computed once."""

    @wraps(f)
    def call(a: str | Column, *args, **kwargs) -> Column:
        return f(col(a), *args, **kwargs) if isinstance(a, str) else let(a, lambda v: f(v, *args, **kwargs))

    return call


def kept(x: Column) -> Column:
    """x as a column that the optimizer does not merge into what is built on it: arguments of numpy kernels with nested lambdas need that."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def total(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


@bound
def mean(a: str | Column) -> Column:
    return F.try_divide(total(a), F.size(a))


@bound
def moment(a: str | Column, centre: Column, power: int) -> Column:
    """Mean of (x - centre) ** power."""
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x - centre, F.lit(float(power)))), F.size(a))


@bound
def std(a: str | Column) -> Column:
    """Population standard deviation; the mean first, then the squares around it."""
    return let(mean(a), lambda m: F.sqrt(moment(a, m, 2)))


@bound
def median(a: str | Column) -> Column:
    """Middle value, or the mean of the two middle ones."""
    n = F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return let(F.array_sort(a), lambda s: F.when(n > 0, (at(s, low) + at(s, high)) / 2))


def at(a: str | Column, i: Column | int) -> Column:
    """Element i, null outside the array."""
    return F.get(col(a), F.lit(i) if isinstance(i, int) else i.cast("int"))


@bound
def pick(a: str | Column, indices: str | Column) -> Column:
    """Elements at a list of indices."""
    return F.transform(col(indices), lambda i: at(a, i))


@bound
def diff(a: str | Column) -> Column:
    """Successive differences, one shorter than the array."""
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda x, y: x - y)).otherwise(F.slice(a, 1, 0))


@bound
def padded_diff(a: str | Column, order: int = 1) -> Column:
    """Derivative of the given order by successive differences, zeros on the left keep the length."""
    return F.transform(a, lambda _, i: F.when(i < order, F.lit(0.0)).otherwise(sum((_binomial(order, k) * at(a, i - k) for k in range(order + 1)), F.lit(0.0))))


def _binomial(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out * (-1) ** k


@bound
def argmax(a: str | Column) -> Column:
    """First place of the largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


@bound
def argmin(a: str | Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


@bound
def cut(a: str | Column, start: Column | int, end: Column | int) -> Column:
    """Elements start (in) to end (out), clipped to the array."""
    lo = F.greatest(F.lit(0), F.lit(start) if isinstance(start, int) else start.cast("int"))
    hi = F.least(F.size(a), F.lit(end) if isinstance(end, int) else end.cast("int"))
    return F.slice(a, lo + 1, F.greatest(F.lit(0), hi - lo))


@bound
def first_where(a: str | Column, test: Callable[[Column, Column], Column]) -> Column:
    """First index whose element and index pass the test, else null."""
    found = F.filter(F.transform(a, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    return F.get(found, F.lit(0))


@bound
def maxima(a: str | Column) -> Column:
    """Strict local maxima; a plateau counts once, at its middle (rounded down); the ends do not count."""
    state = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("left"), F.lit(False).alias("up"))

    def step(s: Column, i: Column) -> Column:
        x, y = at(a, i), at(a, i - 1)
        peak = s["up"] & (x < y)
        return F.struct(
            F.when(peak, F.array_append(s["found"], F.floor((s["left"] + i - 1) / 2).cast("int"))).otherwise(s["found"]).alias("found"),
            F.when(x > y, i).otherwise(s["left"]).alias("left"),
            F.when(x > y, F.lit(True)).when(x < y, F.lit(False)).otherwise(s["up"]).alias("up"),
        )

    return F.when(F.size(a) > 2, F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), state, step)["found"]).otherwise(F.array().cast("array<int>"))


@bound
def minima(a: str | Column) -> Column:
    return maxima(F.transform(a, lambda x: -x))


@bound
def trapezoid(a: str | Column) -> Column:
    """Area under unit-spaced samples; 0 for fewer than two."""
    n = F.size(a)
    return F.when(n < 2, F.lit(0.0)).otherwise(total(a) - (at(a, 0) + at(a, n - 1)) / 2)


@bound
def min_max(a: str | Column, eps: float) -> Column:
    """(x - min) / (max - min + eps)."""
    return let(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), lambda s: F.transform(a, lambda x: (x - s["lo"]) / (s["hi"] - s["lo"] + eps)))


@bound
def z_score(a: str | Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (population deviation + eps)."""
    return let(F.struct(mean(a).alias("m"), std(a).alias("s")), lambda s: F.transform(a, lambda x: (x - s["m"]) / (s["s"] + eps)))


@bound
def centred(a: str | Column) -> Column:
    """The array without its mean."""
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


@bound
def flat_share(a: str | Column, delta: float = 1e-5) -> Column:
    """Share of all samples whose step from the one before is below delta."""
    return F.try_divide(F.size(F.filter(diff(a), lambda d: F.abs(d) < delta)), F.size(a))


@bound
def skewness(a: str | Column, flat: float = 0.3) -> Column:
    """Mean cube of (x - mean) / (population deviation + 1e-6); 0 if over ``flat`` of the samples are flat."""
    cubes = F.aggregate(z_score(a), F.lit(0.0), lambda s, x: s + x * x * x)
    return F.when(flat_share(a) > flat, F.lit(0.0)).otherwise(F.try_divide(cubes, F.size(a)))
