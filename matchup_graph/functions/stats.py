"""Statistics as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction: the fraction's terms shrink after about the square root of its larger parameter.
STEPS, PER_ROOT = 200, 3
#: Coefficients of 1/a, 1/a^3, ... in ln(gamma(a + 1/2) / gamma(a)) - ln(a) / 2.
HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)
SHIFT = 12


def log_beta_half(a: Column) -> Column:
    """ln B(a, 1/2) for a > 0: the series at a + 12, and twelve steps of the recurrence back."""
    far = a + SHIFT
    series = F.log(far) / 2
    for i, c in enumerate(HALF_STEP):
        series = series + F.lit(c) * F.pow(far, F.lit(-(2 * i + 1)))
    back = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, i: s + F.log((a + i) / (a + i + 0.5)))
    return F.lit(math.log(math.pi) / 2) - (series + back)


def beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated forwards as a fold over a sequence of steps."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = F.lit(1.0) / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"), a.alias("a"), b.alias("b"), x.alias("x"))
    steps = F.sequence(F.lit(1), (F.lit(STEPS) + PER_ROOT * F.sqrt(F.greatest(a, b))).cast("int"))

    def term(s: Column, numerator: Column) -> Column:
        d, c = F.lit(1.0) / safe(1 + numerator * s["d"]), safe(1 + numerator / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["value"] * c * d).alias("value"), s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"))

    def step(s: Column, n: Column) -> Column:
        m = n.cast("double")
        even = lambda v: term(v, m * (v["b"] - m) * v["x"] / ((v["a"] + 2 * m - 1) * (v["a"] + 2 * m)))
        odd = lambda v: term(v, -(v["a"] + m) * (v["a"] + v["b"] + m) * v["x"] / ((v["a"] + 2 * m) * (v["a"] + 2 * m + 1)))
        return F.get(F.transform(F.array(even(s)), odd), F.lit(0))  # the array holds one value, so it is computed once

    return F.aggregate(steps, start, step, lambda s: s["value"])


def slope_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a zero slope: Student's t with n - 2 degrees of freedom, as I(1 - r^2; df/2, 1/2).

    NULL where r is or below three rows, 0 where |r| is 1.  The fraction runs on
    the side where it converges fast, the other one is its complement.
    """
    half, x = (n - 2).cast("double") / 2, (1 - r) * (1 + r)
    front = F.exp(half * F.log(x) + F.log(F.abs(r)) - log_beta_half(half))  # x^a (1 - x)^(1/2) / B(a, 1/2)
    direct = x < (half + 1) / (half + 2.5)
    a, b, at = F.when(direct, half).otherwise(0.5), F.when(direct, 0.5).otherwise(half), F.when(direct, x).otherwise(r * r)
    part = front * beta_fraction(a, b, at) / a
    p = F.when(direct, part).otherwise(1 - part)
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
