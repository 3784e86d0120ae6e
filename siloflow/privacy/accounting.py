"""Differential-privacy accounting for T Gaussian steps without subsampling, in closed form.

T steps of noise multiplier s compose to mu-GDP with mu = sqrt(T) / s; the exact trade-off between epsilon
and delta follows from the normal distribution. The Renyi bound is an independent check from above.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erfc, exp, inf, log, log1p, pi, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beyond this epsilon the guarantee is reported as none.
LARGEST = 1e4
# The grid of Renyi orders.
ORDERS = ((1.01, 10.0, 400), (10.0, 512.0, 400))


@dataclass(frozen=True)
class Noise:
    multiplier: float
    clip: float = 1.0


def mu(multiplier: float, steps: int) -> float:
    return sqrt(steps) / multiplier


def _log_upper(x: float) -> float:
    """log of the standard normal's upper tail, by its asymptotic series where the tail underflows."""
    if x < 30:
        return log(0.5 * erfc(x / sqrt(2.0)))
    return -0.5 * x * x - log(x * sqrt(2 * pi)) + log1p(-1 / (x * x) + 3 / x**4)


def delta(m: float, epsilon: float) -> float:
    """The delta at an epsilon; the product with e**epsilon is taken in logarithms, so large ones do not overflow."""
    first = 0.5 * erfc((epsilon / m - m / 2.0) / sqrt(2.0))
    return first - exp(min(0.0, epsilon + _log_upper(epsilon / m + m / 2.0)))


def _bisect(wrong, low: float, high: float, steps: int = 200) -> float:
    """The border below which ``wrong`` holds."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if wrong(mid) else (low, mid)
    return high


def epsilon(multiplier: float, steps: int, at_delta: float) -> float:
    """The least epsilon at a delta; infinite if above LARGEST."""
    m, high = mu(multiplier, steps), 1.0
    while delta(m, high) > at_delta:
        high *= 2
        if high > LARGEST:
            return inf
    return _bisect(lambda e: delta(m, e) > at_delta, 0.0, high)


def multiplier_for(target: float, steps: int, at_delta: float) -> float:
    """The least noise multiplier that keeps to an epsilon."""
    high = 1.0
    while epsilon(high, steps, at_delta) > target:
        high *= 2
    return _bisect(lambda s: epsilon(s, steps, at_delta) > target, 1e-3, high, 100)


def orders(spark: SparkSession) -> DataFrame:
    """The grid of orders as a table."""
    parts = [spark.range(n).select((F.lit(a) + F.col("id") * F.lit((b - a) / (n - 1))).alias("a")) for a, b, n in ORDERS]
    return parts[0].unionByName(parts[1])


def renyi(spark: SparkSession, multipliers: list[float], steps: int, at_delta: float) -> DataFrame:
    """(sigma, epsilon_rdp): the Renyi bound, the least over the grid of orders."""
    a = F.col("a")
    sigmas = spark.range(1).select(F.explode(F.array(*(F.lit(float(s)) for s in multipliers))).alias("sigma"))
    bound = steps * a / (2.0 * F.col("sigma") * F.col("sigma")) + F.log((a - 1.0) / a) - (F.lit(log(at_delta)) + F.log(a)) / (a - 1.0)
    return orders(spark).crossJoin(F.broadcast(sigmas)).groupBy("sigma").agg(F.greatest(F.min(bound), F.lit(0.0)).alias("epsilon_rdp"))


def renyi_epsilon(multiplier: float, steps: int, at_delta: float) -> float:
    grid = (a + (b - a) * i / (n - 1) for a, b, n in ORDERS for i in range(n))
    return max(0.0, min(steps * o / (2 * multiplier**2) + log((o - 1) / o) - (log(at_delta) + log(o)) / (o - 1) for o in grid))
