"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.storage import bound_batches, cut, shared_dir, ship  # noqa: F401

#: what parts words: runs of space, tab, LF, VT, FF, CR
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACE_BYTES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: recurrence up by eight, then Stirling's series (error < 1e-12)."""
    y = x + F.lit(8.0)
    shift = sum((F.ln(x + F.lit(float(i))) for i in range(8)), F.lit(0.0))
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    series = inv * (
        F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680)))
    )
    return (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + series - shift


#: from here on, of both parameters, the beta density is integrated; the continued fraction would take too many steps
LARGE_BETA, NODES = 3000.0, 32


def _beta_by_quadrature(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for large a and b: Gauss-Legendre over the tail that starts at x, ten standard deviations deep."""
    m = a / (a + b)
    sd = F.sqrt(m * (1.0 - m) / (a + b + 1.0))
    end = F.when(x > m, F.least(F.lit(1.0), F.greatest(m + 10.0 * sd, x + 5.0 * sd))).otherwise(F.greatest(F.lit(0.0), F.least(m - 10.0 * sd, x - 5.0 * sd)))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    points = F.array(*[F.struct(F.lit(float(0.5 + 0.5 * t)).alias("t"), F.lit(float(0.5 * w)).alias("w")) for t, w in zip(nodes, weights, strict=True)])

    def density(t: Column) -> Column:
        """Relative to that at the mean."""
        return F.exp((a - 1.0) * F.log1p((t - m) / m) + (b - 1.0) * F.log1p((m - t) / (1.0 - m)))

    area = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["w"] * density(x + (end - x) * p["t"])) * (end - x)
    # the density at the mean, by Stirling's series, in which the large terms cancel
    rest = lambda z: 1.0 / (12.0 * z)
    at_mean = F.exp(1.5 * F.ln(a + b) - 0.5 * F.ln(a) - 0.5 * F.ln(b) - 0.9189385332046727 + rest(a + b) - rest(a) - rest(b))
    v = area * at_mean
    return F.when(x > m, 1.0 - v).otherwise(F.abs(v))


def beta_cdf(x: Column, a: Column, b: Column, steps: int = 300) -> Column:
    """Regularised incomplete beta I_x(a, b) from its continued fraction (modified Lentz).

    The fraction converges in O(sqrt(max(a, b))) steps on the side where
    x < (a+1)/(a+b+2); the other side uses the symmetry I_x(a,b) = 1 - I_{1-x}(b,a).
    Where both parameters are beyond LARGE_BETA the density is integrated instead.
    """
    tiny = 1e-300
    swap = x >= (a + 1.0) / (a + b + 2.0)
    p = F.struct(
        F.when(swap, b).otherwise(a).alias("a"),
        F.when(swap, a).otherwise(b).alias("b"),
        F.when(swap, 1.0 - x).otherwise(x).alias("x"),
    )

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def fraction(q: Column) -> Column:
        qa, qb, qx = q["a"], q["b"], q["x"]
        d0 = 1.0 / safe(1.0 - (qa + qb) * qx / (qa + 1.0))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), F.lit(False).alias("done"))

        def half(s: Column, num: Column) -> tuple[Column, Column, Column]:
            d = 1.0 / safe(1.0 + num * s["d"])
            c = safe(1.0 + num / s["c"])
            return c, d, s["h"] * d * c

        def even(s: Column, i: Column) -> Column:
            m = i.cast("double")
            num = m * (qb - m) * qx / ((qa + 2.0 * m - 1.0) * (qa + 2.0 * m))
            c, d, h = half(s, num)
            return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

        def odd(s: Column, i: Column) -> Column:
            m = i.cast("double")
            num = -(qa + m) * (qa + qb + m) * qx / ((qa + 2.0 * m) * (qa + 2.0 * m + 1.0))
            c, d, h = half(s, num)
            stop = F.abs(c * d - 1.0) < 1e-14
            return F.struct(c.alias("c"), d.alias("d"), h.alias("h"), stop.alias("done"))

        def step(s: Column, i: Column) -> Column:
            two = F.transform(F.array(even(s, i)), lambda e: odd(e, i))[0]
            return F.when(s["done"], s).otherwise(two)

        h = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])
        front = F.exp(
            log_gamma(qa + qb) - log_gamma(qa) - log_gamma(qb) + qa * F.ln(qx) + qb * F.ln(1.0 - qx)
        )
        return front * h / qa

    core = F.transform(F.array(p), fraction)[0]
    value = F.when(swap, 1.0 - core).otherwise(core)
    large = (a > LARGE_BETA) & (b > LARGE_BETA)
    return F.when(x <= 0.0, F.lit(0.0)).when(x >= 1.0, F.lit(1.0)).when(large, _beta_by_quadrature(x, a, b)).otherwise(value)


def binom_cdf(k: Column, n: Column, p: Column, steps: int = 300) -> Column:
    """P(Bin(n, p) <= k) as a beta tail."""
    k, n = k.cast("double"), n.cast("double")
    return F.when(k >= n, F.lit(1.0)).otherwise(beta_cdf(1.0 - p, n - k, k + 1.0, steps))


def pack(df: DataFrame, **columns: Column) -> DataFrame:
    """One struct column `row` with all of df's columns, and the given ones; no names can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpack(df: DataFrame) -> DataFrame:
    return df.select("row.*")
