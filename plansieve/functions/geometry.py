"""Polygon measures as column expressions and joins over boundary segments.

A polygon is an array of closed rings (outer ring first, holes after it), each an array of
points; orientation doesn't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(polygons: DataFrame) -> DataFrame:
    """node_id, ring, x1, y1, x2, y2 of every boundary segment that has a length."""
    ring = polygons.select("node_id", F.posexplode("rings").alias("ring", "pts"))
    pairs = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts")), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return ring.where(F.size("pts") > 1).select("node_id", "ring", F.inline(pairs)).where("x1 <> x2 or y1 <> y2")


def _ring_sum(ring: Column, term) -> Column:
    """Sum of term(a, b) over consecutive points."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + term(p["a"], p["b"]))


def signed_area(ring: Column) -> Column:
    return _ring_sum(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2.0


def area(rings: Column) -> Column:
    """Outer area less the holes'."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.aggregate(sizes, F.lit(0.0), lambda s, v: s - v) + 2.0 * F.coalesce(F.get(sizes, F.lit(0)), F.lit(0.0))


def perimeter(rings: Column) -> Column:
    """Length of all rings."""
    one = F.transform(rings, lambda r: _ring_sum(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))
    return F.aggregate(one, F.lit(0.0), lambda s, v: s + v)


def centroid(rings: Column) -> Column:
    """struct(x, y): area-weighted, holes counting against; null without area."""

    def moment(r: Column, sign: Column, axis: str) -> Column:
        # a ring's own orientation is divided out
        m = _ring_sum(r, lambda a, b: (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"])) / 6.0
        return sign * m * F.signum(signed_area(r))

    def total(axis: str) -> Column:
        parts = F.transform(rings, lambda r, i: moment(r, F.when(i == 0, 1.0).otherwise(-1.0), axis))
        return F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), area(rings))

    return F.struct(total("x").alias("x"), total("y").alias("y"))


#: GRS80 ellipsoid and the parameters of the contiguous US Albers projection (EPSG:5070)
_A, _F = 6378137.0, 1 / 298.257222101
_PHI1, _PHI2, _PHI0, _LAM0 = (math.radians(v) for v in (29.5, 45.5, 23.0, -96.0))
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(s: float) -> float:
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_N = (_m(_PHI1) ** 2 - _m(_PHI2) ** 2) / (_q(math.sin(_PHI2)) - _q(math.sin(_PHI1)))
_C = _m(_PHI1) ** 2 + _N * _q(math.sin(_PHI1))
_RHO0 = _A * math.sqrt(_C - _N * _q(math.sin(_PHI0))) / _N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y in metres of degrees, by the ellipsoidal equal-area conic."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = _A * F.sqrt(_C - _N * q) / _N
    theta = _N * (F.radians(lon) - _LAM0)
    return rho * F.sin(theta), _RHO0 - rho * F.cos(theta)


def project(rings: Column) -> Column:
    """Rings in degrees to rings in EPSG:5070 metres."""

    def point(p: Column) -> Column:
        x, y = albers(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting; points on the border may fall on either side."""

    def crossings(r: Column) -> Column:
        return _ring_sum(
            r,
            lambda a, b: F.when(
                ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]), 1.0
            ).otherwise(0.0),
        )

    hits = F.aggregate(F.transform(rings, crossings), F.lit(0.0), lambda s, v: s + v)
    return F.pmod(hits, F.lit(2.0)) == 1.0
