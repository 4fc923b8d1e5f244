"""Coordinate reference systems from well-known text, and the way back from their planes to degrees.

Inverse map projections of the ellipsoid as column functions: transverse Mercator, Lambert conformal
conic, Albers equal-area conic and the web's spherical Mercator. Datums are not shifted against each
other: the North American datum of 1983 and WGS 84 differ by a metre or two.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREES = ("EPSG:4326", "EPSG:4269", "OGC:CRS84")
TARGET = "EPSG:5070"
#: fixed values of EPSG:5070: names as in well-known text
ALBERS_US = {"standard_parallel_1": 29.5, "standard_parallel_2": 45.5, "latitude_of_origin": 23.0, "central_meridian": -96.0, "false_easting": 0.0, "false_northing": 0.0}
GRS80 = (6378137.0, 298.257222101)
_SAME = {"latitude_of_center": "latitude_of_origin", "longitude_of_center": "central_meridian", "longitude_of_origin": "central_meridian"}


@dataclass
class Crs:
    """kind: degrees, transverse_mercator, lambert, albers or web_mercator; unit: metres of one unit of the plane."""

    kind: str
    parameters: dict[str, float] = field(default_factory=dict)
    spheroid: tuple[float, float] = GRS80
    unit: float = 1.0

    def is_target(self) -> bool:
        same = all(abs(self.parameters.get(k, 0.0) - v) < 1e-9 for k, v in ALBERS_US.items())
        return self.kind == "albers" and same and abs(self.spheroid[0] - GRS80[0]) < 1e-6 and self.unit == 1.0


def parse(text: str | None) -> Crs:
    """A CRS from an EPSG code or well-known text (version 1); none is taken for degrees, an unknown one raises."""
    text = (text or "").strip()
    if not text or text.upper() in DEGREES:
        return Crs("degrees")
    if m := re.fullmatch(r"EPSG:(\d+)", text.upper()):
        code = int(m[1])
        if code == 5070:
            return Crs("albers", dict(ALBERS_US))
        if code == 3857:
            return Crs("web_mercator")
        for base, top in ((26900, 23), (32600, 60)):  # UTM zones of the northern half, on either datum
            if 1 <= code - base <= top:
                return Crs("transverse_mercator", {"central_meridian": 6.0 * (code - base) - 183, "scale_factor": 0.9996, "false_easting": 500000.0})
        raise ValueError(f"cannot project {text}: pass its well-known text")
    if re.match(r"(GEOGCS|GEOGCRS|GEODCRS)\[", text, re.IGNORECASE):
        return Crs("degrees")
    name = re.search(r'PROJECTION\["([^"]+)"', text, re.IGNORECASE)
    kinds = {"transverse_mercator": "transverse_mercator", "lambert_conformal": "lambert", "albers": "albers", "mercator_auxiliary_sphere": "web_mercator"}
    kind = next((v for k, v in kinds.items() if name and name[1].lower().replace(" ", "_").startswith(k)), None)
    if kind is None:
        raise ValueError(f"cannot project {name[1] if name else text[:60]}")
    found = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)"\s*,\s*([-+0-9.eE]+)', text, re.IGNORECASE)}
    ball = re.search(r'SPHEROID\["[^"]*"\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)', text, re.IGNORECASE)
    units = re.findall(r'UNIT\["[^"]*"\s*,\s*([0-9.eE+-]+)', text, re.IGNORECASE)
    return Crs(kind, {_SAME.get(k, k): v for k, v in found.items()}, (float(ball[1]), float(ball[2])) if ball else GRS80, float(units[-1]) if units else 1.0)


def to_degrees(crs: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of the plane."""
    if crs.kind == "degrees":
        return x, y
    p = crs.parameters
    a, flat = crs.spheroid[0], 1 / crs.spheroid[1] if crs.spheroid[1] else 0.0
    e2 = flat * (2 - flat)
    x, y = x * crs.unit - p.get("false_easting", 0.0) * crs.unit, y * crs.unit - p.get("false_northing", 0.0) * crs.unit
    lam0, phi0 = math.radians(p.get("central_meridian", 0.0)), math.radians(p.get("latitude_of_origin", 0.0))
    if crs.kind == "web_mercator":
        return F.degrees(x / a + lam0), F.degrees(math.pi / 2 - 2 * F.atan(F.exp(-y / a)))
    if crs.kind == "transverse_mercator":
        lam, phi = _transverse_mercator(x, y, a, e2, p.get("scale_factor", 1.0), phi0)
    else:
        phi1 = math.radians(p.get("standard_parallel_1", p.get("latitude_of_origin", 0.0)))
        phi2 = math.radians(p["standard_parallel_2"]) if "standard_parallel_2" in p else phi1
        lam, phi = (_lambert if crs.kind == "lambert" else _albers)(x, y, a, e2, phi0, phi1, phi2, p.get("scale_factor", 1.0))
    return F.degrees(lam + lam0), F.degrees(phi)


def _transverse_mercator(x: Column, y: Column, a: float, e2: float, k0: float, phi0: float) -> tuple[Column, Column]:
    """Series about the latitude at which the meridian is as long as y says; millimetres within a zone."""
    e4, e6 = e2 * e2, e2**3
    length = (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024, 15 * e4 / 256 + 45 * e6 / 1024, 35 * e6 / 3072)
    start = length[0] * phi0 - length[1] * math.sin(2 * phi0) + length[2] * math.sin(4 * phi0) - length[3] * math.sin(6 * phi0)
    mu = (y / (k0 * a) + start) / length[0]
    root = math.sqrt(1 - e2)
    n = (1 - root) / (1 + root)
    foot = mu + (1.5 * n - 27 / 32 * n**3) * F.sin(2 * mu) + (21 / 16 * n**2 - 55 / 32 * n**4) * F.sin(4 * mu) + 151 / 96 * n**3 * F.sin(6 * mu) + 1097 / 512 * n**4 * F.sin(8 * mu)
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    ep2 = e2 / (1 - e2)
    c, t, bend = ep2 * cos * cos, tan * tan, 1 - e2 * sin * sin
    d = x * F.sqrt(bend) / (a * k0)
    d2 = d * d
    drop = d2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d2 * d2 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d2 * d2 * d2 / 720
    turn = d * (1 - (1 + 2 * t + c) * d2 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d2 * d2 / 120)
    return turn / cos, foot - tan * bend / (1 - e2) * drop


def _lambert(x: Column, y: Column, a: float, e2: float, phi0: float, phi1: float, phi2: float, k0: float) -> tuple[Column, Column]:
    e = math.sqrt(e2)
    m = lambda v: math.cos(v) / math.sqrt(1 - e2 * math.sin(v) ** 2)
    t = lambda v: math.tan(math.pi / 4 - v / 2) / ((1 - e * math.sin(v)) / (1 + e * math.sin(v))) ** (e / 2)
    n = math.sin(phi1) if abs(phi1 - phi2) < 1e-12 else math.log(m(phi1) / m(phi2)) / math.log(t(phi1) / t(phi2))
    scale = a * k0 * m(phi1) / (n * t(phi1) ** n)
    down = scale * t(phi0) ** n - y
    sign = math.copysign(1.0, n)
    tt = F.pow(sign * F.hypot(x, down) / scale, F.lit(1 / n))
    phi = math.pi / 2 - 2 * F.atan(tt)
    for _ in range(5):  # each step gains two or three digits
        phi = math.pi / 2 - 2 * F.atan(tt * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2)))
    return F.atan2(sign * x, sign * down) / n, phi


def _albers(x: Column, y: Column, a: float, e2: float, phi0: float, phi1: float, phi2: float, k0: float) -> tuple[Column, Column]:
    e = math.sqrt(e2)
    m2 = lambda v: math.cos(v) ** 2 / (1 - e2 * math.sin(v) ** 2)

    def q(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    n = math.sin(phi1) if abs(phi1 - phi2) < 1e-12 else (m2(phi1) - m2(phi2)) / (q(math.sin(phi2)) - q(math.sin(phi1)))
    c = m2(phi1) + n * q(math.sin(phi1))
    down = a * math.sqrt(c - n * q(math.sin(phi0))) / n - y
    sign = math.copysign(1.0, n)
    height = (c - (x * x + down * down) * (n / a) ** 2) / (n * q(1.0))
    # a pole may come out beyond 1 by rounding; points off the plane stay NaN
    beta = F.asin(F.when(F.abs(height).between(1.0, 1 + 1e-12), F.signum(height)).otherwise(height))
    e4, e6 = e2 * e2, e2**3
    phi = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.atan2(sign * x, sign * down) / n, phi
