"""Geometry as column arithmetic: distances, projections and rectangles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalar import C, col, num

EARTH_KM = 6371.0088
#: GRS80 ellipsoid and the parameters of the conterminous-US Albers projection (EPSG:5070).
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0}


def clip01(x: C) -> Column:
    return F.least(num(1), F.greatest(num(0), col(x)))


def haversine_km(lat1: C, lon1: C, lat2: C, lon2: C) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2.0), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2.0), 2)
    return 2.0 * EARTH_KM * F.asin(F.sqrt(clip01(h)))


def unit_vector(lat: C, lon: C) -> dict[str, Column]:
    a, b = F.radians(col(lat)), F.radians(col(lon))
    return {"ux": F.cos(a) * F.cos(b), "uy": F.cos(a) * F.sin(b), "uz": F.sin(a)}


def km_to_chord(km: C) -> Column:
    return 2.0 * F.sin(col(km) / (2.0 * EARTH_KM))


def chord_to_km(chord: C) -> Column:
    return 2.0 * EARTH_KM * F.asin(clip01(col(chord) / 2.0))


def planar_km(x1: C, y1: C, x2: C, y2: C) -> Column:
    return F.hypot(col(x1) - col(x2), col(y1) - col(y2)) / 1000.0


def mercator_y(lat: C) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(col(lat)) / 2.0))


def albers(lat: C, lon: C) -> dict[str, Column]:
    """Albers equal-area coordinates in metres on the GRS80 ellipsoid."""
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)

    def q(s, log, one):
        return (1 - e2) * (s / (one - e2 * s * s) - log((one - e * s) / (one + e * s)) / (2 * e))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    p1, p2, p0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    q1, q2, q0 = (q(math.sin(p), math.log, 1.0) for p in (p1, p2, p0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
    c = m(p1) ** 2 + n * q1
    rho0 = GRS80_A * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(col(lat)))
    rho = GRS80_A * F.sqrt(c - n * q(s, F.log, num(1))) / n
    theta = n * F.radians(col(lon) - ALBERS["lon0"])
    return {"x": rho * F.sin(theta), "y": rho0 - rho * F.cos(theta)}


def overlap_1d(a0: C, a1: C, b0: C, b1: C) -> Column:
    return F.greatest(F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)), num(0))


def overlap_area(a: str, b: str) -> Column:
    """Common area of two rectangles given by struct or table prefix."""
    f = lambda p, k: F.col(f"{p}.{k}")
    return overlap_1d(f(a, "xmin"), f(a, "xmax"), f(b, "xmin"), f(b, "xmax")) * overlap_1d(f(a, "ymin"), f(a, "ymax"), f(b, "ymin"), f(b, "ymax"))


def _inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 12) -> np.ndarray:
    a, f = GRS80_A, GRS80_F
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    whole = np.radians(lon2 - lon1)
    whole = whole - 2 * np.pi * np.rint(whole / (2 * np.pi))  # the short way round
    lam = whole
    for i in range(rounds + 1):
        sin_l, cos_l = np.sin(lam), np.cos(lam)
        sin_s = np.sqrt((c2 * sin_l) ** 2 + (c1 * s2 - s1 * c2 * cos_l) ** 2)
        cos_s = s1 * s2 + c1 * c2 * cos_l
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sin_l / np.where(sin_s == 0, 1.0, sin_s))
        cos2a = 1 - sin_a**2
        mid = np.where(cos2a == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2a == 0, 1.0, cos2a))
        if i < rounds:
            k = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
            lam = whole + (1 - k) * f * sin_a * (sigma + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
    uu = cos2a * (a * a - b * b) / (b * b)
    big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    fix = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - fix) / 1000.0


@F.pandas_udf(DoubleType())
def _geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(_inverse(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2))))


def geodesic_km(lat1: C, lon1: C, lat2: C, lon2: C) -> Column:
    """Inverse geodesic on GRS80 by a fixed number of Vincenty iterations, in Arrow batches: an iteration shares its terms, which a
    column expression would spell out again and again.  Null where an argument is."""
    args = [col(x).cast("double") for x in (lat1, lon1, lat2, lon2)]
    d = _geodesic(*args)
    return F.when(args[0].isNotNull() & args[1].isNotNull() & args[2].isNotNull() & args[3].isNotNull(), d)
