"""Areas: polygons clipped to grid cells (Arrow), boxes and spherical quadrangles (columns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def clipped_areas(x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Areas that simple polygons, a row of corners each, share with their boxes: halfplanes one by one for all rows at once, then the shoelace formula."""
    count = np.full(len(x), x.shape[1] if x.ndim == 2 else 0)
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        slot = np.arange(x.shape[1])
        live = slot < count[:, None]
        after = np.where(slot + 1 < count[:, None], slot + 1, 0)
        d = sign * ((y if axis else x) - limit[:, None])
        e, u, v = (np.take_along_axis(z, after, 1) for z in (d, x, y))
        crosses = live & (((d > 0) & (e < 0)) | ((d < 0) & (e > 0)))
        t = np.where(crosses, d, 0.0) / np.where(crosses, d - e, 1.0)
        both = lambda a, b: np.stack([a, b], axis=2).reshape(len(a), 2 * a.shape[1])
        kept = both(live & (d >= 0), crosses)
        count = kept.sum(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, int(count.max(initial=0)))]
        x, y = (np.take_along_axis(both(a, a + t * (b - a)), order, 1) for a, b in ((x, u), (y, v)))
    slot = np.arange(x.shape[1])
    after = np.where(slot + 1 < count[:, None], slot + 1, 0)
    u, v = np.take_along_axis(x, after, 1), np.take_along_axis(y, after, 1)
    return np.abs(np.where(slot < count[:, None], x * v - y * u, 0.0).sum(axis=1)) / 2


def _corners(column: pd.Series, width: int) -> np.ndarray:
    """Rows of corners; shorter ones repeat their last corner, which adds no area."""
    return np.array([np.pad(np.asarray(c, float), (0, width - len(c)), "edge") if len(c) < width else c for c in column], float).reshape(len(column), width)


@F.pandas_udf(T.DoubleType())
def overlap_area(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Area in square degrees of a pixel's corners (lon, lat) within the cell x0, x1, y0, y1."""
    for lon, lat, *box in batches:
        width = int(lon.str.len().max()) if len(lon) else 1
        yield pd.Series(clipped_areas(_corners(lon, width), _corners(lat, width), *(b.to_numpy(float) for b in box)))


def cell_area_m2(lat: Column, dlat: float, dlon: float, radius: float = 6371000.0) -> Column:
    """Area of a latitude-longitude cell on the sphere."""
    top, bottom = F.radians(lat + dlat / 2), F.radians(lat - dlat / 2)
    return radius * radius * F.abs(F.sin(top) - F.sin(bottom)) * F.radians(F.lit(dlon))


def spherical_quad_area(lons: list[Column], lats: list[Column], radius: float = 6371000.0) -> Column:
    """Spherical excess of a quadrangle, split into two triangles."""

    def excess(k: tuple[int, int, int]) -> Column:
        p = [(F.cos(F.radians(lats[i])) * F.cos(F.radians(lons[i])), F.cos(F.radians(lats[i])) * F.sin(F.radians(lons[i])), F.sin(F.radians(lats[i]))) for i in k]
        dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        a, b, c = p
        triple = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        return 2 * F.atan2(F.abs(triple), 1 + dot(a, b) + dot(b, c) + dot(c, a))

    return (excess((0, 1, 2)) + excess((0, 2, 3))) * radius * radius


#: Semi-axes in metres of the ellipsoids of 1866 (Clarke) and 1984.
CLARKE_1866, WGS84 = (6378206.4, 6356583.8), (6378137.0, 6356752.314245179)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def zone_area(lat: np.ndarray, a: float, b: float) -> np.ndarray:
    """Area between the equator and a latitude (radians) of an ellipsoid, for each radian of longitude."""
    e = np.sqrt(1 - (b / a) ** 2)
    s = np.sin(lat)
    return b * b / 2 * (s / (1 - (e * s) ** 2) + np.arctanh(e * s) / e)


def geodesic_strips(lon0: np.ndarray, lat0: np.ndarray, lon1: np.ndarray, lat1: np.ndarray, a: float, b: float) -> np.ndarray:
    """Signed areas between the equator and geodesics of an ellipsoid, positive where they run east in the north; ends in degrees.

    The geodesic's azimuth at the equator comes from the inverse problem, by
    iterating the longitude on the auxiliary sphere; the area is then an integral
    along the arc. Ends that lie nearly opposite each other aren't solved.
    """
    f = 1 - b / a
    dlon = np.radians((lon1 - lon0 + 180) % 360 - 180)
    u0, u1 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat0, lat1))
    omega = dlon.copy()
    for _ in range(60):
        so, co = np.sin(omega), np.cos(omega)
        ss = np.hypot(np.cos(u1) * so, np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * co)
        cs = np.sin(u0) * np.sin(u1) + np.cos(u0) * np.cos(u1) * co
        sigma = np.arctan2(ss, cs)
        sin_a = np.clip(np.where(ss > 0, np.cos(u0) * np.cos(u1) * so / np.where(ss > 0, ss, 1), 0.0), -1, 1)
        start = np.arctan2(np.sin(u0), np.cos(u0) * np.where(ss > 0, np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * co, 1.0) / np.where(ss > 0, ss, 1.0))
        k2 = (a * a / (b * b) - 1) * (1 - sin_a**2)
        half = sigma / 2
        at = start[:, None] + half[:, None] * (1 + _NODES)
        slow = (2 - f) / (1 + (1 - f) * np.sqrt(1 + k2[:, None] * np.sin(at) ** 2))
        fresh = dlon + f * sin_a * half * (slow @ _WEIGHTS)
        done = np.max(np.abs(fresh - omega), initial=0.0) < 1e-14
        omega = fresh
        if done:
            break
    sin_b = np.sqrt(np.maximum(0.0, 1 - sin_a**2))[:, None] * np.sin(at)
    cos2_b = np.maximum(1e-300, 1 - sin_b**2)
    lat = np.arctan(sin_b / np.sqrt(cos2_b) / (1 - f))
    speed = sin_a[:, None] / cos2_b - f * sin_a[:, None] * slow
    strips = np.where(sigma > 0, half * ((zone_area(lat, a, b) * speed) @ _WEIGHTS), 0.0)
    # at a pole an edge turns from one meridian to the other
    polar = np.where(np.abs(lat0) > np.abs(lat1), lat0, lat1)
    return np.where(np.abs(polar) > 90 - 1e-12, dlon * zone_area(np.radians(np.clip(polar, -90, 90)), a, b), strips)
