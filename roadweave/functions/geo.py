"""Distances, azimuths and planar geometry on longitude and latitude columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # not least(): that would turn an unknown place into half the globe
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def vincenty_arrays(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Vincenty's inverse formula on the WGS-84 ellipsoid, in km rounded to 6 decimals; NaN where it does not converge."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    diff = np.radians(lon2 - lon1)
    lam, done = diff.copy(), np.zeros(len(diff), bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sin_l, cos_l = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(np.cos(u2) * sin_l, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cos_l)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * sin_l / sin_s)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = diff + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done[~np.isnan(lam)].all():
                break
        k = cos2_a * (a * a - b * b) / (b * b)
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        km = b * big_a * (sigma - delta) / 1000
    return np.where(done, np.round(km, 6), np.nan)


@F.pandas_udf(DoubleType())
def vincenty_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Ellipsoidal distance; Arrow batches, as the iteration has no closed form."""
    return pd.Series(vincenty_arrays(*(s.to_numpy(float) for s in (lon1, lat1, lon2, lat2)))).replace(np.nan, None)


def trip_pair_distance(begin: Column, end: Column) -> Column:
    """The larger of the distances of two trips' begins and ends."""
    return F.greatest(begin, end)


def path_km(coords: Column) -> Column:
    """Length of a polyline given as array<struct<lon,lat>>."""
    steps = F.zip_with(F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))), lambda p, q: haversine_km(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.when(F.size(coords) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


def north_azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar azimuth from north in [0, 360)."""
    deg = F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def path_azimuth(coords: Column) -> Column:
    """From the first to the last point of a polyline."""
    a, b = F.get(coords, F.lit(0)), F.get(coords, F.size(coords) - 1)
    return north_azimuth(a["lon"], a["lat"], b["lon"], b["lat"])


def road_headings(azimuth: Column, oneway: Column) -> Column:
    """Allowed headings: one for any ``oneway`` tag (turned by 180 if it is ``-1``), two without the tag."""
    back = F.pmod(azimuth + 180, F.lit(360.0))
    return F.when(oneway.isNull(), F.array(azimuth, back)).when(oneway == "-1", F.array(back)).otherwise(F.array(azimuth))


def heading_gap(a: Column, b: Column) -> Column:
    """Angle between two headings, 0 to 180."""
    return F.lit(180) - F.abs(F.abs(a - b) - 180)


def heading_direction(headings: Column, heading: Column) -> Column:
    """1 if a point on a two-way road drives against the road's first heading (more than 90 degrees off), else 0."""
    return F.when((F.size(headings) == 2) & (heading_gap(F.get(headings, F.lit(0)), heading) > 90), 1).otherwise(0)


def cos_rate(azimuth1: Column, azimuth2: Column) -> Column:
    """0 for equal, 1 for opposite directions."""
    return F.lit(1) - (F.cos(F.radians(azimuth1 - azimuth2)) / 2 + 0.5)


def unit_vector(p: Column, q: Column) -> Column:
    """struct(cos, sin) of the azimuth of a leg."""
    az = F.radians(north_azimuth(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.struct(F.cos(az).alias("cos"), F.sin(az).alias("sin"))


def direction_score(cos1: Column, sin1: Column, cos2: Column, sin2: Column) -> Column:
    """exp(|d cos| + |d sin|) - 1; infinite above e."""
    s = F.exp(F.abs(cos1 - cos2) + F.abs(sin1 - sin2)) - 1
    return F.when(s > math.e, F.lit(math.inf)).otherwise(s)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """box: (west, south, east, north), edges included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting against a ring given as array<struct<lon,lat>>, open or closed."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    edges = F.zip_with(ring, nxt, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crosses = lambda e: ((e["p"]["lat"] > lat) != (e["q"]["lat"] > lat)) & (
        lon < (e["q"]["lon"] - e["p"]["lon"]) * F.try_divide(lat - e["p"]["lat"], e["q"]["lat"] - e["p"]["lat"]) + e["p"]["lon"]
    )
    return F.aggregate(edges, F.lit(False), lambda inside, e: F.when(crosses(e), ~inside).otherwise(inside))


def line_meets_box(coords: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a polyline has a point in a box: a vertex inside, or an edge that crosses it (Liang-Barsky)."""
    inside = F.exists(coords, lambda p: in_box(p["lon"], p["lat"], box))
    pairs = F.zip_with(F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def clipped(e: Column) -> Column:
        dx, dy = e["q"]["lon"] - e["p"]["lon"], e["q"]["lat"] - e["p"]["lat"]
        lows, highs, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
        for d, start, lo, hi in ((dx, e["p"]["lon"], box[0], box[2]), (dy, e["p"]["lat"], box[1], box[3])):
            t1, t2 = F.try_divide(lo - start, d), F.try_divide(hi - start, d)
            lows.append(F.least(t1, t2))
            highs.append(F.greatest(t1, t2))
            ok = ok & ((d != 0) | start.between(lo, hi))
        return ok & (F.greatest(*lows) <= F.least(*highs))

    return inside | F.exists(pairs, clipped)


def closest_on_leg(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Planar projection of a point on a leg, clamped to its ends."""
    dx, dy = lon2 - lon1, lat2 - lat1
    along = F.try_divide((lon - lon1) * dx + (lat - lat1) * dy, dx * dx + dy * dy)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    return lon1 + t * dx, lat1 + t * dy
