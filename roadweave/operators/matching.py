"""Spatial joins: nearest road, radius search, point in polygon.

Both sides get grid cells and are joined on the cell, so the work is an equi-join
that hashes and spreads; exact geometry decides among the few candidates.  A
crowded cell is a matter of cell size, and AQE may split its partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import discard, materialize

KM_PER_DEGREE = geo.EARTH_KM * math.pi / 180


def cell(lon: Column, lat: Column, size: float) -> Column:
    return F.struct(F.floor(lon / size).alias("x"), F.floor(lat / size).alias("y"))


def cells_of_box(west: Column, south: Column, east: Column, north: Column, size: float) -> Column:
    """All cells that a box touches, as an array."""
    xs = F.sequence(F.floor(west / size), F.floor(east / size))
    ys = F.sequence(F.floor(south / size), F.floor(north / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def legs(roads: DataFrame) -> DataFrame:
    """(road, oneway, leg, lon1, lat1, lon2, lat2): the legs of polylines ``coords`` array<struct<lon,lat>>."""
    pairs = F.zip_with(F.slice("coords", F.lit(1), F.size("coords") - 1), F.slice("coords", F.lit(2), F.size("coords") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return roads.filter(F.size("coords") > 1).select("road", "oneway", "coords", F.posexplode(pairs).alias("leg", "e")).select(
        "road", "oneway", geo.path_azimuth(F.col("coords")).alias("azimuth"), "leg", F.col("e.p.lon").alias("lon1"), F.col("e.p.lat").alias("lat1"), F.col("e.q.lon").alias("lon2"), F.col("e.q.lat").alias("lat2")
    )


def nearest_road(points: DataFrame, roads: DataFrame, max_metres: float = 10.0, cell_degrees: float | None = None) -> DataFrame:
    """Each point with its nearest road within ``max_metres`` (ties: smallest road), else null road.

    Adds ``road, metres, on_lon, on_lat, heading_road``.  The nearest candidate is
    kept by an aggregate with map-side combine, not by a sort of all candidates.
    """
    reach_lat = max_metres / 1000 / KM_PER_DEGREE
    # candidates at latitude |lat| < 80 degrees; beyond, cells would have to widen
    reach_lon = reach_lat / math.cos(math.radians(80))
    size = cell_degrees or max(4 * reach_lat, 1e-3)
    west, east = F.least("lon1", "lon2") - F.lit(reach_lon), F.greatest("lon1", "lon2") + F.lit(reach_lon)
    south, north = F.least("lat1", "lat2") - F.lit(reach_lat), F.greatest("lat1", "lat2") + F.lit(reach_lat)
    spread = legs(roads).withColumn("cell", F.explode(cells_of_box(west, south, east, north, size)))
    px, py = geo.closest_on_leg(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    metres = 1000 * geo.haversine_km(F.col("lon"), F.col("lat"), F.col("on_lon"), F.col("on_lat"))
    near = (
        points.select("pid", "lon", "lat", "heading", cell(F.col("lon"), F.col("lat"), size).alias("cell"))
        .join(spread, "cell")
        .withColumn("on_lon", px).withColumn("on_lat", py).withColumn("metres", metres).filter(F.col("metres") <= max_metres)
    )
    bit = geo.heading_direction(geo.road_headings(F.col("azimuth"), F.col("oneway")), F.col("heading"))
    best = near.groupBy("pid").agg(F.min(F.struct("metres", "road", "leg", "on_lon", "on_lat", bit.alias("heading_road"))).alias("b"))
    return points.drop("road", "heading_road").join(best, "pid", "left").select(
        *[c for c in points.columns if c not in ("road", "heading_road")], "b.road", "b.metres", "b.on_lon", "b.on_lat", "b.heading_road"
    )


def near_point(points: DataFrame, lon: float, lat: float, max_metres: float = 100, most: int = 1000) -> DataFrame:
    """Points within a radius, nearest first; ``most`` is the report's length.  The box prefilter reaches the scan."""
    d_lat = max_metres / 1000 / KM_PER_DEGREE
    d_lon = d_lat / max(math.cos(math.radians(lat)), 1e-6)
    box = points.filter(geo.in_box(F.col("lon"), F.col("lat"), (lon - d_lon, lat - d_lat, lon + d_lon, lat + d_lat)))
    metres = 1000 * geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return box.withColumn("metres", metres).filter(F.col("metres") <= max_metres).orderBy("metres", "pid").limit(most)


def with_ring_box(zones: DataFrame) -> DataFrame:
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return zones.withColumns({"west": side(F.array_min, "lon"), "east": side(F.array_max, "lon"), "south": side(F.array_min, "lat"), "north": side(F.array_max, "lat")})


def zone_of_points(points: DataFrame, zones: DataFrame, cell_degrees: float = 0.05, missing: str = "N/A") -> DataFrame:
    """Adds ``zone``: the zone (``zone, ring``) that holds the point, else ``missing``; of several the smallest."""
    boxed = with_ring_box(zones)
    spread = boxed.withColumn("cell", F.explode(cells_of_box(F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell_degrees)))
    at = points.select("pid", "lon", "lat", cell(F.col("lon"), F.col("lat"), cell_degrees).alias("cell"))
    inside = at.join(spread.select("zone", "ring", "cell"), "cell").filter(geo.in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    found = inside.groupBy("pid").agg(F.min("zone").alias("zone"))
    return points.join(found, "pid", "left").withColumn("zone", F.coalesce("zone", F.lit(missing)))


def ring_legs(zones: DataFrame, key: str = "zone") -> DataFrame:
    """Zones as closed polylines, so that distances to them are distances to roads."""
    return zones.select(F.col(key).alias("road"), F.lit(None).cast("string").alias("oneway"), F.concat("ring", F.slice("ring", F.lit(1), F.lit(1))).alias("coords"))


def zone_within(points: DataFrame, zones: DataFrame, max_metres: float, missing: str = "N/A") -> DataFrame:
    """Adds ``zone``: the one that holds the point, else the nearest within ``max_metres``, else ``missing``."""
    held = zone_of_points(points, zones, missing="").select("pid", F.nullif("zone", F.lit("")).alias("held"))
    edge = nearest_road(points.withColumn("heading", F.lit(0.0)), ring_legs(zones), max_metres).select("pid", F.col("road").alias("edge"))
    return points.join(held, "pid").join(edge, "pid").withColumn("zone", F.coalesce("held", "edge", F.lit(missing))).drop("held", "edge")


def nearest_way_any_distance(points: DataFrame, ways: DataFrame, start_metres: float = 200.0, rounds: int = 16) -> DataFrame:
    """Adds ``road, metres``: the nearest way at any distance.

    The radius grows fourfold for points still without a way, so most points are
    settled on small cells and no point is compared with every way.
    """
    todo, done, reach = points.withColumn("heading", F.lit(0.0)), None, start_metres
    for _ in range(rounds):
        got = nearest_road(todo, ways, reach, max(reach / 1000 / KM_PER_DEGREE, 1e-3))
        # written, so that no round works out the ones before it again
        hit = materialize(got.filter(F.col("road").isNotNull()).select("pid", "road", "metres"), "nearest")
        done = hit if done is None else done.union(hit)
        before, todo = todo, materialize(todo.join(hit.select("pid"), "pid", "left_anti"), "farther")
        discard(before)
        if reach > 20_000_000 or todo.isEmpty():
            break
        reach *= 4
    return points.drop("road").join(done, "pid", "left")


def is_residential(points: DataFrame, land_use: DataFrame) -> DataFrame:
    """Adds ``residential``: whether the nearest land-use way (``road, oneway, coords, landuse``) is residential."""
    near = nearest_way_any_distance(points, land_use).withColumnRenamed("road", "way")
    kinds = land_use.select(F.col("road").alias("way"), (F.col("landuse") == "residential").alias("residential"))
    return near.join(kinds, "way", "left").withColumn("residential", F.coalesce("residential", F.lit(False)))
