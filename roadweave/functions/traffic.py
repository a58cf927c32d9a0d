"""Rules of roads and speeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# way classes that are no roads for cars (fixed values)
NOT_FOR_CARS = ("footway", "path", "pedestrian", "track", "bus_guideway", "raceway", "bridleway", "steps", "cycleway", "construction", "proposed")


def tag_map(tags: Column) -> Column:
    """array<struct<k,v>> as a map; of equal keys the last wins."""
    last = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, i + 2, F.size(tags)), lambda u: u["k"] == t["k"]))
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v"))))


def is_car_road(tags: Column, excluded: tuple[str, ...] = NOT_FOR_CARS) -> Column:
    """Has a ``highway`` tag and no tag value among the excluded."""
    return F.exists(tags, lambda t: t["k"] == "highway") & ~F.exists(tags, lambda t: t["v"].isin(*excluded))


def one_way(oneway: Column, highway: Column, junction: Column) -> Column:
    """1: along the nodes only, -1: against them, 0: both ways."""
    ring = F.coalesce(junction.isin("circular", "roundabout"), F.lit(False))
    along = F.coalesce(oneway == "yes", F.lit(False)) | F.coalesce(highway == "motorway", F.lit(False)) | ring
    return F.when(along, 1).when(oneway == "-1", -1).otherwise(0)


def cast_speed(limit: Column) -> Column:
    """A speed limit tag as a number; ``50+`` is 50, anything else that is no number is null."""
    return F.when(limit == "50+", F.lit(50.0)).otherwise(limit.try_cast("double"))


def congestion(speed: Column, limit: Column) -> Column:
    """Speed over limit; null if either is missing or no number."""
    return F.try_divide(speed, cast_speed(limit))


def congestion_level(ratio: Column) -> Column:
    """-1 unknown, 0 below a quarter of the limit, 1 below 0.7, else 2."""
    return F.when(ratio.isNull() | F.isnan(ratio), -1).when(ratio < 0.25, 0).when(ratio < 0.70, 1).otherwise(2)


def weighted_speed(speed: Column, density: Column, mean: Column, threshold: float) -> Column:
    """The measured speed where enough cars were seen, else drawn towards the mean in proportion."""
    w = density / F.lit(float(threshold))
    return F.when(density >= threshold, speed).otherwise(w * speed + (1 - w) * mean)


def segment_key(road: Column, heading: Column) -> Column:
    return F.concat_ws("_", road.cast("string"), heading.cast("string"))


def road_of_key(key: Column) -> Column:
    return F.split_part(key, F.lit("_"), F.lit(1)).cast("bigint")


def heading_of_key(key: Column) -> Column:
    return F.split_part(key, F.lit("_"), F.lit(2)).cast("int")


def smape_terms(y: Column, pred: Column) -> Column:
    """Symmetric error with a floor under the denominator."""
    return 2 * F.abs(pred - y) / F.greatest(F.abs(y) + F.abs(pred) + 0.1, F.lit(0.6))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def log_size_class(n: Column) -> Column:
    """Order of magnitude of a count."""
    return F.floor(F.log10(n)).cast("int")


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def colour_or_black(c: Column) -> Column:
    """Colour codes as they are; anything that is none becomes black."""
    return F.when(c.startswith("#"), c).otherwise(F.lit("#000000"))
