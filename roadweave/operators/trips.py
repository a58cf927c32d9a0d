"""Trips: cutting logs, trip measures, filters, origin-destination matrices, home locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as T

DETOUR = 1.24  # a path's length over that of the straight legs


def cut_by_gaps(points: DataFrame, gap_minutes: float = 15) -> DataFrame:
    """Adds ``trip_id`` (0, 1, ... per car): a gap above ``gap_minutes`` starts a new trip."""
    order = Window.partitionBy("id").orderBy("ts", "pid")
    gap = T.minutes_between(F.lag("ts").over(order), F.col("ts"))
    cut = F.coalesce((gap > gap_minutes).cast("int"), F.lit(0))
    return points.withColumn("__cut", cut).withColumn("trip_id", F.sum("__cut").over(order).cast("long")).drop("__cut")


def cut_by_gaps_and_stops(points: DataFrame, gap_minutes: float = 15, stop_minutes: int = 10) -> DataFrame:
    """Adds ``trip_id``: cuts at gaps, and behind stops of more than ``stop_minutes``.

    A stop is a maximal run of points without speed inside a gap segment that
    also has moving points.  It lasts from its first point to the first point of
    the next run (or the segment's last point), where the cut goes; if the point
    before that one is less than half of ``stop_minutes`` away, the cut goes
    there.  All windows share one partitioning and order: one shuffle by car.
    """
    car = Window.partitionBy("id")
    order = car.orderBy("ts", "pid")
    df = cut_by_gaps(points, gap_minutes).withColumnRenamed("trip_id", "__seg")
    seg = Window.partitionBy("id", "__seg")
    in_seg = seg.orderBy("ts", "pid")
    moving = F.coalesce(F.col("speed") > 0, F.lit(False))
    df = df.withColumn("__moving", moving)
    df = df.withColumn("__new", F.coalesce((F.col("__moving") != F.lag("__moving").over(in_seg)).cast("int"), F.lit(0)))
    df = df.withColumn("__run", F.sum("__new").over(in_seg))
    df = df.withColumn("__n", F.row_number().over(in_seg)).withColumn("__runs", F.max("__run").over(seg))
    df = df.withColumn("__before", F.lag("ts").over(in_seg)).withColumn("__after", F.lead("ts").over(in_seg))
    run = Window.partitionBy("id", "__seg", "__run")
    df = df.withColumn("__start", F.min("ts").over(run)).withColumn("__from_before", F.lag("__start").over(in_seg))
    df = df.withColumn("__still_before", F.lag(~F.col("__moving")).over(in_seg))
    last = F.col("__after").isNull()
    # where the run behind a stop begins, or a segment that ends in a stop
    ends = (F.col("__runs") > 0) & (((F.col("__new") == 1) & F.col("__still_before")) | (last & ~F.col("__moving")))
    began = F.when(F.col("__new") == 1, F.when(F.col("__still_before"), F.col("__from_before")).otherwise(F.col("__start"))).otherwise(F.col("__start"))
    long_stop = ends & (T.minutes_between(began, F.col("ts")) > stop_minutes)
    near = T.minutes_between(F.col("__before"), F.col("ts")) < stop_minutes // 2
    df = df.withColumn("__here", F.coalesce(long_stop & ~F.coalesce(near, F.lit(False)), F.lit(False)))
    df = df.withColumn("__earlier", F.coalesce(long_stop & near, F.lit(False)))
    df = df.withColumn("__shifted", F.coalesce(F.lead("__earlier").over(in_seg), F.lit(False)))
    first = (F.col("__n") == 1) & (F.col("__seg") > 0)
    df = df.withColumn("__cut", (first | F.col("__here") | F.col("__shifted")).cast("int"))
    df = df.withColumn("trip_id", F.sum("__cut").over(order).cast("long"))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def build_trips(cut: DataFrame, detour: float = DETOUR) -> DataFrame:
    """One row per trip: times, begin and end points, legs, kilometres.

    ``km`` is the sum of the legs times ``detour``; ``km_straight`` is the plain
    distance from begin to end.
    """
    order = Window.partitionBy("id", "trip_id").orderBy("ts", "pid")
    here = [F.col("lon"), F.col("lat")]
    leg = cut.withColumn("leg_s", T.seconds_between(F.lag("ts").over(order), F.col("ts"))).withColumn(
        "leg_km", geo.haversine_km(F.lag("lon").over(order), F.lag("lat").over(order), *here) * F.lit(detour)
    )
    at = F.struct("ts", "pid")
    point = F.struct("ts", "lon", "lat", "speed", "road", "pid")
    legs = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ts", "pid", F.col(c).alias("x"))))), lambda s: s["x"])
    trips = leg.groupBy("id", "trip_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(point, at).alias("begin"),
        F.max_by(point, at).alias("end"),
        F.avg("speed").alias("mean_speed"),
        F.coalesce(F.sum("leg_km"), F.lit(0.0)).alias("km"),
        legs("leg_s").alias("leg_s"),
        legs("leg_km").alias("leg_km"),
        F.sort_array(F.collect_set("road")).alias("roads"),
    )
    return (
        trips.withColumn("day", T.day(F.col("begin.ts")))
        .withColumn("dur_s", T.seconds_between(F.col("begin.ts"), F.col("end.ts")))
        .withColumn("km_straight", geo.haversine_km(F.col("begin.lon"), F.col("begin.lat"), F.col("end.lon"), F.col("end.lat")))
    )


def trip_predicates(max_speed: float = 0.2, min_km: float = 0.2, min_s: float = 60, max_end_speed: float = 0.0, max_first: float = 0.05) -> dict[str, Column]:
    """The named conditions on trips; a division by zero rejects the trip."""
    no = F.lit(False)
    return {
        "overall_speed": F.coalesce(F.try_divide(F.col("km"), F.col("dur_s")) < max_speed, no),
        "observed_speed": F.coalesce(F.col("mean_speed") > 0, no),
        "distance": F.col("km") >= min_km,
        "straight_distance": F.col("km_straight") >= min_km,
        "duration": F.col("dur_s") >= min_s,
        "begin_speed": F.coalesce(F.col("begin.speed") <= max_end_speed, no),
        "end_speed": F.coalesce(F.col("end.speed") <= max_end_speed, no),
        "first_leg": F.coalesce(F.try_divide(F.get("leg_km", F.lit(0)), F.get("leg_s", F.lit(0))) <= max_first, no),
    }


def filter_trips(trips: DataFrame, **limits) -> DataFrame:
    """Library form: all eight conditions."""
    return _where_all(trips, trip_predicates(**limits).values())


def filter_trips_by_zone(trips: DataFrame, zones: list, zone_col: str = "roads", **limits) -> DataFrame:
    """Batch form: without the straight distance, and some point in one of the zones."""
    p = trip_predicates(**limits)
    del p["straight_distance"]
    return _where_all(trips, [*p.values(), F.arrays_overlap(zone_col, F.array(*[F.lit(z) for z in zones]))])


def filter_trips_short(trips: DataFrame, **limits) -> DataFrame:
    """Parallel form: without mean observed speed and straight distance."""
    p = trip_predicates(**limits)
    del p["straight_distance"], p["observed_speed"]
    return _where_all(trips, p.values())


def _where_all(df: DataFrame, conditions) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def od_trips(trips: DataFrame, zones: DataFrame | None = None, max_speed: float = 0, min_minutes: float = 5) -> DataFrame:
    """Trips that count for an OD matrix."""
    out = trips.filter((F.col("dur_s") >= 60 * min_minutes) & (F.col("begin_speed") <= max_speed) & (F.col("end_speed") <= max_speed))
    if zones is not None:
        for side in ("begin_zone", "end_zone"):
            out = out.join(zones.select(F.col("zone").alias(side)), side, "left_semi")
    return out


def od_matrix(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """(begin_zone, end_zone, n) on the full grid of zones, absent pairs 0; the grid is the result."""
    z = zones.select("zone").distinct()
    grid = z.select(F.col("zone").alias("begin_zone")).crossJoin(z.select(F.col("zone").alias("end_zone")))
    counts = trips.groupBy("begin_zone", "end_zone").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["begin_zone", "end_zone"], "left").select("begin_zone", "end_zone", F.coalesce("n", F.lit(0)).alias("n"))


def zone_flow(od: DataFrame) -> DataFrame:
    """(zone, flow): row sum plus column sum minus diagonal, in one aggregate."""
    same = F.col("begin_zone") == F.col("end_zone")
    ends = F.when(same, F.array("begin_zone")).otherwise(F.array("begin_zone", "end_zone"))
    return od.select(F.explode(ends).alias("zone"), "n").groupBy("zone").agg(F.sum("n").alias("flow"))


def grouped_edges(trips: DataFrame) -> DataFrame:
    """(id, begins, ends, trip_ids, length): each car's trips as ordered arrays; length is twice their number."""
    ordered = F.array_sort(F.collect_list(F.struct("trip_id", "begin", "end")))
    return trips.groupBy("id").agg(ordered.alias("t")).select(
        "id", F.col("t.begin").alias("begins"), F.col("t.end").alias("ends"), F.col("t.trip_id").alias("trip_ids"), (2 * F.size("t")).alias("length")
    )


def filter_edges_length(edges: DataFrame, min_points: int = 0) -> DataFrame:
    return edges.filter(F.col("length") >= min_points)


def first_last_per_day(points: DataFrame, n: int = 1) -> DataFrame:
    """The first and last n points of each car and day; a point that is both comes twice."""
    by_day = points.withColumn("day", T.day(F.col("ts")))
    w = Window.partitionBy("id", "day")
    up, down = F.row_number().over(w.orderBy("ts", "pid")), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("pid")))
    sides = F.array_compact(F.array(F.when(F.col("__up") <= n, F.lit("first")), F.when(F.col("__down") <= n, F.lit("last"))))
    return by_day.withColumn("__up", up).withColumn("__down", down).withColumn("side", F.explode(sides)).drop("__up", "__down")


def home_cluster(points: DataFrame, cluster: str = "road") -> DataFrame:
    """(id, home, seq_share, sequences, point_share): the cluster where a car's days most often begin and end.

    ``seq_share`` is its share among first and last points, ``point_share`` among all.
    """
    ends = first_last_per_day(points).groupBy("id", cluster).agg(F.count(F.lit(1)).alias("e"))
    per_car = Window.partitionBy("id")
    best = (
        ends.withColumn("sequences", F.sum("e").over(per_car)).withColumn("rank", F.row_number().over(per_car.orderBy(F.desc("e"), cluster)))
        .filter("rank = 1").select("id", F.col(cluster).alias("home"), (F.col("e") / F.col("sequences")).alias("seq_share"), "sequences")
    )
    share = points.groupBy("id", F.col(cluster).alias("home")).agg(F.count(F.lit(1)).alias("c"))
    share = share.withColumn("point_share", F.col("c") / F.sum("c").over(per_car)).drop("c")
    return best.join(share, ["id", "home"])


def likely_homes(clusters: DataFrame, min_sequences: int = 10) -> DataFrame:
    return clusters.filter((F.col("home") != -1) & (F.col("seq_share") > 0.5) & (F.col("sequences") >= min_sequences) & (F.col("seq_share") > F.col("point_share")))


def location_stats(points: DataFrame, cluster: str = "road") -> DataFrame:
    """Per car and cluster: hours and speeds (all, and halves of the day), centroid and RMS distance to it."""
    h = T.fractional_hour(F.col("ts"))
    morning = F.hour("ts") < 12
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("mean_lon"), F.col("mean_lat"))
    w = Window.partitionBy("id", cluster)
    centred = points.withColumn("mean_lon", F.avg("lon").over(w)).withColumn("mean_lat", F.avg("lat").over(w))
    return centred.groupBy("id", cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("hour_mean"), F.stddev_samp(h).alias("hour_std"), F.avg("speed").alias("speed_mean"),
        F.avg(F.when(morning, F.col("speed"))).alias("speed_morning"), F.avg(F.when(~morning, F.col("speed"))).alias("speed_evening"),
        F.first("mean_lon").alias("mean_lon"), F.first("mean_lat").alias("mean_lat"), F.sqrt(F.avg(km * km)).alias("loc_std"),
    )


def edge_cluster_stats(labelled: DataFrame, ends: tuple[str, ...] = ("begin", "end")) -> DataFrame:
    """(id, cluster, trips, mean_clock) of trips' begins, ends or both; ``labelled`` has ``<side>_cluster`` and ``<side>_ts``."""
    sides = [labelled.select("id", F.col(f"{s}_cluster").alias("cluster"), F.col(f"{s}_ts").alias("ts")) for s in ends]
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.union(s)
    return rows.groupBy("id", "cluster").agg(F.count(F.lit(1)).alias("trips"), F.avg(T.seconds_of_day(F.col("ts"))).alias("mean_clock"))


def trip_documents(trips: DataFrame, server: str = "") -> DataFrame:
    """Trips as they are stored: whole seconds, begin and end as point ids, constant columns of the loader."""
    return trips.select(
        "id", "trip_id", "day", "points", F.col("begin.pid").alias("begin"), F.col("end.pid").alias("end"), F.col("dur_s").cast("int").alias("dur"), "km", "km_straight",
        F.lit(server).alias("server_name"), F.lit(0).alias("indexed_iris"),
    )


def both_ends(edges: DataFrame) -> DataFrame:
    """(id, places): begins and ends of a car's trips in one array, begins first."""
    return edges.select("id", F.concat("begins", "ends").alias("places"))
