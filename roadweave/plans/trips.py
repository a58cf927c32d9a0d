"""Trips, origin-destination matrices and homes.

Events of a user are hours apart, so queries cut at gaps of 24 hours and stops
of 10 hours; the operators' own defaults are 15 and 10 minutes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import models, trips as TR
from . import views as V
from .registry import query

GAP, STOP = 1440, 600


def cut(spark, d):
    return TR.cut_by_gaps_and_stops(V.gps(spark, d), GAP, STOP)


def trips(spark, d):
    return TR.build_trips(cut(spark, d))


@query("trip_gap", "SELECT pid, id, CAST(seg AS BIGINT) AS trip_id FROM gaps", "gaps")
def trip_gap(spark, d):
    return TR.cut_by_gaps(V.gps(spark, d), GAP).select("pid", "id", "trip_id")


@query("trip_stops", "SELECT pid, id, trip_id FROM cut", "cut")
def trip_stops(spark, d):
    return cut(spark, d).select("pid", "id", "trip_id")


@query(
    "build_trips",
    "SELECT id, trip_id, points, t0, t1, dur_s, km, km_straight, mean_speed, speed_b, speed_e, day FROM trips",
    "trips",
    ("km", "km_straight", "mean_speed", "dur_s"),
    dates="day",
)
def build_trips(spark, d):
    t = trips(spark, d)
    return t.select("id", "trip_id", "points", F.col("begin.ts").alias("t0"), F.col("end.ts").alias("t1"), "dur_s", "km", "km_straight", "mean_speed", F.col("begin.speed").alias("speed_b"), F.col("end.speed").alias("speed_e"), "day")


@query("trip_legs", "SELECT id, trip_id, count(leg_s) AS legs, coalesce(sum(leg_s), 0) AS seconds, coalesce(max(1.24 * HAV(lon0, lat0, lon, lat)), 0) AS longest FROM leg GROUP BY 1, 2", "leg", ("seconds", "longest"))
def trip_legs(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return trips(spark, d).select("id", "trip_id", F.size("leg_s").cast("long").alias("legs"), total("leg_s").alias("seconds"), F.coalesce(F.array_max("leg_km"), F.lit(0.0)).alias("longest"))


WHERE = {
    "overall": "coalesce(km / nullif(dur_s, 0) < 0.2, false)", "observed": "mean_speed > 0", "distance": "km >= 0.2", "straight": "km_straight >= 0.2", "duration": "dur_s >= 60",
    "begin": "speed_b <= 20", "end": "speed_e <= 20", "first": "coalesce(first_km / nullif(first_s, 0) <= 0.05, false)",
}


@query("filter_trips", f"SELECT id, trip_id, points FROM trips WHERE {' AND '.join(WHERE.values())}", "trips")
def filter_trips(spark, d):
    return TR.filter_trips(trips(spark, d), max_end_speed=20).select("id", "trip_id", "points")


@query("filter_trips_iris", f"SELECT id, trip_id, points FROM trips WHERE {' AND '.join(v for k, v in WHERE.items() if k != 'straight')} AND list_has_any(roads, [1, 2, 3])", "trips")
def filter_trips_iris(spark, d):
    return TR.filter_trips_by_zone(trips(spark, d), [1, 2, 3], max_end_speed=20).select("id", "trip_id", "points")


@query("filter_trips_short", f"SELECT id, trip_id, points FROM trips WHERE {' AND '.join(v for k, v in WHERE.items() if k not in ('straight', 'observed'))}", "trips")
def filter_trips_short(spark, d):
    return TR.filter_trips_short(trips(spark, d), max_end_speed=20).select("id", "trip_id", "points")


@query(
    "grouped_edges",
    """SELECT id, array_to_string(list(trip_id ORDER BY trip_id), ',') AS trip_ids, array_to_string(list(CAST(round(lon_b * 1e4) AS BIGINT) ORDER BY trip_id), ',') AS begins,
      CAST(2 * count(*) AS INTEGER) AS length FROM trips GROUP BY 1 HAVING 2 * count(*) >= 6""",
    "trips",
)
def grouped_edges(spark, d):
    e = TR.filter_edges_length(TR.grouped_edges(trips(spark, d)), 6)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return e.select("id", text("trip_ids").alias("trip_ids"), text(F.transform("begins", lambda b: F.round(b["lon"] * 1e4).cast("long"))).alias("begins"), "length")


ODW = "WHERE dur_s >= 300 AND begin_speed <= 0.05 AND end_speed <= 0.05"
OD = f"""SELECT a.z AS begin_zone, b.z AS end_zone, coalesce(n, 0) AS n FROM (SELECT n_nationkey AS z FROM nation) a CROSS JOIN (SELECT n_nationkey AS z FROM nation) b
  LEFT JOIN (SELECT begin_zone, end_zone, count(*) AS n FROM odt {ODW} GROUP BY 1, 2) o ON o.begin_zone = a.z AND o.end_zone = b.z"""


def od(spark, d):
    z = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"))
    return TR.od_matrix(TR.od_trips(V.od_trip_view(spark, d), z, 0.05, 5), z)


@query("od_trips", f"SELECT begin_zone, end_zone, dur_s FROM odt {ODW}", "odt")
def od_trips(spark, d):
    return TR.od_trips(V.od_trip_view(spark, d), None, 0.05, 5).select("begin_zone", "end_zone", "dur_s")


@query("od_matrix", OD, "odt")
def od_matrix(spark, d):
    return od(spark, d)


@query("zone_flow", f"SELECT zone, CAST(sum(n) AS BIGINT) AS flow FROM (SELECT begin_zone AS zone, n FROM ({OD}) UNION ALL SELECT end_zone, n FROM ({OD}) WHERE begin_zone <> end_zone) GROUP BY 1", "odt")
def zone_flow(spark, d):
    return TR.zone_flow(od(spark, d))


ENDS = """SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY id, CAST(ts AS DATE) ORDER BY ts, pid) AS up,
  row_number() OVER (PARTITION BY id, CAST(ts AS DATE) ORDER BY ts DESC, pid DESC) AS down FROM gps"""


@query("first_last_per_day", f"SELECT pid, id, day, 'first' AS side FROM ({ENDS}) WHERE up = 1 UNION ALL SELECT pid, id, day, 'last' FROM ({ENDS}) WHERE down = 1", "gps", dates="day")
def first_last_per_day(spark, d):
    return TR.first_last_per_day(V.gps(spark, d)).select("pid", "id", "day", "side")


HOME = f"""WITH e AS (SELECT id, kind, count(*) AS c FROM (SELECT id, kind FROM ({ENDS}) WHERE up = 1 UNION ALL SELECT id, kind FROM ({ENDS}) WHERE down = 1) GROUP BY 1, 2),
  b AS (SELECT id, kind AS home, c / sum(c) OVER (PARTITION BY id) AS seq_share, CAST(sum(c) OVER (PARTITION BY id) AS BIGINT) AS sequences, row_number() OVER (PARTITION BY id ORDER BY c DESC, kind) AS r FROM e),
  p AS (SELECT id, kind AS home, count(*) / sum(count(*)) OVER (PARTITION BY id) AS point_share FROM gps GROUP BY 1, 2)
  SELECT b.id, b.home, b.seq_share, b.sequences, p.point_share FROM b JOIN p ON p.id = b.id AND p.home = b.home WHERE b.r = 1"""


@query("home_cluster", HOME, "gps", ("seq_share", "point_share"))
def home_cluster(spark, d):
    return TR.home_cluster(V.gps(spark, d), "kind")


@query(
    "likely_homes",
    HOME.replace("SELECT b.id, b.home,", "SELECT b.id, CAST(ascii(b.home) AS INTEGER) AS home,") + " AND b.seq_share > 0.3 AND b.sequences >= 10 AND b.seq_share > p.point_share",
    "gps",
    ("seq_share", "point_share"),
)
def likely_homes(spark, d):
    h = TR.home_cluster(V.gps(spark, d), "kind").withColumn("home", F.ascii("home"))
    # half of the ends in one place is never reached by five event types: the share is lifted for the view
    lifted = h.withColumn("s", F.col("seq_share")).withColumn("seq_share", F.col("seq_share") + 0.2).withColumn("point_share", F.col("point_share") + 0.2)
    out = TR.likely_homes(lifted)
    return out.select("id", "home", F.col("s").alias("seq_share"), "sequences", (F.col("point_share") - 0.2).alias("point_share"))


FH = "(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))) / 3600.0"


@query(
    "location_stats",
    f"""WITH c AS (SELECT *, {FH} AS h, avg(lon) OVER w AS ml, avg(lat) OVER w AS mt FROM gps WINDOW w AS (PARTITION BY id, kind))
      SELECT id, kind, count(*) AS n, avg(h) AS hour_mean, stddev_samp(h) AS hour_std, avg(speed) AS speed_mean, avg(speed) FILTER (extract(hour FROM ts) < 12) AS speed_morning,
      avg(speed) FILTER (extract(hour FROM ts) >= 12) AS speed_evening, sqrt(avg(pow(HAV(lon, lat, ml, mt), 2))) AS loc_std FROM c GROUP BY 1, 2""",
    "gps",
    ("hour_mean", "hour_std", "speed_mean", "speed_morning", "speed_evening", "loc_std"),
)
def location_stats(spark, d):
    return TR.location_stats(V.gps(spark, d), "kind").drop("mean_lon", "mean_lat")


@query(
    "edge_cluster_stats",
    """SELECT id, c AS cluster, count(*) AS trips, avg(s) AS mean_clock FROM (SELECT id, arg_min(road, (ts, pid)) AS c, extract(hour FROM min(ts)) * 3600 + extract(minute FROM min(ts)) * 60 + floor(extract(second FROM min(ts))) AS s FROM cut GROUP BY id, trip_id
      UNION ALL SELECT id, arg_max(road, (ts, pid)), extract(hour FROM max(ts)) * 3600 + extract(minute FROM max(ts)) * 60 + floor(extract(second FROM max(ts))) FROM cut GROUP BY id, trip_id) GROUP BY 1, 2""",
    "cut",
    "mean_clock",
)
def edge_cluster_stats(spark, d):
    t = trips(spark, d).select("id", F.col("begin.road").alias("begin_cluster"), F.col("end.road").alias("end_cluster"), F.col("begin.ts").alias("begin_ts"), F.col("end.ts").alias("end_ts"))
    return TR.edge_cluster_stats(t)


@query("haversine", "SELECT pid, HAV(lon, lat, -1.6778, 48.1113) AS km FROM gps", "gps", "km")
def haversine(spark, d):
    return V.gps(spark, d).select("pid", geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(-1.6778), F.lit(48.1113)).alias("km"))


@query("vincenty")
def vincenty(spark, d):
    """Ellipsoidal distances; no SQL form (iterative)."""
    return V.gps(spark, d).select("pid", geo.vincenty_km(F.col("lon"), F.col("lat"), F.lit(-1.6778), F.lit(48.1113)).alias("km"))


@query(
    "trip_pair_distance",
    "SELECT a.id, a.trip_id, greatest(HAV(a.lon_b, a.lat_b, b.lon_b, b.lat_b), HAV(a.lon_e, a.lat_e, b.lon_e, b.lat_e)) AS km FROM trips a JOIN trips b ON a.id = b.id AND b.trip_id = a.trip_id + 1",
    "trips",
    "km",
)
def trip_pair_distance(spark, d):
    t = trips(spark, d).select("id", "trip_id", "begin", "end")
    n = t.select("id", (F.col("trip_id") - 1).alias("trip_id"), F.col("begin").alias("b2"), F.col("end").alias("e2"))
    km = lambda p, q: geo.haversine_km(F.col(f"{p}.lon"), F.col(f"{p}.lat"), F.col(f"{q}.lon"), F.col(f"{q}.lat"))
    return t.join(n, ["id", "trip_id"]).select("id", "trip_id", geo.trip_pair_distance(km("begin", "b2"), km("end", "e2")).alias("km"))


@query("user_regions")
def user_regions(spark, d):
    """DBSCAN of trip begins per user; no SQL form."""
    return models.all_regions(trips(spark, d), eps_km=3.0, min_samples=3)["begin"]


@query("user_regions_both")
def user_regions_both(spark, d):
    return models.all_regions(trips(spark, d), both=True, eps_km=2.0, min_samples=3)["both"]


@query("recurrent_trips")
def recurrent_trips(spark, d):
    return models.recurrent_trips(trips(spark, d), eps_km=6.0, min_samples=3)


@query("time_clusters")
def time_clusters(spark, d):
    return models.time_clusters(V.gps(spark, d))


@query("heading_clusters")
def heading_clusters(spark, d):
    h = models.heading_clusters(V.gps(spark, d))
    return h.select("road", F.size("centres").alias("n"), F.round(F.get("centres", F.lit(0)), 6).alias("first"))


@query("trip_documents", "SELECT id, trip_id, points, arg_min_pid AS begin, arg_max_pid AS \"end\", CAST(trunc(dur_s) AS INTEGER) AS dur, 'node1' AS server_name, 0 AS indexed_iris FROM trips JOIN (SELECT id, trip_id, arg_min(pid, (ts, pid)) AS arg_min_pid, arg_max(pid, (ts, pid)) AS arg_max_pid FROM cut GROUP BY 1, 2) USING (id, trip_id)", ("trips", "cut"))
def trip_documents(spark, d):
    return TR.trip_documents(trips(spark, d), "node1").drop("day", "km", "km_straight")


@query("both_ends", "SELECT id, CAST(2 * count(*) AS INTEGER) AS places FROM trips GROUP BY 1", "trips")
def both_ends(spark, d):
    return TR.both_ends(TR.grouped_edges(trips(spark, d))).select("id", F.size("places").alias("places"))


@query("colour_or_black", "SELECT DISTINCT kind, CASE WHEN starts_with(c, '#') THEN c ELSE '#000000' END AS c FROM (SELECT kind, CASE WHEN kind < 'p' THEN '#' || kind ELSE kind END AS c FROM gps)", "gps")
def colour_or_black(spark, d):
    from ..functions.traffic import colour_or_black as rule

    k = V.gps(spark, d).select("kind").distinct()
    return k.select("kind", rule(F.when(F.col("kind") < "p", F.concat(F.lit("#"), F.col("kind"))).otherwise(F.col("kind"))).alias("c"))


@query("multi_key_sort", "SELECT road, kind, n, row_number() OVER (ORDER BY n DESC, kind, road) AS r FROM (SELECT road, kind, count(*) AS n FROM gps GROUP BY 1, 2)", "gps")
def multi_key_sort(spark, d):
    """All (road, kind) groups with their rank in order of three keys."""
    from pyspark.sql import Window

    c = V.gps(spark, d).groupBy("road", "kind").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "kind", "road")).cast("long"))
