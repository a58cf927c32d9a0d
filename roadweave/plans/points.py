"""Scans, filters, counts, speed matrices and congestion on points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..functions import traffic
from ..operators import points as P
from ..operators import reshape
from ..sources import logs
from . import views as V
from .registry import query

GPS_COLS = "pid, id, ts, speed, road, heading_road, heading, lon, lat, kind"


@query("load_raw", f"SELECT {GPS_COLS} FROM gps", "gps", ("lon", "lat"))
def load_raw(spark, d):
    return V.gps(spark, d)


@query("load_projected", "SELECT event_id AS pid, ts, value FROM events")
def load_projected(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("pid"), "ts", "value")


@query("range_scan", f"SELECT {GPS_COLS} FROM gps WHERE ts >= TIMESTAMP '2024-01-10 16:00:00' AND ts < TIMESTAMP '2024-01-10 21:00:00'", "gps", ("lon", "lat"))
def range_scan(spark, d):
    return P.time_range(V.gps(spark, d), "2024-01-10 16:00:00", "2024-01-10 21:00:00")


@query("find_one", "SELECT pid, id, speed FROM gps WHERE road = 7 ORDER BY ts, pid LIMIT 1", "gps")
def find_one(spark, d):
    return logs.find_one(V.gps(spark, d), F.col("road") == 7, "ts", "pid").select("pid", "id", "speed")


@query("geo_within_box", "SELECT pid, id FROM gps WHERE lon BETWEEN -1.70 AND -1.60 AND lat BETWEEN 48.08 AND 48.13", "gps")
def geo_within_box(spark, d):
    from ..functions.geo import in_box

    return V.gps(spark, d).filter(in_box(F.col("lon"), F.col("lat"), (-1.70, 48.08, -1.60, 48.13))).select("pid", "id")


@query("hour_filter", "SELECT pid, id FROM gps WHERE extract(hour FROM ts) >= 14 AND extract(hour FROM ts) < 19", "gps")
def hour_filter(spark, d):
    return P.hour_filter(V.gps(spark, d), 14, 19).select("pid", "id")


@query("clock_filter", "SELECT pid FROM gps WHERE extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) > 61200 AND extract(hour FROM ts) < 20", "gps")
def clock_filter(spark, d):
    return V.gps(spark, d).filter(T.between_clocks(F.col("ts"), 61200, 72000, strict=True)).select("pid")


@query("matched_points", "SELECT count(*) AS n FROM gps WHERE road IS NOT NULL", "gps")
def matched_points(spark, d):
    return P.matched(V.gps(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("semi_join", "SELECT pid, road FROM gps WHERE road IN (SELECT road FROM roads WHERE oneway IS NULL)", ("gps", "roads"))
def semi_join(spark, d):
    return P.on_roads(V.gps(spark, d), V.roads(spark, d).filter("oneway is null")).select("pid", "road")


@query("anti_join", "SELECT pid, road FROM gps WHERE road NOT IN (SELECT road FROM roads)", ("gps", "roads"))
def anti_join(spark, d):
    return V.gps(spark, d).join(V.roads(spark, d), "road", "left_anti").select("pid", "road")


@query("points_per_15min", "SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, min(ts) AS first FROM gps GROUP BY 1", "gps")
def points_per_15min(spark, d):
    return P.counts_per_interval(V.gps(spark, d), 15)


@query("points_per_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM gps GROUP BY 1", "gps", dates="day")
def points_per_day(spark, d):
    return P.points_per_day(V.gps(spark, d))


@query("cars_per_day", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT id) AS cars FROM gps GROUP BY 1", "gps", dates="day")
def cars_per_day(spark, d):
    return P.cars_per_day(V.gps(spark, d))


@query("avg_speed_global", "SELECT avg(speed) AS avg_speed FROM gps", "gps", "avg_speed")
def avg_speed_global(spark, d):
    return P.average_speed(V.gps(spark, d))


@query("avg_speed_day", "SELECT CAST(ts AS DATE) AS day, avg(speed) AS avg_speed FROM gps GROUP BY 1", "gps", "avg_speed", dates="day")
def avg_speed_day(spark, d):
    return P.average_speed(V.gps(spark, d), "day")


@query("avg_speed_road_day", "SELECT CAST(ts AS DATE) AS day, road, avg(speed) AS avg_speed FROM gps GROUP BY 1, 2", "gps", "avg_speed", dates="day")
def avg_speed_road_day(spark, d):
    return P.average_speed(V.gps(spark, d), "day", "road")


@query(
    "remove_aberrant",
    "SELECT pid, id, speed FROM (SELECT *, speed = 0 AS still, time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01') AS b FROM gps) "
    "QUALIFY NOT still OR count(*) OVER (PARTITION BY road, id, b, still) <= 1 OR row_number() OVER (PARTITION BY road, id, b, still ORDER BY ts, pid) = 1",
    "gps",
)
def remove_aberrant(spark, d):
    return P.remove_aberrant(V.gps(spark, d), 43200, 1).select("pid", "id", "speed")


@query(
    "aberrant_points",
    "SELECT pid, id FROM (SELECT *, time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01') AS b FROM gps WHERE speed = 0) "
    "QUALIFY count(*) OVER (PARTITION BY road, id, b) > 1 AND row_number() OVER (PARTITION BY road, id, b ORDER BY ts, pid) > 1",
    "gps",
)
def aberrant_points(spark, d):
    return P.aberrant(V.gps(spark, d), 43200, 1).select("pid", "id")


@query("points_per_road", "SELECT road, count(*) AS n FROM gps GROUP BY 1", "gps")
def points_per_road(spark, d):
    return P.points_per_road(V.gps(spark, d))


@query("top_k_roads", "SELECT road, count(*) AS n FROM gps GROUP BY 1 ORDER BY n DESC, road LIMIT 15", "gps")
def top_k_roads(spark, d):
    return P.top_roads(V.gps(spark, d), 15)


@query("road_size_class", "SELECT CAST(floor(log10(n)) AS INTEGER) AS size_class, count(*) AS roads FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def road_size_class(spark, d):
    return P.size_classes(P.points_per_road(V.table(spark, d, "lineitem").withColumnRenamed("l_partkey", "road")))


@query(
    "road_size_class_common",
    "WITH c AS (SELECT CAST(floor(log10(n)) AS INTEGER) AS size_class, count(*) AS roads FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1) "
    "SELECT * FROM c QUALIFY row_number() OVER (ORDER BY roads, size_class DESC) > 1",
)
def road_size_class_common(spark, d):
    return P.size_classes(P.points_per_road(V.table(spark, d, "lineitem").withColumnRenamed("l_partkey", "road")), drop_rarest=True)


@query("cars_per_road", "SELECT road, count(DISTINCT id) AS n FROM gps GROUP BY 1", "gps")
def cars_per_road(spark, d):
    return P.cars_per_road(V.gps(spark, d))


@query("cars_per_road_class", "SELECT CAST(floor(log10(n)) AS INTEGER) AS size_class, count(*) AS roads FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def cars_per_road_class(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("road"), F.col("l_suppkey").alias("id"))
    return P.size_classes(P.cars_per_road(li))


@query("headings_per_road", "SELECT road, array_to_string(list(CAST(heading AS BIGINT) ORDER BY heading), ',') AS headings, count(*) AS n FROM gps GROUP BY 1", "gps")
def headings_per_road(spark, d):
    h = P.headings_per_road(V.gps(spark, d))
    return h.withColumn("headings", F.array_join(F.transform("headings", lambda x: x.cast("long").cast("string")), ","))


@query("segment_counts", "SELECT road, count(*) AS points, count(DISTINCT id) AS cars FROM gps GROUP BY 1", "gps")
def segment_counts(spark, d):
    return P.segment_counts(V.gps(spark, d))


@query("distinct_devices", "SELECT count(DISTINCT id) AS devices FROM gps WHERE road IN (SELECT road FROM roads)", ("gps", "roads"))
def distinct_devices(spark, d):
    return P.distinct_devices(V.gps(spark, d), V.roads(spark, d))


@query("speed_matrix", "SELECT road, heading_road, time_bucket(INTERVAL '360 minutes', ts) AS start, avg(speed) AS speed, count(*) AS cnt FROM gps GROUP BY 1, 2, 3", "gps", "speed")
def speed_matrix(spark, d):
    return P.speed_long(V.gps(spark, d), 360)


@query(
    "speed_matrix_offset",
    "SELECT road, heading_road, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01 00:10:00') AS start, avg(speed) AS speed, count(*) AS cnt FROM gps GROUP BY 1, 2, 3",
    "gps",
    "speed",
)
def speed_matrix_offset(spark, d):
    return P.speed_long(V.gps(spark, d), 15, 10)


USERS_SQL = """SELECT segment, start, avg(s) AS speed, stddev_samp(s) AS std, count(*) AS cars FROM
  (SELECT road || '_' || heading_road AS segment, id, time_bucket(INTERVAL '{m} minutes', ts) AS start, avg(speed) AS s FROM gps GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("speed_matrix_per_user", USERS_SQL.format(m=1440), "gps", ("speed", "std"))
def speed_matrix_per_user(spark, d):
    return P.speed_of_users(P.speed_per_user(V.gps(spark, d), 1440))


@query(
    "speed_per_user",
    "SELECT road || '_' || heading_road AS segment, id, time_bucket(INTERVAL '360 minutes', ts) AS start, avg(speed) AS speed, count(*) AS cnt FROM gps GROUP BY 1, 2, 3",
    "gps",
    "speed",
)
def speed_per_user(spark, d):
    return P.speed_per_user(V.gps(spark, d), 360)


LEVELS_SQL = f"""SELECT q.segment, q.start, q.road, r.lim AS "limit", q.speed, q.speed / v.lim AS ratio,
  CASE WHEN v.lim IS NULL OR q.speed IS NULL THEN -1 WHEN q.speed / v.lim < 0.25 THEN 0 WHEN q.speed / v.lim < 0.70 THEN 1 ELSE 2 END AS level
  FROM (SELECT *, CAST(split_part(segment, '_', 1) AS BIGINT) AS road FROM ({USERS_SQL.format(m=360)})) q LEFT JOIN limits r ON r.road = q.road
  LEFT JOIN (SELECT road, CASE WHEN lim = '50+' THEN 50.0 ELSE TRY_CAST(lim AS DOUBLE) END AS lim FROM limits) v ON v.road = q.road"""


def levels(spark, d):
    per_day = P.speed_of_users(P.speed_per_user(V.gps(spark, d), 360))
    return P.with_congestion(per_day, V.limits(spark, d))


@query("congestion_level", LEVELS_SQL, ("gps", "limits"), ("speed", "ratio"))
def congestion_level(spark, d):
    """Speed matrix per user, joined with limits, as congestion levels."""
    return levels(spark, d).select("segment", "start", "road", "limit", "speed", "ratio", "level")


@query("congestion_counts", f"SELECT level, count(*) AS n FROM ({LEVELS_SQL}) GROUP BY 1", ("gps", "limits"))
def congestion_counts(spark, d):
    return P.congestion_counts(levels(spark, d))


@query("roads_by_congestion", f"SELECT DISTINCT road FROM ({LEVELS_SQL}) WHERE level = 0", ("gps", "limits"))
def roads_by_congestion(spark, d):
    return P.roads_by_congestion(levels(spark, d), 0)


@query("speed_limit_join", "SELECT g.pid, g.road, l.lim AS \"limit\" FROM gps g LEFT JOIN limits l ON l.road = g.road", ("gps", "limits"))
def speed_limit_join(spark, d):
    return V.gps(spark, d).join(V.limits(spark, d), "road", "left").select("pid", "road", "limit")


@query(
    "sliding_speed",
    "SELECT road, heading_road, start, avg(speed) AS speed, count(*) AS cnt FROM (SELECT *, unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes', time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '10 minutes']) AS start FROM gps) GROUP BY 1, 2, 3",
    "gps",
    "speed",
)
def sliding_speed(spark, d):
    return P.speed_long_sliding(V.gps(spark, d), 15, 5)


DEC = ", ".join(f"quantile_cont(n, {k / 10}) AS d{k}" for k in range(11))


@query(
    "road_count_deciles",
    f"SELECT road, count(*) AS slots, {DEC} FROM (SELECT road, time_bucket(INTERVAL '1440 minutes', ts) AS b, count(*) AS n FROM gps GROUP BY 1, 2) GROUP BY 1",
    "gps",
    tuple(f"d{k}" for k in range(11)),
)
def road_count_deciles(spark, d):
    q = P.quantiles_by_road(V.gps(spark, d), 1440)
    return q.select("road", "slots", *[F.get("deciles", F.lit(k)).alias(f"d{k}") for k in range(11)])


@query("day_hour_density", "SELECT CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS hour, count(*) AS n, avg(speed) AS speed FROM gps GROUP BY 1, 2", "gps", "speed", dates="day")
def day_hour_density(spark, d):
    return P.density_by(V.gps(spark, d), "day", "hour")


SLOT = "CAST(extract(hour FROM ts) * 4 + extract(minute FROM ts) // 15 AS INTEGER)"


@query("segment_density", f"SELECT road, CAST(ts AS DATE) AS day, {SLOT} AS slot, count(*) AS n, avg(speed) AS speed FROM gps GROUP BY 1, 2, 3", "gps", "speed", dates="day")
def segment_density(spark, d):
    return P.density_by(V.gps(spark, d), "road", "day", "slot")


def _minute_means(k: int) -> None:
    sql = f"SELECT CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) // {k} * {k} AS INTEGER) AS m, avg(speed) AS speed, count(*) AS n FROM gps GROUP BY 1, 2"

    @query(f"minute_means_{k}", sql, "gps", "speed")
    def run(spark, d):
        return P.minute_means(V.gps(spark, d), k)


for _k in (1, 3, 5, 10, 15):
    _minute_means(_k)


@query(
    "hourly_profile",
    """SELECT CAST(extract(hour FROM start) AS INTEGER) AS hour, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS low, max(n) AS high, quantile_cont(n, 0.5) AS median,
      avg(n) FILTER (isodow(start) < 6) AS weekday_mean, avg(n) FILTER (isodow(start) >= 6) AS weekend_mean
      FROM (SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n FROM gps GROUP BY 1) GROUP BY 1""",
    "gps",
    ("mean", "std", "median", "weekday_mean", "weekend_mean"),
)
def hourly_profile(spark, d):
    return P.hourly_profile(V.gps(spark, d))


@query(
    "describe_by_group",
    """SELECT kind, count(speed) AS count, avg(speed) AS mean, stddev_samp(speed) AS std, min(speed) AS min, quantile_cont(speed, 0.25) AS q25, quantile_cont(speed, 0.5) AS q50,
      quantile_cont(speed, 0.75) AS q75, max(speed) AS max FROM gps GROUP BY 1""",
    "gps",
    ("mean", "std", "q25", "q50", "q75"),
)
def describe_by_group(spark, d):
    return P.describe_by(V.gps(spark, d), "kind", "speed")


AT = "SELECT id, road, time_bucket(INTERVAL '360 minutes', ts) AS start, count(*) AS n FROM gps GROUP BY 1, 2, 3"
DIFFUSION = f"""SELECT src, dst, CAST(sum(c) AS BIGINT) AS cnt FROM (SELECT a.road AS src, b.road AS dst, b.n AS c FROM ({AT}) a JOIN ({AT}) b ON a.id = b.id AND b.start = a.start + INTERVAL '360 minutes'
  UNION ALL SELECT road, road, 1 FROM (SELECT DISTINCT road FROM gps)) GROUP BY 1, 2"""


@query("diffusion", DIFFUSION, "gps")
def diffusion(spark, d):
    return P.diffusion(V.gps(spark, d), 360)


@query("diffusion_normalised", f"SELECT src, dst, cnt / sum(cnt) OVER (PARTITION BY dst) AS cnt FROM ({DIFFUSION})", "gps", "cnt")
def diffusion_normalised(spark, d):
    return P.diffusion(V.gps(spark, d), 360, normalise=True)


@query(
    "cross_flow",
    f"WITH f AS ({DIFFUSION}), r AS (SELECT DISTINCT road FROM gps) SELECT a.road AS src, b.road AS dst, coalesce(f.cnt, 0) AS cnt FROM r a CROSS JOIN r b LEFT JOIN f ON f.src = a.road AND f.dst = b.road",
    "gps",
)
def cross_flow(spark, d):
    return P.cross_flow(P.diffusion(V.gps(spark, d), 360))


@query(
    "prev_next_presence",
    """WITH s AS (SELECT DISTINCT id, time_bucket(INTERVAL '360 minutes', ts) AS start FROM gps)
      SELECT s.start, count(*) AS now, count(b.id) AS before, count(a.id) AS after FROM s LEFT JOIN s b ON b.id = s.id AND b.start = s.start - INTERVAL '360 minutes'
      LEFT JOIN s a ON a.id = s.id AND a.start = s.start + INTERVAL '360 minutes' GROUP BY 1""",
    "gps",
)
def prev_next_presence(spark, d):
    return P.presence_of_neighbours(V.gps(spark, d), 360)


# --- scalar functions on points -------------------------------------------


@query("time_bucket", "SELECT pid, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01 00:10:00') AS start FROM gps", "gps")
def time_bucket(spark, d):
    return V.gps(spark, d).select("pid", T.bucket_start(F.col("ts"), 15, 10).alias("start"))


@query("slot_of_day", "SELECT pid, CAST(extract(hour FROM ts) * 6 + extract(minute FROM ts) // 10 AS INTEGER) AS slot FROM gps", "gps")
def slot_of_day(spark, d):
    return V.gps(spark, d).select("pid", T.slot_of_day(F.col("ts"), 10).alias("slot"))


@query(
    "date_parts",
    """SELECT pid, CAST(extract(month FROM ts) AS INTEGER) AS month, CAST(extract(day FROM ts) AS INTEGER) AS dom, CAST(extract(hour FROM ts) AS INTEGER) AS hour,
      CAST(extract(minute FROM ts) AS INTEGER) AS minute, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(ts AS DATE) AS day FROM gps""",
    "gps",
    dates="day",
)
def date_parts(spark, d):
    ts = F.col("ts")
    return V.gps(spark, d).select("pid", F.month(ts).alias("month"), F.dayofmonth(ts).alias("dom"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.weekday(ts).alias("weekday"), T.day(ts).alias("day"))


SOD = "CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS INTEGER)"


@query("seconds_of_day", f"SELECT pid, {SOD} AS s, strftime(ts, '%H:%M:%S') AS clock, {SOD} // 900 AS quarter FROM gps", "gps")
def seconds_of_day(spark, d):
    s = T.seconds_of_day(F.col("ts"))
    return V.gps(spark, d).select("pid", s.alias("s"), T.clock(s).alias("clock"), T.quarter_index(F.col("ts")).alias("quarter"))


@query("day_types", f"SELECT pid, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, {SOD} / 3600.0 AS hour, CAST(floor(({SOD} / 3600.0 - 14) * 4) = 5 AS INTEGER) AS slot_5 FROM gps", "gps", "hour")
def day_types(spark, d):
    ts = F.col("ts")
    return V.gps(spark, d).select("pid", F.weekday(ts).alias("weekday"), T.fractional_hour(ts).alias("hour"), T.slot_one_hot(ts, 14, 5)[5])


@query("congestion_formula", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -1 WHEN p_retailprice / (p_size * 50) < 0.25 THEN 0 WHEN p_retailprice / (p_size * 50) < 0.70 THEN 1 ELSE 2 END AS level FROM part")
def congestion_formula(spark, d):
    limit = F.when(F.col("p_size") % 7 == 0, "walk").otherwise((F.col("p_size") * 50).cast("string"))
    return V.table(spark, d, "part").select("p_partkey", traffic.congestion_level(traffic.congestion(F.col("p_retailprice"), limit)).alias("level"))


@query("cast_speed", "SELECT road, CASE WHEN lim = '50+' THEN 50.0 ELSE TRY_CAST(lim AS DOUBLE) END AS v FROM limits", "limits")
def cast_speed(spark, d):
    return V.limits(spark, d).select("road", traffic.cast_speed(F.col("limit")).alias("v"))


@query(
    "max_speed",
    "SELECT g.road, coalesce(max(CASE WHEN l.lim = '50+' THEN 50.0 ELSE TRY_CAST(l.lim AS DOUBLE) END), max(g.speed)) AS v FROM gps g LEFT JOIN limits l ON l.road = g.road GROUP BY 1",
    ("gps", "limits"),
    "v",
)
def max_speed(spark, d):
    top = V.gps(spark, d).groupBy("road").agg(F.max("speed").alias("top"))
    return top.join(V.limits(spark, d), "road", "left").select("road", F.coalesce(traffic.cast_speed(F.col("limit")), "top").alias("v"))


@query(
    "weighted_speed",
    "SELECT segment, ts, CASE WHEN cnt >= 4 THEN speed ELSE cnt / 4.0 * speed + (1 - cnt / 4.0) * m END AS v FROM (SELECT *, avg(speed) OVER (PARTITION BY segment) AS m FROM known)",
    "known",
    "v",
)
def weighted_speed(spark, d):
    from pyspark.sql import Window

    s = V.series(spark, d).filter("speed is not null").withColumn("m", F.avg("speed").over(Window.partitionBy("segment")))
    return s.select("segment", "ts", traffic.weighted_speed(F.col("speed"), F.col("cnt"), F.col("m"), 4).alias("v"))


@query("fill_by_limit", "SELECT d.segment, d.ts, coalesce(d.speed, 50.0) AS speed FROM dense d", "dense", "speed")
def fill_by_limit(spark, d):
    return V.dense(spark, d).select("segment", "ts", F.coalesce("speed", F.lit(50.0)).alias("speed"))


@query("segment_key", "SELECT pid, road || '_' || heading_road AS segment FROM gps", "gps")
def segment_key(spark, d):
    return V.gps(spark, d).select("pid", traffic.segment_key(F.col("road"), F.col("heading_road")).alias("segment"))


@query("split_key", "SELECT segment, CAST(split_part(segment, '_', 1) AS BIGINT) AS road, CAST(split_part(segment, '_', 2) AS INTEGER) AS side FROM (SELECT DISTINCT road || '_' || heading_road AS segment FROM gps)", "gps")
def split_key(spark, d):
    s = V.gps(spark, d).select(traffic.segment_key(F.col("road"), F.col("heading_road")).alias("segment")).distinct()
    return s.select("segment", traffic.road_of_key(F.col("segment")).alias("road"), traffic.heading_of_key(F.col("segment")).alias("side"))


@query("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return V.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("clip_round", "SELECT event_id, least(greatest(value, 5.0), 90.0) AS v, CAST(round_even(value, 0) AS DOUBLE) AS r, floor(log10(value + 1)) AS l FROM events", rounded=("v",))
def clip_round(spark, d):
    v = F.col("value")
    return V.table(spark, d, "events").select("event_id", traffic.clip(v, 5.0, 90.0).alias("v"), traffic.round_half_even(v).alias("r"), F.floor(F.log10(v + 1)).cast("double").alias("l"))


# --- sets and shapes ------------------------------------------------------


@query("set_union", "SELECT DISTINCT id FROM gps WHERE kind = 'view' UNION SELECT id FROM gps WHERE kind = 'click'", "gps")
def set_union(spark, d):
    g = V.gps(spark, d)
    return g.filter("kind = 'view'").select("id").union(g.filter("kind = 'click'").select("id")).distinct()


@query("set_intersect", "SELECT id FROM gps WHERE kind = 'view' INTERSECT SELECT id FROM gps WHERE kind = 'error'", "gps")
def set_intersect(spark, d):
    g = V.gps(spark, d)
    return g.filter("kind = 'view'").select("id").intersect(g.filter("kind = 'error'").select("id"))


@query("set_except", "SELECT CAST(ts AS DATE) AS day, id FROM gps WHERE kind = 'view' EXCEPT SELECT CAST(ts AS DATE), id FROM gps WHERE kind = 'error'", "gps", dates="day")
def set_except(spark, d):
    g = V.gps(spark, d).withColumn("day", T.day(F.col("ts")))
    return g.filter("kind = 'view'").select("day", "id").subtract(g.filter("kind = 'error'").select("day", "id"))


@query("union_dedupe", "SELECT pid, 'inner' AS side FROM gps WHERE road < 20 UNION ALL SELECT pid, 'outer' FROM gps WHERE road >= 20 AND road < 30", "gps")
def union_dedupe(spark, d):
    g = V.gps(spark, d)
    return reshape.union_keep_first(g.filter("road < 20").select("pid", F.lit("inner").alias("side")), g.filter("road between 10 and 29").select("pid", F.lit("outer").alias("side")), "pid")


@query("speed_pivot", "SELECT segment, " + ", ".join(f"avg(speed) FILTER (extract(hour FROM ts) = {h}) AS h{h}" for h in range(6)) + " FROM series GROUP BY 1", "series", tuple(f"h{h}" for h in range(6)))
def speed_pivot(spark, d):
    s = V.series(spark, d).withColumn("slot", F.concat(F.lit("h"), F.hour("ts").cast("string")))
    return reshape.pivot_speeds(s, [f"h{h}" for h in range(6)])


@query("unpivot_counts", "SELECT road, 'points' AS name, count(*) AS value FROM gps GROUP BY 1 UNION ALL SELECT road, 'cars', count(DISTINCT id) FROM gps GROUP BY 1", "gps")
def unpivot_counts(spark, d):
    return reshape.unpivot(P.segment_counts(V.gps(spark, d)), ["road"], ["points", "cars"])


@query("densify_15min", "SELECT segment, ts, coalesce(speed, 0) AS speed, cnt FROM dense", "dense", "speed")
def densify_15min(spark, d):
    return reshape.densify(V.series(spark, d), "segment", 60, 0.0, ts="ts")


@query("last_n_slots", "SELECT segment, ts, cnt FROM series WHERE ts IN (SELECT DISTINCT ts FROM series ORDER BY ts DESC LIMIT 100)", "series")
def last_n_slots(spark, d):
    return reshape.last_n_slots(V.series(spark, d), 100, "ts").select("segment", "ts", "cnt")


@query("ffill", "SELECT segment, ts, last_value(speed IGNORE NULLS) OVER (PARTITION BY segment ORDER BY ts) AS speed FROM dense", "dense", "speed")
def ffill(spark, d):
    return reshape.forward_fill(V.dense(spark, d), "segment", "ts").select("segment", "ts", "speed")


@query("arg_min_pair", f"SELECT src, dst, cnt FROM ({DIFFUSION}) WHERE src <> dst ORDER BY cnt, src, dst LIMIT 1", "gps")
def arg_min_pair(spark, d):
    return reshape.arg_min(P.diffusion(V.gps(spark, d), 360).filter("src <> dst"), "cnt", "src", "dst")


@query("merge_lookup", "SELECT s.segment, m.grp, s.ts, s.cnt FROM series s JOIN segmap m ON m.segment = s.segment", ("series", "segmap"))
def merge_lookup(spark, d):
    return V.series(spark, d).join(V.segment_map(spark, d), "segment").select("segment", "grp", "ts", "cnt")


@query("period_union", "SELECT segment, ts, cnt, 'early' AS period FROM series WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT segment, ts, cnt, 'late' FROM series WHERE ts >= TIMESTAMP '2024-01-15'", "series")
def period_union(spark, d):
    s = V.series(spark, d).select("segment", "ts", "cnt")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return s.filter(F.col("ts") < cut).withColumn("period", F.lit("early")).unionByName(s.filter(F.col("ts") >= cut).withColumn("period", F.lit("late")))


@query("self_pivot_join", "SELECT a.road, a.n AS n_0, b.n AS n_1 FROM (SELECT road, count(*) n FROM gps WHERE heading_road = 0 GROUP BY 1) a JOIN (SELECT road // 2 AS r2, count(*) n FROM gps WHERE heading_road = 1 GROUP BY 1) b ON a.road // 2 = b.r2", "gps")
def self_pivot_join(spark, d):
    g = V.gps(spark, d)
    a = g.filter("heading_road = 0").groupBy("road").agg(F.count(F.lit(1)).alias("n_0"))
    b = g.filter("heading_road = 1").groupBy(F.floor(F.col("road") / 2).alias("r2")).agg(F.count(F.lit(1)).alias("n_1"))
    return a.join(b, F.floor(F.col("road") / 2) == F.col("r2")).select("road", "n_0", "n_1")
