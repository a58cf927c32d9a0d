"""Views of the driver's tables in the shape of the domain, in Spark and as SQL.

There are no GPS data among the tables, so events stand for points, lineitems
for road nodes, nations for zones and roads, parts for speed limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEST, SOUTH = -1.7626, 48.0632


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lon(k: Column) -> Column:
    return F.lit(WEST) + (k * 7919 % 2167) / F.lit(10000.0)


def _lat(k: Column) -> Column:
    return F.lit(SOUTH) + (k * 104729 % 1025) / F.lit(10000.0)


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("pid"), F.col("user_id").alias("id"), "ts", F.when(F.col("value") < 15, 0.0).otherwise(F.col("value")).alias("speed"),
        (k % 40).alias("road"), (k % 2).cast("int").alias("heading_road"), (k * 37 % 360).cast("double").alias("heading"),
        _lon(k).alias("lon"), _lat(k).alias("lat"), F.col("event_type").alias("kind"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly speeds by event type; values below 15 are no measurement."""
    start = F.window("ts", "60 minutes")["start"].alias("ts")
    v = F.when(F.col("value") >= 15, F.col("value"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("segment"), start).agg(F.avg(v).alias("speed"), F.count(F.lit(1)).alias("cnt"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reshape import densify

    return densify(series(spark, sf_dir), "segment", 60, ts="ts")


def segment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("segment")).distinct()
    return s.withColumn("grp", F.when(F.col("segment").isin("click", "view"), "browse").otherwise("act"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(size == 50, "50+").when(size % 10 == 0, "none").otherwise(size.cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("road"), text.alias("limit"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(k.alias("node"), _lon(k).alias("lon"), _lat(k).alias("lat"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(ordered.alias("n"))
    w = w.select("way", F.transform("n", lambda s: s["l_partkey"].cast("long")).alias("nodes"))
    coords = F.transform("nodes", lambda k: F.struct(_lon(k).alias("lon"), _lat(k).alias("lat")))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("way"), F.col("o_orderpriority").alias("highway"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0).alias("oneway"),
        (F.col("o_custkey") % 130).cast("string").alias("limit"),
    )
    return w.withColumn("coords", coords).join(o, "way")


def way_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of a way's lines by weekday of shipping, as (way, slot, speed): 7 slots, most unknown."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("way"), F.weekday("l_shipdate").alias("slot")).agg(F.avg("l_quantity").alias("speed"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 roads of two legs, diagonals through the cells of a 5 x 5 grid; every third is one-way, some against their nodes."""
    k = F.col("n_nationkey").cast("long")
    west, south = F.lit(WEST) + (k % 5) * F.lit(0.0434), F.lit(SOUTH) + F.floor(k / 5) * F.lit(0.0205)
    p = lambda dx, dy: F.struct((west + F.lit(dx)).alias("lon"), (south + F.lit(dy)).alias("lat"))
    return table(spark, sf_dir, "nation").select(
        k.alias("road"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "-1").alias("oneway"), F.array(p(0.0, 0.0), p(0.03, 0.008), p(0.0434, 0.0205)).alias("coords")
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rectangles of the same grid; the last row and column are open to the box's edge."""
    k = F.col("n_nationkey").cast("long")
    west, south = F.lit(WEST) + (k % 5) * F.lit(0.0434), F.lit(SOUTH) + F.floor(k / 5) * F.lit(0.0205)
    p = lambda dx, dy: F.struct((west + F.lit(dx)).alias("lon"), (south + F.lit(dy)).alias("lat"))
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("zone"), F.col("n_regionkey").cast("string").alias("dept"), F.array(p(0.0, 0.0), p(0.04, 0.0), p(0.04, 0.0205), p(0.0, 0.0205)).alias("ring")
    )


def od_trip_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips between nations: a customer's order line shipped by a supplier."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        F.col("c_nationkey").alias("begin_zone"), F.col("s_nationkey").alias("end_zone"), F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate")).alias("dur_s"),
        F.col("l_discount").alias("begin_speed"), F.col("l_tax").alias("end_speed"),
    )


def hour_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hours of the day that have events, linked to the next hour: a path of at most 24 nodes."""
    h = table(spark, sf_dir, "events").select(F.hour("ts").alias("h")).distinct()
    seg = lambda c: F.concat(F.lit("h"), c.cast("string"))
    n = h.select(seg(F.col("h")).alias("segment"))
    e = h.join(h.select((F.col("h") - 1).alias("h"), F.col("h").alias("g")), "h").select(seg(F.col("h")).alias("src"), seg(F.col("g")).alias("dst"))
    return n, e


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three baselines on the hourly series as (model, segment, ts, y, pred)."""
    from ..operators import models

    s = series(spark, sf_dir).filter("speed is not null")
    named = {"last": models.last_value(s), "historic": models.historic_mean(s), "clock": models.clock_mean(s)}
    out = None
    for name, df in named.items():
        part = df.filter("pred is not null").select(F.lit(name).alias("model"), "segment", "ts", "y", "pred")
        out = part if out is None else out.unionByName(part)
    return out


CTES: dict[str, str] = {
    "gps": f"""SELECT event_id AS pid, user_id AS id, ts, CASE WHEN value < 15 THEN 0.0 ELSE value END AS speed,
      event_id % 40 AS road, CAST(event_id % 2 AS INTEGER) AS heading_road, CAST(event_id * 37 % 360 AS DOUBLE) AS heading,
      {WEST} + (event_id * 7919 % 2167) / CAST(10000 AS DOUBLE) AS lon, {SOUTH} + (event_id * 104729 % 1025) / CAST(10000 AS DOUBLE) AS lat, event_type AS kind FROM events""",
    "series": """SELECT event_type AS segment, time_bucket(INTERVAL '60 minutes', ts) AS ts, avg(value) FILTER (value >= 15) AS speed, count(*) AS cnt FROM events GROUP BY 1, 2""",
    "dense": """SELECT k.segment, g.ts, s.speed, s.cnt FROM (SELECT DISTINCT segment FROM series) k
      CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL '60 minutes')) AS ts FROM series) g LEFT JOIN series s ON s.segment = k.segment AND s.ts = g.ts""",
    "segmap": """SELECT DISTINCT event_type AS segment, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'act' END AS grp FROM events""",
    "limits": """SELECT CAST(p_partkey AS BIGINT) AS road, CASE WHEN p_size = 50 THEN '50+' WHEN p_size % 10 = 0 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS lim FROM part""",
    "nodes": f"""SELECT CAST(p_partkey AS BIGINT) AS node, {WEST} + (p_partkey * 7919 % 2167) / CAST(10000 AS DOUBLE) AS lon, {SOUTH} + (p_partkey * 104729 % 1025) / CAST(10000 AS DOUBLE) AS lat FROM part""",
    "ways": """SELECT w.way, w.nodes, o.o_orderpriority AS highway, CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS oneway, CAST(o.o_custkey % 130 AS VARCHAR) AS lim
      FROM (SELECT l_orderkey AS way, list(CAST(l_partkey AS BIGINT) ORDER BY l_linenumber, l_partkey) AS nodes FROM lineitem GROUP BY 1) w JOIN orders o ON o.o_orderkey = w.way""",
    "segs": """SELECT way, way || '_0' AS segment, nodes, highway, lim FROM ways UNION ALL SELECT way, way || '_1', list_reverse(nodes), highway, lim FROM ways WHERE oneway = 0""",
    "ends": """SELECT segment, nodes, nodes[1] AS first, nodes[-1] AS last FROM segs""",
    "roads": f"""SELECT CAST(n_nationkey AS BIGINT) AS road, CASE WHEN n_nationkey % 3 = 0 THEN 'yes' WHEN n_nationkey % 3 = 1 THEN '-1' END AS oneway,
      {WEST} + (n_nationkey % 5) * CAST(0.0434 AS DOUBLE) AS west, {SOUTH} + (n_nationkey // 5) * CAST(0.0205 AS DOUBLE) AS south FROM nation""",
    "legs": """SELECT road, oneway, west, south, 0 AS leg, west + 0.0 AS lon1, south + 0.0 AS lat1, west + CAST(0.03 AS DOUBLE) AS lon2, south + CAST(0.008 AS DOUBLE) AS lat2 FROM roads
      UNION ALL SELECT road, oneway, west, south, 1, west + CAST(0.03 AS DOUBLE), south + CAST(0.008 AS DOUBLE), west + CAST(0.0434 AS DOUBLE), south + CAST(0.0205 AS DOUBLE) FROM roads""",
    "odt": """SELECT c_nationkey AS begin_zone, s_nationkey AS end_zone, date_diff('second', o_orderdate, l_shipdate) AS dur_s, l_discount AS begin_speed, l_tax AS end_speed
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "hours": """SELECT DISTINCT CAST(extract(hour FROM ts) AS INTEGER) AS h FROM events""",
    "edges": """SELECT 'h' || a.h AS src, 'h' || b.h AS dst FROM hours a JOIN hours b ON b.h = a.h + 1""",
    "known": """SELECT * FROM series WHERE speed IS NOT NULL""",
    "kdays": """SELECT d, row_number() OVER (ORDER BY d) AS day_no, count(*) OVER () AS days FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM known)""",
    "marked": """SELECT k.*, d.day_no <= floor(0.7 * d.days) AS train, extract(hour FROM k.ts) * 3600 AS tod FROM known k JOIN kdays d ON CAST(k.ts AS DATE) = d.d""",
    "preds": """SELECT 'last' AS model, segment, ts, speed AS y, lag(speed) OVER (PARTITION BY segment, CAST(ts AS DATE) ORDER BY ts) AS pred FROM known
      UNION ALL SELECT 'historic', segment, ts, speed, pred FROM (SELECT *, avg(speed) FILTER (train) OVER (PARTITION BY segment) AS pred FROM marked) WHERE NOT train
      UNION ALL SELECT 'clock', segment, ts, speed, pred FROM (SELECT *, avg(speed) FILTER (train) OVER (PARTITION BY segment, tod) AS pred FROM marked) WHERE NOT train""",
    "fc": """SELECT * FROM preds WHERE pred IS NOT NULL""",
    "gaps": """SELECT *, coalesce(sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, pid), 0) AS seg FROM
      (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY id ORDER BY ts, pid))) / 1e6 AS gap FROM gps)""",
    "runs0": """SELECT *, speed > 0 AS moving, lag(speed > 0) OVER w AS m0, lag(ts) OVER w AS before, lead(ts) OVER w AS after, row_number() OVER w AS n FROM gaps WINDOW w AS (PARTITION BY id, seg ORDER BY ts, pid)""",
    "runs": """SELECT *, sum(CASE WHEN m0 <> moving THEN 1 ELSE 0 END) OVER (PARTITION BY id, seg ORDER BY ts, pid) AS run FROM runs0""",
    "starts": """SELECT *, min(ts) OVER (PARTITION BY id, seg, run) AS began, max(run) OVER (PARTITION BY id, seg) AS last_run FROM runs""",
    "stops": """SELECT *, CASE WHEN last_run > 0 AND m0 IS NOT NULL AND NOT m0 AND moving THEN lag(began) OVER w WHEN last_run > 0 AND after IS NULL AND NOT moving THEN began END AS stop_from,
      (epoch_us(ts) - epoch_us(before)) / 1e6 AS step FROM starts WINDOW w AS (PARTITION BY id, seg ORDER BY ts, pid)""",
    "cuts0": """SELECT *, coalesce((epoch_us(ts) - epoch_us(stop_from)) / 1e6 > 36000, false) AS long_stop, coalesce(step < 300 * 60, false) AS near FROM stops""",
    "cuts": """SELECT *, (n = 1 AND seg > 0) OR (long_stop AND NOT near) OR coalesce(lead(long_stop AND near) OVER (PARTITION BY id, seg ORDER BY ts, pid), false) AS cut FROM cuts0""",
    "cut": """SELECT pid, id, ts, speed, road, heading_road, heading, lon, lat, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, pid) AS BIGINT) AS trip_id FROM cuts""",
    "leg": """SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS leg_s, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, row_number() OVER w AS rn FROM cut WINDOW w AS (PARTITION BY id, trip_id ORDER BY ts, pid)""",
    "trips": """SELECT *, date_trunc('day', t0)::DATE AS day, (epoch_us(t1) - epoch_us(t0)) / 1e6 AS dur_s, HAV(lon_b, lat_b, lon_e, lat_e) AS km_straight FROM
      (SELECT id, trip_id, count(*) AS points, min(ts) AS t0, max(ts) AS t1, arg_min(lon, (ts, pid)) AS lon_b, arg_min(lat, (ts, pid)) AS lat_b, arg_max(lon, (ts, pid)) AS lon_e, arg_max(lat, (ts, pid)) AS lat_e,
       arg_min(speed, (ts, pid)) AS speed_b, arg_max(speed, (ts, pid)) AS speed_e, avg(speed) AS mean_speed, coalesce(sum(1.24 * HAV(lon0, lat0, lon, lat)), 0) AS km,
       max(CASE WHEN rn = 2 THEN leg_s END) AS first_s, max(CASE WHEN rn = 2 THEN 1.24 * HAV(lon0, lat0, lon, lat) END) AS first_km, list(DISTINCT road) AS roads FROM leg GROUP BY 1, 2)""",
}

_NEEDS = {
    "dense": ["series"], "segs": ["ways"], "ends": ["segs"], "legs": ["roads"], "edges": ["hours"], "known": ["series"], "kdays": ["known"], "marked": ["known", "kdays"],
    "preds": ["known", "marked"], "fc": ["preds"], "gaps": ["gps"], "runs0": ["gaps"], "runs": ["runs0"], "starts": ["runs"], "stops": ["starts"], "cuts0": ["stops"],
    "cuts": ["cuts0"], "cut": ["cuts"], "leg": ["cut"], "trips": ["leg"],
}


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * 6371.0088 * asin(sqrt(CASE WHEN {a} > 1 THEN 1.0 ELSE {a} END)))"


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """The query behind its views as common table expressions; HAV(a, b, c, d) is the haversine distance in km."""
    order: list[str] = []

    def need(v: str) -> None:
        for n in _NEEDS.get(v, []):
            need(n)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    own = sql.startswith("WITH ")
    ctes = ",\n".join(f"{v} AS ({CTES[v]})" for v in order)
    text = f"WITH {ctes}{',' if own else ''}\n{sql[5:] if own else sql}" if order else sql
    while "HAV(" in text:
        at = text.index("HAV(")
        end = text.index(")", at)
        text = text[:at] + haversine_sql(*(x.strip() for x in text[at + 4 : end].split(","))) + text[end + 1 :]
    return text
