"""Map matching, zones, road graph and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, traffic
from ..operators import graph as G
from ..operators import matching as M
from ..operators import merging
from ..storage import discard, materialize
from . import views as V
from .registry import query

# nearest point of a leg, clamped (t), as in functions.geo
NEAR = """WITH pr AS (SELECT g.pid, g.lon, g.lat, g.heading, l.*, greatest(0.0, least(1.0, ((g.lon - lon1) * (lon2 - lon1) + (g.lat - lat1) * (lat2 - lat1)) / ((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)))) AS t
  FROM gps g JOIN legs l ON g.lon BETWEEN lon1 - 0.03 AND lon2 + 0.03 AND g.lat BETWEEN lat1 - 0.01 AND lat2 + 0.01),
  onleg AS (SELECT *, lon1 + t * (lon2 - lon1) AS px, lat1 + t * (lat2 - lat1) AS py FROM pr),
  dist AS (SELECT *, 1000 * HAV(lon, lat, px, py) AS metres FROM onleg),
  best AS (SELECT * FROM dist WHERE metres <= 300 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY metres, road, leg) = 1),
  az AS (SELECT *, degrees(atan2(west + CAST(0.0434 AS DOUBLE) - west, south + CAST(0.0205 AS DOUBLE) - south)) AS a FROM best) """


def matched(spark, d):
    return M.nearest_road(V.gps(spark, d), V.roads(spark, d), 300.0)


@query(
    "map_match",
    NEAR + """SELECT g.pid, b.road, b.metres, CASE WHEN b.road IS NULL THEN NULL WHEN b.oneway IS NULL AND 180 - abs(abs(b.a - b.heading) - 180) > 90 THEN 1 ELSE 0 END AS heading_road FROM gps g LEFT JOIN az b ON b.pid = g.pid""",
    ("gps", "legs"),
    "metres",
    4,
)
def map_match(spark, d):
    """Nearest road within 300 m and direction of travel; SQL compares every point with every road."""
    return matched(spark, d).select("pid", "road", "metres", "heading_road")


@query("closest_point", NEAR + "SELECT pid, road, px AS on_lon, py AS on_lat FROM best", ("gps", "legs"), ("on_lon", "on_lat"))
def closest_point(spark, d):
    return matched(spark, d).filter("road is not null").select("pid", "road", "on_lon", "on_lat")


@query("match_counts", NEAR + "SELECT road, count(*) AS n FROM (SELECT b.road FROM gps g LEFT JOIN best b ON b.pid = g.pid) GROUP BY 1", ("gps", "legs"))
def match_counts(spark, d):
    return matched(spark, d).groupBy("road").agg(F.count(F.lit(1)).alias("n"))


@query("geo_near", "SELECT pid, 1000 * HAV(lon, lat, -1.6778, 48.1113) AS metres FROM gps WHERE 1000 * HAV(lon, lat, -1.6778, 48.1113) <= 1500 ORDER BY metres, pid LIMIT 1000", "gps", "metres", 4)
def geo_near(spark, d):
    return M.near_point(V.gps(spark, d), -1.6778, 48.1113, 1500).select("pid", "metres")


ZONES = f"""SELECT n_name AS zone, {V.WEST} + (n_nationkey % 5) * CAST(0.0434 AS DOUBLE) AS w, {V.SOUTH} + (n_nationkey // 5) * CAST(0.0205 AS DOUBLE) AS s FROM nation"""
IN_ZONE = f"SELECT g.pid, coalesce(min(z.zone), 'N/A') AS zone FROM gps g LEFT JOIN ({ZONES}) z ON g.lon >= w AND g.lon < w + CAST(0.04 AS DOUBLE) AND g.lat >= s AND g.lat < s + CAST(0.0205 AS DOUBLE) GROUP BY 1"


@query("zone_join", IN_ZONE, "gps")
def zone_join(spark, d):
    return M.zone_of_points(V.gps(spark, d), V.zones(spark, d)).select("pid", "zone")


@query("zone_counts", f"SELECT zone, count(*) AS n FROM ({IN_ZONE}) GROUP BY 1", "gps")
def zone_counts(spark, d):
    return M.zone_of_points(V.gps(spark, d), V.zones(spark, d)).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


# nearest of all legs (id, leg, lon1, lat1, lon2, lat2) to each point, by comparing every point with every leg
NEAREST = """pr AS (SELECT g.pid, g.lon, g.lat, l.*, greatest(0.0, least(1.0, ((g.lon - lon1) * (lon2 - lon1) + (g.lat - lat1) * (lat2 - lat1)) / ((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)))) AS t FROM gps g, {0} l),
  onleg AS (SELECT *, lon1 + t * (lon2 - lon1) AS px, lat1 + t * (lat2 - lat1) AS py FROM pr),
  near AS (SELECT *, 1000 * HAV(lon, lat, px, py) AS metres FROM onleg QUALIFY row_number() OVER (PARTITION BY pid ORDER BY 1000 * HAV(lon, lat, px, py), id, leg) = 1)"""
SIDES = ["w, s, w + 0.04, s", "w + 0.04, s, w + 0.04, s + 0.0205", "w + 0.04, s + 0.0205, w, s + 0.0205", "w, s + 0.0205, w, s"]
ZONE_LEGS = " UNION ALL ".join(
    f"SELECT zone AS id, {i} AS leg, " + ", ".join(f"{x.replace('0.04', 'CAST(0.04 AS DOUBLE)').replace('0.0205', 'CAST(0.0205 AS DOUBLE)')} AS {n}" for x, n in zip(side.split(", "), ("lon1", "lat1", "lon2", "lat2"))) + " FROM z"
    for i, side in enumerate(SIDES)
)


@query(
    "zone_within",
    f"WITH z AS ({ZONES}), zl AS ({ZONE_LEGS}), held AS ({IN_ZONE}), {NEAREST.format('zl')} "
    "SELECT h.pid, CASE WHEN h.zone <> 'N/A' THEN h.zone WHEN near.metres <= 200 THEN near.id ELSE 'N/A' END AS zone FROM held h JOIN near ON near.pid = h.pid",
    "gps",
)
def zone_within(spark, d):
    """Zone that holds the point, else the nearest within 200 m; SQL compares every point with every side."""
    return M.zone_within(V.gps(spark, d), V.zones(spark, d), 200.0).select("pid", "zone")


@query(
    "is_residential",
    f"WITH rl AS (SELECT road AS id, leg, lon1, lat1, lon2, lat2 FROM legs), {NEAREST.format('rl')} SELECT pid, id AS way, id % 4 = 0 AS residential FROM near",
    ("gps", "legs"),
)
def is_residential(spark, d):
    use = V.roads(spark, d).withColumn("landuse", F.when(F.col("road") % 4 == 0, "residential").otherwise("retail"))
    return M.is_residential(V.gps(spark, d), use).select("pid", "way", "residential")


# --- geometry of ways ------------------------------------------------------


@query("way_geometry", "SELECT way, array_to_string(list(CAST(round(n.lon * 1e4) AS BIGINT) ORDER BY i), ',') AS lons FROM (SELECT way, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i FROM ways) w JOIN nodes n ON n.node = w.node GROUP BY 1", ("ways", "nodes"))
def way_geometry(spark, d):
    g = G.way_geometry(V.ways(spark, d), V.nodes(spark, d))
    return g.select("way", F.array_join(F.transform("coords", lambda c: F.round(c["lon"] * 1e4).cast("long").cast("string")), ",").alias("lons"))


@query("explode_nodes", "SELECT way, CAST(generate_subscripts(nodes, 1) - 1 AS INTEGER) AS pos, unnest(nodes) AS node FROM ways", "ways")
def explode_nodes(spark, d):
    from ..operators.reshape import explode_with_position

    return explode_with_position(V.ways(spark, d).select("way", "nodes"), "nodes")


WAY_PTS = "SELECT way, i, n.lon, n.lat, lag(n.lon) OVER w AS lon0, lag(n.lat) OVER w AS lat0 FROM (SELECT way, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i FROM ways) x JOIN nodes n ON n.node = x.node WINDOW w AS (PARTITION BY way ORDER BY i)"


@query("segment_length", f"SELECT way, coalesce(sum(HAV(lon0, lat0, lon, lat)), 0) AS km FROM ({WAY_PTS}) GROUP BY 1", ("ways", "nodes"), "km")
def segment_length(spark, d):
    return V.ways(spark, d).select("way", geo.path_km(F.col("coords")).alias("km"))


ENDPTS = f"SELECT way, arg_min(lon, i) AS lon1, arg_min(lat, i) AS lat1, arg_max(lon, i) AS lon2, arg_max(lat, i) AS lat2 FROM ({WAY_PTS}) GROUP BY 1"
AZ = f"SELECT way, CASE WHEN a < 0 THEN a + 360 ELSE a END AS azimuth FROM (SELECT way, degrees(atan2(lon2 - lon1, lat2 - lat1)) AS a FROM ({ENDPTS}))"


@query("north_azimuth", AZ, ("ways", "nodes"), "azimuth")
def north_azimuth(spark, d):
    return V.ways(spark, d).select("way", geo.path_azimuth(F.col("coords")).alias("azimuth"))


def _mod360(x: str) -> str:
    return f"CASE WHEN {x} >= 360 THEN {x} - 360 ELSE {x} END"


@query(
    "road_headings",
    f"SELECT a.way, CASE WHEN w.oneway = -1 THEN {_mod360('azimuth + 180')} ELSE azimuth END AS h0, CASE WHEN w.oneway = 0 THEN {_mod360('azimuth + 180')} END AS h1 FROM ({AZ}) a JOIN ways w ON w.way = a.way",
    ("ways", "nodes"),
    ("h0", "h1"),
    5,
)
def road_headings(spark, d):
    tag = F.when(F.col("oneway") == 1, "yes").when(F.col("oneway") == -1, "-1")
    w = V.ways(spark, d).withColumn("h", geo.road_headings(geo.path_azimuth(F.col("coords")), tag))
    return w.select("way", F.get("h", F.lit(0)).alias("h0"), F.get("h", F.lit(1)).alias("h1"))


@query("heading_direction", "SELECT pid, CASE WHEN road % 2 = 0 AND 180 - abs(abs(road * 9 - heading) - 180) > 90 THEN 1 ELSE 0 END AS bit FROM gps", "gps")
def heading_direction(spark, d):
    first = (F.col("road") * 9).cast("double")
    headings = F.when(F.col("road") % 2 == 0, F.array(first, first + 180)).otherwise(F.array(first))
    return V.gps(spark, d).select("pid", geo.heading_direction(headings, F.col("heading")).alias("bit"))


@query("cos_rate", "SELECT pid, 1 - (cos(radians(heading - road * 9)) / 2 + 0.5) AS rate FROM gps", "gps", "rate")
def cos_rate(spark, d):
    return V.gps(spark, d).select("pid", geo.cos_rate(F.col("heading"), F.col("road") * 9).alias("rate"))


@query("direction_score", "SELECT pid, CASE WHEN s > e THEN -1.0 ELSE s END AS score FROM (SELECT pid, exp(abs(cos(radians(heading)) - cos(radians(road * 9))) + abs(sin(radians(heading)) - sin(radians(road * 9)))) - 1 AS s, exp(1.0) AS e FROM gps)", "gps", "score")
def direction_score(spark, d):
    h, r = F.radians("heading"), F.radians(F.col("road") * 9)
    s = geo.direction_score(F.cos(h), F.sin(h), F.cos(r), F.sin(r))
    return V.gps(spark, d).select("pid", F.when(s == float("inf"), -1.0).otherwise(s).alias("score"))


@query("one_way", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' OR o_custkey % 9 = 0 THEN 1 WHEN o_orderstatus = 'P' THEN -1 ELSE 0 END AS oneway FROM orders")
def one_way(spark, d):
    tag = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "P", "-1").otherwise("no")
    klass = F.when(F.col("o_orderpriority") == "1-URGENT", "motorway").otherwise("primary")
    ring = F.when(F.col("o_custkey") % 9 == 0, "roundabout")
    return V.table(spark, d, "orders").select("o_orderkey", traffic.one_way(tag, klass, ring).alias("oneway"))


@query("tag_map", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'b' ELSE o_orderpriority END AS highway, o_orderstatus AS oneway FROM orders")
def tag_map(spark, d):
    t = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    tags = F.array_compact(F.array(t("highway", F.col("o_orderpriority")), t("oneway", F.col("o_orderstatus")), F.when(F.col("o_custkey") % 3 == 0, t("highway", F.lit("b")))))
    m = traffic.tag_map(tags)
    return V.table(spark, d, "orders").select("o_orderkey", m["highway"].alias("highway"), m["oneway"].alias("oneway"))


@query("car_roads", "SELECT o_orderkey AS way FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW'")
def car_roads(spark, d):
    t = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    klass = F.when(F.col("o_orderpriority") == "5-LOW", "footway").otherwise(F.col("o_orderpriority"))
    tags = F.array(t("name", F.col("o_orderstatus")), t(None, klass)).cast("array<struct<k:string,v:string>>")
    tags = F.transform(tags, lambda x: F.struct(F.coalesce(x["k"], F.when(F.col("o_orderstatus") == "O", "waterway").otherwise("highway")).alias("k"), x["v"].alias("v")))
    return G.car_roads(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("way"), tags.alias("tag"))).select("way")


@query(
    "get_segments",
    f"""SELECT DISTINCT p.way, w.highway FROM ({WAY_PTS}) p JOIN ways w ON w.way = p.way GROUP BY 1, 2
      HAVING (count(*) FILTER (lon BETWEEN -5 AND -1.70 AND lat BETWEEN 40 AND 60) > 0 AND highway IN ('1-URGENT', '2-HIGH')) OR (count(*) FILTER (lon BETWEEN -5 AND 5 AND lat BETWEEN 40 AND 48.07) > 0 AND highway = '1-URGENT')""",
    ("ways", "nodes"),
)
def get_segments(spark, d):
    """Boxes that reach beyond all data on three sides, so that meeting a box is having a vertex in it."""
    tag = F.array(F.struct(F.lit("highway").alias("k"), F.col("highway").alias("v")))
    w = V.ways(spark, d).withColumn("tag", tag)
    return G.get_segments(w, (-5.0, 40.0, -1.70, 60.0), ["1-URGENT", "2-HIGH"], (-5.0, 40.0, 5.0, 48.07), ["1-URGENT"]).select("way", "highway")


@query("array_ops", "SELECT way, nodes[1] AS first, nodes[-1] AS last, CAST(len(nodes) AS INTEGER) AS n, array_to_string(list_sort(list_distinct(nodes)), ',') AS uniq, list_contains(nodes, 7) AS has7 FROM ways", "ways")
def array_ops(spark, d):
    n = F.col("nodes")
    return V.ways(spark, d).select("way", F.element_at(n, 1).alias("first"), F.element_at(n, -1).alias("last"), F.size(n).alias("n"), F.array_join(F.transform(F.array_sort(F.array_distinct(n)), lambda x: x.cast("string")), ",").alias("uniq"), F.array_contains(n, F.lit(7).cast("long")).alias("has7"))


# --- graph -----------------------------------------------------------------


@query("directed_segments", "SELECT segment, first, last FROM ends", "ends")
def directed_segments(spark, d):
    return G.directed_segments(V.ways(spark, d)).select("segment", "first", "last")


LINEAR = "SELECT DISTINCT a.segment AS src, b.segment AS dst FROM ends a JOIN ends b ON a.last = b.first WHERE a.nodes <> b.nodes AND a.nodes <> list_reverse(b.nodes)"


@query("graph_linear", LINEAR, "ends")
def graph_linear(spark, d):
    return G.linear_edges(G.directed_segments(V.ways(spark, d)))


@query(
    "graph_ins_outs",
    """SELECT DISTINCT src, dst FROM (SELECT a.segment AS src, b.segment AS dst, a.nodes AS x, b.nodes AS y FROM ends a JOIN (SELECT segment, nodes, unnest(list_distinct(nodes[:-2])) AS node FROM ends) b ON a.last = b.node
      UNION ALL SELECT a.segment, b.segment, a.nodes, b.nodes FROM (SELECT segment, nodes, unnest(list_distinct(nodes[2:])) AS node FROM ends) a JOIN ends b ON a.node = b.first) WHERE x <> y AND x <> list_reverse(y)""",
    "ends",
)
def graph_ins_outs(spark, d):
    return G.ins_outs(G.directed_segments(V.ways(spark, d)))


@query(
    "segments_meta",
    """SELECT s.segment, CASE WHEN s.lim = '50+' THEN 50.0 ELSE TRY_CAST(s.lim AS DOUBLE) END AS max_speed, c.points, c.cars FROM segs s
      LEFT JOIN (SELECT l_orderkey AS way, count(*) AS points, count(DISTINCT l_suppkey) AS cars FROM lineitem GROUP BY 1) c ON c.way = s.way""",
    "segs",
)
def segments_meta(spark, d):
    from ..operators.points import segment_counts

    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("road"), F.col("l_suppkey").alias("id"))
    return G.segments_meta(V.ways(spark, d), segment_counts(li)).select("segment", "max_speed", "points", "cars")


A0 = "WITH a0 AS (SELECT 'h' || h AS src, 'h' || h AS dst, 1 AS w FROM hours UNION SELECT src, dst, 1 FROM edges), "
LEVEL = "a{n} AS (SELECT src, dst, CAST(sum(w) AS INTEGER) AS w FROM (SELECT * FROM a{m} UNION ALL SELECT DISTINCT x.src, y.dst, 1 FROM a{m} x JOIN a{m} y ON x.dst = y.src) GROUP BY 1, 2)"
LEVELS = A0 + ", ".join(LEVEL.format(n=n, m=n - 1) for n in (1, 2, 3))


@query("adjacency_level", LEVELS + " SELECT * FROM a3", ("hours", "edges"))
def adjacency_level(spark, d):
    return G.add_levels(G.adjacency(*V.hour_graph(spark, d)), 3)


def hour_groups(spark, d):
    return V.hour_graph(spark, d)[0].withColumn("grp", F.concat(F.lit("g"), (F.substring("segment", 2, 2).cast("int") % 5).cast("string")))


@query("adjacency_merge", LEVELS + " SELECT 'g' || (CAST(src[2:] AS INTEGER) % 5) AS src, 'g' || (CAST(dst[2:] AS INTEGER) % 5) AS dst, max(w) AS w FROM a3 GROUP BY 1, 2", ("hours", "edges"))
def adjacency_merge(spark, d):
    return G.merge_adjacency(G.add_levels(G.adjacency(*V.hour_graph(spark, d)), 3), hour_groups(spark, d))


@query("remove_roundabouts")
def remove_roundabouts(spark, d):
    """Closed ways bridged in the linear graph; tested on small graphs."""
    s = G.directed_segments(V.ways(spark, d))
    return G.remove_roundabouts(s, G.linear_edges(s))


@query("relation_backrefs", "SELECT o_orderkey AS id, coalesce(r.relations, '') AS relations FROM orders LEFT JOIN (SELECT l_orderkey, array_to_string(list(DISTINCT CAST(l_suppkey AS BIGINT) ORDER BY CAST(l_suppkey AS BIGINT)), ',') AS relations FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_orderkey = o_orderkey")
def relation_backrefs(spark, d):
    member = F.struct(F.when(F.col("l_returnflag") == "R", "way").otherwise("node").alias("type"), F.col("l_orderkey").alias("ref"))
    rel = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("id")).agg(F.collect_list(member).alias("members"))
    out = G.relation_backrefs(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), rel, "way")
    return out.select("id", F.array_join(F.transform("relations", lambda x: x.cast("string")), ",").alias("relations"))


def profiles(spark, d):
    """Mean speed of roads by hour of the day, over all days."""
    g = V.gps(spark, d)
    return g.groupBy(F.concat(F.lit("r"), F.col("road").cast("string")).alias("segment"), F.hour("ts").alias("slot")).agg(F.avg(F.when(F.col("speed") > 0, F.col("speed"))).alias("speed"))


def road_pairs(spark, d):
    r = V.gps(spark, d).select("road").distinct()
    n = lambda c: F.concat(F.lit("r"), c.cast("string"))
    return r.join(r.select((F.col("road") - 1).alias("road"), F.col("road").alias("next")), "road").select(n(F.col("road")).alias("src"), n(F.col("next")).alias("dst"))


PROFILE = """WITH p AS (SELECT road, extract(hour FROM ts) AS slot, avg(speed) FILTER (speed > 0) AS v FROM gps GROUP BY 1, 2),
  c AS (SELECT a.road, a.v AS x, b.v AS y FROM p a JOIN p b ON b.road = a.road + 1 AND a.slot = b.slot WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
  s AS (SELECT road, 1 + sum(x) AS sx, 1 + sum(y) AS sy, count(*) AS n FROM c GROUP BY 1),
  g AS (SELECT c.road, avg(pow(x / sx - y / sy, 2)) + 1 - max(n) / 24.0 AS distance FROM c JOIN s ON s.road = c.road GROUP BY 1) """


@query("profile_distance", PROFILE + "SELECT 'r' || a.road AS src, 'r' || (a.road + 1) AS dst, coalesce(g.distance, 2.0) AS distance FROM (SELECT DISTINCT road FROM gps) a JOIN (SELECT DISTINCT road FROM gps) b ON b.road = a.road + 1 LEFT JOIN g ON g.road = a.road", "gps", "distance")
def profile_distance(spark, d):
    return G.profile_distance(road_pairs(spark, d), profiles(spark, d), 24)


LON, LAT = (f"({v} + ({{0}} * {m} % {r}) / CAST(10000 AS DOUBLE))" for v, m, r in ((V.WEST, 7919, 2167), (V.SOUTH, 104729, 1025)))
AZIMUTH = "atan2({} - {}, {} - {})"
HEAD = AZIMUTH.format(*(f.format(f"p[{i}]") for f in (LON, LAT) for i in (-1, -2)))
TAIL = AZIMUTH.format(*(f.format(f"p[{i}]") for f in (LON, LAT) for i in (2, 1)))


@query(
    "segment_attributes",
    f"""WITH sh AS (SELECT l_orderkey AS way, count(DISTINCT isodow(l_shipdate)) / 7.0 AS share FROM lineitem GROUP BY 1),
      a AS (SELECT s.way, s.segment, s.nodes, CASE WHEN w.oneway = -1 THEN list_reverse(s.nodes) ELSE s.nodes END AS p FROM segs s JOIN ways w ON w.way = s.way)
      SELECT a.segment, sh.share, nodes[-1] AS head, nodes[1] AS tail, cos({HEAD}) AS head_cos, sin({HEAD}) AS head_sin, cos({TAIL}) AS tail_cos, sin({TAIL}) AS tail_sin
      FROM a JOIN sh ON sh.way = a.way WHERE len(nodes) > 1""",
    ("segs", "ways"),
    ("share", "head_cos", "head_sin", "tail_cos", "tail_sin"),
)
def segment_attributes(spark, d):
    """Shares of weekdays with a known speed, ends and directions of all road segments."""
    s = G.directed_segments(V.ways(spark, d))
    shares = V.way_profiles(spark, d).groupBy("way").agg((F.count("speed") / F.lit(7.0)).alias("share"))
    return G.segment_attributes(s, s.select("way", "segment").join(shares, "way").select("segment", "share"))


def _angle(road: str, head: bool) -> str:
    return f"radians(20.0 * ({road} % 5) + {5 if head else 0})"


TURN = "exp(abs(cos({0}) - cos({1})) + abs(sin({0}) - sin({1}))) - 1"
CRITERIA = f"""pairs AS (SELECT road AS r, road + 1 AS n, true AS fwd FROM p0 UNION ALL SELECT road + 1, road, false FROM p0),
  turned AS (SELECT *, CASE WHEN fwd THEN {TURN.format(_angle("r", True), _angle("n", True))} ELSE {TURN.format(_angle("r", False), _angle("n", False))} END AS turn FROM pairs)
  SELECT 'r' || r AS src, 'r' || n AS dst,
    2 * coalesce(g.distance, 2.0) + turn + 0.5 * ((greatest(a.share, b.share) > 0.75)::INT + ((r % 5) + (n % 5) + 2 > 10)::INT + ((r % 3) + (n % 3) > 4)::INT) AS criterion
  FROM turned LEFT JOIN g ON g.road = least(r, n) JOIN sh a ON a.road = r JOIN sh b ON b.road = n WHERE r // 3 = n // 3 AND turn <= exp(1)"""


@query(
    "merge_criteria",
    PROFILE + """, sh AS (SELECT road, count(v) / 24.0 AS share FROM p GROUP BY 1), p0 AS (SELECT DISTINCT x.road FROM gps x JOIN gps y ON y.road = x.road + 1), """ + CRITERIA,
    "gps",
    "criterion",
)
def merge_criteria(spark, d):
    """Chain of roads r0, r1, ..., priced in both directions; groups of three share a class, across which no price is finite."""
    p = profiles(spark, d)
    k = F.substring("segment", 2, 9).cast("long")
    a = p.groupBy("segment").agg((F.count("speed") / F.lit(24.0)).alias("share"))
    way = lambda head: F.radians(20.0 * (k % 5) + (5 if head else 0))
    directions = [f(way(e == "head")).alias(f"{e}_{c}") for e in ("head", "tail") for c, f in (("cos", F.cos), ("sin", F.sin))]
    a = a.select("segment", "share", k.alias("tail"), (k + 1).alias("head"), *directions, (k % 3).cast("double").alias("km"), (k % 5 + 1).alias("members"), F.floor(k / 3).alias("highway"))
    pairs = road_pairs(spark, d)
    pairs = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.merge_criteria(pairs, a, p, 24, (2.0, 1.0, 0.25, 0.5), 1.5).filter(F.col("criterion") < float("inf"))


@query("merge_segments")
def merge_segments(spark, d):
    """Greedy merge of the whole directed road graph by component; tested against one loop over all."""
    speeds = V.way_profiles(spark, d).groupBy("way").agg(F.array(*[F.max(F.when(F.col("slot") == v, F.col("speed"))) for v in range(7)]).alias("speeds"))
    # written once: in one plan with what reads them, places would be computed anew for each of their uses
    ways = materialize(V.ways(spark, d).drop("limit").join(speeds, "way", "left"), "ways")
    segs = G.directed_segments(ways).withColumn("km", geo.path_km(F.col("coords")))
    merged = merging.merge_segments(segs, None, None, list(range(7)))
    discard(ways)  # the operator has written what it takes from them
    return merged


@query("adjacency", f"SELECT segment AS src, segment AS dst, 1 AS w FROM ends UNION SELECT src, dst, 1 FROM ({LINEAR})", "ends")
def adjacency(spark, d):
    return G.adjacency(*road_graph(spark, d))


@query("adjacency_full_outer", f"SELECT coalesce(a.src, e.src) AS src, coalesce(a.dst, e.dst) AS dst, 1 AS w FROM (SELECT segment AS src, segment AS dst FROM ends) a FULL OUTER JOIN ({LINEAR}) e ON a.src = e.src AND a.dst = e.dst", "ends")
def adjacency_full_outer(spark, d):
    return G.adjacency_outer(*road_graph(spark, d))


@query("adjacency_symmetric", f"WITH l AS ({LINEAR}), a0 AS (SELECT segment AS src, segment AS dst, 1 AS w FROM ends UNION SELECT src, dst, 1 FROM l) SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM a0 UNION ALL SELECT dst, src, w FROM a0) GROUP BY 1, 2", "ends")
def adjacency_symmetric(spark, d):
    return G.symmetric(G.adjacency(*road_graph(spark, d)))


def road_graph(spark, d):
    s = G.directed_segments(V.ways(spark, d))
    return s, G.linear_edges(s)
