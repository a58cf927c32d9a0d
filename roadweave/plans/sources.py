"""Sources and sinks: tables written in a format to the shared folder and read back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import logs, osm
from ..storage import fresh_path
from . import views as V
from .registry import query


@query(
    "source_csv_log",
    "SELECT CAST(id AS VARCHAR) AS id, lat, lon, heading, CASE WHEN road = 3 THEN NULL ELSE speed END AS speed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM gps",
    "gps",
    ("lat", "lon", "speed"),
)
def source_csv_log(spark, d):
    """A log of text columns; speeds of one road are no numbers there."""
    path = fresh_path(spark, "log")
    text = lambda c: F.col(c).cast("string")
    speed = F.when(F.col("road") == 3, "n/a").otherwise(text("speed"))
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    logs.write_csv(V.gps(spark, d).select(text("id").alias("id"), text("lat").alias("latitude"), text("lon").alias("longitude"), text("heading").alias("heading"), speed.alias("speed"), day.alias("ts")), path)
    return logs.read_csv_log(spark, path).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("source_json", "SELECT pid, road, kind FROM gps", "gps")
def source_json(spark, d):
    path = fresh_path(spark, "json")
    logs.write_json(V.gps(spark, d).select("pid", "road", "kind"), path)
    return spark.read.schema("pid long, road long, kind string").json(path)


@query("source_prefix", "SELECT kind, count(*) AS n FROM gps WHERE pid % 3 < 2 GROUP BY 1", "gps")
def source_prefix(spark, d):
    """Two collections of three are read by their common prefix."""
    folder, g = fresh_path(spark, "collections"), V.gps(spark, d).select("pid", "kind")
    for k, name in enumerate(("cars_2018a", "cars_2018b", "other")):
        logs.write_matrix(g.filter(F.col("pid") % 3 == k), f"{folder}/{name}")
    return logs.read_by_prefix(spark, folder, "cars_2018").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("source_coefficients", "SELECT CAST(road AS INTEGER) AS k, avg(speed) AS value FROM gps GROUP BY 1", "gps", "value")
def source_coefficients(spark, d):
    path = fresh_path(spark, "coefficients")
    logs.write_coefficients(V.gps(spark, d).groupBy(F.col("road").alias("k")).agg(F.avg("speed").alias("value")), path)
    return logs.read_coefficients(spark, f"{path}/*.txt")


@query(
    "source_osm",
    """SELECT w.way AS id, w.highway, array_to_string(w.nodes, ',') AS nodes, k.known FROM ways w
      JOIN (SELECT x.way, count(DISTINCT n.node) AS known FROM (SELECT way, unnest(nodes) AS node FROM ways) x JOIN nodes n ON n.node = x.node GROUP BY 1) k ON k.way = w.way""",
    ("ways", "nodes"),
)
def source_osm(spark, d):
    """Nodes and ways written as OpenStreetMap XML and ingested: ways with their coordinates."""
    folder = fresh_path(spark, "osm")
    n, w = V.nodes(spark, d), V.ways(spark, d)
    n.select(F.col("node").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).write.format("xml").options(rootTag="osm", rowTag="node").save(f"{folder}/nodes")
    refs = F.transform("nodes", lambda x: F.struct(x.alias("_ref")))
    tags = F.array(F.struct(F.lit("highway").alias("_k"), F.col("highway").alias("_v")))
    w.select(F.col("way").alias("_id"), refs.alias("nd"), tags.alias("tag")).write.format("xml").options(rootTag="osm", rowTag="way").save(f"{folder}/ways")
    got = osm.ingest(spark, f"{folder}/*")["ways"]
    known = F.size(F.array_distinct(F.filter("coords", lambda c: c["lon"].isNotNull())))
    return got.select("id", F.get("tag", F.lit(0))["v"].alias("highway"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"), known.cast("long").alias("known"))
