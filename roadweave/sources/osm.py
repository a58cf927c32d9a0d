"""OpenStreetMap XML: nodes, ways and relations.

Spark's XML reader splits the file by row tag, so a planet extract is read in
parallel; nothing is batched by hand, and the tail of the file is not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _common(df: DataFrame) -> list[Column]:
    """Attributes that all elements share; missing tags are an empty array, optional attributes null."""
    tag = F.transform(F.coalesce("tag", F.array().cast(schemas.TAG)), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    return [
        F.col("_id").alias("id"), tag.alias("tag"), F.transform(tag, lambda t: t["k"]).alias("key"), F.col("_version").alias("version"),
        F.col("_changeset").alias("changeset"), F.col("_uid").alias("uid"), F.col("_user").alias("user"),
        F.try_to_timestamp("_timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
    ]


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, "node", schemas.OSM_NODE)
    return df.select(*_common(df), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, "way", schemas.OSM_WAY)
    nodes = F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref:long>>")), lambda n: n["_ref"])
    return df.select(*_common(df), nodes.alias("nodes"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, "relation", schemas.OSM_RELATION)
    none = F.array().cast("array<struct<_type:string,_ref:long,_role:string>>")
    members = F.transform(F.coalesce("member", none), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return df.select(*_common(df), members.alias("members"))


def ingest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, ways (with coordinates and relation back-references) and relations of a file."""
    from ..operators.graph import relation_backrefs, way_geometry

    nodes, ways, relations = read_nodes(spark, path), read_ways(spark, path), read_relations(spark, path)
    shape = way_geometry(ways.select(F.col("id").alias("way"), "nodes"), nodes.select(F.col("id").alias("node"), "lon", "lat"))
    ways = ways.join(shape.withColumnRenamed("way", "id"), "id", "left")
    return {"nodes": relation_backrefs(nodes, relations, "node"), "ways": relation_backrefs(ways, relations, "way"), "relations": relations}
