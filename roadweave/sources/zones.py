"""Zone polygons and their attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zones_from_geojson(spark: SparkSession, path: str, dept: str | None = None, swap: bool = False) -> DataFrame:
    """(zone, dept, ring): outer rings of Polygon and MultiPolygon features, one row each; ``swap`` for files with latitude first."""
    schema = (
        "features array<struct<properties:struct<code:string,dept:string>,geometry:struct<type:string,coordinates:string>>>"
    )
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(polygon)).otherwise(many)
    x, y = (1, 0) if swap else (0, 1)
    ring = F.transform(F.get("p", F.lit(0)), lambda c: F.struct(F.get(c, F.lit(x)).alias("lon"), F.get(c, F.lit(y)).alias("lat")))
    out = f.select(F.col("f.properties.code").alias("zone"), F.col("f.properties.dept").alias("dept"), F.explode(polygons).alias("p")).select("zone", "dept", ring.alias("ring"))
    return out if dept is None else out.filter(F.col("dept") == dept)


def population_from_excel(spark: SparkSession, path: str, skip: int = 5, columns: int = 13) -> DataFrame:
    """The first columns of a spreadsheet behind its heading lines; needs an Excel engine of pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, skiprows=skip).iloc[:, :columns])
