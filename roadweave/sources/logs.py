"""GPS logs and result tables: readers and writers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import time as T


def load_raw(spark: SparkSession, path: str, kind: str = "parquet", limit: int | None = None, tz_shift: str | None = None, schema: str | None = None) -> DataFrame:
    """Points in order of (ts, pid); a numeric ``ts`` is epoch seconds.  A limit takes the earliest points."""
    reader = spark.read.format(kind)
    df = (reader.schema(schema) if schema else reader).load(path)
    if dict(df.dtypes)["ts"] in ("bigint", "int", "double"):
        df = df.withColumn("ts", T.from_epoch(F.col("ts"), tz_shift))
    df = df.orderBy("ts", "pid")
    return df if limit is None else df.limit(limit)


def load_projected(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, **options) -> DataFrame:
    """``load_raw`` with columns chosen or left out; only these are read from the files."""
    df = load_raw(spark, path, **options)
    if include:
        df = df.select(*include)
    return df.drop(*exclude) if exclude else df


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    """A log table of text columns with a header, cast to numbers; what is no number is null."""
    df = spark.read.csv(path, header=True, schema=schemas.CARS_LOG)
    num = lambda c: F.col(c).try_cast("double").alias(c)
    return df.select("id", num("latitude").alias("lat"), num("longitude").alias("lon"), num("heading"), num("speed"), F.col("ts").try_cast("timestamp").alias("ts"))


def read_by_prefix(spark: SparkSession, folder: str, prefix: str, kind: str = "parquet") -> DataFrame:
    """All collections of a folder whose names start with ``prefix``, with the file they come from."""
    return spark.read.format(kind).load(f"{folder.rstrip('/')}/{prefix}*").withColumn("source_file", F.col("_metadata.file_path"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_copy(df: DataFrame, table: str) -> None:
    """Materialise a result as a table, replacing it."""
    df.write.mode("overwrite").saveAsTable(table)


def append_trips(trips: DataFrame, path: str) -> None:
    """Trips go to one folder, partitioned by day."""
    trips.write.mode("append").partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_matrix(long: DataFrame, path: str) -> None:
    """Speed matrices are kept long, in Parquet, partitioned by nothing that grows with segments."""
    long.write.mode("overwrite").parquet(path)


def write_coefficients(coefs: DataFrame, path: str) -> None:
    """One number a line, in order of ``k``."""
    coefs.orderBy("k").select(F.format_string("%.18e", F.col("value")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(k, value) of a text file with one number a line; a file of coefficients is small and read as one."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split(F.trim("value"), "\n"), lambda s: F.trim(s) != "")
    return whole.select(F.posexplode(lines).alias("k", "v")).select("k", F.trim("v").try_cast("double").alias("value"))


def update_matches(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Points with new ``road`` and ``heading_road`` where ``matches`` (pid, road, heading_road) has them."""
    m = matches.select("pid", F.col("road").alias("__road"), F.col("heading_road").alias("__heading"))
    out = points.join(m, "pid", "left")
    return out.withColumn("road", F.coalesce("__road", "road")).withColumn("heading_road", F.coalesce("__heading", "heading_road")).drop("__road", "__heading")


def delete_points(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("pid"), "pid", "left_anti")


def find_one(df: DataFrame, condition, *order: str) -> DataFrame:
    """The first row that meets a condition, in a given order."""
    return df.filter(condition).orderBy(*order).limit(1)


def yesterday_name(name: str, today: date | None = None) -> str:
    """Name of a daily collection: year, month and day without padding."""
    d = (today or date.today()) - timedelta(days=1)
    return f"{name}_{d.year}{d.month}{d.day}"
