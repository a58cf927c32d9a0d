"""Speed matrices, sessions and congestion over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.traffic import segment_key


def read_points(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def speed_matrix(points: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(segment, start, speed, cnt) per tumbling window, final once the watermark passes."""
    w = F.window("ts", f"{minutes} minutes")
    key = segment_key(F.col("road"), F.col("heading_road")).alias("segment")
    return points.withWatermark("ts", late).groupBy(key, w).agg(F.avg("speed").alias("speed"), F.count(F.lit(1)).alias("cnt")).select("segment", F.col("window.start").alias("start"), "speed", "cnt")


def sliding_speeds(points: DataFrame, minutes: int = 15, step: int = 5, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", f"{minutes} minutes", f"{step} minutes")
    key = segment_key(F.col("road"), F.col("heading_road")).alias("segment")
    return points.withWatermark("ts", late).groupBy(key, w).agg(F.avg("speed").alias("speed"), F.count(F.lit(1)).alias("cnt")).select("segment", F.col("window.start").alias("start"), "speed", "cnt")


def sessions(points: DataFrame, gap_minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(id, begin, last_gap_end, points): trips by gaps; a gap of exactly ``gap_minutes`` does not cut."""
    w = F.session_window("ts", f"{gap_minutes} minutes")
    return points.withWatermark("ts", late).groupBy("id", w).agg(F.count(F.lit(1)).alias("points")).select("id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("last_gap_end"), "points")


def write_batches(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Exactly-once Parquet sink."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
