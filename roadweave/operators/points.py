"""GPS points: filters, counts, removal of stationary noise, speed matrices.

Points have columns ``pid, id, ts, lon, lat, heading, speed, road, heading_road``;
``pid`` breaks ties of ``ts``.  Null ``road`` means not matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.traffic import congestion, congestion_level, log_size_class, segment_key


def hour_filter(points: DataFrame, start: int, end: int) -> DataFrame:
    return points.filter(T.between_hours(F.col("ts"), start, end))


def time_range(points: DataFrame, start: str, end: str) -> DataFrame:
    """``start`` <= ts < ``end``; both reach the Parquet scan."""
    kind = dict(points.dtypes)["ts"]
    return points.filter((F.col("ts") >= F.lit(start).cast(kind)) & (F.col("ts") < F.lit(end).cast(kind)))


def matched(points: DataFrame) -> DataFrame:
    return points.filter(F.col("road").isNotNull())


def on_roads(points: DataFrame, roads: DataFrame) -> DataFrame:
    """Points whose road is listed: a semi-join, so the list may be of any size."""
    return points.join(roads.select("road").distinct(), "road", "left_semi")


def counts_per_interval(points: DataFrame, minutes: int = 15) -> DataFrame:
    """(start, n, first): points per interval; windows carry the date, so months and years stay apart."""
    return points.groupBy(T.bucket_start(F.col("ts"), minutes).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


def points_per_day(points: DataFrame) -> DataFrame:
    return points.groupBy(T.day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def cars_per_day(points: DataFrame) -> DataFrame:
    return points.groupBy(T.day(F.col("ts")).alias("day")).agg(F.countDistinct("id").alias("cars"))


def average_speed(points: DataFrame, *keys: str) -> DataFrame:
    """Mean speed over everything or by ``day`` and ``road``."""
    named = {"day": T.day(F.col("ts")).alias("day"), "road": F.col("road")}
    return points.groupBy(*(named[k] for k in keys)).agg(F.avg("speed").alias("avg_speed"))


def aberrant(points: DataFrame, minutes: int = 15, most: int = 5) -> DataFrame:
    """The points that the cleaner deletes: of a car standing on a road for more than ``most`` points of a window, all but the first."""
    key = Window.partitionBy("road", "id", "bucket")
    still = points.filter(F.col("speed") == 0).withColumn("bucket", T.bucket_start(F.col("ts"), minutes))
    ranked = still.withColumn("n", F.count(F.lit(1)).over(key)).withColumn("rank", F.row_number().over(key.orderBy("ts", "pid")))
    return ranked.filter((F.col("n") > most) & (F.col("rank") > 1)).drop("bucket", "n", "rank")


def remove_aberrant(points: DataFrame, minutes: int = 15, most: int = 5) -> DataFrame:
    """Points without the stationary noise, in one shuffle: moving points form groups of their own that no rule touches."""
    still = F.col("speed") == 0
    key = Window.partitionBy("road", "id", "__bucket", "__still")
    marked = points.withColumn("__still", F.coalesce(still, F.lit(False))).withColumn("__bucket", T.bucket_start(F.col("ts"), minutes))
    ranked = marked.withColumn("__n", F.count(F.lit(1)).over(key)).withColumn("__rank", F.row_number().over(key.orderBy("ts", "pid")))
    return ranked.filter(~F.col("__still") | (F.col("__n") <= most) | (F.col("__rank") == 1)).drop("__still", "__bucket", "__n", "__rank")


def points_per_road(points: DataFrame) -> DataFrame:
    return points.groupBy("road").agg(F.count(F.lit(1)).alias("n"))


def top_roads(points: DataFrame, k: int) -> DataFrame:
    """A top-k report: the k roads with most points."""
    return points_per_road(matched(points)).orderBy(F.desc("n"), "road").limit(k)


def cars_per_road(points: DataFrame) -> DataFrame:
    return points.groupBy("road").agg(F.countDistinct("id").alias("n"))


def size_classes(counts: DataFrame, drop_rarest: bool = False) -> DataFrame:
    """(size_class, roads): roads by order of magnitude of their count; optionally without the rarest class."""
    out = counts.groupBy(log_size_class(F.col("n")).alias("size_class")).agg(F.count(F.lit(1)).alias("roads"))
    if drop_rarest:
        last = out.orderBy("roads", F.desc("size_class")).limit(1)
        out = out.join(last, "size_class", "left_anti")
    return out


def headings_per_road(points: DataFrame) -> DataFrame:
    """(road, headings, n): all headings of a road in order, put together from how often each occurs."""
    counts = points.groupBy("road", "heading").agg(F.count(F.lit(1)).alias("n"))
    each = F.array_sort(F.collect_list(F.when(F.col("heading").isNotNull(), F.struct("heading", F.col("n").cast("int").alias("n")))))
    by = counts.groupBy("road").agg(each.alias("each"), F.sum("n").alias("n"))
    return by.select("road", F.flatten(F.transform("each", lambda x: F.array_repeat(x["heading"], x["n"]))).alias("headings"), "n")


def segment_counts(points: DataFrame) -> DataFrame:
    """(road, points, cars), joined by road id."""
    return points.groupBy("road").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("id").alias("cars"))


def distinct_devices(points: DataFrame, roads: DataFrame) -> DataFrame:
    return on_roads(points, roads).agg(F.countDistinct("id").alias("devices"))


def speed_long(points: DataFrame, minutes: int = 15, offset: int = 0) -> DataFrame:
    """(road, heading_road, start, speed, cnt): plain mean of the points of a bucket."""
    keys = ["road", "heading_road", T.bucket_start(F.col("ts"), minutes, offset).alias("start")]
    return points.groupBy(*keys).agg(F.avg("speed").alias("speed"), F.count(F.lit(1)).alias("cnt"))


def speed_long_sliding(points: DataFrame, minutes: int = 15, step: int = 5) -> DataFrame:
    """All phase-shifted matrices at once: windows of ``minutes`` that start every ``step``."""
    w = F.window("ts", f"{minutes} minutes", f"{step} minutes")["start"].alias("start")
    return points.groupBy("road", "heading_road", w).agg(F.avg("speed").alias("speed"), F.count(F.lit(1)).alias("cnt"))


def speed_per_user(points: DataFrame, minutes: int = 15, offset: int = 0) -> DataFrame:
    """(segment, id, start, speed, cnt): mean of one car's points on a segment in a bucket."""
    keys = [segment_key(F.col("road"), F.col("heading_road")).alias("segment"), "id", T.bucket_start(F.col("ts"), minutes, offset).alias("start")]
    return points.groupBy(*keys).agg(F.avg("speed").alias("speed"), F.count(F.lit(1)).alias("cnt"))


def speed_of_users(per_user: DataFrame) -> DataFrame:
    """(segment, start, speed, std, cars): mean of the cars' means, their spread, their number."""
    return per_user.groupBy("segment", "start").agg(
        F.avg("speed").alias("speed"), F.stddev_samp("speed").alias("std"), F.count(F.lit(1)).alias("cars")
    )


def with_congestion(speeds: DataFrame, limits: DataFrame) -> DataFrame:
    """Speeds by segment with the road's limit (null if it has none), the ratio and the level."""
    road = F.split_part(F.col("segment"), F.lit("_"), F.lit(1)).cast("bigint")
    ratio = congestion(F.col("speed"), F.col("limit"))
    joined = speeds.withColumn("road", road).join(limits.select("road", "limit"), "road", "left")
    return joined.withColumn("ratio", ratio).withColumn("level", congestion_level(ratio))


def congestion_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def roads_by_congestion(levels: DataFrame, level: int) -> DataFrame:
    return levels.filter(F.col("level") == level).select("road").distinct()


def quantiles_by_road(points: DataFrame, minutes: int = 15) -> DataFrame:
    """Deciles of the number of points per slot, for each road (linear interpolation)."""
    slots = points.groupBy("road", T.bucket_start(F.col("ts"), minutes).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.lit(k / 10) for k in range(11)])
    return slots.groupBy("road").agg(F.count(F.lit(1)).alias("slots"), F.percentile("n", levels).alias("deciles"))


def density_by(points: DataFrame, *keys: str, minutes: int = 15) -> DataFrame:
    """Counts and mean speeds by any of ``road``, ``day``, ``hour``, ``slot``."""
    ts = F.col("ts")
    named = {"road": F.col("road"), "day": T.day(ts).alias("day"), "hour": F.hour(ts).alias("hour"), "slot": T.slot_of_day(ts, minutes).alias("slot")}
    return points.groupBy(*(named[k] for k in keys)).agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed"))


def minute_means(points: DataFrame, k: int) -> DataFrame:
    """Mean speed by hour and k-minute step of the hour, over all days."""
    m = (F.floor(F.minute("ts") / k) * k).cast("int")
    return points.groupBy(F.hour("ts").alias("h"), m.alias("m")).agg(F.avg("speed").alias("speed"), F.count(F.lit(1)).alias("n"))


def hourly_profile(points: DataFrame, minutes: int = 15) -> DataFrame:
    """By hour: mean, spread and extremes of counts per interval; means of weekdays and weekends."""
    c = counts_per_interval(points, minutes)
    week = T.is_weekday(F.col("start"))
    return c.groupBy(F.hour("start").alias("hour")).agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.percentile("n", F.lit(0.5)).alias("median"),
        F.avg(F.when(week, F.col("n"))).alias("weekday_mean"), F.avg(F.when(~week, F.col("n"))).alias("weekend_mean"),
    )


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a value by group."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(key).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(value).alias("max"),
    )


def presence_of_neighbours(points: DataFrame, minutes: int = 15) -> DataFrame:
    """(slot, now, before, after): distinct cars of a slot and how many of them were seen one slot before or after."""
    seen = points.select("id", T.bucket_start(F.col("ts"), minutes).alias("start")).distinct()
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    shifted = seen.select("id", (F.col("start") + step).alias("start"), F.lit(1).alias("b"), F.lit(0).alias("a")).union(
        seen.select("id", (F.col("start") - step).alias("start"), F.lit(0), F.lit(1))
    )
    around = shifted.groupBy("id", "start").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return seen.join(around, ["id", "start"], "left").groupBy("start").agg(
        F.count(F.lit(1)).alias("now"), F.sum(F.coalesce("b", F.lit(0))).alias("before"), F.sum(F.coalesce("a", F.lit(0))).alias("after")
    )


def diffusion(points: DataFrame, minutes: int = 15, normalise: bool = False) -> DataFrame:
    """(src, dst, cnt): points on dst one slot after the same car was on src, summed; one more on the diagonal.

    A car's points at q + 1 count once for each group that it was in at q; both
    sides are summed per car and slot before the equi-join.
    """
    at = points.groupBy("id", "road", T.bucket_start(F.col("ts"), minutes).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    now = at.select("id", F.col("road").alias("src"), (F.col("start") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("start"))
    nxt = at.select("id", F.col("road").alias("dst"), "start", "n")
    moved = now.join(nxt, ["id", "start"]).groupBy("src", "dst").agg(F.sum("n").alias("cnt"))
    roads = points.select(F.col("road").alias("src")).distinct()
    out = moved.union(roads.select("src", F.col("src").alias("dst"), F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))
    if normalise:
        out = out.withColumn("cnt", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("dst")))
    return out


def cross_flow(diffused: DataFrame) -> DataFrame:
    """Flow rows for every pair of roads that occur; absent pairs are 0.  The grid of roads is the result, so its size is the output's."""
    roads = diffused.select("src").union(diffused.select("dst")).distinct()
    grid = roads.crossJoin(roads.withColumnRenamed("src", "dst"))
    return grid.join(diffused, ["src", "dst"], "left").select("src", "dst", F.coalesce("cnt", F.lit(0)).alias("cnt"))
