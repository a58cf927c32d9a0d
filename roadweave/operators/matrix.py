"""Series of segments in long form (segment, ts, speed, cnt): cleaning, imputation, windows, statistics.

``ts`` is a slot's start.  A missing value is a null speed on a dense grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T


def tod(c: str = "ts") -> Column:
    return T.seconds_of_day(F.col(c))


def drop_weekends(long: DataFrame) -> DataFrame:
    return long.filter(T.is_weekday(F.col("ts")))


def drop_erroneous_days(long: DataFrame) -> DataFrame:
    """Days whose total count is above 0.75 of the median day and whose number of slots is the most frequent one (ties: smallest)."""
    days = long.groupBy(T.day(F.col("ts")).alias("day")).agg(F.sum("cnt").alias("total"), F.countDistinct("ts").alias("slots"))
    typical = days.agg(F.percentile("total", F.lit(0.5)).alias("median"))
    modal = days.groupBy("slots").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "slots"))["slots"].alias("slots"))
    good = days.filter((F.col("total") > 0.75 * typical.scalar()) & (F.col("slots") == modal.scalar())).select("day")
    return long.withColumn("day", T.day(F.col("ts"))).join(good, "day", "left_semi").drop("day")


def valid_segments(long: DataFrame, share: float = 0.8) -> DataFrame:
    """(segment, known): segments with a speed in at least ``share`` of all slots that occur."""
    slots = long.agg(F.countDistinct("ts").alias("n"))
    known = long.groupBy("segment").agg(F.count("speed").alias("known"))
    return known.filter(F.col("known") >= F.floor(F.lit(share) * slots.scalar()))


def missing_percent(dense: DataFrame) -> DataFrame:
    return dense.groupBy("segment").agg((100 * F.avg(F.col("speed").isNull().cast("int"))).alias("missing"))


def missing_bands(dense: DataFrame, cuts: tuple[float, ...] = (20, 22, 25)) -> DataFrame:
    """Segments below the last cut, with the band they fall in."""
    band = F.lit(None).cast("string")
    for low, high in reversed(list(zip((0, *cuts), cuts))):
        band = F.when(F.col("missing") < high, f"{low}-{high}").otherwise(band)
    return missing_percent(dense).filter(F.col("missing") < cuts[-1]).withColumn("band", band)


def missing_by_slot(dense: DataFrame) -> DataFrame:
    return dense.groupBy("ts").agg(F.avg(F.col("speed").isNull().cast("int")).alias("share"))


def missing_by_segment(dense: DataFrame) -> DataFrame:
    return dense.groupBy("segment").agg(F.count_if(F.col("speed").isNull()).alias("missing"))


def merged_speed(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """(grp, ts, speed, cnt): means weighted by counts; counts of rows without a speed stay in the denominator."""
    joined = long.join(mapping, "segment")
    return joined.groupBy("grp", "ts").agg(F.try_divide(F.sum(F.col("speed") * F.col("cnt")), F.sum("cnt")).alias("speed"), F.sum("cnt").alias("cnt"))


def merge_group_na(dense: DataFrame, mapping: DataFrame) -> DataFrame:
    """(grp, mean_na, min_na, members) of the members' shares of missing slots."""
    na = dense.groupBy("segment").agg(F.avg(F.col("speed").isNull().cast("int")).alias("na"))
    return na.join(mapping, "segment").groupBy("grp").agg(F.avg("na").alias("mean_na"), F.min("na").alias("min_na"), F.count(F.lit(1)).alias("members"))


def impute_by_clock(dense: DataFrame) -> DataFrame:
    """Missing speeds become the segment's mean at that time of day."""
    w = Window.partitionBy("segment", tod())
    return dense.withColumn("speed", F.coalesce("speed", F.avg("speed").over(w)))


def day_number(long: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, day_no): days that occur, numbered from 1; the window runs over days, not rows."""
    days = long.select(T.day(F.col(ts)).alias("day")).distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("day")))


def train_split(long: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``train``: whether the row's day is among the first ``share`` of days."""
    days = day_number(long)
    n = days.agg(F.max("day_no").alias("n"))
    first = days.withColumn("train", F.col("day_no") <= F.floor(F.lit(share) * n.scalar())).drop("day_no")
    return long.withColumn("day", T.day(F.col("ts"))).join(first, "day").drop("day")


def split_index(slots: int, per_day: int, in_lag: int, out_lag: int, share: float) -> int:
    """Number of training samples of a series of ``slots`` with ``per_day`` a day."""
    lag = in_lag + out_lag - 1
    if slots / per_day < 10:
        return int(share * (slots - lag))
    return int(share * slots / per_day) * (per_day - lag)


def centre_by_clock(long: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``mean`` (segment's training mean at the time of day) and ``centred``."""
    marked = train_split(long, share).withColumn("tod", tod())
    w = Window.partitionBy("segment", "tod")
    mean = F.avg(F.when(F.col("train"), F.col("speed"))).over(w)
    return marked.withColumn("mean", mean).withColumn("centred", F.col("speed") - F.col("mean")).drop("tod")


def by_day() -> "Window":
    return Window.partitionBy("segment", T.day(F.col("ts"))).orderBy("ts")


def lag_features(long: DataFrame, in_lag: int, out_lag: int = 1) -> DataFrame:
    """One sample per window of ``in_lag + out_lag`` slots inside a day: x_1..x_in (oldest first) and y, the last slot."""
    last = in_lag + out_lag - 1
    cols = [F.lag("speed", last - k).over(by_day()).alias(f"x_{k + 1}") for k in range(in_lag)]
    n = F.row_number().over(by_day())
    return long.select("segment", "ts", *cols, F.col("speed").alias("y"), n.alias("n")).filter(F.col("n") > last).drop("n")


def differenced(long: DataFrame, value: str = "speed") -> DataFrame:
    """Change from slot to slot inside a day; the first slot of each day has none and is dropped."""
    before = F.lag(value).over(by_day())
    return long.withColumn("diff", F.col(value) - before).withColumn("n", F.row_number().over(by_day())).filter("n > 1").drop("n")


def scale_log(long: DataFrame) -> DataFrame:
    """Difference of log(1 + speed) from slot to slot inside a day."""
    return differenced(long.withColumn("log", F.log1p("speed")), "log").withColumnRenamed("diff", "scaled").drop("log")


def unscale_log(scaled: Column, last: Column, legacy: bool = False) -> Column:
    """Inverse of ``scale_log``; the legacy form multiplies expm1 by the last value."""
    return F.expm1(scaled) * last if legacy else (1 + last) * F.exp(scaled) - 1


def minmax_global(long: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``scaled``: 0 to 1 between the extremes of the training days."""
    marked = train_split(long, share)
    ends = marked.filter("train").agg(F.struct(F.min("speed").alias("lo"), F.max("speed").alias("hi")).alias("e"))
    return marked.withColumn("e", ends.scalar()).withColumn("scaled", F.try_divide(F.col("speed") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo"))).drop("e")


def minmax_segment(long: DataFrame, share: float = 0.7) -> DataFrame:
    marked = train_split(long, share)
    w = Window.partitionBy("segment")
    known = F.when(F.col("train"), F.col("speed"))
    lo, hi = F.min(known).over(w), F.max(known).over(w)
    return marked.withColumn("scaled", F.try_divide(F.col("speed") - lo, hi - lo))


def unscale_minmax(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low


def scale_max(c: Column, largest: float = 130.0) -> Column:
    return c / F.lit(largest)


class Transforms:
    """Ordered forward transforms of a column with their inverses, undone last in, first out."""

    def __init__(self):
        self.steps: list[tuple[str, object, object]] = []

    def add(self, name: str, forward, inverse) -> "Transforms":
        self.steps.append((name, forward, inverse))
        return self

    def apply(self, c: Column) -> Column:
        for _, forward, _ in self.steps:
            c = forward(c)
        return c

    def undo(self, c: Column) -> Column:
        for _, _, inverse in reversed(self.steps):
            c = inverse(c)
        return c


def regime_split(long: DataFrame, t: int) -> DataFrame:
    """Rows with ``side``: slots of the day up to t are left, from t on right; slot t is in both."""
    slot = F.dense_rank().over(Window.partitionBy("segment", T.day(F.col("ts"))).orderBy("ts")) - 1
    sides = F.array_compact(F.array(F.when(F.col("slot") <= t, F.lit("left")), F.when(F.col("slot") >= t, F.lit("right"))))
    return long.withColumn("slot", slot).withColumn("side", F.explode(sides))


def sliding_slots(long: DataFrame, length: int = 2, minutes: int = 15) -> DataFrame:
    """Each row once for every window of ``length`` consecutive slots of the day that holds it."""
    slot = F.floor(tod() / (60 * minutes)).cast("int")
    per_day = 1440 // minutes
    starts = F.sequence(F.greatest(F.col("slot") - (length - 1), F.lit(0)), F.least(F.col("slot"), F.lit(per_day - length)))
    return long.withColumn("slot", slot).withColumn("window", F.explode(starts))


def smooth(long: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of each segment's series with reflected ends, as one ordered array per segment."""
    import math

    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = [x / sum(raw) for x in raw]
    series = long.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("ts", "speed"))).alias("s"))
    n = F.size("s")

    def mirrored(i: Column) -> Column:  # d c b a | a b c d | d c b a
        j = F.pmod(i, 2 * n)
        return F.when(j < n, j).otherwise(2 * n - 1 - j)

    weights = F.array(*[F.lit(w) for w in kernel])
    at = lambda i: F.aggregate(F.zip_with(F.sequence(F.lit(-r), F.lit(r)), weights, lambda k, w: w * F.get("s", mirrored(i + k))["speed"]), F.lit(0.0), lambda a, x: a + x)
    out = F.transform("s", lambda p, i: F.struct(p["ts"].alias("ts"), at(i).alias("speed")))
    return series.select("segment", F.explode(out).alias("o")).select("segment", "o.ts", "o.speed")


def gap_rows(long: DataFrame, days: int = 1) -> DataFrame:
    """The series with a null row behind each day that is not followed by the next one."""
    seen = long.select("segment", T.day(F.col("ts")).alias("day")).distinct()
    after = F.lead("day").over(Window.partitionBy("segment").orderBy("day"))
    broken = seen.withColumn("next", after).filter(F.datediff("next", "day") > days)
    ends = broken.select("segment", F.date_add("day", 1).cast(dict(long.dtypes)["ts"]).alias("ts"), F.lit(None).cast("double").alias("speed"))
    return long.select("segment", "ts", "speed").unionByName(ends)


def ranked_counts(long: DataFrame) -> DataFrame:
    """(segment, top): largest count of a segment."""
    return long.groupBy("segment").agg(F.max("cnt").alias("top"))


def cumulative_above(long: DataFrame, least: int = 10) -> DataFrame:
    """(slots, segments, at_least): segments by number of slots with more than ``least`` points, and how many have at least that many."""
    per = long.groupBy("segment").agg(F.count_if(F.col("cnt") > least).alias("slots"))
    hist = per.groupBy("slots").agg(F.count(F.lit(1)).alias("segments"))
    return hist.withColumn("at_least", F.sum("segments").over(Window.orderBy(F.desc("slots"))))


def correlations(long: DataFrame, key: str = "segment", axis: str = "ts") -> DataFrame:
    """(a, b, corr) of all pairs of series over the common axis; joined on the axis, never as a product of series."""
    x = long.select(F.col(key).alias("a"), F.col(axis).alias("t"), F.col("speed").alias("x"))
    y = long.select(F.col(key).alias("b"), F.col(axis).alias("t"), F.col("speed").alias("y"))
    return x.join(y, "t").filter("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def autocorrelation(series: DataFrame, most: int) -> DataFrame:
    """(lag, r) of the means per ts over segments: sum((x_t - m)(x_t+k - m)) / (n s^2) with the population spread."""
    x = series.groupBy("ts").agg(F.avg("speed").alias("x"))
    x = x.withColumn("i", F.row_number().over(Window.orderBy("ts")))
    stats = x.agg(F.struct(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n")).alias("s"))
    c = x.withColumn("s", stats.scalar()).select("i", (F.col("x") - F.col("s.m")).alias("d"), F.col("s.n").alias("n"), F.col("s.v").alias("v"))
    shifted = c.select(F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"), (F.col("i") - F.col("lag")).alias("i"), F.col("d").alias("e"))
    return c.join(shifted, "i").groupBy("lag").agg((F.sum(F.col("d") * F.col("e")) / (F.first("n") * F.first("v"))).alias("r"))


def spread_by_segment(long: DataFrame, share: float = 0.7) -> DataFrame:
    return train_split(long, share).filter("train").groupBy("segment").agg(F.stddev_samp("speed").alias("std"))
