"""Set operations, pivots, grids and array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_keep_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union in which rows of ``first`` win over rows of ``second`` with the same key."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti")).dropDuplicates([key])


def pivot_speeds(long: DataFrame, columns: list, row: str = "segment", column: str = "slot", value: str = "speed") -> DataFrame:
    """Wide matrix; the list of columns is always given, so Spark runs no job to find it."""
    return long.groupBy(row).pivot(column, columns).agg(F.avg(value))


def unpivot(wide: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return wide.unpivot(ids, columns, name, value)


def explode_with_position(df: DataFrame, array: str, value: str = "node") -> DataFrame:
    return df.select(*[c for c in df.columns if c != array], F.posexplode(array).alias("pos", value))


def densify(long: DataFrame, key: str, minutes: int, fill: float | None = None, ts: str = "start", value: str = "speed") -> DataFrame:
    """Every key at every step between the first and last time of all; missing values null or ``fill``.

    The grid is the result itself: its rows are generated per key from the two
    ends of the time axis and left-joined on the key and time.
    """
    ends = long.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    axis = F.sequence(F.col("ends.lo"), F.col("ends.hi"), F.expr(f"INTERVAL {minutes} MINUTES"))
    keys = long.select(key).distinct().withColumn("ends", ends.select(F.struct("lo", "hi")).scalar())
    grid = keys.select(key, F.explode(axis).alias(ts))
    out = grid.join(long, [key, ts], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def last_n_slots(long: DataFrame, n: int, ts: str = "start") -> DataFrame:
    """Rows of the n latest distinct times; times are ranked on their distinct values only."""
    times = long.select(ts).distinct().orderBy(F.desc(ts)).limit(n)
    return long.join(times, ts, "left_semi")


def forward_fill(long: DataFrame, key: str, ts: str = "start", value: str = "speed") -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn(value, F.last(value, ignorenulls=True).over(w))


def arg_min(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """The row with the smallest score, ties by the named columns; a combine on the map side, no sort."""
    order = [score, *ties]
    best = df.agg(F.min(F.struct(*order, F.struct(*df.columns).alias("row"))).alias("b"))
    return best.filter("b is not null").select("b.row.*")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same on each run: those with the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
