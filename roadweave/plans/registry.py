"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] | str = (), rounded: tuple[str, ...] | str = (), digits: int = 6, dates: tuple[str, ...] | str = ()):
    """Registers a query; the columns in ``rounded`` are rounded in both forms, so that the order of sums does not show, and ``dates`` become text."""
    views = (views,) if isinstance(views, str) else tuple(views)
    rounded = (rounded,) if isinstance(rounded, str) else tuple(rounded)
    dates = (dates,) if isinstance(dates, str) else tuple(dates)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            changed = {c: F.round(c, digits) for c in rounded} | {c: F.col(c).cast("string") for c in dates}
            return df.withColumns(changed) if changed else df

        run.__doc__, run.__name__ = fn.__doc__, name
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = sql
            if rounded or dates:
                cols = ", ".join([*(f"round({c}, {digits}) AS {c}" for c in rounded), *(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)])
                body = f"SELECT * REPLACE ({cols}) FROM ({sql}) AS q"
            ORACLES[name] = with_views(body, views)
        return fn

    return register
