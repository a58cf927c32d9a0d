"""Properties of physical plans that scale depends on."""

import pytest
from pyspark.sql import functions as F

from roadweave.operators import points as P
from roadweave.plans import graph, matrix, points, sources, trips  # noqa: F401
from roadweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
GRIDS = {"cross_flow", "od_matrix", "zone_flow"}  # a full grid is the result itself
NUMPY = {  # fits and iterations that no expression can say
    "vincenty", "user_regions", "user_regions_both", "recurrent_trips", "time_clusters", "heading_clusters", "ar_5", "ols_all_segments", "lasso_all_segments", "lasso_cv",
    "lasso_by_slice", "regime_search", "empirical_risk", "dickey_fuller",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"merge_segments", "home_classifier", "segment_kmeans", "is_residential", "remove_roundabouts", "source_osm"}))
def test_no_products_and_no_python(spark, name):
    p = plan(QUERIES[name](spark, SF))
    if name not in GRIDS:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p
    assert ("InPandas" in p or "ArrowEvalPython" in p) == (name in NUMPY)


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("event_id", "pid")
    p = plan(P.time_range(df, "2024-01-10 00:00:00", "2024-01-11 00:00:00").select("pid"))
    assert "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_trips_take_one_shuffle(spark):
    from roadweave.operators.trips import build_trips, cut_by_gaps_and_stops
    from roadweave.plans.views import gps

    p = plan(build_trips(cut_by_gaps_and_stops(gps(spark, SF))).select("id", "trip_id", F.col("km")))
    assert p.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
