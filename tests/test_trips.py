"""Cutting logs into trips against a plain loop over the rules, and hand-made cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadweave.functions import time as T
from roadweave.operators import points as P
from roadweave.operators import trips as TR

START = datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (car, minute, speed)"""
    data = [(i, car, START + timedelta(minutes=m), float(s), 1, 0, 0.0, -1.7 + i * 1e-4, 48.1) for i, (car, m, s) in enumerate(rows)]
    return spark.createDataFrame(data, "pid long, id long, ts timestamp, speed double, road long, heading_road int, heading double, lon double, lat double")


def by_rules(times, speeds, gap=15, stop=10):
    """Trip number of each point of one car, straight from the rules."""
    cuts, n = set(), len(times)
    segments, first = [], 0
    for i in range(1, n):
        if times[i] - times[i - 1] > gap:
            cuts.add(i)
            segments.append((first, i))
            first = i
    segments.append((first, n))
    for a, b in segments:
        runs, i = [], a
        while i < b:
            j = i
            while j < b and (speeds[j] > 0) == (speeds[i] > 0):
                j += 1
            runs.append((i, j))
            i = j
        if len(runs) < 2:
            continue
        for i, j in runs:
            if speeds[i] > 0:
                continue
            end = j if j < b else b - 1
            if times[end] - times[i] > stop:
                cuts.add(end - 1 if times[end] - times[end - 1] < stop // 2 else end)
    trip, out = 0, []
    for i in range(n):
        trip += i in cuts
        out.append(trip)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_logs(spark, seed):
    rnd, rows, want = random.Random(seed), [], {}
    for car in range(40):
        times, t = [], 0.0
        for _ in range(rnd.randrange(1, 40)):
            t += rnd.choice([0.5, 1, 2, 4, 5, 6, 11, 15, 16, 40])
            times.append(t)
        speeds = [rnd.choice([0, 0, 0, 30]) for _ in times]
        want[car] = by_rules(times, speeds)
        rows += [(car, m, s) for m, s in zip(times, speeds)]
    got = TR.cut_by_gaps_and_stops(frame(spark, rows)).orderBy("id", "ts", "pid").collect()
    have = {}
    for r in got:
        have.setdefault(r.id, []).append(r.trip_id)
    assert have == want


def trip_ids(spark, rows, fn=TR.cut_by_gaps_and_stops):
    return [r.trip_id for r in fn(frame(spark, [(1, m, s) for m, s in rows])).orderBy("ts", "pid").collect()]


def test_hand_made_cases(spark):
    assert trip_ids(spark, [(0, 5), (15, 5), (30 + 1 / 60, 5)], TR.cut_by_gaps) == [0, 0, 1]
    # stop of 11.5 minutes, last step 5.5: cut at the moving point
    assert trip_ids(spark, [(0, 9), (1, 0), (6, 0), (7, 0), (12.5, 9)]) == [0, 0, 0, 0, 1]
    # a stopped point half a minute before: cut there
    assert trip_ids(spark, [(0, 9), (1, 0), (6, 0), (7, 0), (12, 0), (12.5, 9)]) == [0, 0, 0, 0, 1, 1]
    assert trip_ids(spark, [(m, 0) for m in range(0, 31, 5)]) == [0] * 7
    assert trip_ids(spark, [(0, 0), (5, 0), (10, 9), (11, 9)]) == [0] * 4


def test_trips_partition_points(spark):
    rows = [(c, m * 7 % 90, m % 3 * 10) for c in range(5) for m in range(30)]
    trips = TR.build_trips(TR.cut_by_gaps_and_stops(frame(spark, rows)))
    assert trips.agg(F.sum("points")).first()[0] == len(rows)
    one = trips.orderBy("id", "trip_id").first()
    assert len(one.leg_s) == one.points - 1 and one.km == pytest.approx(sum(one.leg_km)) and sum(one.leg_s) == pytest.approx(one.dur_s)


def test_filters_drop_zero_durations(spark):
    trips = TR.build_trips(TR.cut_by_gaps(frame(spark, [(1, 0, 0), (2, 0, 0), (2, 5, 0)])))
    assert TR.filter_trips_short(trips, min_km=0, min_s=0).select("id").collect()[0].id == 2
    assert TR.filter_trips_short(trips, min_km=0, min_s=0).count() == 1


def test_zone_flow(spark):
    od = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)], "begin_zone int, end_zone int, n long")
    assert {r.zone: r.flow for r in TR.zone_flow(od).collect()} == {1: 6, 2: 9}


def test_aberrant_boundary(spark):
    five = [(1, m, 0) for m in range(5)]
    six = [(2, m, 0) for m in range(6)]
    left = P.remove_aberrant(frame(spark, five + six + [(2, 7, 10)])).collect()
    assert sum(r.id == 1 for r in left) == 5 and sorted(r.pid for r in left if r.id == 2) == [5, 11]
    assert sorted(r.pid for r in P.aberrant(frame(spark, five + six)).collect()) == [6, 7, 8, 9, 10]


def test_bucket_offset(spark):
    rows = frame(spark, [(1, 0, 1), (1, 15, 1), (1, 29 + 59 / 60, 1)])
    got = [r.b.strftime("%H:%M") for r in rows.orderBy("pid").select(T.bucket_start(F.col("ts"), 15, 10).alias("b")).collect()]
    assert got == ["23:55", "00:10", "00:25"]
    with pytest.raises(ValueError):
        T.slot_of_day(F.col("ts"), 61)


def test_first_last_of_a_day_with_one_point(spark):
    got = TR.first_last_per_day(frame(spark, [(1, 3, 1)])).collect()
    assert sorted(r.side for r in got) == ["first", "last"]


def test_multi_key_sort_keeps_every_group(spark):
    from roadweave.plans import trips, views  # noqa: F401
    from roadweave.plans.registry import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES["multi_key_sort"](spark, d).orderBy("r").collect()
    assert len(got) == views.gps(spark, d).select("road", "kind").distinct().count() > 50
    assert [r.r for r in got] == list(range(1, len(got) + 1)) and got == sorted(got, key=lambda r: (-r.n, r.kind, r.road))
