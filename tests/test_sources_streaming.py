from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadweave.sources import logs, osm, zones
from roadweave.streaming import speeds

XML = """<?xml version="1.0"?><osm>
<node id="1" lat="48.1" lon="-1.7" version="2" timestamp="2020-01-02T03:04:05Z"/>
<node id="2" lat="48.2" lon="-1.6"><tag k="highway" v="stop"/></node>
<node id="3" lat="48.3" lon="-1.5"/>
<way id="10" user="u"><nd ref="1"/><nd ref="3"/><nd ref="99"/><nd ref="2"/><tag k="highway" v="primary"/></way>
<way id="11"><nd ref="2"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="node" ref="2" role=""/><tag k="type" v="route"/></relation>
</osm>"""


def test_osm_xml(spark, tmp_path):
    (tmp_path / "x.osm").write_text(XML)
    got = osm.ingest(spark, str(tmp_path / "x.osm"))
    ways = {r.id: r for r in got["ways"].collect()}
    assert ways[10].nodes == [1, 3, 99, 2] and [c.lon for c in ways[10].coords] == [-1.7, -1.5, -1.6]
    assert ways[10].relations == [20] and ways[11].relations == [] and ways[10].key == ["highway"] and ways[11].tag == []
    nodes = {r.id: r for r in got["nodes"].collect()}
    assert nodes[2].relations == [20] and nodes[1].version == 2 and nodes[1].timestamp == datetime(2020, 1, 2, 3, 4, 5)
    assert got["relations"].first().members[0].role == "outer"


def test_logs(spark, tmp_path):
    rows = [(i, f"c{i % 3}", 1_700_000_000 + i, float(i)) for i in range(9)]
    spark.createDataFrame(rows[::-1], "pid long, id string, ts long, speed double").write.parquet(str(tmp_path / "coll_2018a"))
    spark.createDataFrame(rows[:2], "pid long, id string, ts long, speed double").write.parquet(str(tmp_path / "coll_2018b"))
    spark.createDataFrame(rows[:1], "pid long, id string, ts long, speed double").write.parquet(str(tmp_path / "other"))
    raw = logs.load_raw(spark, str(tmp_path / "coll_2018a"), limit=2)
    assert [r.pid for r in raw.collect()] == [0, 1] and dict(raw.dtypes)["ts"] == "timestamp"
    assert logs.load_projected(spark, str(tmp_path / "coll_2018a"), include=["pid", "ts"]).columns == ["pid", "ts"]
    assert logs.load_projected(spark, str(tmp_path / "coll_2018a"), exclude=["speed"]).columns == ["pid", "id", "ts"]
    both = logs.read_by_prefix(spark, str(tmp_path), "coll_2018")
    assert both.count() == 11 and both.select("source_file").distinct().count() >= 2
    logs.write_json(both, str(tmp_path / "out_json"))
    assert spark.read.json(str(tmp_path / "out_json")).count() == 11
    logs.write_csv(both, str(tmp_path / "out_csv"))
    assert spark.read.csv(str(tmp_path / "out_csv"), header=True).count() == 11


def test_csv_log(spark, tmp_path):
    (tmp_path / "cars.csv").write_text("id,latitude,longitude,heading,speed,ts\na,48.1,-1.7,90,x,2020-01-01 00:00:00\nb,,,,,\n")
    got = {r.id: r for r in logs.read_csv_log(spark, str(tmp_path / "cars.csv")).collect()}
    assert got["a"].lat == 48.1 and got["a"].speed is None and got["b"].lon is None


def test_updates_and_coefficients(spark, tmp_path):
    p = spark.createDataFrame([(1, 5, 0), (2, None, None)], "pid long, road long, heading_road int")
    m = spark.createDataFrame([(2, 9, 1)], "pid long, road long, heading_road int")
    assert {(r.pid, r.road) for r in logs.update_matches(p, m).collect()} == {(1, 5), (2, 9)}
    assert [r.pid for r in logs.delete_points(p, m).collect()] == [1]
    logs.write_coefficients(spark.createDataFrame([(1, 2.5), (0, 1e-9)], "k int, value double"), str(tmp_path / "alphas"))
    assert [(r.k, r.value) for r in logs.read_coefficients(spark, str(tmp_path / "alphas") + "/*.txt").orderBy("k").collect()] == [(0, 1e-9), (1, 2.5)]
    assert logs.yesterday_name("c", date(2018, 1, 2)) == "c_201811"
    t = spark.createDataFrame([(1, date(2020, 1, 1))], "id int, day date")
    logs.append_trips(t, str(tmp_path / "trips"))
    logs.append_trips(t, str(tmp_path / "trips"))
    assert spark.read.parquet(str(tmp_path / "trips")).count() == 2


def test_zones(spark, tmp_path):
    (tmp_path / "z.json").write_text(
        '{"features":[{"properties":{"code":"a","dept":"35"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},'
        '{"properties":{"code":"b","dept":"22"},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6]]],[[[7,7],[8,7],[8,8]]]]}}]}'
    )
    z = zones.zones_from_geojson(spark, str(tmp_path / "z.json"))
    assert {(r.zone, len(r.ring)) for r in z.collect()} == {("a", 3), ("b", 3)} and z.count() == 3
    assert zones.zones_from_geojson(spark, str(tmp_path / "z.json"), dept="35", swap=True).first().ring[1].lat == 1.0


def test_streaming_speeds_and_sessions(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(minutes=4 * i), 10.0 + i, i % 2, 0) for i in range(60)] + [(99, 1, start + timedelta(days=2), 1.0, 1, 0)]
    schema = "pid long, id long, ts timestamp, speed double, road long, heading_road int"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    points = speeds.read_points(spark, str(tmp_path / "in"), df.schema)
    q = speeds.write_batches(speeds.speed_matrix(points), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = df.filter("pid < 99").groupBy("road", F.window("ts", "15 minutes")).agg(F.avg("speed"), F.count("*"))
    assert got.count() == want.count() and got.agg(F.sum("cnt")).first()[0] == 60
    q = speeds.write_batches(speeds.sessions(points, 11), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out2")).agg(F.sum("points")).first()[0] == 60
    q = speeds.write_batches(speeds.sliding_speeds(points), str(tmp_path / "out3"), str(tmp_path / "cp3"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out3")).agg(F.sum("cnt")).first()[0] == 180


@pytest.fixture(autouse=True)
def _stop_streams(spark):
    yield
    for q in spark.streams.active:
        q.stop()
