import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, traffic
from roadweave.operators import graph as G
from roadweave.operators import matching as M
from roadweave.operators.merging import Group, greedy_merge, merge_segments


def km(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, a)))


def scene(spark, n=300, roads=40, seed=2):
    rnd = random.Random(seed)
    p = lambda: (rnd.uniform(-1.75, -1.55), rnd.uniform(48.07, 48.16))
    pts = [(i, *p(), float(rnd.randrange(360))) for i in range(n)]
    ways = []
    for r in range(roads):
        x, y = p()
        line = [(x, y)]
        for _ in range(rnd.randrange(1, 4)):
            line.append((line[-1][0] + rnd.uniform(-0.02, 0.02), line[-1][1] + rnd.uniform(-0.01, 0.01)))
        ways.append((r, rnd.choice([None, "yes", "no", "-1"]), line))
    points = spark.createDataFrame(pts, "pid long, lon double, lat double, heading double")
    return pts, ways, points, spark.createDataFrame(ways, "road long, oneway string, coords array<struct<lon:double,lat:double>>")


def brute_nearest(pts, ways):
    out = {}
    for i, x, y, _ in pts:
        best = None
        for r, _, line in ways:
            for k, ((a, b), (c, d)) in enumerate(zip(line, line[1:])):
                t = ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)
                t = max(0.0, min(1.0, t))
                m = 1000 * km(x, y, a + t * (c - a), b + t * (d - b))
                best = min(best, (m, r, k)) if best else (m, r, k)
        out[i] = best
    return out


@pytest.mark.parametrize("metres", [50, 400, 3000])
def test_nearest_road_against_brute_force(spark, metres):
    pts, ways, points, roads = scene(spark)
    want = brute_nearest(pts, ways)
    for r in M.nearest_road(points, roads, metres).collect():
        m, road, _ = want[r.pid]
        if m <= metres:
            assert r.road == road and r.metres == pytest.approx(m)
        else:
            assert r.road is None


def test_nearest_at_any_distance(spark):
    pts, ways, points, roads = scene(spark, 60, 5)
    want = brute_nearest(pts, ways)
    got = M.nearest_way_any_distance(points, roads, 100.0).collect()
    assert len(got) == 60 and all(r.road == want[r.pid][1] for r in got)


def test_polygon_and_nearest_zone(spark):
    ring = [(0.0, 0.0), (4.0, 1.0), (3.0, 4.0), (2.0, 2.0), (1.0, 4.0)]
    inside = [(2.0, 1.5), (1.0, 2.0), (3.0, 3.0)]
    outside = [(2.0, 3.0), (0.0, 3.0), (5.0, 1.0), (2.0, 0.2)]
    zones = spark.createDataFrame([("a", ring)], "zone string, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(inside + outside)], "pid long, lon double, lat double")
    got = {r.pid: r.zone for r in M.zone_of_points(points, zones, 0.5).collect()}
    assert [got[i] for i in range(7)] == ["a"] * 3 + ["N/A"] * 4
    near = {r.pid: r.zone for r in M.zone_within(points, zones, 40_000.0).collect()}
    assert near[6] == "a" and near[4] == "N/A"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_headings(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    h = lambda tag: geo.road_headings(F.lit(10.0), F.lit(tag))
    r = one(spark, h(None).alias("n"), h("yes").alias("y"), h("-1").alias("b"), h("no").alias("o"))
    assert (r.n, r.y, r.b, r.o) == ([10.0, 190.0], [10.0], [190.0], [10.0])
    bits = [one(spark, geo.heading_direction(a(10, 190), F.lit(float(x))))[0] for x in (100, 101, 190)]
    assert bits == [0, 1, 1]
    assert one(spark, geo.heading_gap(F.lit(350.0), F.lit(10.0)))[0] == 20


def test_one_way_and_congestion(spark):
    w = lambda *x: one(spark, traffic.one_way(*[F.lit(v).cast("string") for v in x]))[0]
    assert [w("yes", None, None), w("-1", None, None), w("no", None, None), w(None, None, None), w(None, "motorway", None), w("-1", None, "circular")] == [1, -1, 0, 0, 1, 1]
    level = lambda s, limit: one(spark, traffic.congestion_level(traffic.congestion(F.lit(s).cast("double"), F.lit(limit))))[0]
    assert [level(24.99, "100"), level(25, "100"), level(69.99, "100"), level(70, "100"), level(None, "100"), level(3, "walk"), level(30, "50+"), level(3, "0")] == [0, 1, 1, 2, -1, -1, 1, -1]


def test_vincenty_known_distance():
    # Flinders Peak to Buninyong, the classic check of the inverse formula: 54972.271 m
    d = geo.vincenty_arrays(np.array([144 + 25 / 60 + 29.52440 / 3600]), np.array([-(37 + 57 / 60 + 3.72030 / 3600)]), np.array([143 + 55 / 60 + 35.38390 / 3600]), np.array([-(37 + 39 / 60 + 10.15610 / 3600)]))
    assert d[0] == pytest.approx(54.972271, abs=2e-3)
    assert geo.vincenty_arrays(*[np.array([1.0])] * 4)[0] == 0


def test_line_meets_box(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    lines = [([(-1.0, 0.5), (2.0, 0.5)], True), ([(-1.0, 2.0), (2.0, 2.0)], False), ([(0.5, 0.5), (9.0, 9.0)], True), ([(-1.0, 0.5), (0.5, 2.5)], False), ([(0.5, -1.0), (0.5, 3.0)], True), ([(5.0, 5.0)], False)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(lines)], "i int, c array<struct<lon:double,lat:double>>")
    got = {r.i: r.x for r in df.select("i", geo.line_meets_box(F.col("c"), box).alias("x")).collect()}
    assert [got[i] for i in range(len(lines))] == [x for _, x in lines]


def ways(spark, rows):
    data = [(w, n, [(float(k), float(k % 3)) for k in n], hw, ow, "50") for w, n, hw, ow in rows]
    return spark.createDataFrame(data, "way long, nodes array<long>, coords array<struct<lon:double,lat:double>>, highway string, oneway int, limit string")


def brute_edges(segs):
    out = set()
    for s, x in segs.items():
        for t, y in segs.items():
            if x != y and x != y[::-1] and (x[-1] in y[:-1] or y[0] in x[1:]):
                out.add((s, t))
    return out


def test_edges_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(25) for _ in range(rnd.randrange(1, 5))], "a", rnd.choice([-1, 0, 1])) for i in range(60)]
    s = G.directed_segments(ways(spark, rows))
    segs = {r.segment: r.nodes for r in s.collect()}
    assert {(r.src, r.dst) for r in G.ins_outs(s).collect()} == brute_edges(segs)
    linear = {(a, b) for a, x in segs.items() for b, y in segs.items() if x[-1] == y[0] and x != y and x != y[::-1]}
    assert {(r.src, r.dst) for r in G.linear_edges(s).collect()} == linear
    turned = {r.segment: r.nodes for r in G.directed_segments(ways(spark, rows), reverse_nodes=True).collect()}
    assert all(turned[f"{w}_0"] == (n[::-1] if o == -1 else n) for w, n, _, o in rows)


def test_adjacency_levels_on_a_path(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(9)], "segment string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src string, dst string")
    got = {(r.src, r.dst): r.w for r in G.add_levels(G.adjacency(nodes, edges), 3).collect()}
    want = {0: 4, 1: 4, 2: 3, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1}
    assert {j: got[("n0", f"n{j}")] for j in range(9)} == want


def test_roundabouts(spark):
    s = G.directed_segments(ways(spark, [(1, [1, 2], "a", 1), (2, [2, 5, 6, 2], "a", 1), (3, [2, 3], "a", 1), (4, [3, 7, 3], "a", 1), (5, [3, 4], "a", 1)]))
    e = G.linear_edges(s)
    got = {(r.src, r.dst) for r in G.remove_roundabouts(s, e).collect()}
    assert got == {("1_0", "3_0"), ("3_0", "5_0")}
    merged = G.merge_roundabout_chunks([{"way": 9, "nodes": [1, 2, 3]}, {"way": 4, "nodes": [3, 4, 1]}, {"way": 7, "nodes": [8, 9]}])
    assert merged == [{"way": 4, "nodes": [3, 4, 1, 2, 3]}]
    assert G.chain_walk(e, "1_0") == ["1_0", "2_0", "3_0", "4_0", "5_0"]


def test_rings_of_roundabouts(spark):
    """Roundabouts that lead to each other in a circle: whatever goes in comes out at every exit."""
    rings = [(10 + i, [20 + i, 30 + i, 20 + i]) for i in range(3)]
    segs = spark.createDataFrame([(f"{w}_0", n[0], n[-1]) for w, n in rings] + [(f"{w}_0", w, w + 100) for w in (1, 2, 3)], "segment string, first long, last long")
    edges = [("10_0", "11_0"), ("11_0", "12_0"), ("12_0", "10_0"), ("1_0", "10_0"), ("12_0", "2_0"), ("11_0", "3_0"), ("2_0", "3_0")]
    got = {(r.src, r.dst) for r in G.remove_roundabouts(segs, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {("1_0", "2_0"), ("1_0", "3_0"), ("2_0", "3_0")}
    with pytest.raises(RuntimeError):
        G.remove_roundabouts(segs, spark.createDataFrame(edges, "src string, dst string"), rounds=1)


def test_merge_criteria_by_hand(spark):
    """Heads are compared with an out, tails with an in; a common end links; the better share of the two counts."""
    e, a0, a60 = "segment string, share double, tail long, head long, head_cos double, head_sin double, tail_cos double, tail_sin double, km double, members int, highway string", (1.0, 0.0), (0.5, 0.75 ** 0.5)
    rows = [("a", 0.5, 1, 2, *a0, *a60, 1.0, 1, "h"), ("b", 0.1, 2, 3, *a60, *a60, 4.0, 10, "h"), ("c", 0.3, 9, 2, *a60, *a0, 1.0, 1, "h"), ("d", 0.3, 7, 8, *a60, *a60, 1.0, 1, "x"), ("e", 0.1, 7, 8, *a0, *a60, 1.0, 1, "h")]
    prof = spark.createDataFrame([("a", 0, 1.0)], "segment string, slot int, speed double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "e")], "src string, dst string")
    got = {(r.src, r.dst): r.criterion for r in G.merge_criteria(pairs, spark.createDataFrame(rows, e), prof, 4, min_share=0.8).collect()}
    turn = math.exp(0.5 + 0.75 ** 0.5) - 1
    turn = math.inf if turn > math.e else turn
    assert got["a", "b"] == pytest.approx(2 + turn + 0 + 3) or got["a", "b"] == turn == math.inf
    assert got["b", "a"] == pytest.approx(2 + 0 + 0 + 3)  # a is an in of b: tails are alike; share 0.5 > 0.4, 11 members, 5 km
    assert got["a", "c"] == pytest.approx(2 + turn + 0 + 1) or got["a", "c"] == turn == math.inf  # both end in 2: linked, not an out
    assert got["a", "d"] == math.inf
    assert got["a", "e"] == pytest.approx(2 + 0 + 1 + 1)  # no common end
    assert got["b", "e"] == pytest.approx(2 + 0 + 1 + 2)  # nobody has more than 0.4


def group(i, speeds, ins, outs, km=1.0, highway="a"):
    return Group(i, highway, km, i, i + 1, (1.0, 0.0), (1.0, 0.0), {i, i + 1}, set(ins), set(outs), np.array(speeds, float))


def test_greedy_merge():
    nan = math.nan
    chain = [group(0, [5, nan, nan, nan], [], [1]), group(1, [5, 5, nan, nan], [0], [2]), group(2, [nan, nan, 5, 5], [1], [3]), group(3, [9, 9, 9, 9], [2], [])]
    owner = greedy_merge(chain)
    # all four together would have neither ins nor outs: the last merge is refused
    assert owner == {0: 0, 1: 1, 2: 1, 3: 1}
    chain = [group(0, [5, nan, nan, nan], [7], [1]), group(1, [5, 5, nan, nan], [0], [2]), group(2, [nan, nan, 5, 5], [1], [3]), group(3, [9, 9, 9, 9], [2], [8])]
    owner = greedy_merge(chain)
    assert len(set(owner.values())) == 1
    other = [group(0, [5, nan], [], [1]), group(1, [5, 5], [0], [], highway="b")]
    assert greedy_merge(other) == {0: 0, 1: 1}
    full = [group(0, [5, 5], [], [1]), group(1, [5, 5], [0], [])]
    assert greedy_merge(full) == {0: 0, 1: 1}


def test_merge_segments_table(spark):
    rows = [(f"s{i}", "a", 1.0, i, i + 1, [i, i + 1], [(0.0, float(i)), (0.0, float(i + 1))]) for i in range(3)]
    segs = spark.createDataFrame(rows, "segment string, highway string, km double, first long, last long, nodes array<long>, coords array<struct<lon:double,lat:double>>")
    edges = spark.createDataFrame([("s0", "s1"), ("s1", "s2")], "src string, dst string")
    prof = spark.createDataFrame([("s0", 0, 5.0), ("s1", 0, 5.0), ("s1", 1, 5.0), ("s2", 1, 5.0), ("s2", 2, None)], "segment string, slot int, speed double")
    got = {r.segment: r.grp for r in merge_segments(segs, edges, prof, [0, 1]).collect()}
    assert set(got) == {"s0", "s1", "s2"} and got["s0"] in got.values()
    with pytest.raises(ValueError):
        merge_segments(segs, edges, prof, [0, 1], most_segments=2)


def test_merge_by_component_is_one_loop_over_all(spark):
    import random

    rnd = random.Random(5)
    rows, speeds = [], []
    for i in range(120):
        x, y = rnd.randrange(40), rnd.randrange(40)
        rows.append((f"s{i}", rnd.choice("abc"), rnd.random(), x, y, [x, y], [(float(x), 0.0), (float(y), 1.0)]))
        speeds += [(f"s{i}", k, 10 * rnd.random()) for k in range(4) if rnd.random() < 0.3]
    segs = spark.createDataFrame(rows, "segment string, highway string, km double, first long, last long, nodes array<long>, coords array<struct<lon:double,lat:double>>")
    links = [(a[0], b[0]) for a in rows for b in rows if a[4] == b[3] and a is not b]
    got = {r.segment: r.grp for r in merge_segments(segs, spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(speeds, "segment string, slot int, speed double"), list(range(4))).collect()}
    rows.sort()
    at = {r[0]: i for i, r in enumerate(rows)}
    table = np.full((len(rows), 4), np.nan)
    for s, k, v in speeds:
        table[at[s], k] = v
    groups = []
    for i, (s, kind, km, x, y, nodes, c) in enumerate(rows):
        az = math.atan2(c[1][0] - c[0][0], c[1][1] - c[0][1])
        way = math.cos(az), math.sin(az)
        groups.append(Group(i, kind, km, x, y, way, way, set(nodes), {at[a] for a, b in links if b == s}, {at[b] for a, b in links if a == s}, table[i]))
    want = {rows[i][0]: rows[g][0] for i, g in greedy_merge(groups).items()}
    assert got == want and len(set(want.values())) < len(rows)


def test_merge_query_runs_on_the_road_graph(spark):
    from roadweave.plans import graph, views  # noqa: F401
    from roadweave.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    got = QUERIES["merge_segments"](spark, d).collect()
    assert sorted(r.segment for r in got) == sorted(r.segment for r in G.directed_segments(views.ways(spark, d)).filter(F.size("coords") > 1).select("segment").collect())
    assert len({r.grp for r in got}) < len(got)


def test_segment_attributes_query_has_shares_and_directions(spark):
    from roadweave.plans import graph  # noqa: F401
    from roadweave.plans.registry import QUERIES

    got = QUERIES["segment_attributes"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.share for r in got}) > 2 and min(r.share for r in got) > 0
    assert all(abs(r[f"{e}_cos"] ** 2 + r[f"{e}_sin"] ** 2 - 1) < 1e-5 for r in got for e in ("head", "tail"))
    assert len({r.head_cos for r in got}) > 100


def test_merge_by_ends_is_merge_by_linear_edges(spark, monkeypatch):
    """Segments alone give what their table of edges gives: with closed ways, equal and opposite node lists in other classes, unknown classes and nodes."""
    from roadweave.operators import merging

    monkeypatch.setattr(merging, "SMALL", 9)
    rnd = random.Random(11)
    rows = [(i, [rnd.randrange(30) for _ in range(rnd.randrange(1, 4))], rnd.choice(["a", "b", None]), rnd.choice([-1, 0, 1])) for i in range(150)]
    rows += [(200 + i, rnd.choice([n, n[::-1]]), rnd.choice(["a", "c", None]), 0) for i, (_, n, _, _) in enumerate(rows[:60])]
    rows += [(300, [100, 101], "a", 1), (301, [101, 100], "b", 1), (302, [110, 111], "a", 1), (303, [111, 112], "b", 1), (304, [120, 120], "a", 1), (305, [120, 120], "b", 1)]
    segs = G.directed_segments(ways(spark, rows)).withColumn("km", geo.path_km(F.col("coords")))
    names = [r.segment for r in segs.select("segment").collect()]
    speeds = [(s, k, float(rnd.randrange(1, 60))) for s in names for k in range(10) if rnd.random() < 0.4]
    prof = spark.createDataFrame(speeds, "segment string, slot int, speed double").localCheckpoint()
    edges = G.linear_edges(segs)
    got, want = ({r.segment: r.grp for r in merge_segments(segs, e, prof, list(range(10))).collect()} for e in (None, edges))
    assert got == want and len(got) > len(set(got.values()))
    assert got.keys() == {r.segment for r in segs.filter(F.size("coords") > 1).select("segment").collect()}
    stored = merging.materialize(segs.filter(F.size("coords") > 1).select("segment", "highway", "first", "last", "nodes", F.monotonically_increasing_id().alias("id"), F.xxhash64(F.least("nodes", F.reverse("nodes"))).alias("list")), "test")
    kind = {r.segment: r.highway for r in stored.collect()}
    other = [(r.src, r.dst) for r in edges.collect() if r.src in kind and r.dst in kind and kind[r.src] != kind[r.dst]]
    near = merging.near_by_ends(stored).join(stored.select("id", "segment"), "id").collect()
    assert {r.segment for r in near if r.ins_other} == {b for _, b in other} and {r.segment for r in near if r.outs_other} == {a for a, _ in other}
    assert not {"300_0", "301_0", "304_0", "305_0"} & {x for pair in other for x in pair} and ("302_0", "303_0") in other


def test_merge_query_writes_no_pairs_of_segments(spark, monkeypatch):
    """What the merge writes grows with the segments (and their two ends), not with the pairs that meet at a node, here 90,000."""
    from roadweave.operators import merging

    n, rows = 300, []
    for i in range(n):
        rows += [(i, [1000 + i, 1], f"in{i}", 1), (n + i, [1, 5000 + i], f"out{i % 20}", 1)]
    segs = G.directed_segments(ways(spark, rows)).withColumn("km", F.lit(1.0)).withColumn("speeds", F.array(F.lit(5.0), F.lit(None)))
    sizes = []

    def counted(df, name, keep=merging.materialize):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(merging, "materialize", counted)
    got = merge_segments(segs, None, None, [0, 1]).collect()
    assert len(got) == 2 * n and sizes and max(sizes) <= 4 * n


def test_profile_gap_is_the_sum_of_numpy():
    from roadweave.operators.merging import profile_gap

    rnd = random.Random(4)
    for slots in (3, 7, 8, 24):
        for _ in range(200):
            a, b = ([rnd.choice([None, 60 * rnd.random()]) for _ in range(slots)] for _ in "ab")
            x, y = (np.array([math.nan if v is None else v for v in s]) for s in (a, b))
            both = ~np.isnan(x) & ~np.isnan(y)
            n, x, y = int(both.sum()), x[both], y[both]
            assert profile_gap(a, b) == (float(np.mean((x / (1 + x.sum()) - y / (1 + y.sum())) ** 2)) + 1 - n / slots if n else 2.0)


def chain_case(rnd, n, places, slots, whole_numbers=False):
    """Arguments of ``chain_owners`` and of ``greedy_owners`` for the same random segments of one class, some of them equal or opposite."""
    nodes = [[rnd.randrange(places) for _ in range(rnd.randrange(2, 5))] for _ in range(n)]
    for i in range(0, n, 6):
        nodes[i] = rnd.choice(nodes)[:: rnd.choice([1, -1])]
    turn = lambda: round(rnd.uniform(-3, 3), 0 if whole_numbers else 9)
    tail, head = ([(math.cos(z), math.sin(z)) for z in (turn() for _ in nodes)] for _ in "th")
    km = [2 * rnd.random() for _ in nodes]
    speeds = [[(float(rnd.randrange(1, 4)) if whole_numbers else 60 * rnd.random()) if rnd.random() < 0.3 else None for _ in range(slots)] for _ in nodes]
    first, last, ins, outs = [x[0] for x in nodes], [x[-1] for x in nodes], [[] for _ in nodes], [[] for _ in nodes]
    others = [[rnd.random() < 0.2 for _ in nodes] for _ in "io"]
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            if a[-1] == b[0] and a != b and a != b[::-1]:
                outs[i].append(j)
                ins[j].append(i)
    for near, other in ((ins, others[0]), (outs, others[1])):
        for x, more in zip(near, other):
            x.extend([-1] * more)
    at = np.cumsum([0, *map(len, nodes)])
    alike = np.array([hash(tuple(min(x, x[::-1]))) % 97 for x in nodes], np.int32)
    flat = [np.array(x) for x in (tail, head)]
    new = (np.array(km), np.array(first, np.int32), np.array(last, np.int32), *((np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])) for x in flat), np.array(sum(nodes, [])), at, alike)
    new += (*map(np.array, others), np.array([[math.nan if v is None else v for v in s] for s in speeds]))
    return new, (["a"] * n, km, first, last, tail, head, nodes, ins, outs, speeds, [1] * n)


def test_merge_in_arrays_is_merge_in_objects(monkeypatch):
    """With few and many links at a node, equal prices, profiles that NumPy sums in another order, and offers that are put aside."""
    from roadweave.operators import chains
    from roadweave.operators.merging import greedy_owners

    rnd = random.Random(8)
    for k in range(60):
        monkeypatch.setattr(chains, "KEEP", rnd.choice([5, 10_000]))
        monkeypatch.setattr(chains, "FEW", rnd.choice([0, 24]))
        n = rnd.choice([20, 90, 200])
        new, old = chain_case(rnd, n, max(1, int(n * rnd.choice([0.03, 0.2, 0.6]))), rnd.choice([1, 3, 7, 10]), k % 2 == 0)
        assert chains.chain_owners(*new).tolist() == greedy_owners(*old)


def test_merge_of_many_links_at_a_node_holds_segments_only():
    """1,200 segments with 360,000 links at one node: pairs, as objects or in lists, would take some 100 MB."""
    import tracemalloc

    from roadweave.operators.chains import chain_owners

    n, rnd = 600, random.Random(2)
    begin, end = np.array([*range(1, n + 1), *[0] * n], np.int32), np.array([*[0] * n, *range(n + 1, 2 * n + 1)], np.int32)
    nodes, at, one = np.stack([begin, end], axis=1).astype(np.int64).reshape(-1), np.arange(0, 4 * n + 1, 2), np.ones(2 * n)
    speeds = np.array([[60 * rnd.random() if rnd.random() < 0.4 else math.nan for _ in range(7)] for _ in one])
    tracemalloc.start()
    try:
        owner = chain_owners(one.copy(), begin, end, (one, one), (one, one), nodes, at, np.arange(2 * n), one > 0, one > 0, speeds)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4e6 and len(set(owner.tolist())) < 2 * n


def test_merge_query_reads_a_component_batch_by_batch(spark, monkeypatch):
    """A component is neither sorted by the JVM nor handed over as one table, which an executor cannot hold beside its heap; large ones ask for an executor."""
    from roadweave.operators import merging

    n = 40
    segs = G.directed_segments(ways(spark, [(i, [i, i + 1], "a", 1) for i in range(n)])).withColumn("km", F.lit(1.0)).withColumn("speeds", F.array(F.lit(5.0), F.lit(None)))
    want = {r.segment: r.grp for r in merge_segments(segs, None, None, [0, 1]).collect()}
    for name, most in (("SMALL", 5), ("HEAVY", 20), ("BATCH", 7)):
        monkeypatch.setattr(merging, name, most)
    got = merge_segments(segs, None, None, [0, 1])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert {r.segment: r.grp for r in got.collect()} == want and len(want) == n
    assert merging.whole_executor(spark) is None
