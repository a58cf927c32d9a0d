"""Road graph: ways, directed segments, adjacency, merging.

A way has ``way, nodes array<long>, coords array<struct<lon,lat>>, highway, oneway
int, limit string``; a segment is a directed way, ``<way>_0`` or reversed ``<way>_1``.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.traffic import cast_speed, is_car_road, tag_map
from ..storage import discard, materialize


def get_segments(ways: DataFrame, inner_box, inner_tags: list[str], outer_box, outer_tags: list[str]) -> DataFrame:
    """Ways in the inner box with an inner tag, or in the outer box with an outer tag; the road class must be an inner one."""
    tag = tag_map(F.col("tag"))["highway"]
    inner = geo.line_meets_box(F.col("coords"), inner_box) & tag.isin(*inner_tags)
    outer = geo.line_meets_box(F.col("coords"), outer_box) & tag.isin(*outer_tags)
    return ways.filter((inner | outer) & tag.isin(*inner_tags)).dropDuplicates(["way"]).withColumn("highway", tag)


def car_roads(ways: DataFrame) -> DataFrame:
    return ways.filter(is_car_road(F.col("tag")))


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, coords): node ids replaced by places in their order, unknown nodes left out."""
    places = ways.select("way", F.posexplode("nodes").alias("pos", "node")).join(nodes.select("node", "lon", "lat"), "node")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lon", "lat")))
    return places.groupBy("way").agg(ordered.alias("p")).select("way", F.transform("p", lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"))).alias("coords"))


def relation_backrefs(items: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """``items`` (id) with the sorted ids of the relations that have them as members of the kind; none: empty array."""
    members = relations.select(F.col("id").alias("relation"), F.explode("members").alias("m")).filter(F.col("m.type") == kind)
    back = members.groupBy(F.col("m.ref").alias("id")).agg(F.sort_array(F.collect_set("relation")).alias("relations"))
    return items.join(back, "id", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<bigint>")))


def directed_segments(ways: DataFrame, reverse_nodes: bool = False) -> DataFrame:
    """Segments with first and last node: each way along its nodes and, unless one-way, against them.

    ``oneway`` -1 turns the geometry and, with ``reverse_nodes``, the nodes as well; then it is 1.
    """
    against = F.col("oneway") == -1
    fixed = ways.withColumn("coords", F.when(against, F.reverse("coords")).otherwise(F.col("coords")))
    if reverse_nodes:
        fixed = fixed.withColumn("nodes", F.when(against, F.reverse("nodes")).otherwise(F.col("nodes")))
    fixed = fixed.withColumn("oneway", F.abs("oneway"))
    sides = F.when(F.col("oneway") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = fixed.withColumn("side", F.explode(sides))
    turned = F.col("side") == 1
    return (
        both.withColumn("segment", F.concat_ws("_", F.col("way").cast("string"), F.col("side").cast("string")))
        .withColumn("nodes", F.when(turned, F.reverse("nodes")).otherwise(F.col("nodes")))
        .withColumn("coords", F.when(turned, F.reverse("coords")).otherwise(F.col("coords")))
        .withColumn("first", F.element_at("nodes", 1)).withColumn("last", F.element_at("nodes", -1))
    )


def segments_meta(ways: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Segments with speed limit, length and, joined by road id, numbers of points and cars."""
    s = directed_segments(ways).withColumn("max_speed", cast_speed(F.col("limit"))).withColumn("km", geo.path_km(F.col("coords")))
    if counts is not None:
        s = s.join(counts.select(F.col("road").alias("way"), "points", "cars"), "way", "left")
    return s


def linear_edges(segments: DataFrame) -> DataFrame:
    """(src, dst): dst begins where src ends; never a segment to itself or to its own reverse."""
    a = segments.select(F.col("segment").alias("src"), F.col("last").alias("node"), F.col("nodes").alias("a"))
    b = segments.select(F.col("segment").alias("dst"), F.col("first").alias("node"), F.col("nodes").alias("b"))
    return a.join(b, "node").filter((F.col("a") != F.col("b")) & (F.col("a") != F.reverse("b"))).select("src", "dst").distinct()


def ins_outs(segments: DataFrame) -> DataFrame:
    """(src, dst): dst can be entered from src: src ends on a node of dst before its last, or dst begins on a node of src behind its first.

    The condition on pairs is two equi-joins on exploded nodes and a union.
    """
    inner = lambda lo: F.slice("nodes", F.lit(lo), F.greatest(F.size("nodes") - 1, F.lit(0)))
    # 96 bits of hashes and the size stand for the node lists that must differ: joins carry these, not the lists
    both = lambda c: F.struct(F.xxhash64(c), F.hash(c), F.size(c))
    s = segments.select("segment", "first", "last", "nodes", both(F.col("nodes")).alias("own"), both(F.reverse("nodes")).alias("turned"))
    ends = s.select(F.col("segment").alias("src"), F.col("last").alias("node"), F.col("own").alias("a"))
    enters = s.select(F.col("segment").alias("dst"), F.col("own").alias("b"), F.col("turned").alias("r"), F.explode(F.array_distinct(inner(1))).alias("node"))
    starts = s.select(F.col("segment").alias("dst"), F.col("first").alias("node"), F.col("own").alias("b"), F.col("turned").alias("r"))
    leaves = s.select(F.col("segment").alias("src"), F.col("own").alias("a"), F.explode(F.array_distinct(inner(2))).alias("node"))
    other = (F.col("a") != F.col("b")) & (F.col("a") != F.col("r"))
    one = ends.join(enters, "node").filter(other).select("src", "dst")
    two = leaves.join(starts, "node").filter(other).select("src", "dst")
    return one.union(two).distinct()


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): identity and edges, weight 1; absence of a row means no edge."""
    own = nodes.select(F.col("segment").alias("src"), F.col("segment").alias("dst"))
    return own.union(edges.select("src", "dst")).distinct().withColumn("w", F.lit(1))


def adjacency_outer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by a full outer join: 1 where identity or edge has the pair."""
    own = nodes.select(F.col("segment").alias("src"), F.col("segment").alias("dst"), F.lit(1).alias("i")).distinct()
    e = edges.select("src", "dst", F.lit(1).alias("e")).distinct()
    return own.join(e, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("i", "e").alias("w"))


def symmetric(adj: DataFrame) -> DataFrame:
    """A + transposed A."""
    return adj.union(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def add_levels(adj: DataFrame, levels: int) -> DataFrame:
    """Adds, ``levels`` times, 1 for each pair that the present support reaches in two steps; support doubles its reach each time."""
    spark = adj.sparkSession
    keep = spark.conf.get("spark.checkpoint.dir", None)
    for _ in range(levels):
        a = adj.select("src", F.col("dst").alias("mid"))
        b = adj.select(F.col("src").alias("mid"), "dst")
        reach = a.join(b, "mid").select("src", "dst").distinct().withColumn("w", F.lit(1))
        adj = adj.union(reach).groupBy("src", "dst").agg(F.sum("w").cast("int").alias("w"))
        if keep:  # a shared folder: cut the lineage there
            adj = adj.checkpoint()
    return adj


def merge_adjacency(adj: DataFrame, mapping: DataFrame) -> DataFrame:
    """Largest weight between merged groups; ``mapping`` (segment, grp)."""
    a = mapping.select(F.col("segment").alias("src"), F.col("grp").alias("g_src"))
    b = mapping.select(F.col("segment").alias("dst"), F.col("grp").alias("g_dst"))
    return adj.join(a, "src").join(b, "dst").groupBy(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).agg(F.max("w").alias("w"))


def remove_roundabouts(segments: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Edges in which closed segments (first node = last node) are bridged: their ins lead straight to their outs.

    Only edges that touch a roundabout take part.  Each round joins ways through
    them, so chains of adjacent roundabouts are bridged in as many rounds as their
    length has bits; what is not complete after ``rounds`` is an error.
    """
    closed = segments.filter("first = last").select("segment")
    into, out = closed.withColumnRenamed("segment", "dst"), closed.withColumnRenamed("segment", "src")
    edges = edges.select("src", "dst").distinct()
    plain = edges.join(into, "dst", "left_anti").join(out, "src", "left_anti").select("src", "dst")
    near = materialize(edges.join(into, "dst", "left_semi").select("src", "dst").union(edges.join(out, "src", "left_semi").select("src", "dst")).distinct(), "roundabouts")
    n = near.count()
    for _ in range(rounds):
        ins = near.join(into, "dst", "left_semi").select("src", F.col("dst").alias("ring"))
        outs = near.join(out, "src", "left_semi").select(F.col("src").alias("ring"), "dst")
        more = ins.join(outs, "ring").filter("src <> dst").select("src", "dst")
        before, near = near, materialize(near.union(more).distinct(), "roundabouts")
        discard(before)
        was, n = n, near.count()
        if n == was:
            break
    else:
        raise RuntimeError(f"roundabouts are not bridged after {rounds} rounds")
    return plain.union(near.join(into, "dst", "left_anti").join(out, "src", "left_anti").select("src", "dst")).distinct()


def merge_roundabout_chunks(chunks: list[dict]) -> list[dict]:
    """Joins open pieces of roundabouts ({way, nodes}) into closed ways: one per cycle, named by its smallest way.

    Pieces without a predecessor are dropped until none is left.  The input is the
    roundabout pieces of one study area, tens of rows.
    """
    left = {c["way"]: list(c["nodes"]) for c in chunks}
    while True:
        starts = {n[0] for n in left.values()}
        ends = {n[-1] for n in left.values()}
        open_ = [w for w, n in left.items() if n[0] not in ends or n[-1] not in starts]
        if not open_:
            break
        for w in open_:
            del left[w]
    by_start = defaultdict(list)
    for w in sorted(left):
        by_start[left[w][0]].append(w)
    out, used = [], set()
    for w in sorted(left):
        if w in used:
            continue
        ring, at, nodes = [w], left[w][-1], list(left[w])
        while at != left[w][0]:
            nxt = next((x for x in by_start[at] if x not in ring and x not in used), None)
            if nxt is None:
                break
            ring.append(nxt)
            nodes += left[nxt][1:]
            at = left[nxt][-1]
        if at == left[w][0]:
            used |= set(ring)
            out.append({"way": min(ring), "nodes": nodes})
    return out


def segment_attributes(segments: DataFrame, shares: DataFrame) -> DataFrame:
    """(segment, share, head, tail, head_cos, head_sin, tail_cos, tail_sin); ``shares`` (segment, share) of slots with a speed."""
    leg = lambda i, j: geo.unit_vector(F.element_at("coords", i), F.element_at("coords", j))
    s = segments.filter(F.size("coords") > 1).withColumn("h", leg(-2, -1)).withColumn("t", leg(1, 2))
    return s.join(shares, "segment", "left").select(
        "segment", F.coalesce("share", F.lit(0.0)).alias("share"), F.col("last").alias("head"), F.col("first").alias("tail"),
        F.col("h.cos").alias("head_cos"), F.col("h.sin").alias("head_sin"), F.col("t.cos").alias("tail_cos"), F.col("t.sin").alias("tail_sin"),
    )


def profile_distance(pairs: DataFrame, profiles: DataFrame, slots: int) -> DataFrame:
    """(src, dst, distance) of speed profiles (segment, slot, speed).

    Over the slots that both know, each series is divided by 1 plus its sum; the
    distance is the mean squared difference plus 1 minus the share of common
    slots, and 2 without a common slot.
    """
    a = profiles.filter("speed is not null").select(F.col("segment").alias("src"), "slot", F.col("speed").alias("a"))
    b = profiles.filter("speed is not null").select(F.col("segment").alias("dst"), "slot", F.col("speed").alias("b"))
    common = pairs.select("src", "dst").join(a, "src").join(b, ["dst", "slot"])
    # mean((a/A - b/B)^2) from sums, so that one aggregate is enough
    s = common.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), (1 + F.sum("a")).alias("sa"), (1 + F.sum("b")).alias("sb"),
        F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"),
    )
    gap = (F.col("aa") / (F.col("sa") * F.col("sa")) + F.col("bb") / (F.col("sb") * F.col("sb")) - 2 * F.col("ab") / (F.col("sa") * F.col("sb"))) / F.col("n")
    joined = pairs.select("src", "dst").join(s, ["src", "dst"], "left")
    return joined.select("src", "dst", F.coalesce(gap + 1 - F.col("n") / F.lit(float(slots)), F.lit(2.0)).alias("distance"))


def merge_criteria(
    edges: DataFrame, attributes: DataFrame, profiles: DataFrame, slots: int, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0), min_share: float = 0.8
) -> DataFrame:
    """(src, dst, criterion): the price of merging dst into src; infinite if the road classes differ or src is well known already.

    ``attributes`` also has ``highway``, ``km`` and ``members``.  Terms: profile
    distance; difference in direction, of both heads if dst is an out of src (its
    tail is src's head, or column ``out`` of ``edges`` says so), else of both tails;
    1 if no end of one is an end of the other; and how many of three conditions
    hold: the better known of the two has more than half of ``min_share``, over 10
    members together, over 4 km together.
    """
    side = lambda p: attributes.select(F.col("segment").alias({"a": "src", "b": "dst"}[p]), *[F.col(c).alias(f"{p}_{c}") for c in attributes.columns if c != "segment"])
    d = profile_distance(edges, profiles, slots).join(side("a"), "src").join(side("b"), "dst")
    if "out" in edges.columns:
        d = d.join(edges.select("src", "dst", "out"), ["src", "dst"])
    out = F.col("out") if "out" in edges.columns else F.col("a_head") == F.col("b_tail")
    ends = lambda e: geo.direction_score(*(F.col(f"{p}_{e}_{c}") for p in "ab" for c in ("cos", "sin")))
    turn = F.when(out, ends("head")).otherwise(ends("tail"))
    unlinked = F.when(F.arrays_overlap(F.array("a_head", "a_tail"), F.array("b_head", "b_tail")), 0.0).otherwise(1.0)
    length = (
        (F.greatest("a_share", "b_share") > min_share / 2).cast("int") + (F.col("a_members") + F.col("b_members") > 10).cast("int") + (F.col("a_km") + F.col("b_km") > 4).cast("int")
    )
    price = weights[0] * F.col("distance") + weights[1] * turn + weights[2] * unlinked + weights[3] * length
    never = ~F.col("a_highway").eqNullSafe(F.col("b_highway")) | (F.col("a_share") >= min_share) | (F.col("src") == F.col("dst"))
    return d.select("src", "dst", F.when(never, F.lit(float("inf"))).otherwise(price).alias("criterion"))


def chain_walk(edges: DataFrame, start: str, most: int = 10_000) -> list[str]:
    """Segments met by following the smallest successor until the end or a repeat.

    Each step is one lookup with a filter that Spark pushes to the scan; the graph
    stays where it is.
    """
    path, seen = [start], {start}
    while len(path) < most:
        row = edges.filter(F.col("src") == path[-1]).agg(F.min("dst")).first()
        if row[0] is None or row[0] in seen:
            break
        path.append(row[0])
        seen.add(row[0])
    return path
