"""Near-duplicate detection with min-max hashing.

Every permutation gives two signature values, the minimum and the maximum of a
document's shingle hashes, so 128 values cost 64 hash evaluations.  Values are
cut into bands; documents that agree on a band are candidates and every link is
confirmed on the full shingle sets.  No pairs within a group are listed:

1. Equal sets are one class (key: a 128-bit digest of the set); copies cost one
   row each from here on.
2. Classes that share a band get an edge to the smallest of them (a star), and
   connected components of these edges are candidate clusters.  Two classes
   that agree on any band are in one cluster.
3. A cluster whose sets fit in ``cluster_bytes`` is resolved in one task:
   members in order against all later ones that are not yet connected and that
   the triangle inequality of the Jaccard distance does not exclude.
4. A larger cluster is dealt out: all its members are compared with one pivot,
   in parallel; those that can no longer decide anything leave, the rest are
   banded and clustered again.  What is still too large after ``pivot_rounds``
   is dealt into blocks of half a task each, and every two blocks of a cluster
   meet in one task that emits links only; this is exact whatever is left.

Aggregates by band, text or cluster are written before they are joined, so AQE
can split whatever a third of all documents shares.

With 32 bands of 4 a pair at exactly 0.75 is missed with probability 5e-6, one
at 0.8 with 5e-8.

Cases: null, blank or empty text has an empty set, is linked with nothing and is
its own component; a repeated row is a copy like any other; a row with a null id
belongs to its text's component (null if no copy has an id) and is kept only in
the latter case; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._graph import connected_components
from ._store import discard, discard_since, made, materialize, short_batches

PERMUTATIONS, ROWS = 64, 4
_rng = np.random.default_rng(41)
_MUL = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def min_max_signatures(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, 2 * PERMUTATIONS) minima, then maxima; rows of empty sets are 0."""
    has = np.flatnonzero(np.diff(offs))
    out = np.zeros((len(offs) - 1, 2 * PERMUTATIONS), np.uint32)
    if len(has):
        x, at = (hashes >> np.uint64(32)).astype(np.uint32), offs[:-1][has]
        for k in range(PERMUTATIONS):
            y = x * _MUL[k] + _ADD[k]
            out[has, k] = np.minimum.reduceat(y, at)
            out[has, PERMUTATIONS + k] = np.maximum.reduceat(y, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, bands) 64-bit keys of ROWS signature values each; minima and maxima of a permutation are in different bands."""
    bands = sig.shape[1] // ROWS
    s = sig.reshape(len(sig), bands, ROWS).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = T.mix(key + s[:, :, r] + np.uint64(0x2545F4914F6CDD1D))
    return key.view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = T.buffers(b.column(1))
            for i, j in T.slices(offs):
                h, ho = T.shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                n = np.diff(ho)
                keys = band_keys(min_max_signatures(h, ho))
                sets = [blake2b(h[ho[x] : ho[x + 1]].tobytes(), digest_size=16).digest() if n[x] else None for x in range(j - i)]
                bands = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(sets, pa.binary()), bands], ["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(k: int):
    """Full sets of the documents asked for; a row whose set is not the one asked for is dropped (ids may repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = T.buffers(b.column("text"))
            asked = b.column("set_key").to_pylist()
            for i, j in T.slices(offs):
                h, ho = T.shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                raw = [h[ho[x] : ho[x + 1]].tobytes() for x in range(j - i)]
                keep = [x for x in range(j - i) if blake2b(raw[x], digest_size=16).digest() == asked[i + x]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("cluster").take(pa.array([i + x for x in keep], pa.int64())), pa.array([asked[i + x] for x in keep], pa.binary()), pa.array([raw[x] for x in keep], pa.binary())],
                    ["cluster", "set_key", "shingles"],
                )

    return run


def intersections(one: np.ndarray, values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with many."""
    at = np.searchsorted(one, values)
    at[at == len(one)] = 0
    hits = np.concatenate([[0], np.cumsum(one[at] == values)])
    return hits[offs[1:]] - hits[offs[:-1]]


def linked(inter: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def resolve_cluster(sets: list[np.ndarray], percent: int, pivots: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Component (smallest position) and number of confirmed links of each set; all sets are distinct and not empty.

    Exact: a pair is left out only if it is connected already, its sizes forbid
    a link, or its distances to a pivot differ by more than the largest distance
    of a link.
    """
    n = len(sets)
    comp, links = np.arange(n), np.zeros(n, np.int64)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    offs = np.concatenate([[0], np.cumsum(size)])
    far, known = 1 - percent / 100 + 1e-9, []
    for a in range(n - 1):
        later = np.arange(a + 1, n)
        late = later[comp[a + 1 :] != comp[a]]
        if not len(late):
            if not (comp != comp[0]).any():
                break
            continue
        late = late[(100 * np.minimum(size[late], size[a]) >= percent * np.maximum(size[late], size[a]))]
        for d in known:
            late = late[np.abs(d[late] - d[a]) <= far]
        if not len(late):
            continue
        if len(known) < pivots:
            inter = intersections(sets[a], flat, offs)
            known.append(1 - inter / (size[a] + size - inter))
            inter = inter[late]
        elif len(late) > n // 4:
            inter = intersections(sets[a], flat, offs)[late]
        else:
            inter = intersections(sets[a], np.concatenate([sets[x] for x in late]), np.concatenate([[0], np.cumsum(size[late])]))
        yes = late[linked(inter, size[a], size[late], percent)]
        if len(yes):
            links[a] += len(yes)
            links[yes] += 1
            old = np.unique(np.append(comp[yes], comp[a]))
            comp[np.isin(comp, old)] = old[0]
    return comp, links


def _resolve(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("set_key").to_pylist()
        raw = table.column("shingles").to_pylist()
        first = {k: i for i, k in reversed(list(enumerate(keys)))}  # repeated ids may bring a set twice
        order = sorted(first)
        comp, _ = resolve_cluster([np.frombuffer(raw[first[k]], np.uint64) for k in order], percent)
        return pa.table({"u": pa.array(order, pa.binary()), "v": pa.array([order[c] for c in comp], pa.binary())})

    return run


def _against_pivot(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, p in zip(b.column("shingles"), b.column("pivot_set")):
                x, y = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(p.as_py(), np.uint64)
                n = int(intersections(y, x, np.array([0, len(x)]))[0])
                out.append((100 * n >= percent * (len(x) + len(y) - n), 1 - n / (len(x) + len(y) - n)))
            yield pa.RecordBatch.from_arrays(
                [b.column("cluster"), b.column("set_key"), b.column("pivot"), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.float64())],
                ["cluster", "set_key", "pivot", "hit", "far"],
            )

    return run


def star_edges(classes: DataFrame) -> DataFrame:
    """(u, v): each class and the smallest class of every band that it shares; at most one row per class and band."""
    rows = classes.select("set_key", F.explode("bands").alias("band"))
    centres = rows.groupBy("band").agg(F.min("set_key").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    centres = materialize(centres.select(F.col("band").alias("of"), "v"), "centres")
    return rows.join(centres, F.col("band") == F.col("of")).filter("set_key <> v").select(F.col("set_key").alias("u"), "v").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 75,
    cluster_bytes: int = 64 << 20,
    pivot_rounds: int = 8,
) -> DataFrame:
    """(doc_id, n_shingles, set_key, component_id, kept), one row per input row."""
    short_batches(docs.sparkSession)
    mark = made()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(
        texts.mapInArrow(_signed(shingle_words), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures"
    )
    classes = materialize(
        signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    # bands are most of the table and not needed again
    signatures, signed = signed, materialize(signed.drop("bands"), "sets")
    discard(signatures)
    active, links, rounds = classes, None, 0
    while True:
        before = made()
        stars = materialize(star_edges(active), "stars")
        discard_since(docs.sparkSession, before, stars)
        found = connected_components(stars)
        discard(stars)
        members = materialize(
            found.select(F.col("node").alias("set_key"), F.col("component").alias("cluster")).join(active.select("set_key", "rep", "n"), "set_key"), "clusters"
        )
        sizes = materialize(members.groupBy("cluster").agg((8 * F.sum("n")).alias("bytes")), "sizes")
        big = sizes.filter(F.col("bytes") > cluster_bytes).select("cluster")
        members = members.join(sizes, "cluster")
        # always a merge join: what is asked for grows with the corpus, so one plan holds for every size
        asked = texts.join(members.filter(F.col("rep").isNotNull()).hint("merge"), F.col("doc_id") == F.col("rep"))
        sets = asked.select("cluster", "set_key", "text").mapInArrow(_sets(shingle_words), "cluster binary, set_key binary, shingles binary")
        any_big = big.limit(1).count() > 0
        if any_big:
            sets = materialize(sets, "sets")
            big = materialize(big, "large")
            small = sets.join(big, "cluster", "left_anti")
        else:
            small = sets
        new = materialize(small.groupBy("cluster").applyInArrow(_resolve(percent), "u binary, v binary"), "links")
        links = new if links is None else links.union(new)
        rounds += 1
        if not any_big:
            break
        if rounds > pivot_rounds:
            links = links.union(_block_links(sets.join(big, "cluster", "left_semi"), sizes, cluster_bytes, percent))
            break
        active, pivot_links = _pivot_round(sets.join(big, "cluster", "left_semi"), active, percent)
        links = links.union(pivot_links)
    if any_big or rounds > 1:
        whole = connected_components(links)
        resolved = whole.select(F.col("node").alias("set_key"), F.col("component").alias("root"))
    else:
        resolved = links.select(F.col("u").alias("set_key"), F.col("v").alias("root"))
    near = resolved.join(classes.select("set_key", "rep"), "set_key")
    lowest = materialize(near.groupBy("root").agg(F.min("rep").alias("low")), "lowest")
    near = near.join(lowest, "root").select("set_key", "low")
    of_class = classes.select("set_key", "rep").join(near, "set_key", "left").select(F.col("set_key").alias("key"), F.least("rep", "low").alias("of_set"))
    of_class = materialize(of_class, "components")
    discard_since(docs.sparkSession, mark, signed, of_class)
    out = signed.join(of_class, F.col("set_key") == F.col("key"), "left").drop("key")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("of_set"))).drop("of_set")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _pivot_round(sets: DataFrame, active: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Compare all members of large clusters with one pivot each; returns the classes that still matter, and links.

    A linked member still matters only to an unlinked one, and only if its
    distance to the pivot is within a link's distance of that one's.  The join
    on the cluster repeats one set per cluster and is one that AQE can split.
    """
    pivots = sets.groupBy("cluster").agg(F.min("set_key").alias("pivot"))
    pivot_sets = sets.select(F.col("set_key").alias("pivot"), F.col("shingles").alias("pivot_set")).join(pivots, "pivot").dropDuplicates(["pivot"])
    tested = materialize(
        sets.join(pivot_sets, "cluster").filter("set_key <> pivot").select("cluster", "set_key", "shingles", "pivot", "pivot_set")
        .mapInArrow(_against_pivot(percent), "cluster binary, set_key binary, pivot binary, hit boolean, far double"),
        "pivot",
    )
    edge = tested.filter("not hit").groupBy("cluster").agg(F.min("far").alias("near"))
    rest = tested.join(edge, "cluster").filter((~F.col("hit")) | (F.col("far") >= F.col("near") - (1 - percent / 100) - 1e-9))
    left = materialize(active.join(rest.select("set_key"), "set_key", "left_semi"), "active")
    return left, tested.filter("hit").select(F.col("set_key").alias("u"), F.col("pivot").alias("v"))


def _block_links(sets: DataFrame, sizes: DataFrame, cluster_bytes: int, percent: int) -> DataFrame:
    """Links within clusters of any size: each block of sets meets each other block of its cluster in a task of its own."""
    blocks = (1 + F.floor(2 * F.col("bytes") / cluster_bytes)).cast("int")
    dealt = sets.join(sizes, "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("cluster", "set_key", "shingles", "block", meets)
    pairs = pairs.select("cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "set_key", "shingles")
    return materialize(pairs.groupBy("cluster", "a", "b").applyInArrow(_resolve(percent), "u binary, v binary"), "links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns, whatever their names: that of the smallest id; of equal rows one."""
    keep = near_duplicates(docs, id_col, text_col, **more).filter("kept").select(F.col("doc_id").alias("of")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of_text"))
    same = Window.partitionBy("id", "of_text").orderBy(F.lit(0))
    rows = keyed.join(keep, F.col("id").eqNullSafe(F.col("of"))).withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
