"""Removal of repeated passages by a distributed, common-prefix-aware suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  Sorting every suffix of the corpus would exchange many times the input,
so only suffixes that can matter are sorted, and the result stays exact:

1. Anchors.  In every window of the smallest length asked for, the smallest gram
   of half that length (by hash) is an anchor.  Equal windows have the same
   anchors at the same places, so two equal windows are found through a common
   anchor.  About four bytes in ``length`` are anchors; one whose gram is nowhere
   else is dropped.
2. Runs.  The suffixes at the remaining anchors, cut at the largest length, are
   sorted where they are, led by the gram's hash (equal grams have equal
   hashes), front-coded against their neighbour and exchanged by range of hash.
   Equal suffixes with equal left sides travel once, with a list of places.
3. Merge.  A loser tree over the runs keeps for each head the prefix it shares
   with the last output.  Heads with different shared prefixes are ordered
   without reading a byte; with equal ones, reading starts behind them.  The
   merged order comes with its array of common prefixes.
4. Windows.  With the common prefixes to the right and, from a second sort, to
   the left of the anchors, every offset of a window around an anchor is decided
   by comparing numbers; the covered bytes are joined per document.  Windows of
   several lengths are decided from one merge.

Passages.  ``passages`` counts repeats in words: strings of ``passage_bytes`` (200,
about 50 tokens) that start elsewhere too are joined to runs, and a run with more
than ``passage_words`` whole words is a passage.  ``remove_repeats`` reports them
beside the removal by bytes; ``without_repeats`` cuts them.

Texts that are equal as a whole take part once; if there are two or more they
go entirely.  A gram at more than ``hot_anchors`` places (whatever a third of all
documents shares) is not sorted in one task: each window at its anchors gets a
128-bit digest, and digests are counted with map-side sums.  Grams, digests and
texts are joined with tables written before, so AQE can split a common key.

Cases: null and empty texts have no bytes and stay as they are; repeated rows
are copies; ids may be null or repeat; an empty table gives an empty result.
Texts are keyed by 64-bit hashes of theirs (chance of a clash among 10**8
distinct texts: 3 in 10,000).
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import discard, discard_since, made, materialize, short_batches

EMPTY_SHA256 = sha256(b"").hexdigest()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = frozenset(b" \t\n\x0b\x0c\r")
_INV = pow(int(T._BASE), -1, 1 << 64)
_INVERSE = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        more = np.full(1 << int(n - 1).bit_length(), _INV, np.uint64)
        more[0] = 1
        _INVERSE = np.multiply.accumulate(more)
    return _INVERSE[:n]


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every w neighbours: one running op from each side of blocks of w."""
    n = len(x)
    pad = np.full(-(-n // w) * w, fill, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    left = op.accumulate(rows, axis=1).ravel()
    right = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in buf, gram hashes): places that are the smallest gram of some window of one text."""
    k = length // 2
    w, n = length - k + 1, len(buf)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < length:
        return none
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(T._BYTE[buf] * T.powers(n), out=sums[1:])
    gram = T.mix((sums[k:] - sums[:-k]) * _inverse_powers(n - k + 1))
    np.maximum(gram, np.uint64(1), out=gram)
    low = _sliding(gram, w, np.minimum, np.iinfo(np.uint64).max)
    cross = np.zeros(len(low) + 1, np.int32)
    ends = offs[1:-1]
    np.add.at(cross, np.clip(ends - length + 1, 0, len(low)), 1)
    np.add.at(cross, np.clip(ends, 0, len(low)), -1)
    low[np.cumsum(cross[:-1]) > 0] = 0
    padded = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    at = np.flatnonzero(_sliding(padded, w, np.maximum, 0) == gram)
    return at, gram[at]


def _anchored(length: int):
    """Anchors of the texts of a task; equal texts of a task count once, so a group of copies adds a row per task, not per copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            keys, first = np.unique(b.column("k").to_numpy(zero_copy_only=False), return_index=True)
            fresh = np.sort(first[~np.isin(keys, seen, assume_unique=True)])
            seen = np.union1d(seen, keys)
            b = b.take(pa.array(fresh))
            keys = b.column("k").to_numpy(zero_copy_only=False)
            buf, offs = T.buffers(b.column("text"))
            for i, j in T.slices(offs):
                part = offs[i : j + 1] - offs[i]
                at, gram = anchors(buf[offs[i] : offs[j]], part, length)
                doc = np.searchsorted(part, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(keys[i:j][doc]), pa.array(at - part[doc])], ["h", "k", "pos"]
                )

    return run


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two byte strings that agree up to ``start``."""
    most = min(len(a), len(b))
    while start < most:
        x, y = a[start : start + 64], b[start : start + 64]
        if x != y:
            n = min(len(x), len(y))
            d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return start + (n if d == 0 else n - (d.bit_length() + 7) // 8)
        start += 64
    return most


Entry = tuple[bytes, bytes, list[int], list[int]]  # hash and suffix, left side, texts, positions


def encode_run(entries: list[Entry], block: int = 1000) -> bytes:
    """Sorted entries, each stored from where it differs from the one before, in blocks that are read one at a time."""
    out, before = [], b""
    u4 = lambda x: np.fromiter(x, np.uint32).tobytes()
    for i in range(0, len(entries), block):
        part = entries[i : i + block]
        shared, rests = [], []
        for e in part:
            n = common_prefix(before, e[0])
            shared.append(n)
            rests.append(e[0][n:])
            before = e[0]
        lefts = [e[1] for e in part]
        body = b"".join(
            (
                u4(shared), u4(map(len, rests)), u4(map(len, lefts)), u4(len(e[2]) for e in part),
                np.array([k for e in part for k in e[2]], np.int64).tobytes(), np.array([p for e in part for p in e[3]], np.int64).tobytes(),
                *rests, *lefts,
            )
        )
        packed = zstandard.ZstdCompressor(level=3).compress(body)
        out += [struct.pack("<II", len(part), len(packed)), packed]
    return b"".join(out)


def decode_run(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(bytes shared with the entry before, entry), in order."""
    here, before, run = 0, b"", memoryview(run)
    while here < len(run):
        n, size = struct.unpack_from("<II", run, here)
        body = zstandard.ZstdDecompressor().decompress(run[here + 8 : here + 8 + size])
        here += 8 + size
        shared, rest_n, left_n, places = (np.frombuffer(body, np.uint32, n, 4 * n * i) for i in range(4))
        total, at = int(places.sum()), 16 * n
        keys = np.frombuffer(body, np.int64, total, at).tolist()
        pos = np.frombuffer(body, np.int64, total, at + 8 * total).tolist()
        at += 16 * total
        lat, o = at + int(rest_n.sum()), 0
        for s, r, l, m in zip(shared.tolist(), rest_n.tolist(), left_n.tolist(), places.tolist()):
            if r or s < len(before):  # an equal string is kept once
                before = before[:s] + body[at : at + r]
            yield s, (before, body[lat : lat + l], keys[o : o + m], pos[o : o + m])
            at, lat, o = at + r, lat + l, o + m


def merge_runs(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """Loser tree: (bytes shared with the output before, entry) over all runs, in order.

    ``lcp[r]`` is what the head of run r shares with the last output.  Of two
    heads the one that shares more is the smaller, and what they share with each
    other is the lesser number; only heads that share equally much are read, from
    that place on.  The loser keeps what it shares with the winner, which is
    right for when the winner has become the last output.
    """
    n = len(runs)
    if not n:
        return
    leaves = 1 << (n - 1).bit_length()
    heads: list[Entry | None] = [None] * leaves
    lcp = [-1] * leaves
    for r, it in enumerate(runs):
        if (x := next(it, None)) is not None:
            lcp[r], heads[r] = 0, x[1]

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); an ended run shares -1 and loses."""
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = heads[a][0], heads[b][0]
        m = common_prefix(x, y, la)
        if x[m : m + 1] > y[m : m + 1] or (m == len(x) == len(y) and b < a):
            a, b = b, a
        lcp[b] = m
        return a, b

    tree = [0] * leaves
    winners = list(range(leaves))
    level = leaves
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            w, l = duel(winners[i], winners[i + 1])
            tree[(level + i) // 2] = l
            nxt.append(w)
        winners, level = nxt, level // 2
    w = winners[0]
    while heads[w] is not None and lcp[w] >= 0:
        yield lcp[w], heads[w]
        x = next(runs[w], None)
        if x is None:
            lcp[w], heads[w] = -1, None
        else:
            lcp[w], heads[w] = x
        node = (leaves + w) // 2
        while node:
            w, tree[node] = duel(w, tree[node])
            node //= 2


def covered(
    shared: np.ndarray, right_len: np.ndarray, lefts: list[bytes], many: np.ndarray, gram: int, lengths: tuple[int, ...]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: (smallest, largest) offset d for which the window that starts d bytes left of the anchor is elsewhere too; 1, 0 if none.

    Entries are in order of their right sides, left sides run from the anchor
    outwards.  ``shared``: what each right side has in common with the one before; ``many``: whether an entry has several
    places.  An entry alone with one other is decided at once; of the others
    only those are looked at for an offset that share enough on either side
    with some neighbour.
    """
    n = len(lefts)
    left_len = np.fromiter(map(len, lefts), np.int64, n)
    group = np.cumsum(shared < gram)
    starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n)
    order, both = np.arange(n), np.full(n, -1, np.int64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a > 1:
            by_left = sorted(range(a, b), key=lefts.__getitem__)
            order[a:b] = by_left
            both[a + 1 : b] = [common_prefix(lefts[i], lefts[j]) for i, j in zip(by_left, by_left[1:])]
    # what an entry has in common with the nearest of its neighbours, to the right and to the left of the anchor
    inside = np.where(shared < gram, -1, shared)
    near_right = np.maximum(inside, np.append(inside[1:], -1))
    near_left = np.empty(n, np.int64)
    near_left[order] = np.maximum(both, np.append(both[1:], -1))
    near_right, near_left = np.where(many, right_len, near_right), np.where(many, left_len, near_left)
    two = np.bincount(group)[group] == 2
    two &= ~many & ~np.isin(group, group[many])
    found = []
    for length in lengths:
        # a window needs length - d bytes to the right and d to the left
        first = np.maximum(length - near_right, 0)
        last = np.minimum(near_left, length - gram)
        lo, hi = np.ones(n, np.int64), np.zeros(n, np.int64)
        at_once = two & (first <= last)
        lo[at_once], hi[at_once] = first[at_once], last[at_once]
        rest = np.flatnonzero(~two & (first <= last))
        first, last = first[rest], last[rest]
        for d in range(int(first.min(initial=length)), int(last.max(initial=-1)) + 1):
            at = rest[(first <= d) & (d <= last)]
            if not len(at):
                continue
            r = np.cumsum(shared < length - d)
            l = np.empty(n, np.int64)
            l[order] = np.cumsum(both < d)
            key = r[at] * (n + 1) + l[at]
            o = np.argsort(key, kind="stable")
            same = key[o][1:] == key[o][:-1]
            twice = many[at].copy()
            twice[o[1:][same]] = True
            twice[o[:-1][same]] = True
            hit = at[twice]
            fresh = hit[lo[hit] > hi[hit]]
            lo[fresh] = d
            hi[hit] = d
        found.append((lo, hi))
    return found


def _runs(gram: int, length: int, parts: int, flush: int = 20_000):
    """Front-coded runs of the anchored suffixes of a task, one for each range of hashes it has."""
    side = length - gram

    def flushed(found: dict[tuple[bytes, bytes], tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
        ordered = sorted(found)
        part = [int.from_bytes(x[0][:8], "big") * parts >> 64 for x in ordered]
        cuts = [0, *(i for i in range(1, len(part)) if part[i] != part[i - 1]), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                run = encode_run([(*x, *found[x]) for x in ordered[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), pa.array([run], pa.binary())], ["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        n = 0
        for b in batches:
            for text, k, at, grams in zip(b.column("text"), b.column("k").to_pylist(), b.column("at"), b.column("grams")):
                raw = text.as_py().encode()
                for p, h in zip(at.as_py(), grams.as_py()):
                    key = (h.to_bytes(8, "big", signed=True), p)
                    right = bytes([key[0][0] ^ 0x80]) + key[0][1:] + raw[p : p + length]
                    ks, ps = found.setdefault((right, raw[max(0, p - side) : p]), ([], []))
                    ks.append(k)
                    ps.append(p)
                    n += 1
                if n >= flush:
                    yield from flushed(found)
                    found, n = {}, 0
        yield from flushed(found)

    return run


def _merged(gram: int, lengths: tuple[int, ...]):
    """(text, length of the windows, run of bytes) for each anchor that has repeated windows."""
    longest = max(lengths)

    def decided(shared: list[int], rights: list[int], lefts: list[bytes], counts: list[int], keys: array, pos: array) -> pa.Table:
        k, p = np.array(keys), np.array(pos)
        entry = np.repeat(np.arange(len(counts)), counts)
        # a text whose row is repeated names a place twice
        o = np.lexsort((p, k, entry))
        entry, k, p = entry[o], k[o], p[o]
        new = np.ones(len(k), bool)
        new[1:] = (entry[1:] != entry[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        entry, k, p = entry[new], k[new], p[new]
        many = np.bincount(entry, minlength=len(counts)) > 1
        parts = []
        for length, (lo, hi) in zip(lengths, covered(np.array(shared), np.array(rights), lefts, many, gram, lengths)):
            at = np.flatnonzero((lo <= hi)[entry])
            e = entry[at]
            parts.append(
                pa.table({"k": pa.array(k[at]), "of": pa.array(np.full(len(at), length, np.int32)), "lo": pa.array(p[at] - hi[e]), "hi": pa.array(p[at] - lo[e] + length)})
            )
        return pa.concat_tables(parts)

    def run(table: pa.Table) -> pa.Table:
        def fresh():
            return [], [], [], [], array("q"), array("q")

        out, held = [], fresh()
        shared, rights, lefts, counts, keys, pos = held
        for n, e in merge_runs([decode_run(r.as_buffer()) for r in table.column("run")]):
            n, right = max(n - 8, 0), len(e[0]) - 8
            keys.extend(e[2])
            pos.extend(e[3])
            left = e[1][::-1]  # kept once, from the anchor outwards; in runs it stands as in the text, which compresses better
            if lefts and n == longest and right == rights[-1] and left == lefts[-1]:
                counts[-1] += len(e[2])
                continue
            if n < gram and len(lefts) >= 5_000:
                more = keys[len(keys) - len(e[2]) :], pos[len(pos) - len(e[3]) :]
                del keys[len(keys) - len(e[2]) :], pos[len(pos) - len(e[3]) :]
                out.append(decided(*held))
                shared, rights, lefts, counts, keys, pos = held = fresh()
                keys.extend(more[0])
                pos.extend(more[1])
            shared.append(n if lefts else 0)
            rights.append(right)
            lefts.append(left)
            counts.append(len(e[2]))
        out.append(decided(*held))
        return pa.concat_tables(out)

    return run


def _window_digests(gram: int, lengths: tuple[int, ...]):
    """(digest, text, length, start) of every window at a hot anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, k, at in zip(b.column("text"), b.column("k").to_pylist(), b.column("at")):
                raw = text.as_py().encode()
                for length in lengths:
                    starts = sorted({s for p in at.as_py() for s in range(max(0, p - length + gram), min(p, len(raw) - length) + 1)})
                    digests = [blake2b(raw[s : s + length], digest_size=16).digest() for s in starts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digests, pa.binary()), pa.array([k] * len(starts), pa.int64()), pa.array([length] * len(starts), pa.int32()), pa.array(starts, pa.int64())],
                        ["w", "k", "of", "lo"],
                    )

    return run


def joined_runs(lo: np.ndarray, hi: np.ndarray) -> list[list[int]]:
    """Maximal runs [lo, hi) of bytes that the spans cover."""
    if not len(lo):
        return []
    o = np.argsort(lo, kind="stable")
    lo, end = lo[o], np.maximum.accumulate(hi[o])
    first = np.append(True, lo[1:] > end[:-1])
    return np.stack([lo[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)]], axis=1).tolist()


def whole_words(raw: bytes, lo: int, hi: int) -> int:
    """Words of ``raw`` that lie in [lo, hi) as a whole."""
    n = sum(1 for _ in WORD.finditer(raw, lo, hi))
    cut_left = lo > 0 and n and raw[lo - 1] not in SPACE and raw[lo] not in SPACE
    cut_right = hi < len(raw) and n and raw[hi - 1] not in SPACE and raw[hi] not in SPACE
    return max(0, n - cut_left - cut_right)


def passages(raw: bytes, runs: list[list[int]], words: int) -> list[list[int]]:
    return [r for r in runs if whole_words(raw, *r) > words]


def _without(length: int, passage_bytes: int | None, passage_words: int, cut: str):
    """What is covered in each text, and the text without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            spans = b.column("spans")
            ends, flat = spans.offsets.to_numpy(), spans.values
            of, start, stop = (flat.field(c).to_numpy() for c in ("of", "lo", "hi"))
            for text, k, i, j in zip(b.column("text"), b.column("k").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                raw = text.as_py().encode()
                by = {x: joined_runs(start[i:j][of[i:j] == x], stop[i:j][of[i:j] == x]) for x in (length, passage_bytes)}
                removed = by[length]
                found = passages(raw, by[passage_bytes], passage_words)
                keep, at = [], 0
                for lo, hi in found if cut == "passages" else removed:
                    keep.append(raw[at:lo])
                    at = hi
                kept = b"".join([*keep, raw[at:]])
                size = lambda runs: sum(hi - lo for lo, hi in runs)
                rows.append((k, size(removed), len(removed), size(found), len(found), sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(),) * 5 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["k", "n_removed", "n_spans", "n_passage_bytes", "n_passages", "kept_sha256", "kept_text"]
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int | None = 400,
    passage_bytes: int | None = None,
    passage_words: int = 50,
    cut: str = "length",
    hot_anchors: int = 200_000,
    part_anchors: int = 60_000,
) -> tuple[DataFrame, DataFrame]:
    """(rows, rests): per input row (doc_id, k, n_bytes, n_removed, n_spans, n_passage_bytes, n_passages, kept_sha256), and the rest (k, kept_text) of each text that loses some but not all.

    ``length`` gives n_removed and n_spans, ``passage_bytes`` n_passage_bytes and
    n_passages; either may be None and then counts nothing.  ``cut`` says which
    of them ("length" or "passages") the kept text is without.
    """
    short_batches(docs.sparkSession)
    mark = made()
    lengths = tuple(sorted({x for x in (length, passage_bytes) if x}))
    least, longest = lengths[0], lengths[-1]
    gram = least // 2
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    ids = materialize(
        keyed.select(
            "doc_id", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"),
            (F.regexp_count("text", F.lit(WORD.pattern.decode())) if passage_bytes else F.lit(0)).cast("long").alias("words"),
        ),
        "texts",
    )
    found = materialize(
        keyed.filter(F.octet_length("text") >= least).select("k", "text").mapInArrow(_anchored(least), "h long, k long, pos long"), "anchors"
    )
    place = F.xxhash64("k", "pos")
    repeated = materialize(
        found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
        .filter("a <> b").select(F.col("h").alias("gram"), (F.col("n") > hot_anchors).alias("hot")),
        "grams",
    )
    of_text = (
        found.join(repeated, F.col("h") == F.col("gram")).groupBy("k", "hot").agg(F.collect_set(F.struct("pos", "h")).alias("at"))
        .select("k", "hot", F.col("at.pos").alias("at"), F.col("at.h").alias("grams"))
    )
    classes = materialize(ids.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    wanted = of_text.join(classes, "k").withColumnRenamed("k", "key")
    # rows of one text and one id may repeat; their places are told apart by (text, position) only
    texts = materialize(
        keyed.join(wanted, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("k", "copies", "hot", "at", "grams", "text"),
        "candidates",
    )
    discard(found)
    discard(repeated)
    total = texts.filter("not hot").agg(F.sum(F.size("at"))).first()[0] or 0
    parts = max(1, -(-total // part_anchors))
    runs = texts.filter("not hot").select("k", "text", "at", "grams").mapInArrow(_runs(gram, longest, parts), "part long, run binary")
    # as many tasks as ranges: by bytes alone AQE would join ranges until a task grows with the corpus
    spans = runs.repartition(parts, "part").groupBy("part").applyInArrow(_merged(gram, lengths), "k long, of int, lo long, hi long")
    if texts.filter("hot").limit(1).count():
        windows = materialize(
            texts.filter("hot").select("k", "text", "at").mapInArrow(_window_digests(gram, lengths), "w binary, k long, of int, lo long").distinct(), "windows"
        )
        twice = materialize(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("w").alias("digest")), "digests")
        spans = spans.union(windows.join(twice, F.col("w") == F.col("digest")).select("k", "of", "lo", (F.col("lo") + F.col("of")).alias("hi")))
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("of", "lo", "hi")).alias("spans"))
    partly = texts.filter("copies = 1").select("k", "text").dropDuplicates(["k"]).join(spans, "k")
    rests = materialize(
        partly.select("k", "text", "spans").mapInArrow(
            _without(length, passage_bytes, passage_words, cut),
            "k long, n_removed long, n_spans long, n_passage_bytes long, n_passages long, kept_sha256 string, kept_text string",
        ),
        "rests",
    )
    copied = F.col("copies") > 1
    gone = copied & (F.col("n_bytes") >= length) if length else F.lit(False)
    passage = copied & (F.col("n_bytes") >= passage_bytes) & (F.col("words") > passage_words) if passage_bytes else F.lit(False)
    # one join on the text, with a written table: copies of one text may be a third of all rows
    of_k = materialize(classes.select("k", "copies").join(rests.drop("kept_text"), "k", "left").withColumnRenamed("k", "key"), "covered")
    discard_since(docs.sparkSession, mark, ids, rests, of_k)
    joined = ids.join(of_k, F.col("k") == F.col("key")).drop("key")
    whole = lambda test, value, part: F.when(test, value).otherwise(F.coalesce(part, F.lit(0))).cast("long").alias(part)
    rows = joined.select(
        "doc_id",
        "k",
        "n_bytes",
        whole(gone, F.col("n_bytes"), "n_removed"),
        whole(gone, F.lit(1), "n_spans"),
        whole(passage, F.col("n_bytes"), "n_passage_bytes"),
        whole(passage, F.lit(1), "n_passages"),
        F.when(passage if cut == "passages" else gone, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return rows, rests.select("k", "kept_text")


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    passage_bytes: int = 200,
    passage_words: int = 50,
    **more,
) -> DataFrame:
    """``docs`` with repeated passages cut from the texts and their lengths set anew.

    Every row stays; a text that repeats as a whole becomes empty.  Of a
    character that lost some of its bytes, the others go as well.  Columns of
    any name pass unchanged; a table without ``length_col`` gets none.
    """
    mark = made()
    rows, rests = remove_repeats(docs, id_col, text_col, None, passage_bytes, passage_words, "passages", **more)
    gone = rows.filter("n_bytes > 0 and n_passage_bytes = n_bytes").select("k").distinct().withColumn("rest", F.lit(""))
    changed = materialize(gone.union(rests.join(gone.select("k"), "k", "left_anti")), "changed")
    discard_since(docs.sparkSession, mark, changed)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("at"))
    out = keyed.join(changed, F.col("at") == F.col("k"), "left")
    new = F.coalesce("rest", F.col("row")[text_col])
    size = F.when(new.isNotNull(), F.length(new).cast("long")).otherwise(F.col("row")[length_col] if length_col in docs.columns else F.lit(None))
    kinds = dict(docs.dtypes)
    fresh = {text_col: new, length_col: size}
    return out.select(*[(fresh[c].cast(kinds[c]) if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])
