"""Vector best-fit packing of tokenized documents into sequences.

A bin (sequence) has residual capacities of tokens, documents and attention cost
(the sum of squared piece lengths).  A piece goes to the open bin that it fits in
every capacity and that scores best: least weighted norm of the residual after
placement (``rule="norm"``) or largest weighted dot product of piece and residual
(``rule="dot"``).  Pieces come in order of decreasing length.

A piece's vector follows from its length alone, so the packing is worked out on
the histogram of lengths: at most ``capacity`` rows, whatever the corpus.  Bins
with equal contents are one class with a count; a class that takes pieces splits
in at most three.  The plan lists, for each length, ranges of ranks and the bins
they go to; every piece then finds its place from its rank among the pieces of
its length.  Ranks come from counters kept by the tokenizing tasks and running
sums of their totals, so no length, however common, meets in one task, and the
result is one packing of the whole corpus, not one for each partition.

Documents are the tokenizer's ids, then id 0.  Only longer ones than ``capacity``
are cut: the first piece takes what does not fill a whole number of pieces.

Cases: null and empty texts are one token (id 0); repeated rows and null ids are
packed like any other; a text longer than the capacity gives full pieces; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize, short_batches

END_ID = 0
_LOADED: dict[str, "ByteTokenizer"] = {}


class ByteTokenizer:
    """A byte-level BPE file of the ``tokenizers`` library.

    Texts of common Latin script go through a faster engine with the same ranks
    and the same split pattern; any other, and one that contains an added token's
    content (which is that token's id), goes through ``tokenizers`` itself.
    """

    # the split pattern of byte-level BPE files without one of their own (fixed value)
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, fast: bool = True):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.added = sorted(special)
        self.fast = None
        if fast:
            import tiktoken

            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or max(text) < "ɐ") and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def _short(ids: np.ndarray) -> bytes:
    """Ids as 2 or 4 bytes each behind a byte that says which: they are written and shuffled once."""
    width = 2 if ids.max() < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _long(short: bytes) -> np.ndarray:
    return np.frombuffer(short, f"<u{short[0]}", offset=1).astype(np.int32)


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = tokenizer(path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids_of, rows, tokens, held = b.column(0).to_pylist(), [], [], 0

            def batch() -> pa.RecordBatch:
                cols = list(zip(*rows)) if rows else [[]] * 6
                arrays = [pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(cols)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
                if with_ids:
                    arrays.append(pa.array(tokens, pa.binary()))
                    names.append("ids")
                return pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(rows), pa.int32())], [*names, "task"])

            for doc, text in zip(ids_of, b.column(1)):
                t = text.as_py()
                ids = np.array([*(tok.encode(t) if t else ()), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[lo:hi]
                    rows.append((doc, n, lo, hi - lo, zlib.crc32(part.tobytes()), int(ranks[hi - lo])))
                    ranks[hi - lo] += 1
                    if with_ids:
                        tokens.append(_short(part))
                held += len(ids)
                if held > 1_000_000:
                    yield batch()
                    rows, tokens, held = [], [], 0
            yield batch()

    return run


class Plan:
    """Where the pieces of each length go: for ranks from ``rank[i]`` on, to sequences from ``sequence[i]`` on, at ``offset[i]``."""

    def __init__(self, start: np.ndarray, rank: np.ndarray, sequence: np.ndarray, offset: np.ndarray, sequences: int):
        self.start, self.rank, self.sequence, self.offset, self.sequences = start, rank, sequence, offset, sequences

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for s in np.unique(length):
            at = np.flatnonzero(length == s)
            lo, hi = self.start[s], self.start[s + 1]
            seg = lo + np.searchsorted(self.rank[lo:hi], rank[at], "right") - 1
            sequence[at] = self.sequence[seg] + rank[at] - self.rank[seg]
            offset[at] = self.offset[seg]
        return sequence, offset


def vector_best_fit(
    histogram: dict[int, int],
    capacity: int,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4),
) -> Plan:
    """Best fit, longest pieces first, on classes of equal bins.

    Every length takes a few vector operations over the open classes for each
    class that it fills, so the time depends on the lengths that occur, not on
    how many pieces there are.
    """
    cap = np.array([capacity, max_documents or capacity, max_attention or capacity**2], np.int64)
    weight = np.array(weights) / cap.astype(float) ** 2
    need = lambda s: np.array([s, 1, s * s], np.int64)
    least = min(histogram, default=1)
    open_left = np.zeros((0, 3), np.int64)
    open_n: list[int] = []
    open_has: list[tuple] = []  # (length, pieces) pairs as a chain: (length, k, rest)
    done: list[tuple[int, tuple | None]] = []

    def add(left: np.ndarray, n: int, has: tuple) -> None:
        nonlocal open_left
        if not n:
            return
        if (left >= need(least)).all():
            open_left = np.vstack([open_left, left])
            open_n.append(n)
            open_has.append(has)
        else:
            done.append((n, has))

    def drop(i: int) -> None:
        nonlocal open_left
        last = len(open_n) - 1
        open_left[i] = open_left[last]
        open_left = open_left[:last]
        open_n[i], open_has[i] = open_n[last], open_has[last]
        open_n.pop()
        open_has.pop()

    for s in sorted(histogram, reverse=True):
        left, item = histogram[s], need(s)
        if (item > cap).any():
            raise ValueError(f"a piece of length {s} does not fit an empty sequence")
        while left:
            fits = np.flatnonzero((open_left >= item).all(axis=1))
            if len(fits):
                r = open_left[fits]
                if rule == "norm":
                    best = fits[np.argmin((((r - item).astype(float) ** 2) * weight).sum(axis=1))]
                else:
                    best = fits[np.argmax((r.astype(float) * item * weight).sum(axis=1))]
                room, n, has = open_left[best].copy(), open_n[best], open_has[best]
                drop(int(best))
            else:
                room, n, has = cap.copy(), -1, None
            k = int((room // item).min())
            full = left // k if n < 0 else min(n, left // k)
            left -= full * k
            add(room - k * item, full, (s, k, has))
            if left and (n < 0 or full < n):  # the last bin takes fewer
                add(room - left * item, 1, (s, left, has))
                full, left = full + 1, 0
            if n > full:
                add(room, n - full, has)
    rows, cursor, sequence = [], dict.fromkeys(histogram, 0), 0
    for n, has in [*done, *zip(open_n, open_has)]:
        chain = []
        while has is not None:
            chain.append(has[:2])
            has = has[2]
        offset = 0
        for s, k in reversed(chain):
            for _ in range(k):
                rows.append((s, cursor[s], sequence, offset))
                cursor[s] += n
                offset += s
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    start = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    return Plan(start, table[:, 1], table[:, 2], table[:, 3], sequence)


def _placed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("place").to_numpy())
            names = [c for c in b.schema.names if c != "place"]
            cols = [pa.array([_long(x.as_py()) for x in b.column(c)], pa.list_(pa.int32())) if c == "ids" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset), one row per piece."""
    short_batches(docs.sparkSession)
    ids, stored = (", ids array<int>", ", ids binary") if with_ids else ("", "")
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(tokenizer_path, capacity, with_ids),
        f"doc_id long, piece int, start long, length long, ids_crc32 long, rank long{stored}, task int",
    )
    pieces = materialize(pieces, "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # at most `capacity` rows
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = vector_best_fit(histogram, capacity, max_documents, max_attention, rule)
    ranked = pieces.join(by_task.drop("n"), ["length", "task"]).withColumn("place", F.col("before") + F.col("rank"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.select(*cols, "place").mapInArrow(
        _placed(plan), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    )
