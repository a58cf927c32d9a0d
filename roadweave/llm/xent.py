"""Cross-entropy difference: score documents by per-token loss under two models.

Target and background models are interpolated bigram models over one vocabulary,
the ids of a public byte-level tokenizer.  The target is the documents that
``labels`` calls good, the background all documents.  With leave-one-out, a
document's own counts are taken from both models before it is scored, so no
document is told apart by having been counted.

    P1(w)   = (c(w) + alpha) / (N + alpha V)
    P(w|v)  = lambda c(v, w) / c(v) + (1 - lambda) P1(w),   P1(w) alone if c(v) = 0

The score is the mean over tokens of target loss minus background loss, in bits;
lower is more like the target.

Bigram counts grow with the corpus and are never gathered in one place: documents
are dealt into chunks by a hash of their id (about ``chunk_bytes`` of text each);
each chunk counts its distinct bigrams and writes them, counts are summed over
chunks with map-side sums, and every chunk gets back just the counts of the bigrams
that it has; unigrams and the total go the same way.  A frequent key has a row in
every chunk, so sums and counts are joined as written tables and AQE can split it.
"Matched" models have the same form, smoothing, mixture and vocabulary; the
background is not cut to the target's size, as counts cover all documents.

Cases: null and empty texts have no tokens and null losses; documents without a
label are background only; a null id is never a target; repeated rows count each
time they occur and each leaves out only itself; without targets the target model
is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, short_batches
from .packing import tokenizer


TOTAL, TARGET = -1, -2  # keys of rows that are no n-grams


def _tokens(texts: pa.ChunkedArray, path: str) -> Iterator[np.ndarray]:
    tok = tokenizer(path)
    for t in texts:
        text = t.as_py()
        yield np.array(tok.encode(text) if text else [], np.int64)


def _tally(keys: list[np.ndarray], flags: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their counts over all documents and over targets."""
    none = np.zeros(0, np.int64)
    u, n = np.unique(np.concatenate([none, *keys]), return_counts=True)
    ut, nt = np.unique(np.concatenate([none, *(k for k, f in zip(keys, flags) if f)]), return_counts=True)
    t = np.zeros(len(u), np.int64)
    t[np.searchsorted(u, ut)] = nt
    return u, n, t


def _counted(path: str, vocabulary: int):
    """One row per distinct unigram (key below the vocabulary's size) and bigram of a chunk, and one with its number of tokens (TOTAL)."""

    def run(docs: pa.Table, targets: pa.Table) -> pa.Table:
        wanted = set(targets.column("doc_id").to_pylist())
        flags, uni, bi, chunk = [], [], [], docs.column("chunk")[0].as_py() if len(docs) else 0
        for doc, ids in zip(docs.column("doc_id").to_pylist(), _tokens(docs.column("text"), path)):
            flags.append(doc in wanted)
            uni.append(ids)
            bi.append((ids[:-1] + 1) * vocabulary + ids[1:])
        parts = [_tally(uni, flags), _tally(bi, flags)]
        sums = (np.array([TOTAL]), *(np.array([p.sum()]) for p in parts[0][1:]))
        keys, n, t = (np.concatenate(x) for x in zip(sums, *parts))
        return pa.table({"chunk": pa.array(np.full(len(keys), chunk)), "key": pa.array(keys), "n": pa.array(n), "t": pa.array(t)})

    return run


class Losses:
    """Both models, as far as one chunk needs them: sorted keys with their counts in background and target."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, vocabulary: int, alpha: float, mixture: float):
        self.keys, self.counts, self.vocabulary, self.alpha, self.mixture = keys, counts, vocabulary, alpha, mixture
        self.totals = counts[np.searchsorted(keys, TOTAL)] if len(keys) else np.zeros(2)

    def of(self, ids: np.ndarray, target: bool, leave_out: bool) -> tuple[float, float]:
        """Mean loss in bits of a document's tokens under the target and the background model."""
        size = self.vocabulary
        u, un = np.unique(ids, return_counts=True)
        b, bn = np.unique((ids[:-1] + 1) * size + ids[1:], return_counts=True)
        at_u, at_b = np.searchsorted(self.keys, u), np.searchsorted(self.keys, b)
        v, w, start = np.searchsorted(u, b // size - 1), np.searchsorted(u, b % size), np.searchsorted(u, ids[0])
        out = []
        for k, own in ((1, target and leave_out), (0, leave_out)):
            one = self.counts[at_u, k] - (un if own else 0)
            low = (one + self.alpha) / (self.totals[k] - (len(ids) if own else 0) + self.alpha * size)
            pair = self.counts[at_b, k] - (bn if own else 0)
            p = np.where(one[v] > 0, self.mixture * pair / np.maximum(one[v], 1) + (1 - self.mixture) * low[w], low[w])
            out.append((-np.log2(low[start]) - (bn * np.log2(p)).sum()) / len(ids))
        return float(out[0]), float(out[1])


def _scored(path: str, vocabulary: int, alpha: float, mixture: float, leave_out: bool):
    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        is_target = key == TARGET
        wanted = set(table.column("n").to_numpy()[is_target].tolist())
        key = key[~is_target]
        order = np.argsort(key)
        counts = np.stack([table.column(c).to_numpy()[~is_target][order] for c in ("n", "t")], axis=1)
        model = Losses(key[order], counts, vocabulary, alpha, mixture)
        ids_of = docs.column("doc_id").to_pylist()
        rows = []
        for doc, ids in zip(ids_of, _tokens(docs.column("text"), path)):
            a, b = model.of(ids, doc in wanted, leave_out) if len(ids) else (None, None)
            rows.append((doc, len(ids), a, b, None if a is None else a - b))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["doc_id", "n_tokens", "loss_target", "loss_background", "xent_diff"]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(names, zip(*rows) if rows else [[]] * 5, kinds)})

    return run


def cross_entropy_difference(
    docs: DataFrame,
    targets: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: int = 50_257,
    alpha: float = 0.1,
    mixture: float = 0.7,
    leave_one_out: bool = True,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, xent_diff), one row per row.

    ``targets``: a table with the ids (``id_col``) of target documents.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # small inputs still go to as many tasks as a shuffle would have, with a megabyte each at least
    spread = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 20)
    chunks = max(1, -(-total // chunk_bytes), spread)
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk")
    # rows without an id are never targets and may go anywhere
    anywhere = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks)).alias("chunk")
    dealt = rows.select(anywhere, "doc_id", "text")
    ids = targets.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    wanted = ids.select(chunk, "doc_id")
    counted = dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(
        _counted(tokenizer_path, vocabulary), "chunk long, key long, n long, t long"
    )
    counted = materialize(counted, "counts")
    sums = materialize(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).withColumnRenamed("key", "of"), "sums")
    table = counted.select("chunk", "key").join(sums, F.col("key") == F.col("of")).select("chunk", "key", "n", "t")
    table = table.union(wanted.select("chunk", F.lit(TARGET).cast("long"), "doc_id", F.lit(0).cast("long")))
    return dealt.groupBy("chunk").cogroup(table.groupBy("chunk")).applyInArrow(
        _scored(tokenizer_path, vocabulary, alpha, mixture, leave_one_out),
        "doc_id long, n_tokens long, loss_target double, loss_background double, xent_diff double",
    )
