"""Language identification with string kernels.

The kernel is a blended spectrum of character n-gram presence: for each order
n = 1, 2, 3 the number of common n-grams over the root of the product of both
texts' numbers of n-grams, summed.  Letters count in lower case; every run of
other characters is one space.  n-grams are hashed into a fixed number of bits.

Training sees a bounded sample: ``per_language`` documents of each language,
those with the smallest hashes of their ids.  Landmarks, taken from the sample
in turn by language, give Nyström features K(x, L) K(L, L)^(-1/2); one-versus-rest
ridge regression on them gives a weight for each landmark and language.  As the
kernel is linear in the presence bits, landmarks and weights multiply out to one
weight for each bit and language (a few hundred kilobytes, whatever the corpus),
and a batch of documents is scored by one matrix product for each order.

Cases: null texts and texts without a letter are ``und`` with score 0; rows with a
null or repeated id are predicted like any other, and one with a null id is never
in the sample; without any language to learn from all is ``und``; an empty table
gives an empty result.  ``lang`` is read for training only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize, short_batches

ORDERS, BITS = (1, 2, 3), (10, 12, 15)
WIDTHS = tuple(1 << b for b in BITS)
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))  # odd constants of 32 bits
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def presence(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(one 0/1 matrix of texts x bits for each order, whether a text has a letter)."""
    low = [f" {t.lower()} " for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    before = np.empty_like(letter)
    before[:1] = False
    before[1:] = letter[:-1]
    start = np.zeros(len(code), bool)
    start[np.cumsum(lens)[:-1]] = True
    keep = letter | before | start
    keep[:1] = True
    row = np.repeat(np.arange(len(low)), lens)[keep]
    c = np.where(letter, code, np.uint32(32))[keep]
    has = np.bincount(row[c != 32], minlength=len(low)) > 0
    out = []
    h = np.zeros(len(c), np.uint32)
    for n, bits in zip(ORDERS, BITS):
        # the n-gram's hash from that of the shorter one and its last character
        m = len(c) - n + 1
        x = np.zeros((len(low), 1 << bits), np.uint8)
        if m > 0:
            h = (h[:m] ^ (c[n - 1 :] + np.uint32(n))) * _MULTIPLIERS[n - 1]
            h ^= h >> np.uint32(15)
            same = row[:m] == row[n - 1 :]
            at = (h * np.uint32(2654435769)) >> np.uint32(32 - bits)
            x[row[:m][same], at[same]] = 1
        out.append(x)
    return out, has


def _batches(texts: list[str], chars: int = 400_000, rows: int = 64) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and j - i < rows and (j == i or n + len(texts[j]) <= chars):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


class Model:
    def __init__(self, languages: list[str], weights: list[np.ndarray], bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages regression outputs, whether a text has a letter)."""
        bits, has = presence(texts)
        out = np.tile(self.bias, (len(texts), 1))
        for x, w in zip(bits, self.weights):
            f = x.astype(np.float32)
            out += (f @ w) / np.sqrt(np.maximum(f.sum(axis=1, keepdims=True), 1))
        return out, has

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        out, has = self.scores(texts)
        e = np.exp(4 * (out - out.max(axis=1, keepdims=True)))
        best = out.argmax(axis=1)
        score = e[np.arange(len(best)), best] / e.sum(axis=1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has)], [float(s) if h else 0.0 for s, h in zip(score, has)]


def fit(packed: list[list[bytes]], labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model | None:
    """Kernel ridge regression on the sample; ``packed`` holds each document's presence bits for each order."""
    languages = sorted(set(labels))
    if not languages:
        return None
    n = len(labels)
    # landmarks: the sample in turn by language
    turn: dict[str, int] = {}
    rank = []
    for y in labels:
        rank.append((turn.setdefault(y, 0), y))
        turn[y] += 1
    chosen = np.array(sorted(range(n), key=rank.__getitem__)[:landmarks])
    m = len(chosen)

    def matrix(k: int, rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(packed[r][k] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = [matrix(k, chosen) for k in range(len(ORDERS))]
    kernel = np.zeros((n, m))
    for lo in range(0, n, 128):
        rows = np.arange(lo, min(lo + 128, n))
        for k in range(len(ORDERS)):
            kernel[rows] += matrix(k, rows) @ marks[k].T
    values, vectors = np.linalg.eigh(sum(x @ x.T for x in marks).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    goal = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    middle, level = features.mean(axis=0), goal.mean(axis=0)
    a = features - middle
    w = np.linalg.solve(a.T @ a + ridge * n * np.eye(a.shape[1]), a.T @ (goal - level))
    by_mark = (root @ w).astype(np.float32)
    return Model(languages, [x.T @ by_mark for x in marks], (level - middle @ w).astype(np.float32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for i, j in _batches(texts):
            bits, has = presence(texts[i:j])
            cols = [pa.array([np.packbits(r).tobytes() for r in x], pa.binary()) for x in bits]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", "lang")), pa.array(has), *cols], ["doc_id", "lang", "has", "p1", "p2", "p3"])


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs: list[str] = []
            scores: list[float] = []
            for i, j in _batches(texts):
                x, y = model.predict(texts[i:j]) if model else (["und"] * (j - i), [0.0] * (j - i))
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, landmarks: int = 256) -> Model | None:
    """Fit on at most ``per_language`` documents of each language that are not held out.

    The sample is drawn on ids alone.  Counts by language, a written table of as
    many rows as there are languages, give a bound on the hash that leaves some
    4 * ``per_language`` candidates before anything is shuffled, so the ranking
    behind it has as few rows for a language with a third of all documents as for
    any other.  Of the sample only the presence bits, 5 KB for each id and
    language, reach the driver; of rows that repeat an id one counts, as their number is that of ids.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id") & (F.length("text") > 0))
    order = F.xxhash64(F.lit(7), "doc_id")
    counts = materialize(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), "languages")
    # order is uniform in [-2**63, 2**63)
    share = (order.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    few = usable.select("doc_id", "lang", order.alias("order"), share.alias("share")).join(counts, "lang").filter(F.col("share") * F.col("n") < 4 * per_language)
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    chosen = few.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    # at most ``per_language`` ids for each language: sent to all tasks, so that the texts need no shuffle
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")
    packed = sample.mapInArrow(_packed, "doc_id string, lang string, has boolean, p1 binary, p2 binary, p3 binary").filter("has")
    got = packed.groupBy("doc_id", "lang").agg(F.min(F.struct("p1", "p2", "p3")).alias("p")).select("lang", "p.*").toArrow()
    found = sorted(zip(got["lang"].to_pylist(), *(got[c].to_pylist() for c in ("p1", "p2", "p3"))))
    return fit([list(r[1:]) for r in found], [r[0] for r in found], landmarks)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row."""
    short_batches(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col, **training)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")
