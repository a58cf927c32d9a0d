"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line.  It is cut into leaves behind words that their own hash
selects (about every eighth), so an edit moves no cut but those next to it.  A
section ends at a blank line, or behind a paragraph that its hash selects (about
every fourth).  Nodes are hashes of their children's hashes, leaves of raw bytes;
the root tests equality of whole texts, and where roots differ, going down the
differing branches locates the edits.

The fingerprint is text: ``root|section[paragraph:leaves,...;section...`` in
lower-case hex, with leaves of 32 bits.  ``likeness`` is twice the number of
common leaves over the number of all, 1 for equal roots.

Cases: a null text counts as empty and has the fingerprint of the empty text;
equal texts have equal fingerprints wherever they stand; rows of one id follow
each other by text; null ids come last, before the first follows the last; a
table of one row is its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import short_batches

LEAF_WORDS, SECTION_PARAGRAPHS = 8, 4


def _node(kind: bytes, children: bytes) -> bytes:
    return blake2b(children, digest_size=16, person=kind).digest()


def _leaf_cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of leaves inside paragraphs and ends of paragraphs (behind the newline), as places in buf."""
    starts, ends, _ = T.word_spans(buf, offs)
    words = T.word_hashes(buf, starts, ends, lower=False)
    chosen = ends[(words >> np.uint64(32)) % np.uint64(LEAF_WORDS) == 0]
    return chosen, np.flatnonzero(buf == 10) + 1


Tree = tuple[str, list[str]]  # fingerprint, leaves


def fingerprints(texts: list[bytes]) -> list[Tree]:
    """Fingerprint and leaves of each text; one set of array passes finds all cuts."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = b"".join(texts)
    leaf_cuts, line_cuts = _leaf_cuts(np.frombuffer(raw, np.uint8), offs)
    inner = np.union1d(leaf_cuts, line_cuts)
    is_line = np.isin(inner, line_cuts, assume_unique=True).tolist()
    bounds = np.searchsorted(inner, offs, "right").tolist()  # a cut at the end of a text belongs to it
    inner_l, offs_l = inner.tolist(), offs.tolist()
    out = []
    for i in range(len(texts)):
        lo, hi, at = offs_l[i], offs_l[i + 1], offs_l[i]
        sections, section, leaves, all_leaves = [], [], [], []

        def end_paragraph(blank: bool) -> None:
            nonlocal section, leaves
            node = _node(b"paragraph", b"".join(leaves))
            section.append((node, leaves))
            leaves = []
            if blank or node[0] % SECTION_PARAGRAPHS == 0:
                sections.append(section)
                section = []

        for c in range(bounds[i], bounds[i + 1]):
            cut = inner_l[c]
            leaf = raw[at:cut]
            if leaf:
                leaves.append(blake2b(leaf, digest_size=16).digest())
            if is_line[c]:
                end_paragraph(len(leaves) == 1 and not leaf.strip(b" \t\r\x0b\x0c\n"))
            at = cut
        if at < hi:
            leaves.append(blake2b(raw[at:hi], digest_size=16).digest())
        if leaves:
            end_paragraph(False)
        if section:
            sections.append(section)
        parts, tops = [], []
        for s in sections:
            top = _node(b"section", b"".join(p for p, _ in s))
            tops.append(top)
            below = []
            for p, ls in s:
                short = [x[:4].hex() for x in ls]
                all_leaves += short
                below.append(f"{p[:8].hex()}:{''.join(short)}")
            parts.append(f"{top[:8].hex()}[{','.join(below)}")
        out.append((f"{_node(b'root', b''.join(tops)).hex()}|{';'.join(parts)}", all_leaves))
    return out


def parse(fingerprint: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """[(section, [(paragraph, [leaf, ...]), ...]), ...] of a fingerprint."""
    body = fingerprint.split("|", 1)[1]
    out = []
    for s in body.split(";") if body else []:
        top, _, below = s.partition("[")
        paragraphs = []
        for p in below.split(","):
            node, _, leaves = p.partition(":")
            paragraphs.append((node, [leaves[k : k + 8] for k in range(0, len(leaves), 8)]))
        out.append((top, paragraphs))
    return out


def _alike(a: Tree, b: Tree) -> float:
    if a[0].partition("|")[0] == b[0].partition("|")[0]:
        return 1.0
    n = len(a[1]) + len(b[1])
    common = sum((Counter(a[1]) & Counter(b[1])).values())
    return 2.0 * common / n if n else 1.0


def likeness(a: str, b: str) -> float:
    """Share of common leaves of two fingerprints, from 0 to 1."""
    return _alike(*((f, [x for _, s in parse(f) for _, p in s for x in p]) for f in (a, b)))


def edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) places in ``b`` that ``a`` does not have; subtrees that ``a`` has are not entered."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    one = parse(a)
    tops = {s for s, _ in one}
    nodes = {p for _, s in one for p, _ in s}
    leaves = {x for _, s in one for _, p in s for x in p}
    return [
        (i, j, k)
        for i, (s, paragraphs) in enumerate(parse(b)) if s not in tops
        for j, (p, ls) in enumerate(paragraphs) if p not in nodes
        for k, x in enumerate(ls) if x not in leaves
    ]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within each bucket; the row behind a bucket's last is marked."""
    pending: list[tuple[int, bool, int | None, str]] = []

    def done(rows: list) -> pa.RecordBatch:
        edited = []
        for (p, extra, _, t), (q, _, _, nxt) in zip(rows, rows[1:]):
            n = len(t) // 2
            edited.append(t[: len(t) - n] + nxt[:n] if p == q and not extra else None)
        own = fingerprints([r[3].encode() for r in rows])
        real = [i for i, e in enumerate(edited) if e is not None]
        raw = [edited[i].encode() for i in real]
        changed = fingerprints(raw)
        cols = {
            "doc_id": pa.array([rows[i][2] for i in real], pa.int64()),
            "n_chars": pa.array([len(rows[i][3]) for i in real], pa.int64()),
            "edited_sha256": pa.array([sha256(e).hexdigest() for e in raw], pa.string()),
            "fingerprint": pa.array([own[i][0] for i in real], pa.string()),
            "edited_fingerprint": pa.array([c[0] for c in changed], pa.string()),
            "near_edited": pa.array([_alike(own[i], c) for i, c in zip(real, changed)], pa.float64()),
            "near_next": pa.array([_alike(own[i], own[i + 1]) for i in real], pa.float64()),
        }
        return pa.RecordBatch.from_pydict(cols)

    held = 0
    for b in batches:
        for bucket, extra, doc, text in zip(*(b.column(c) for c in ("bucket", "extra", "doc_id", "text"))):
            row = (bucket.as_py(), extra.as_py(), doc.as_py(), text.as_py())
            if row[1] and pending and pending[-1][1] and pending[-1][0] == row[0]:
                continue  # only the first row behind a bucket counts
            pending.append(row)
            held += len(row[3])
            if held > 1_000_000:
                yield done(pending)
                pending, held = pending[-1:], 0
    yield done(pending)


def fingerprint_neighbours(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4000, most_buckets: int = 50_000
) -> DataFrame:
    """Fingerprints of each text, of its edited text and how alike they and the next text are.

    Ids are dealt into ranges between quantiles that are ids of the table, so the
    first row of a range is known beforehand: it goes to the range before as
    well, and the first of all to the last.  One shuffle of the texts, no window
    over all rows; the quantiles are at most ``most_buckets`` numbers.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.agg(F.count("doc_id")).first()[0]
    buckets = int(min(max(1, -(-n // bucket_rows)), most_buckets))
    at = [k / buckets for k in range(1, buckets)]
    first, cuts = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", at or [0.5], max(10_000, 4 * buckets))).first()
    bounds = np.array(sorted({c for c in (cuts or []) if c > first} if at else []), np.int64)

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds), np.int64)
        out[known] = np.searchsorted(bounds, ids[known].astype("int64").to_numpy(), "right")
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def leads(ids: pd.Series) -> pd.Series:
        return ids.isin(bounds)

    whole = rows.select("doc_id", "text", bucket_of("doc_id").alias("bucket"), leads("doc_id").alias("lead"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    ahead = F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("extra"))
    around = F.struct(F.lit(len(bounds)).cast("long").alias("bucket"), F.lit(True).alias("extra"))
    is_first = F.col("doc_id").eqNullSafe(F.lit(first).cast("long"))
    places = F.array_compact(F.array(own, F.when(F.col("lead"), ahead), F.when(is_first, around)))
    dealt = (
        whole.withColumn("place", F.explode(places))
        .select("place.bucket", "place.extra", "doc_id", "text")
        .repartition(len(bounds) + 1, "bucket")
        .sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_last(), "text")
    )
    return dealt.mapInArrow(
        _neighbours,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
