import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from roadweave.llm.suffix import common_prefix, decode_run, encode_run, merge_runs, remove_repeats, whole_words, without_repeats


def repeated_bytes(raws, length):
    """One mark a byte for each text: whether a string of ``length`` bytes over it starts elsewhere too."""
    seen = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        out.append(gone)
    return out


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), r, gone in zip(rows, raws, repeated_bytes(raws, length)):
        spans = sum(1 for x in range(len(r)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(r), sum(gone), spans, sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_passages(rows, length, words):
    """(id, bytes in passages, passages, the text without them) for each row."""
    raws = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), r, gone in zip(rows, raws, repeated_bytes(raws, length)):
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        ends = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)]
        spans = [(lo, hi) for lo, hi in spans if sum(lo <= a and b <= hi for a, b in ends) > words]
        cut = bytes(c for x, c in enumerate(r) if not any(lo <= x < hi for lo, hi in spans))
        out.append((i, sum(hi - lo for lo, hi in spans), len(spans), cut.decode(errors="ignore")))
    return sorted(out, key=str)


def got(docs, **more):
    rows, _ = remove_repeats(docs, **more)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()), key=str)


def passages(n=60, seed=1, alphabet="abcdefgh é"):
    """Random texts with shared pieces of many lengths, runs of one letter and short periods."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    pool = [word(rnd.randrange(10, 140)) for _ in range(12)] + ["x" * 90, "ab" * 45]
    rows = []
    for i in range(n):
        text = word(rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            text += p[a : rnd.randrange(a, len(p) + 1)] + word(rnd.randrange(50))
        rows.append((i, text))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[3][1])]


@pytest.mark.parametrize("length,hot", [(40, 10**6), (21, 10**6), (40, 3)])
def test_against_brute_force(spark, length, hot):
    rows = passages(seed=length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs, length=length, hot_anchors=hot, part_anchors=30) == brute(rows, length)


@pytest.mark.parametrize("length,least,words,hot", [(40, 20, 4, 10**6), (None, 24, 3, 10**6), (40, 20, 4, 3), (20, 40, 2, 10**6)])
def test_passages_against_brute_force(spark, length, least, words, hot):
    rows = passages(seed=least, alphabet="abcdefg   é")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    more = dict(length=length, passage_bytes=least, passage_words=words, hot_anchors=hot, part_anchors=30)
    found, _ = remove_repeats(docs, **more)
    want = brute_passages(rows, least, words)
    assert sum(n for _, n, _, _ in want) > 0
    assert sorted(((r.doc_id, r.n_passage_bytes, r.n_passages) for r in found.collect()), key=str) == sorted((x[:3] for x in want), key=str)
    if length:
        assert got(docs, **more) == brute(rows, length)


def test_cut_passages_and_pass_other_columns(spark):
    rows = passages(seed=9, alphabet="abcdefg   é")
    extra = ("__k", "__rest", "__at", "k", "rest", "at", "row", "n_bytes")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], ["doc_id", "text", *extra]).repartition(3)
    out = without_repeats(docs, passage_bytes=20, passage_words=4)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((x[0], x[3]) for x in brute_passages(rows, 20, 4)), key=str)
    assert {tuple(r)[2:] for r in out.collect()} == {extra}


def test_passage_of_51_words(spark):
    """51 words that two documents share go, 50 stay, whatever stands around them."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = text(51), text(50)
    rows = [(0, f"{text(30)} {long} {text(9)}"), (1, f"{long}\n{text(60)}"), (2, f"{text(8)} {short} {text(70)}"), (3, f"{text(5)}\t{short}"), (4, text(90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert long not in out[0] and long not in out[1]
    assert [out[i] for i in (2, 3, 4)] == [t for _, t in rows[2:]]


def test_whole_words():
    raw = b"ab cd  ef gh"
    assert [whole_words(raw, *x) for x in ((0, 12), (1, 12), (0, 11), (3, 5), (4, 4), (2, 7), (1, 4), (0, 1))] == [4, 3, 3, 1, 0, 1, 0, 0]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_odd_rows(spark, odd_docs):
    assert got(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 400)


def test_empty_table(spark, odd_docs):
    assert got(odd_docs.limit(0)) == []


def test_runs_and_loser_tree():
    rnd = random.Random(4)
    runs = []
    for r in range(7):
        runs.append(sorted((bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 9))), b"l", [r], [i]) for i in range(rnd.randrange(40))))
    coded = [list(decode_run(encode_run(x))) for x in runs]
    assert [[e for _, e in c] for c in coded] == runs
    out = list(merge_runs([iter(c) for c in coded]))
    assert [e[0] for _, e in out] == sorted(e[0] for x in runs for e in x)
    for (_, a), (n, b) in zip(out, out[1:]):
        assert n == common_prefix(a[0], b[0])
