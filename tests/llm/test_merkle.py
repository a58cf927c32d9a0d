import re
from collections import Counter
from hashlib import blake2b, sha256

import numpy as np
import pytest

from roadweave.llm import _text as T

from roadweave.llm.merkle import edits, fingerprint_neighbours, fingerprints, likeness, parse


def selects(word, every):
    """Whether a word ends a leaf: the one thing taken from the library is the hash of a word."""
    buf = np.frombuffer(word, np.uint8)
    (h,) = T.word_hashes(buf, np.array([0]), np.array([len(buf)]), lower=False).tolist()
    return (h >> 32) % every == 0


def tree(text):
    """[[(paragraph node, [leaf, ...]), ...], ...] of a text, straight from the description."""
    node = lambda kind, below: blake2b(b"".join(below), digest_size=16, person=kind).digest()
    sections, section = [], []
    for line in re.findall(rb"[^\n]*\n|[^\n]+$", text):
        cuts = [m.end() for m in re.finditer(rb"[^\x20\x09-\x0D]+", line) if selects(m[0], 8)]
        bounds = [0, *cuts, len(line)]
        leaves = [blake2b(line[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:]) if a < b]
        paragraph = node(b"paragraph", leaves)
        section.append((paragraph, leaves))
        if (line.endswith(b"\n") and not line.strip(b" \t\r\x0b\x0c\n")) or paragraph[0] % 4 == 0:
            sections.append(section)
            section = []
    sections += [section] if section else []
    tops = [node(b"section", [p for p, _ in s]) for s in sections]
    return node(b"root", tops).hex(), [t[:8].hex() for t in tops], [[(p[:8].hex(), [x[:4].hex() for x in ls]) for p, ls in s] for s in sections]


def test_tree_from_its_description(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null").collect()
    texts = [r.text.encode() for r in docs] + [b"", b"\n", b"\n\n a\n\nb", b" ", b"x\n \t\ny z\n", "é\u2028ü\n".encode()]
    trees = [tree(t) for t in texts]
    for (print_, _), (root, tops, sections) in zip(fingerprints(texts), trees):
        assert print_.split("|")[0] == root
        assert [(s, ps) for s, ps in parse(print_)] == list(zip(tops, sections))
    flat = [Counter(x for s in t[2] for _, ls in s for x in ls) for t in trees]
    for a, b in zip(range(len(texts)), range(1, len(texts))):
        n = flat[a].total() + flat[b].total()
        want = 1.0 if trees[a][0] == trees[b][0] else 2 * (flat[a] & flat[b]).total() / n if n else 1.0
        assert likeness(fingerprints([texts[a]])[0][0], fingerprints([texts[b]])[0][0]) == pytest.approx(want)


def brute(rows):
    order = sorted(((i is None, i or 0, t or "", i) for i, t in rows))
    out = []
    for k, (_, _, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        f, g, x = (fingerprints([v.encode()])[0][0] for v in (t, e, nxt))
        out.append((i, len(t), sha256(e.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, x)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [7, 4000])
def test_documents(spark, bucket_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fingerprint_neighbours(docs.repartition(6), bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    long = [r for r in got if r.n_chars > 800]
    assert sum(0.3 < r.near_edited < 0.75 for r in long) > 0.9 * len(long)
    assert sum(r.near_next < 0.2 for r in long) > 0.9 * len(long)


@pytest.mark.parametrize("bucket_rows", [2, 4000])
def test_odd_rows(spark, odd_docs, bucket_rows):
    got = fingerprint_neighbours(odd_docs, bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_one_row_and_none(spark, odd_docs):
    one = odd_docs.filter("doc_id = 7")
    (r,) = fingerprint_neighbours(one).collect()
    assert r.near_next == 1.0
    assert fingerprint_neighbours(odd_docs.limit(0)).count() == 0


def test_tree_locates_edits():
    lines = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    a = "\n".join(lines)
    lines[17] = lines[17].replace("x20", "CHANGED")
    b = "\n".join(lines)
    f, g = (x[0] for x in fingerprints([a.encode(), b.encode()]))
    assert f.split("|")[0] != g.split("|")[0] and 0.9 < likeness(f, g) < 1
    places = edits(f, g)
    flat = [(i, j) for i, (_, ps) in enumerate(parse(g)) for j in range(len(ps))]
    assert 1 <= len(places) <= 3 and {flat.index(p[:2]) for p in places} == {17}
    assert edits(f, f) == [] and likeness(f, f) == 1.0
    assert len({x[0] for x in fingerprints([b"a b", b"a  b", b"a b ", b"A b", b"a\nb", b""])}) == 6
