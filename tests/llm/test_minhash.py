import random
import re

import numpy as np

from roadweave.llm.minhash import keep_one_of_each, near_duplicates, resolve_cluster

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(rows):
    """(doc_id, text) -> doc_id -> (set size, component)."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    post = {}
    for i in ids:
        for s in sets[i]:
            post.setdefault(s, []).append(i)
    for i in ids:
        seen = {}
        for s in sets[i]:
            for j in post[s]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def as_dict(df):
    got = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert as_dict(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def chain(n=120, seed=3):
    """Texts that drift word by word, so that links make long chains, and unrelated ones."""
    rnd = random.Random(seed)
    base, rows = [f"w{rnd.randrange(10**6)}" for _ in range(80)], []
    for i in range(n):
        rows.append((i, " ".join(base)))
        if i % 3 == 2:
            base[rnd.randrange(80)] = f"v{rnd.randrange(10**6)}"
        if i % 40 == 39:
            base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    return rows


def test_large_clusters_are_dealt_out(spark):
    rows = chain()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert as_dict(near_duplicates(docs, cluster_bytes=6000)) == want
    assert as_dict(near_duplicates(docs, cluster_bytes=6000, pivot_rounds=0)) == want


def test_resolve_is_exact():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(5, 60)).astype(np.uint64)) for _ in range(150)]
    sets = [np.frombuffer(x, np.uint64) for x in {s.tobytes() for s in sets}]
    comp, _ = resolve_cluster(sets, 60, pivots=3)
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 60 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((want[a], want[b]))
                want = [x if w == y else w for w in want]
    assert comp.tolist() == want


def test_odd_rows(spark, odd_docs):
    got = near_duplicates(odd_docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert len(got) == 13
    assert {c for _, c, _ in by[0] | by[1] | by[6] | by[None]} == {0}
    assert by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)} and by[9] == {(0, 9, True)} and by[4] == {(1, 4, True)}
    assert all(not k for _, _, k in by[None])


def test_one_of_each_with_clashing_columns(spark, odd_docs):
    names = ["doc_id", "text", "__id", "__nth", "__of_text", "row", "id", "of", "nth", "of_text", "kept", "cluster"]
    rows = [(r.doc_id, r.text, *(["x"] * 10)) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = keep_one_of_each(docs)
    assert out.columns == names
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4, 5, 7, 8, 9, 10]


def test_empty_table(spark, odd_docs):
    assert near_duplicates(odd_docs.limit(0)).count() == 0
