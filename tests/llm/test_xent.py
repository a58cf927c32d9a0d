import math
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadweave.llm.xent import cross_entropy_difference

PATH = public_tokenizers.path("byte_bpe_50k.json")
V, ALPHA, MIX = 50_257, 0.1, 0.7


def brute(rows, targets):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    docs = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    models = {k: (Counter(), Counter()) for k in "tb"}
    for i, ids in docs:
        for k in "tb" if i in targets else "b":
            models[k][0].update(ids)
            models[k][1].update(zip(ids, ids[1:]))
    totals = {k: sum(models[k][0].values()) for k in "tb"}
    out = []
    for i, ids in docs:
        own1, own2, loss = Counter(ids), Counter(zip(ids, ids[1:])), {}
        for k in "tb":
            one, two = models[k]
            mine = k == "b" or i in targets
            c1 = lambda w: one[w] - (own1[w] if mine else 0)
            p1 = lambda w: (c1(w) + ALPHA) / (totals[k] - (len(ids) if mine else 0) + ALPHA * V)
            total = 0.0
            for n, w in enumerate(ids):
                p = p1(w)
                if n and c1(ids[n - 1]):
                    v = ids[n - 1]
                    p = MIX * (two[v, w] - (own2[v, w] if mine else 0)) / c1(v) + (1 - MIX) * p1(w)
                total -= math.log2(p)
            loss[k] = total / len(ids) if ids else None
        out.append((i, len(ids), loss["t"], loss["b"]))
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def compare(got, want):
    got = sorted(((r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in got), key=lambda r: (str(r[0]), r[1]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        if w[1]:
            assert g[2:] == pytest.approx(w[2:], rel=1e-9)
        else:
            assert g[2:] == (None, None)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1")
    got = cross_entropy_difference(docs, good, PATH, chunk_bytes=60_000).collect()
    compare(got, brute([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in good.collect()}))
    assert all(r.xent_diff == pytest.approx(r.loss_target - r.loss_background) for r in got if r.n_tokens)


def test_odd_rows(spark, odd_docs):
    targets = spark.createDataFrame([(0,), (0,), (5,), (None,), (99,)], "doc_id long")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    compare(cross_entropy_difference(odd_docs, targets, PATH, chunk_bytes=5000).collect(), brute(rows, {0, 5}))
    compare(cross_entropy_difference(odd_docs, targets.limit(0), PATH).collect(), brute(rows, set()))
    assert cross_entropy_difference(odd_docs.limit(0), targets, PATH).count() == 0
