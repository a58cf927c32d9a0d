import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadweave.llm.packing import ByteTokenizer, pack_documents, vector_best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, got, capacity, slack=1):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = Counter()
    for r in docs:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, n, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(bins) <= least + slack
    return bins


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs.collect(), pack_documents(docs.repartition(5), PATH).collect(), 2048, slack=3)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_documents_under_binding_capacities(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pack_documents(docs.repartition(5), PATH, max_documents=3, max_attention=2048 * 2048 // 2 + 2048 * 1024, rule=rule)
    assert dict(got.dtypes)["piece"] == "int"
    bins = check(docs.collect(), got.collect(), 2048, slack=10**6).values()
    assert all(len(b) <= 3 and sum(n * n for _, n in b) <= 2048 * 2048 for b in bins)
    tight = pack_documents(docs, PATH, capacity=512, max_documents=2, max_attention=512 * 512, rule=rule).collect()
    assert max(len(b) for b in check(docs.collect(), tight, 512, slack=10**6).values()) == 2


def test_odd_rows(spark, odd_docs):
    check(odd_docs.collect(), pack_documents(odd_docs, PATH, capacity=64).collect(), 64)


def test_all_capacities_hold(spark, odd_docs):
    got = pack_documents(odd_docs, PATH, capacity=256, max_documents=2, max_attention=256 * 256 // 2 + 256 * 256 // 2, with_ids=True).collect()
    assert all(len(b) <= 2 for b in check(odd_docs.collect(), got, 256, slack=10**6).values())
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents,attention", [(None, None), (5, None), (None, 9000), (4, 9000)])
def test_plan_places_every_rank_once(rule, documents, attention):
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(1, 91, 3000)
    plan = vector_best_fit(dict(Counter(lengths.tolist())), 100, documents, attention, rule)
    rank, seen = np.zeros(len(lengths), np.int64), Counter()
    for i, s in enumerate(lengths):
        rank[i] = seen[s]
        seen[s] += 1
    sequence, offset = plan.place(lengths, rank)
    assert set(sequence) == set(range(plan.sequences))
    for q in range(plan.sequences):
        at = np.flatnonzero(sequence == q)
        at = at[np.argsort(offset[at])]
        assert (np.cumsum(lengths[at]) - lengths[at] == offset[at]).all() and lengths[at].sum() <= 100
        assert len(at) <= (documents or 100) and (lengths[at] ** 2).sum() <= (attention or 10**4)


def test_fast_engine_gives_the_same_ids(spark):
    fast, slow = ByteTokenizer(PATH), ByteTokenizer(PATH, fast=False)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", "a  b\u0085c\x1c\x1dd  \n\n e'll I'VE 12½ ªº", "x" * 3000, " \t " * 50, "<|endoftext|>", "ß̀ naïve 日本語 😀"]
    assert all(fast.encode(t) == slow.encode(t) for t in texts if t)


def test_empty_table(spark, odd_docs):
    assert pack_documents(odd_docs.limit(0), PATH).count() == 0


def test_added_tokens_in_texts_have_their_own_id(spark):
    text = "a <|endoftext|> b"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert 50256 in want and ByteTokenizer(PATH).encode(text) == want == ByteTokenizer(PATH, fast=False).encode(text)
    got = pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert (got.length, got.ids_crc32) == (len(want) + 1, zlib.crc32(np.array([*want, 0], "<u4").tobytes()))
