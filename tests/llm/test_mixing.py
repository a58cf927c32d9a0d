import re
from collections import defaultdict

import pytest

from roadweave.llm.mixing import mix_sources, mixed


def targets(sizes, budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, free = {s: 0.0 for s in names}, budget * sum(sizes.values()), [s for s in names if sizes[s]]
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in free:
            out[s] += unit * weight[s]
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
        free = [s for s in free if out[s] < most * sizes[s] - 1e-9]
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(sizes, target, most=2.0):
    """Copies expected by weight (bit length of the size) for the documents of one source."""
    words_of = defaultdict(int)
    for n in sizes:
        words_of[n.bit_length()] += n
    low, high = 0.0, 2 * most
    for _ in range(200):  # the level at which the expected words meet the target
        level = (low + high) / 2
        if sum(min(most, level * w) * n for w, n in words_of.items()) < target:
            low = level
        else:
            high = level
    return {w: min(most, high * w) for w in words_of}


def check(docs, got):
    sizes = defaultdict(list)
    for r in docs:
        sizes[r.source].append(words(r.text))
    want, by = targets({s: sum(x) for s, x in sizes.items()}), defaultdict(list)
    assert sorted(words(r.text) for r in docs) == sorted(r.size for r in got)
    for r in got:
        assert r.source_size == sum(sizes[r.source])
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    for s, rows in by.items():
        e = expected(sizes[s], want[s])
        left, ranked = want[s], []
        for r in rows:
            if not r.size:
                assert r.copies == 0
                continue
            whole = int(e[r.weight] + 1e-6)
            p = e[r.weight] - whole
            left -= whole * r.size
            if p > 1e-6:
                assert r.p == pytest.approx(p, abs=1e-6) and r.copies in (whole, whole + 1)
                ranked.append((r.odds, r.size, r.copies - whole))
            else:
                assert r.p is None and r.copies == whole
        # in the order of the ranks as long as they fit, then some that close the gap
        ranked.sort()
        at = 0
        while at < len(ranked) and ranked[at][1] <= left + 1e-6:
            assert ranked[at][2] == 1
            left -= ranked[at][1]
            at += 1
        extra = [n for _, n, x in ranked[at:] if x]
        free = [n for _, n, _ in ranked[at:]]
        assert len(extra) <= 8
        if len(extra) > 1:
            assert sum(extra) - max(extra) < left
        if extra:
            assert max(n for n in free if n <= left or n == max(extra)) == max(extra) and abs(left - sum(extra)) < left
        elif free:
            assert min(abs(left - n) for n in free) >= left - 1e-6
        assert abs(want[s] - sum(r.taken for r in rows)) <= max(0.01 * want[s], min((n for _, n, x in ranked[at:] if not x), default=0) / 2 + 1, 1)


def test_odd_rows(spark, odd_docs):
    check(odd_docs.collect(), mix_sources(odd_docs).collect())


def test_documents_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = mix_sources(docs).collect()
    check(docs.collect(), first)
    again = mix_sources(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in first} == {(r.doc_id, r.taken) for r in again}


def test_empty_table(spark, odd_docs):
    assert mix_sources(odd_docs.limit(0)).count() == 0


def test_ranks_follow_inclusion_odds(spark):
    """Documents with a larger chance of one more copy get it more often, and their shares come near the chances."""
    rows = [(i, " ".join(["w"] * (3 if i % 2 else 60)), "a") for i in range(4000)] + [(9000 + i, " ".join(["v"] * 40), "b") for i in range(4000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=0.8, weights=(1, 3)).collect()
    assert len({r.p for r in got if r.source == "a"}) == 2
    for kind in ((3, "a"), (60, "a"), (40, "b")):
        some = [r for r in got if (r.size, r.source) == kind]
        if some[0].p is not None:
            assert abs(sum(r.copies for r in some) / len(some) % 1 - some[0].p) < 0.03
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 30  # half the larger size


def test_many_equal_rows_and_slices(spark, monkeypatch):
    from roadweave.llm import mixing

    docs = spark.createDataFrame([(None, "one two three", "a")] * 300 + [(i, "four five " * (i % 9), "b") for i in range(300)], "doc_id long, text string, source string")
    one = sorted((r.taken for r in mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "SLICE", 7)
    assert sorted((r.taken for r in mix_sources(docs).collect())) == one


def test_mixed_rows(spark):
    names = ["doc_id", "text", "source", "__k", "id", "of_text", "nth", "row", "copies", "i", "h"]
    docs = spark.createDataFrame([(i % 40, f"a b {i % 40}", "s" if i % 3 else None, *[f"{c}{i}" for c in names[3:]]) for i in range(80)], names)
    out = mixed(docs)
    assert out.columns == names
    of = {(r.doc_id, r.source, r.nth): r.copies for r in mix_sources(docs).collect()}
    assert sum(of.values()) == out.count() and set(out.collect()) <= set(docs.collect())
