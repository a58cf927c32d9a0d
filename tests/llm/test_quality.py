import re
from collections import Counter

import pytest

from roadweave.llm.quality import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if counts[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def check(docs, got):
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    want = []
    for r in docs:
        m = measures(r.text)
        want.append((r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_measures_on_odd_rows(spark, odd_docs):
    got = quality_rules(odd_docs).collect()
    check(odd_docs.collect(), got)
    assert all(not r.kept for r in got if r.base_failed)


def test_measures_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs.collect(), quality_rules(docs).collect())


def test_host_with_mostly_failures_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, f"s{i % 9}") for i in range(900)] + [(1000 + i, "junk" if i % 20 else good, "bad") for i in range(200)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.host: r for r in got}
    assert by["bad"].host_rejected and not by["s1"].host_rejected
    f = Counter(r.host for r in got if r.base_failed)
    n = Counter(r.host for r in got)
    rates = [f[h] / n[h] for h in n]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    s = min(1000.0, max(1.0, m * (1 - m) / v - 1))
    for h in n:
        assert by[h].shrunk_rate == pytest.approx((f[h] + m * s) / (n[h] + s))
    assert sum(r.kept for r in got) == 900


def test_empty_table(spark, odd_docs):
    assert quality_rules(odd_docs.limit(0)).count() == 0
