from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_minhash import brute as components
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check as check_packed
from tests.llm.test_quality import measures
from tests.llm.test_suffix import brute_passages

STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted(df.collect(), key=str)


def test_stages_against_brute_force(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = docs.columns
    docs = docs.union(odd_docs.withColumn("doc_id", odd_docs.doc_id + 1_000_000).select(*names))
    before = rows(docs)

    kept = STAGES["quality"](spark, docs, "").cache()
    after = rows(kept)
    m = {r: measures(r.text) for r in before}
    passed = [r for r in before if m[r][0] >= 20 and 100 * m[r][4] <= 30 * m[r][0]]
    assert kept.columns == names and Counter(after) <= Counter(passed)
    rejected = {r.source for r in passed} - {r.source for r in after}
    assert Counter(after) == Counter(r for r in passed if r.source not in rejected)

    single = STAGES["near_dedup"](spark, kept, "").cache()
    alone = rows(single)
    comp = components([(r.doc_id, r.text) for r in after if r.doc_id is not None])
    assert single.columns == names
    assert sorted(r.doc_id for r in alone) == sorted({c for _, c in comp.values()})
    assert set(alone) <= set(after)

    cut = STAGES["suffix_dedup"](spark, single, "").cache()
    want = {i: text for i, _, _, text in brute_passages([(r.doc_id, r.text) for r in alone], 200, 50)}
    assert cut.columns == names and cut.count() == len(alone)
    for r in cut.collect():
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text)

    mix = STAGES["mixing"](spark, cut, "").cache()
    n = lambda r: measures(r.text)[0]
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in cut.collect():
        sizes[r.source] += n(r)
        most[r.source] = max(most[r.source], n(r))
    for r in mix.collect():
        taken[r.source] += n(r)
    goal = targets(sizes)
    assert mix.columns == names and set(mix.collect()) <= set(cut.collect())
    assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1 for s in sizes)
    assert max(Counter(r.doc_id for r in mix.collect()).values()) <= 2

    check_packed(mix.collect(), STAGES["packing"](spark, mix, "").collect(), 2048, slack=3)


def test_stages_with_clashing_columns(spark, odd_docs):
    """Columns of any name pass through every stage that returns documents."""
    extra = ["row", "__id", "__nth", "__k", "__text", "__copy", "k", "id", "h", "s", "i", "t", "nth", "of", "of_text", "copies", "weight", "kept", "host", "rest", "at", "component_id"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    table = spark.createDataFrame([(*r, *(f"{c}!" for c in extra)) for r in docs], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, "")
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra], name
        assert {tuple(r)[5:] for r in table.collect()} <= {tuple(f"{c}!" for c in extra)}
    assert STAGES["packing"](spark, table, "").count() > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_empty(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if "sequence_id" not in out.columns:
            docs = out
