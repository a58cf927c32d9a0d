import math
import zlib

import numpy as np

from roadweave.llm.langid import ORDERS, fit, identify_language, presence


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in identify_language(docs).collect()}
    right = total = 0
    for r in docs.collect():
        p = got[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= p.score <= 1
        if p.held_out and p.lang_pred != "und":
            total += 1
            right += p.lang_pred == r.lang
    assert total > 150 and right / total > 0.95


def grams(text, n):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def test_presence_counts_distinct_grams():
    texts = ["Abc, abc! ÄÖ ßx", "", "123 456", "a", "日本語 text"]
    bits, has = presence(texts)
    assert has.tolist() == [True, False, False, True, True]
    for n, x in zip(ORDERS, bits):
        for t, row in zip(texts, x):
            assert abs(int(row.sum()) - len(grams(t, n))) <= 1  # one hash clash at most


def test_weights_equal_the_kernel_form():
    """Scores from multiplied-out weights are those of the kernel expansion over landmarks."""
    texts = ["the cat sat on the mat", "the dog ran to the park", "le chat est sur la table", "le chien va dans le parc", "der hund lief", "die katze schlief"]
    labels = ["en", "en", "fr", "fr", "de", "de"]
    bits, _ = presence(texts)
    packed = [[np.packbits(x[i]).tobytes() for x in bits] for i in range(len(texts))]
    model = fit(packed, labels, landmarks=6, ridge=1e-6)
    out, _ = model.scores(texts)
    k = np.array([[sum(len(grams(a, n) & grams(b, n)) / math.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in ORDERS) for b in texts] for a in texts])
    goal = np.where(np.array(labels)[:, None] == np.array(model.languages), 1.0, -1.0)
    centre = np.eye(6) - 1 / 6
    alpha = np.linalg.solve(centre @ k @ centre + 6e-6 * np.eye(6), centre @ goal)
    want = centre @ k @ centre @ alpha + goal.mean(axis=0)
    assert np.abs(out - want).max() < 0.1
    assert model.predict(texts)[0] == labels


def test_odd_rows(spark, odd_docs):
    got = identify_language(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 13
    assert [by[i].lang_pred for i in (2, 3, 9, 10)] == ["und"] * 4 and by[2].score == 0.0
    assert by[0].lang_pred in ("en", "de", "fr") and by[None].held_out is False


def test_nothing_to_learn_from(spark, odd_docs):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in identify_language(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_language(odd_docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_count_once(spark):
    rows = [(i % 3, f"the cat {i} sat", "en") for i in range(60)] + [(100 + i, f"le chat {i} est la", "fr") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang_pred for r in identify_language(docs, per_language=5).collect()}
    assert got == {"en", "fr"}
