"""Host-level quality rules with an empirical beta prior [native].

Each document gets base measures from whole-text SQL expressions; a document
that breaks a base rule fails.  Failures are summed by host (for documents: the
``source``), the hosts' failure rates are shrunk with a beta prior fitted to all
hosts by the method of moments, and a host whose shrunk rate is above
``max_host_failure`` is rejected with all its documents.

Cases: a null text counts as empty (no words, so it fails); a null host is a
host of its own; repeated rows are judged row by row and each counts for its
host; an empty table gives an empty result.  Extra columns of the input never
reach the plan, so names like ``n_words`` in the input do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

WORD = r"[^\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8


def _repeat_words(ranked: Column) -> Column:
    """Words covered by windows that occur twice or more.

    ``ranked`` is the sorted array of (window hash, position): equal windows are
    neighbours, so a sort in place of a hash table keeps this O(n log n) for
    any text, however long or repetitive.
    """
    twins = F.filter(
        ranked,
        lambda s, i: F.coalesce(F.get(ranked, i + 1)["h"] == s["h"], F.lit(False))
        | F.coalesce(F.get(ranked, i - 1)["h"] == s["h"], F.lit(False)),
    )
    at = F.array_sort(F.transform(twins, lambda s: s["p"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        at,
        zero,
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"].cast("long"),
    )


def base_measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"))
    b = a.select(
        "doc_id",
        "host",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.regexp_replace("t", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    c = b.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    h = F.col("h")
    d = c.withColumn(
        "win",
        F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        ),
    ).drop("h")
    twice = F.size(F.array_distinct("win")) < F.size("win")
    e = d.withColumn(
        "ranked",
        F.when(twice, F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))),
    )
    measured = F.when(F.col("ranked").isNull(), F.lit(0).cast("long")).otherwise(
        _repeat_words(F.col("ranked"))
    )
    return e.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", measured.alias("n_repeat_words")
    )


def host_verdicts(measured: DataFrame, max_host_failure: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_rejected), one row per host.

    Beta(a, b) prior: mean m and variance v of the hosts' rates; a + b =
    m (1 - m) / v - 1, held in [1, 1000].  The sums by host combine on the map
    side, so a host with a third of all rows costs one row per task.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    prior = prior.select(
        F.struct(
            "m",
            F.least(
                F.lit(1000.0),
                F.greatest(F.lit(1.0), F.coalesce(F.try_divide(spread, F.col("v")) - 1, F.lit(1000.0))),
            ).alias("s"),
        ).alias("prior")
    )
    return (
        hosts.withColumn("prior", prior.scalar())
        .withColumn(
            "shrunk_rate",
            (F.col("n_failed") + F.col("prior.m") * F.col("prior.s")) / (F.col("n_docs") + F.col("prior.s")),
        )
        .withColumn("host_rejected", F.col("shrunk_rate") > max_host_failure)
        .drop("prior")
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_host_failure: float = 0.5,
) -> DataFrame:
    """Base measures, base verdict, host verdict and final verdict per document.

    The measures are written once (a few numbers a document) because both the
    sums by host and the join back need them; texts are read once and never
    shuffled.  The hosts are written before they are joined back: a small table
    of them is broadcast, and with a large one AQE can split a common host.
    """
    measured = base_measures(docs, id_col, text_col, host_col).withColumn(
        "base_failed",
        (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    measured = materialize(measured, "quality")
    hosts = materialize(
        host_verdicts(measured, max_host_failure).select(F.col("host").alias("of"), "shrunk_rate", "host_rejected"), "hosts"
    )
    return (
        measured.join(hosts, F.col("host").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep_by_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Rows are written once with their measures; behind that only the small table of hosts is joined to them.
    """
    slim = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t"), F.col(host_col).alias("s"))
    kept = quality_rules(slim, "row", "t", "s", **rules).filter("kept").select("doc_id")
    return kept.select(*[F.col("doc_id")[c].alias(c) for c in docs.columns])
