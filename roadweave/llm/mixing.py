"""Mixing sources to target weights by Pareto order sampling [native].

Targets: sources, ordered by code point with null last, weigh 5, 2, 1 and so on
in turn and share ``budget`` times all words; no target passes ``max_repeat``
times its source's size, and what is cut off is shared again by weight.  The
shares that result have a closed form (capped water filling), found with one
window over the table of sources.

Expected copies: a document's weight is the bit length of its size (1 for one
word, 10 for 512 to 1023), so longer documents are asked for more often.  Of
weight w it is expected e = min(max_repeat, level * w) times, where the level of
the source makes the expected words add up to its target: water filling once
more, over the at most 64 weights of a source.

Sampling: ``floor(e)`` whole copies are certain.  One more copy has the inclusion
probability p = e - floor(e): documents are ranked by random odds divided by
inclusion odds, u/(1-u) / (p/(1-p)), and taken in this order as long as their
words stay within what is left of the target.  Then up to ``fills`` further
documents close the gap, each the largest that fits and the last the one nearest
to it.  The size of the sample is thus fixed in words, not left to chance.

Cases: a null or blank text has size 0 and is taken 0 words; a source without
words has target 0; a null source is a source of its own (last); repeated rows
are documents of their own (their ranks differ by a running number); an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard_since, made, materialize

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 5_000


def source_targets(
    sized: DataFrame, budget: float = 1.5, max_repeat: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)
) -> DataFrame:
    """(source, source_size, weight, target), one row per source.

    target = min(cap, level * weight), where the level makes the targets add up
    to the budget.  With sources in order of cap/weight, the first k are capped
    for the smallest k at which (budget - their caps) / (other weights) is not
    above the next cap/weight.  The windows run over one row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1))
    w = w.withColumn("cap", F.lit(max_repeat) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "*",
        (F.lit(budget) * F.sum("source_size").over(everything)).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(rising), F.lit(0.0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(rising), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))
    w = w.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level")))).over(everything)["level"])
    return w.select(
        "source",
        "source_size",
        "weight",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"),
    )


def expected_copies(sized: DataFrame, targets: DataFrame, max_repeat: float) -> DataFrame:
    """(of, weight_of, source_size, target, whole, p, rest, slices, middle), one row per source and weight of documents.

    ``whole`` copies and one more with probability ``p`` for a document of this
    weight; ``rest``: words of the source's target beyond its whole copies;
    ``slices`` and ``middle``: into how many tasks the source's ranks are dealt,
    and about where their middle is.  All windows run over at most 64 rows of a
    source, summed on the map side before.
    """
    by = sized.groupBy("source", "weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    by = by.select(F.col("source").alias("of"), F.col("weight").alias("weight_of"), "words", "docs")
    t = by.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    heavier = Window.partitionBy("of").orderBy(F.col("weight_of").desc()).rowsBetween(Window.unboundedPreceding, -1)
    not_lighter = Window.partitionBy("of").orderBy("weight_of").rowsBetween(Window.unboundedPreceding, 0)
    whole_source = Window.partitionBy("of")
    # the level if all heavier documents are at their most, and this and all lighter ones below
    level = F.try_divide(
        F.col("target") - F.lit(max_repeat) * F.coalesce(F.sum("words").over(heavier), F.lit(0)),
        F.sum(F.col("words") * F.col("weight_of")).over(not_lighter),
    )
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("weight_of") <= max_repeat, F.struct("weight_of", "level"))).over(whole_source)["level"])
    e = F.when(F.col("level").isNull(), F.lit(max_repeat)).otherwise(F.least(F.lit(max_repeat), F.col("level") * F.col("weight_of")))
    t = t.withColumn("e", F.when(F.col("words") > 0, e).otherwise(F.lit(0.0)))
    t = t.withColumn("whole", F.floor(F.col("e") + F.lit(1e-9)))
    p = F.col("e") - F.col("whole")
    t = t.withColumn("p", F.when(p > 1e-9, p))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source)
    middle = F.sum(F.col("docs") * (1 - F.col("p"))).over(whole_source) / F.sum(F.col("docs") * F.col("p")).over(whole_source)
    return t.select(
        "of", "weight_of", "source_size", "target", "whole", "p", rest.alias("rest"),
        (1 + F.floor(F.sum("docs").over(whole_source) / SLICE)).alias("slices"), F.coalesce(middle, F.lit(1.0)).alias("middle"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float = 1.5,
    max_repeat: float = 2.0,
    weights: tuple[int, ...] = (5, 2, 1),
    seed: int = 17,
    fills: int = 8,
) -> DataFrame:
    """(doc_id, source, size, weight, source_size, target, p, odds, copies, taken, nth, of_text) per document.

    The running sum of words along the ranks is taken in two steps: totals of
    intervals of the rank (summed on the map side, some ``SLICE`` documents
    each) and, inside one interval, a window.  A source with a third of all
    rows is therefore dealt over as many tasks as its size asks for.  Reruns
    agree: the random number is a hash of the id, the source, the text and a
    running number of equal rows.  What is joined to documents by source is a
    written table with a few rows for each source.
    """
    mark = made()
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("of_text"),
    )
    sized = sized.withColumn("weight", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    sized = materialize(sized, "sizes")
    targets = source_targets(sized, budget, max_repeat, weights).select("source", "source_size", "target")
    plan = materialize(expected_copies(sized, targets, max_repeat), "copies")
    # equal rows are told apart by a number; they are summed before, so no sort sees a large group of them
    alike = sized.groupBy("doc_id", "source", "of_text", "size", "weight").agg(F.count(F.lit(1)).alias("n"))
    rows = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("weight_of"))).drop("of", "weight_of")
    # 52 bits of a hash, strictly between 0 and 1
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), shown("doc_id"), shown("source"), "of_text", F.col("nth").cast("string")))
    rows = rows.withColumn("u", (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52))
    rows = rows.withColumn("odds", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    # odds are null for documents without a chance of one more copy; those only need any slice of their own
    anywhere = -1 - F.pmod(F.xxhash64("doc_id", "of_text", "nth"), F.col("slices"))
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("odds") / (F.col("odds") + F.col("middle")) * F.col("slices")), anywhere))
    is_open = F.col("odds").isNotNull() & (F.col("size") > 0)
    rows = materialize(rows, "odds")
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.filter(is_open).groupBy(F.col("source").alias("of"), F.col("slice").alias("at")).agg(F.sum("size").alias("words"))
        .select("of", "at", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    )
    sums = materialize(sums, "slices")
    inside = Window.partitionBy("source", "slice").orderBy("odds", F.col("doc_id").asc_nulls_first(), "of_text", "nth").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("upto", F.sum(F.when(is_open, F.col("size"))).over(inside))
    ranked = ranked.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")), "left").drop("of", "at")
    ranked = ranked.withColumn("extra", is_open & (F.col("before") + F.col("upto") <= F.col("rest")))
    ranked = materialize(ranked.drop("u", "slice", "slices", "middle", "before", "upto"), "ranked")
    discard_since(docs.sparkSession, mark, ranked)
    gaps = ranked.groupBy(F.col("source").alias("of")).agg(
        (F.first("rest") - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).alias("gap")
    )
    row = F.struct("odds", "doc_id", "of_text", "nth", "size")
    gaps, filled, some, last = materialize(gaps, "gaps"), [], True, False
    while not last:
        last = len(filled) >= fills - 1 or not some  # nothing fits any more
        fill = f"fill{len(filled)}"
        now = F.abs(F.col("gap") - F.col("size"))
        free = ranked.filter(is_open & ~F.col("extra")).join(gaps, F.col("source").eqNullSafe(F.col("of")))
        for f in filled:
            free = free.filter(~row.eqNullSafe(F.col(f)))
        # one row per source, minima on the map side
        fits = F.lit(True) if last else F.col("size") <= F.col("gap")
        best = free.filter(fits & (now < F.col("gap"))).groupBy(F.col("of").alias("for")).agg(F.min(F.struct(now.alias("d"), row.alias("row")))["row"].alias(fill))
        gaps = gaps.join(best, F.col("of").eqNullSafe(F.col("for")), "left").drop("for")
        gaps = materialize(gaps.withColumn("gap", F.col("gap") - F.coalesce(F.col(f"{fill}.size"), F.lit(0))), "gaps")
        some = gaps.filter(F.col(fill).isNotNull()).limit(1).count() > 0
        filled.append(fill)
    discard_since(docs.sparkSession, mark, ranked, gaps)
    gaps = gaps.drop("gap")
    ranked = ranked.join(gaps, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    more = F.col("extra")
    for f in filled:
        more = more | (is_open & row.eqNullSafe(F.col(f)))
    copies = (F.col("whole") + more.cast("long")).cast("int")
    return ranked.withColumn("copies", copies).select(
        "doc_id", "source", "size", "weight", "source_size", "target", "p", "odds", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "nth", "of_text"
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, with all its columns, whatever their names."""
    mark = made()
    copies = mix_sources(docs, id_col, text_col, source_col, **more).filter("copies > 0").select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("of_text").alias("h"), F.col("nth").alias("m"), "copies"
    )
    copies = materialize(copies, "copies")
    discard_since(docs.sparkSession, mark, copies)
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("of_text"),
    )
    same = Window.partitionBy("id", "source", "of_text").orderBy(F.lit(0))
    keyed = keyed.withColumn("nth", F.row_number().over(same))
    on = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("of_text") == F.col("h")) & (F.col("nth") == F.col("m"))
    out = keyed.join(copies, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
