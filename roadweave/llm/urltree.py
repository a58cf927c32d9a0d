"""URL filters: rules first, then a tree of path templates for each host.

Rules are (host, path, verdict).  One fits its host and all subdomains if the
url's path starts with the rule's path; of several the longest wins.

What no rule decides is judged by the template tree:

1. Urls are summed to distinct (host, path) with counts of allow and block labels
   (those that the rules give), so copies of a url cost one row.
2. Level by level, a path segment stays as it is or becomes ``*``: segments that
   look like numbers, dates, hashes or slugs with digits are variable; others stay
   if they are frequent below their parent (``min_share``) or if the parent has few
   different children (``max_children``).  Levels below ``max_depth`` are ``**``.
3. Siblings (literal segments below one parent) whose subtrees have the same main
   shapes (those of a tenth of their urls or more) are compared: a branch is alike
   if its counts of shapes do not differ from the pooled ones of these siblings
   (chi-squared below its mean by ``merge_z`` deviations).  Alike branches are merged
   and share their labels, branches without labels among them; a branch whose own
   block rate differs from the pooled rate (two-sided z of ``merge_z``) stays alone.
4. Purity is smoothed from the host down: each branch on the way to a template adds
   the labels that it (or its merged branch) has beyond the next one on the way, so
   none counts twice, to its parent's purity, taken as ``strength`` labels; above the
   host there is the prior.  A template is rejected if its purity reaches ``purity``.
   A host without labels keeps the prior.

All steps are DataFrame aggregates and equi-joins on what is left of the urls: a
host with a third of all rows is spread by path and segment, never one group.

Cases: a null url or one without ``://`` has empty host and path and is allowed
unless a rule says otherwise; repeated rows and null ids are judged row by row; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

Rule = tuple[str, str, str]
VARIABLE = (
    r"^(\d[\d._-]*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|(?=[^.]*\d)[\w%-]{5,})(\.[A-Za-z]{1,5})?$"
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; meant for lists of up to some hundred rules."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def path_templates(
    paths: DataFrame, max_depth: int = 6, max_children: int = 12, min_share: float = 0.02, min_rows: int = 30
) -> DataFrame:
    """(host, path, template): ``paths`` has distinct host and path, and n rows of each."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = paths.select("host", "path", "n", parts.alias("parts"), F.lit("").alias("template"))
    for level in range(max_depth):
        seg = F.get("parts", F.lit(level))
        rows = rows.withColumn("seg", F.when(seg.rlike(VARIABLE), F.lit("*")).otherwise(seg))
        nodes = rows.filter("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("rows_n"))
        parents = nodes.groupBy("host", "template").agg(F.sum("rows_n").alias("all_n"), F.count(F.lit(1)).alias("children"))
        keep = (
            nodes.join(parents, ["host", "template"])
            .filter((F.col("children") <= max_children) | ((F.col("rows_n") >= min_rows) & (F.col("rows_n") >= min_share * F.col("all_n"))))
            .select("host", "template", "seg", F.lit(True).alias("literal"))
        )
        # a written table, so AQE can split a host with one first folder
        rows = rows.join(materialize(keep, "literals"), ["host", "template", "seg"], "left")
        step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.when(F.col("literal"), F.col("seg")).otherwise(F.lit("*"))))
        rows = materialize(rows.withColumn("template", F.concat("template", step)).drop("seg", "literal"), f"level{level}")
    deep = F.when(F.size("parts") > max_depth, F.lit("/**")).otherwise(F.lit(""))
    return rows.select("host", "path", F.concat("template", deep).alias("template"))


def tree_purity(labelled: DataFrame, merge_z: float = 1.96, prior: float = 0.5, strength: float = 2.0, main: float = 0.1) -> DataFrame:
    """(host, template, branch, purity): ``labelled`` has host, template and sums of n, allow and block.

    ``branch`` is the template with ``+`` for each segment that is merged with
    siblings.  A template is a row for each of its levels; all sums are over
    these rows, which are as many as templates, not urls.
    """
    parts = F.split("template", "/")
    rows = labelled.select("host", "template", "n", "allow", "block", parts.alias("parts"), F.posexplode(parts).alias("level", "seg"))
    rows = rows.select(
        "host", "template", "n", "allow", "block", "level", "seg",
        F.when(F.col("level") > 0, F.concat_ws("/", F.slice("parts", F.lit(1), F.col("level")))).otherwise("").alias("parent"),
        F.concat_ws("/", F.slice("parts", F.col("level") + 2, F.greatest(F.size("parts") - F.col("level") - 1, F.lit(0)))).alias("below"),
    )
    rows = materialize(rows, "levels")
    at, sums = ["host", "level", "parent"], [F.sum(c).alias(c) for c in ("n", "allow", "block")]
    node = materialize(rows.groupBy(*at, "seg").agg(*sums), "nodes")
    literal = (F.col("level") > 0) & ~F.col("seg").isin("*", "**")
    shapes = rows.filter(literal).groupBy(*at, "seg", "below").agg(F.sum("n").alias("of_n"))
    shapes = materialize(shapes.join(node.select(*at, "seg", "n"), [*at, "seg"]), "shapes")
    profile = shapes.filter(F.col("of_n") >= main * F.col("n")).groupBy(*at, "seg").agg(F.concat_ws(" ", F.array_sort(F.collect_list("below"))).alias("profile"))
    shapes = materialize(shapes.join(profile, [*at, "seg"]), "profiles")
    pooled = shapes.groupBy(*at, "profile", "below").agg(F.sum("of_n").alias("pool_n"))
    whole = pooled.groupBy(*at, "profile").agg(F.sum("pool_n").alias("all_n"), (F.count(F.lit(1)) - 1).alias("df"))
    share = F.col("pool_n") / F.col("all_n")
    compared = shapes.join(pooled, [*at, "profile", "below"]).join(whole, [*at, "profile"])
    chi = compared.groupBy(*at, "seg", "profile", "n").agg(F.sum(F.col("of_n") * F.col("of_n") / share).alias("q"), F.first("df").alias("df"))
    alike = chi.filter(F.col("q") / F.col("n") - F.col("n") <= F.col("df") + merge_z * F.sqrt(2 * F.col("df")) + 1e-6).select(*at, "seg", "profile")
    alike = materialize(alike.join(node, [*at, "seg"]).withColumn("labels", F.col("allow") + F.col("block")), "alike")
    rates = alike.groupBy(*at, "profile").agg((F.sum("block") / F.nullif(F.sum("labels"), F.lit(0))).alias("rate"))
    tested = alike.join(rates, [*at, "profile"])
    apart = F.abs(F.col("block") / F.col("labels") - F.col("rate")) / F.sqrt(F.greatest(F.col("rate") * (1 - F.col("rate")), F.lit(1e-9)) / F.col("labels"))
    tested = materialize(tested.filter(F.when(F.col("labels") > 0, apart < merge_z).otherwise(True)).select(*at, "seg", "profile", "block", "labels"), "merged")
    groups = tested.groupBy(*at, "profile").agg(F.sum("block").alias("m_block"), F.sum("labels").alias("m_labels"), F.count(F.lit(1)).alias("members"))
    merged = tested.select(*at, "seg", "profile").join(groups.filter("members > 1"), [*at, "profile"]).drop("profile", "members")
    evidence = node.join(merged, [*at, "seg"], "left").select(
        *at, "seg", F.coalesce("m_block", "block").alias("e_block"), F.coalesce("m_labels", F.col("allow") + F.col("block")).alias("e_labels"),
        F.when(F.col("m_labels").isNotNull(), "+").otherwise(F.col("seg")).alias("shown"),
    )
    evidence = materialize(evidence, "evidence")
    way = rows.select("host", "template", *at[1:], "seg").join(evidence, [*at, "seg"])
    way = way.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "shown", "e_block", "e_labels"))).alias("way"))
    beyond = lambda c: lambda x, i: F.greatest(F.lit(0), x[c] - F.coalesce(F.get("way", i + 1)[c], F.lit(0)))
    own = F.transform("way", lambda x, i: F.struct(beyond("e_block")(x, i).alias("b"), beyond("e_labels")(x, i).alias("n")))
    smooth = F.aggregate(own, F.lit(prior), lambda p, x: (x["b"] + p * strength) / (x["n"] + strength))
    return way.select("host", "template", F.concat_ws("/", F.transform("way", lambda x: x["shown"])).alias("branch"), smooth.alias("purity"))


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    purity: float = 0.8,
    **tree,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, branch, purity), one row per row."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.col("by_rule.verdict").alias("given"))
    paths = materialize(
        rows.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("given") == "allow").alias("allow"),
            F.count_if(F.col("given") == "block").alias("block"),
        ),
        "paths",
    )
    templates = path_templates(paths.select("host", "path", "n"), **tree)
    labelled = paths.join(templates, ["host", "path"]).groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
    judged = materialize(tree_purity(labelled), "purities")
    # a written table: urls that are null, or one url that very many rows have, are one key
    judged = materialize(templates.join(judged, ["host", "template"]), "judged")
    out = rows.join(judged, ["host", "path"], "left")
    method = F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", "branch", "purity")
