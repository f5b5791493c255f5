"""URL filters by path-template trees.

Explicit rules decide first. Their verdicts are also labels: each host's paths form a tree whose variable segments
(numbers, hexadecimal keys, values that hardly recur) become wildcards and whose branches with statistically equal
shares of bad pages are merged. A page that no rule fits is judged by its deepest template with enough labelled
pages, or else by coarser evidence: the whole host, the same path over all hosts of the domain, its first segment
there, the whole domain. It is blocked if the smoothed share of bad pages there is high.

Everything is DataFrame expressions. The trees are built over counts by host and generalised path, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import ascii_lower, materialize

#: Rules as (verdict, host and path prefix); the longest that fits decides.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Share of its parent's pages from which a segment stays as it is, labelled pages that a template needs,
#: weight of the overall share of bad pages in a template's share, share from which it is blocked, and the
#: normal quantile up to which two branches count as equal.
LITERAL, LABELLED, PRIOR, CUT, EQUAL = 0.01, 20, 5.0, 0.9, 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A struct of the longest fitting rule's ``rule`` and ``verdict``; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for verdict, rule in ordered:
        of_host, slash, prefix = rule.partition("/")
        inside = (host == of_host) | host.endswith("." + of_host)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(inside & path.startswith(slash + prefix), found))
    return F.coalesce(*fits)


def generalise(path: Column) -> Column:
    """The path's segments; segments that are variable by form are wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), "<number>")
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "<key>")
        .otherwise(s),
    )


def _grow(shapes: DataFrame, level: int, literal: float, labelled: int, equal: float) -> DataFrame:
    """Replace each shape's ``prefix`` by its node on this level and add the node's counts."""
    shapes = shapes.withColumn("segment", F.get("segments", F.lit(level)))
    on = ["host", "prefix"]
    kids = shapes.where("segment is not null").groupBy(*on, "segment").agg(
        F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad")
    )
    kids = kids.join(kids.groupBy(*on).agg(F.sum("n").alias("all")), on)
    by_form = F.col("segment").startswith("<")
    kids = kids.withColumn("node", F.when(by_form | (F.col("seen") >= labelled) | (F.col("n") >= literal * F.col("all")), F.col("segment")).otherwise("*"))
    # siblings in the order of their share of bad pages; a clear step up begins another branch
    nodes = kids.groupBy(*on, "node").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    known = nodes.where((F.col("seen") >= labelled) & (F.col("node") != "*") & ~F.col("node").startswith("<"))
    known = known.withColumn("share", F.col("bad") / F.col("seen"))
    order = Window.partitionBy(*on).orderBy("share", "node")
    pooled = (F.col("bad") + F.lag("bad").over(order)) / (F.col("seen") + F.lag("seen").over(order))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("seen") + 1 / F.lag("seen").over(order)))
    step = F.coalesce((F.col("share") - F.lag("share").over(order) > equal * error).cast("int"), F.lit(1))
    known = known.withColumn("step", step).withColumn("branch", F.sum("step").over(order))
    merged = known.groupBy(*on, "branch").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    merged = merged.where(F.size("nodes") > 1)
    merged = merged.select(*on, F.explode("nodes").alias("node"), F.concat(F.lit("("), F.array_join("nodes", "|"), F.lit(")")).alias("as"))
    kids = kids.join(merged, [*on, "node"], "left").select(*on, "segment", F.coalesce("as", "node").alias("node"))
    shapes = shapes.join(kids, [*on, "segment"], "left")
    ended = F.col("node").isNull()
    shapes = shapes.withColumn("prefix", F.when(ended, F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "node")))
    counts = shapes.where(~ended).groupBy(*on).agg(F.sum("seen").alias("node_seen"), F.sum("bad").alias("node_bad"))
    shapes = shapes.join(counts, on, "left")
    better = ~ended & (F.col("node_seen") >= labelled)
    for column, now in (("template", F.col("prefix")), ("t_seen", F.col("node_seen")), ("t_bad", F.col("node_bad"))):
        shapes = shapes.withColumn(column, F.when(better, now).otherwise(F.col(column)))
    # below a node with fewer labelled pages none has enough
    shapes = shapes.withColumn("open", better & (F.size("segments") > level + 1))
    return materialize(shapes.drop("segment", "node", "node_seen", "node_bad"), f"templates-{level}")


def _back_off(shapes: DataFrame, labelled: int) -> DataFrame:
    """Evidence for the shapes without a template, from the finest of the coarser groups with enough labelled pages."""
    labels = F.split("host", "[.]")
    # the last two labels; a host of fewer has no domain that others share
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    shapes = shapes.withColumn("domain", domain).withColumn("whole", F.xxhash64("segments")).withColumn("top", F.get("segments", F.lit(0)))
    of_domain = F.concat(F.lit("*."), F.col("domain"), F.lit("/"))
    levels = (
        (["host"], F.lit("/")),
        (["domain", "whole"], F.concat(of_domain, F.array_join("segments", "/"))),
        (["domain", "top"], F.concat(of_domain, F.col("top"))),
        (["domain"], of_domain),
    )
    for on, name in levels:
        counts = shapes.groupBy(*on).agg(F.sum("seen").alias("c_seen"), F.sum("bad").alias("c_bad")).where(F.col("c_seen") >= labelled)
        shapes = shapes.join(counts, on, "left")
        use = F.col("template").isNull() & F.col("c_seen").isNotNull()
        for column, now in (("t_seen", F.col("c_seen")), ("t_bad", F.col("c_bad")), ("template", name)):
            shapes = shapes.withColumn(column, F.when(use, now).otherwise(F.col(column)))
        shapes = shapes.drop("c_seen", "c_bad")
    return materialize(shapes.drop("domain", "whole", "top"), "templates-coarse")


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    literal: float = LITERAL,
    labelled: int = LABELLED,
    prior: float = PRIOR,
    cut: float = CUT,
    equal: float = EQUAL,
) -> DataFrame:
    """A verdict for every row of ``pages``.

    Columns: ``page_id``; ``host``; ``path``; ``rule`` (null if none fits); ``verdict`` (``allow`` or ``block``);
    ``template`` (the host's deepest template above the page with at least ``labelled`` labelled pages; else ``/`` for
    the host or ``*.domain/...`` for the hosts of its domain, if those have as many; else null);
    ``purity`` (1 less its smoothed share of bad pages, else null). Null urls and urls without ``://`` have an
    empty host and path, fit no rule, and are allowed unless their template is not. Repeated rows get equal
    results and count each; an empty table gives no rows. Only the two named columns are read.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("segments", generalise(F.col("path")))
    bad = (F.col("found.verdict") == "block").cast("long")
    shapes = rows.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("found").alias("seen"), F.coalesce(F.sum(bad), F.lit(0).cast("long")).alias("bad")
    )
    shapes = shapes.select(
        "*",
        F.lit("").alias("prefix"),
        F.lit(None).cast("string").alias("template"),
        F.lit(None).cast("long").alias("t_seen"),
        F.lit(None).cast("long").alias("t_bad"),
    )
    shapes = materialize(shapes, "url-shapes")
    overall = shapes.agg((F.sum("bad") / F.nullif(F.sum("seen"), F.lit(0))).alias("share")).first()["share"] or 0.0
    level, more = 0, True
    while more:
        shapes = _grow(shapes, level, literal, labelled, equal)
        more = bool(shapes.where("open").limit(1).count())
        level += 1
    shapes = _back_off(shapes.drop("open"), labelled)
    share = (F.col("t_bad") + prior * overall) / (F.col("t_seen") + prior)
    templates = shapes.select("host", "segments", "template", share.alias("share"))
    judged = rows.join(templates, ["host", "segments"], "left")
    by_template = F.when(F.col("share") >= cut, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_template).alias("verdict"),
        "template",
        (1 - F.col("share")).alias("purity"),
    )
