"""URL filtering: rules, then a path-template tree judged by smoothed labelled purity.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. A null url, or one without ``://``, has an empty host and path. A rule (verdict, host, path) fits its host
and all subdomains where the path starts with the rule's; the longest fitting rule wins (host and path together, then
the longer path, then the greater text).

The tree holds, per host, the paths' segments. Level by level, a segment stays literal only if it holds at least
``MIN_ROWS`` rows, however many its node has; all others become the wildcard ``*``. A literal branch whose blocked share
does not differ from its siblings' (chi-square under ``CHI``) is merged into the wildcard as well. Where the branch or
all its siblings hold no labelled row there is no such test, and so nothing that makes them alike: the branch stays
literal. A node of fewer than ``MIN_ROWS`` rows is not split; what is left of its paths is ``**``. A node of one path
takes it whole, so levels end where no node has ``MIN_ROWS`` rows and two paths. A segment that reads ``*`` or ``**`` is
written with ``%2A``. Urls that a rule judged are the labelled ones. A template's purity is its blocked share smoothed
towards the parent's with ``PRIOR`` rows: host template, host, all hosts, one half. Purity of at least ``REJECT`` blocks.

Everything is counted per (host, path) first, so a host with a third of all rows is summed on the map side. Empty
tables give empty results; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_ROWS, CHI, PRIOR, REJECT = 20, 3.84, 10.0, 0.5
MORE = "**"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. The list is a parameter, so its size is the caller's."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def templates(counts: DataFrame) -> DataFrame:
    """From (host, path, n, blocked, labelled): the same with the template of each path."""
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    segment = F.when(F.col("rest")[0].isin("*", MORE), F.replace(F.col("rest")[0], F.lit("*"), F.lit("%2A"))).otherwise(F.col("rest")[0])
    rest = F.split(F.regexp_replace("path", "^/", ""), "/")
    tree, done = counts.select("*", rest.alias("rest"), F.lit("").alias("template")), []  # each segment with a slash before it
    while True:
        nodes = tree.groupBy("host", "template").agg(*[F.sum(c).alias(f"node_{c}") for c in ("n", "blocked", "labelled")], F.count("*").alias("paths"))
        branches = tree.groupBy("host", "template", segment.alias("s")).agg(*sums).join(nodes, ["host", "template"])
        rest_labelled, rest_blocked = F.col("node_labelled") - F.col("labelled"), F.col("node_blocked") - F.col("blocked")
        share = F.try_divide("node_blocked", "node_labelled")
        spread = F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_labelled)
        gap = F.try_divide("blocked", "labelled") - F.try_divide(rest_blocked, rest_labelled)
        chi = F.coalesce(F.try_divide(gap * gap, share * (1 - share) * spread), F.lit(0.0))  # all labelled rows agree: alike
        untested = (F.col("labelled") == 0) | (rest_labelled == 0)
        literal = branches.where((F.col("n") >= MIN_ROWS) & (untested | (chi >= CHI))).select("host", "template", "s", F.lit(True).alias("literal"))
        closed = nodes.select("host", "template", F.when(F.col("node_n") < MIN_ROWS, MORE).when(F.col("paths") == 1, "whole").alias("closed"))
        placed = tree.withColumn("s", segment).join(closed, ["host", "template"]).join(literal, ["host", "template", "s"], "left")
        whole = F.array_join(F.transform("rest", lambda x: F.when(x.isin("*", MORE), F.replace(x, F.lit("*"), F.lit("%2A"))).otherwise(x)), "/")
        step = F.when(F.col("closed") == MORE, MORE).when(F.col("closed") == "whole", whole).when(F.col("literal"), F.col("s")).otherwise("*")
        left = F.when(F.col("closed").isNull(), F.slice("rest", 2, F.size("rest")))  # null: nothing more to place
        placed = common.materialize(placed.select(*counts.columns, left.alias("rest"), F.concat("template", F.lit("/"), step).alias("template")), "level")
        more = F.coalesce(F.size("rest") > 0, F.lit(False))
        done.append(placed.where(~more).select(*counts.columns, F.substr("template", F.lit(2)).alias("template")))
        tree = placed.where(more)
        if tree.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id", url: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict, template and purity of each row's url."""
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{id_column}`").alias(id_column), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select(id_column, "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))
    counts = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("ruled").alias("labelled"))
    tree = common.materialize(templates(common.materialize(counts, "paths")), "templates")
    everything = tree.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = ((everything["b"] or 0) + PRIOR / 2) / ((everything["l"] or 0) + PRIOR)
    smooth = lambda prior: (F.sum("blocked") + PRIOR * prior) / (F.sum("labelled") + PRIOR)
    hosts = tree.groupBy("host").agg(smooth(F.lit(overall)).alias("host_purity"))
    leaves = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    leaves = leaves.join(hosts, "host").withColumn("purity", (F.col("blocked") + PRIOR * F.col("host_purity")) / (F.col("labelled") + PRIOR))
    verdicts = tree.select("host", "path", "template").join(leaves.select("host", "template", "purity"), ["host", "template"])
    return rows.join(verdicts, ["host", "path"]).select(
        id_column, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )
