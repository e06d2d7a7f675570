"""URL verdicts by rules and, where no rule fits, by a tree of path templates per host.

Paths of each host form a tree of segments. Segments that are plainly variable
(numbers, hexadecimal ids) become wildcards, and so do all segments at a place
where a host shows very many values. Branches of one node whose labels do not
differ significantly from the node's are merged into a wildcard, and where all
labelled branches are alike, those without labels as well. The urls that a rule
decides are the labels; a template is rejected if its share of blocked
labels, smoothed towards one half, is high, so it takes evidence to block.

Everything is built from joins and aggregations of distinct shapes of paths; a
host with most of the pages is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.session import stage

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    """Fits a host and its subdomains where the path starts with the rule's path."""

    verdict: str
    host: str
    path: str


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z in lower case. Path: then up to '?', '#' or the end.

    Both are empty for a null url and for one without '://'.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as host and path in one string; null if none fits. For up to some hundred rules."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.host + r.path)) for r in order]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def shape(path: Column, depth: int | None = None) -> Column:
    """The segments of a path with plainly variable parts as wildcards; of more than `depth` the first, and a mark for what lies deeper."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(
        segments if depth is None else F.slice(segments, 1, depth),
        lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)^(?=[^.]*\d)[0-9a-f-]{8,}+(?=\.|$)", "{id}"), r"^\d+(?=\.|$)", "{n}"),
    )
    return general if depth is None else F.when(F.size(segments) > depth, F.concat(general, F.array(F.lit("**")))).otherwise(general)


def templates(shapes: DataFrame, most_values: int, least_per_value: int, z: float) -> DataFrame:
    """shapes (host, shape, n, labels, blocked) to the same with the column template.

    Level by level below each (host, template so far), down to the last
    segment: where more than most_values values share less than
    least_per_value urls each on average, all become '*'; elsewhere a labelled
    branch becomes '*' if its share of blocked labels is within z standard
    errors of that of all branches. Unlabelled branches join them where two
    labelled branches or more are all alike; beside a single one, or ones that
    differ, they stay as they are: nothing says whom they are like. A shape
    that is alone below its node keeps the rest of its segments.
    """
    found, left, level = None, shapes.withColumn("template", F.array().cast("array<string>")), 0
    while True:
        here = left.withColumn("segment", F.get("shape", F.lit(level)))
        branch = here.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labels", "blocked")], F.count("*").alias("shapes"))
        branch = stage(branch, "branches")
        if branch.isEmpty():
            return left if found is None else found.unionByName(left)
        node = branch.groupBy("host", "template").agg(F.count("*").alias("values"), F.sum("n").alias("urls"), F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"), (F.sum("shapes") == 1).alias("alone"))
        node = node.withColumn("rate", F.when(F.col("all_labels") > 0, F.col("all_blocked") / F.col("all_labels")))
        variable = (F.col("values") > most_values) & (F.col("urls") < F.col("values") * least_per_value)
        # The half label on either side keeps the error above zero where all labels agree.
        error = F.sqrt((F.col("all_blocked") + 0.5) * (F.col("all_labels") - F.col("all_blocked") + 0.5) / (F.col("all_labels") + 1) / (F.col("all_labels") + 1) / F.col("labels"))
        alike = (F.col("labels") > 0) & (F.abs(F.col("blocked") / F.greatest("labels", F.lit(1)) - F.col("rate")) <= z * error) & (F.col("values") > 1)
        tested = branch.select("host", "template", "segment", "labels", "blocked").join(node, ["host", "template"])
        tested = tested.select("host", "template", "segment", "labels", "alone", variable.alias("variable"), F.coalesce(alike, F.lit(False)).alias("alike"))
        agreed = tested.filter("labels > 0").groupBy("host", "template").agg(((F.count("*") > 1) & F.bool_and("alike")).alias("agreed"))
        tested = tested.join(agreed, ["host", "template"], "left")
        joins = F.col("variable") | F.col("alike") | ((F.col("labels") == 0) & F.coalesce("agreed", F.lit(False)))
        chosen = tested.select("host", "template", "segment", "alone", F.when(joins, F.lit("*")).otherwise(F.col("segment")).alias("chosen"))
        joined = here.join(chosen, ["host", "template", "segment"], "left")
        rest = F.slice("shape", F.lit(level + 1), F.size("shape"))
        grown = F.when(F.col("chosen").isNull(), F.col("template")).when(F.col("alone"), F.concat("template", rest)).otherwise(F.concat("template", F.array("chosen")))
        grown = stage(joined.select(*shapes.columns, grown.alias("template"), (F.col("chosen").isNotNull() & ~F.col("alone")).alias("open")), "templates")
        ended = grown.filter("NOT open").drop("open")
        found = ended if found is None else found.unionByName(ended)
        left, level = grown.filter("open").drop("open"), level + 1


def judge(
    pages: DataFrame,
    rules: list[Rule],
    url: str = "url",
    depth: int | None = None,
    most_values: int = 24,
    least_per_value: int = 4,
    z: float = 1.96,
    strength: float = 4.0,
    reject: float = 0.7,
) -> DataFrame:
    """Adds host, path, rule, template, purity and verdict to every page.

    rule: the longest that fits, or null. verdict: that of the rule; else block
    if the purity of the url's template, (blocked + strength / 2) /
    (labels + strength), reaches `reject`. `depth` bounds the levels of the tree;
    without it they reach as deep as the paths. A null url, or one without '://', has an empty host and path, which form a host of
    their own. Columns with the new names are replaced; all others pass through.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict")
    kept = pages.drop(*(c for c in new if c != url))
    host, path = host_and_path(url)
    parsed = kept.withColumns({"host": host, "path": path})
    parsed = parsed.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "_shape": shape(F.col("path"), depth)})
    verdicts = {r.host + r.path: r.verdict for r in rules}
    by_rule = F.coalesce(*[F.when(F.col("rule") == name, F.lit(v)) for name, v in verdicts.items()], F.lit(None).cast("string"))
    parsed = parsed.withColumn("verdict", by_rule)

    label, hit = F.col("verdict").isNotNull().cast("int"), (F.col("verdict") == BLOCK).cast("int")
    shapes = parsed.groupBy("host", F.col("_shape").alias("shape")).agg(F.count("*").alias("n"), F.sum(label).alias("labels"), F.sum(F.coalesce(hit, F.lit(0))).alias("blocked"))
    shapes = stage(shapes, "shapes")

    tree = templates(shapes, most_values, least_per_value, z)
    purity = (F.col("blocked") + strength / 2) / (F.col("labels") + strength)
    pure = tree.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked")).select("host", "template", purity.alias("purity"))
    by_shape = tree.join(pure, ["host", "template"]).select(F.col("host").alias("_host"), F.col("shape").alias("_of"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
    found = parsed.join(by_shape, (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("_of")), "left")
    learned = F.when(F.col("purity") >= reject, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return found.withColumn("verdict", F.coalesce("verdict", learned)).select(*kept.columns, *[c for c in new if c != url or c not in kept.columns])
