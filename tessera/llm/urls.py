"""URL filtering with a path-template tree per host, in DataFrame operations only.

Segments of a path are the levels of the host's tree. Digits in a segment always vary, so a
segment is first reduced to its shape (each run of digits becomes one `#`). At each node a
segment stays a branch of its own if its labelled pages differ from those of its siblings
(two-proportion z), however small its share of the pages is; branches that are statistically
alike, and those with too few pages or labels to tell, merge into the wildcard `*`; branches that differ
from it but not from each other merge into one, named `{first+}`. Leaves are templates. A template's
purity is its share of good labelled pages, smoothed to its host's share and that to the
share of all; templates below LEAST_PURITY are rejected. Explicit rules go first.

The tree is built on counts by host and shape, so a hot host is pre-aggregated before any
shuffle by its name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import cluster

DEPTH = 8  # levels of the tree; what is deeper is one more segment
SUPPORT = 5  # pages that a branch needs
DIFFERENT = 1.96  # standard errors between a branch and its siblings
LEAST_LABELS = 10  # of a branch that may differ
SMOOTHING = 10.0  # labels that a parent's share counts for
LEAST_PURITY = 0.5
MOST_BROADCAST = 200_000  # shapes sent to every task; more are joined by a shuffle

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty where there is no ://."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last that fits stands
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def _merged(kept: DataFrame) -> DataFrame:
    """A name for each branch that is unlike the wildcard: its own, or one that it shares with siblings it is statistically like.

    Siblings meet by their share of bad pages on a scale on which shares vary alike (the arc sine of the
    root), cut into steps that two branches with the fewest labels can't be told apart within; one
    of the cuts is at the purity that rejects. Of these, a branch that the sum of its step can't be told from joins it.
    """
    share = F.col("bad") / F.col("labelled")
    step = F.floor((F.asin(F.sqrt(share)) - math.asin(math.sqrt(1 - LEAST_PURITY))) / (DIFFERENT * math.sqrt(1 / (2 * LEAST_LABELS))))
    placed = kept.withColumn("step", step)
    sums = placed.groupBy("host", "template", "step").agg(F.min("segment").alias("first"), F.count(F.lit(1)).alias("branches"), (F.sum("bad") / F.sum("labelled")).alias("all"))
    like = (F.abs(share - F.col("all")) < DIFFERENT * F.sqrt(F.col("all") * (1 - F.col("all")) / F.col("labelled"))) | (share == F.col("all"))
    name = F.when((F.col("branches") > 1) & like, F.concat(F.lit("{"), F.col("first"), F.lit("+}"))).otherwise(F.col("segment"))
    return placed.join(sums, ["host", "template", "step"]).select("host", "template", "segment", name.alias("name"))


def templates(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The template of each (host, shape). counts: host, shape, n pages, labelled, bad; a row a shape."""
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    segments = F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth), F.array(F.array_join(F.expr(f"slice(split(regexp_replace(shape, '^/', ''), '/'), {depth + 1}, 2147483647)"), "/"))))
    tree = cluster.cut(counts.withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(segments)).withColumn("template", F.lit("")))
    levels = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for i in range(levels):
        here = tree.withColumn("segment", F.get("segments", F.lit(i)))
        left = cluster.cut(here.filter("segment is not null").groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad"))))
        kept = left.limit(0)
        while True:  # what leaves the wildcard moves its share, so the others are tested again
            node = left.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")))
            share = F.col("all_bad") / F.col("all_labelled")
            z = F.abs(F.col("bad") / F.col("labelled") - share) / F.sqrt(share * (1 - share) / F.col("labelled"))
            own = (F.col("n") >= SUPPORT) & (F.col("labelled") >= LEAST_LABELS) & F.when((F.col("labelled") > 0) & (share > 0) & (share < 1), z >= DIFFERENT).otherwise(False)
            unlike = cluster.cut(left.join(node, ["host", "template"]).filter(own).select(left.columns))
            if not unlike.limit(1).count():
                break
            kept = kept.unionByName(unlike)
            left = cluster.cut(left.join(unlike, ["host", "template", "segment"], "left_anti"))
        tree = here.join(_merged(kept), ["host", "template", "segment"], "left").withColumn(
            "template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*"))))
        ).drop("segment", "name")
        tree = cluster.cut(tree)
    return tree.select("host", "shape", "template", "n", "labelled", "bad")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A verdict on each url.

    pages needs page_id and url; other columns are not read. labels needs page_id and bad
    (boolean; null is no label): the labelled pages. Returns a row a row: page_id, host, path,
    rule (null where none fits), verdict (the rule's, else block for a template whose purity is
    under LEAST_PURITY, else allow), template, purity. Null urls and urls without :// have an
    empty host and path, whose template is empty. Of labels that repeat an id, one bad one makes
    the page bad. An empty table gives an empty result; without labels all purities are 1.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parsed = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("shape", _shape(F.col("path")))
    if labels is None:
        labelled = parsed.withColumn("bad", F.lit(None).cast("boolean"))
    else:
        marks = labels.select(F.col("page_id").alias("page_id"), F.col("bad").cast("boolean").alias("bad")).filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
        labelled = parsed.join(marks, "page_id", "left")
    counts = labelled.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    leaves = templates(counts)
    total = leaves.agg(F.sum("labelled"), F.sum("bad")).first()
    good = 1.0 - (total[1] / total[0] if total[0] else 0.0)
    hosts = leaves.groupBy("host").agg(((F.sum("labelled") - F.sum("bad") + SMOOTHING * good) / (F.sum("labelled") + SMOOTHING)).alias("host_good"))
    purity = (F.sum("labelled") - F.sum("bad") + SMOOTHING * F.first("host_good")) / (F.sum("labelled") + SMOOTHING)
    pure = leaves.join(hosts, "host").groupBy("host", "template").agg(purity.alias("purity"))
    known = cluster.cut(leaves.select("host", "shape", "template", "n").join(pure, ["host", "template"]))
    if known.count() <= MOST_BROADCAST:
        found = parsed.join(F.broadcast(known), ["host", "shape"], "left")
    else:
        found = cluster.spread_join(parsed, known, ["host", "shape"], "n")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")
