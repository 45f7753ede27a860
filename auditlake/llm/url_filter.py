"""Operator 7: URL filters by a tree of path templates per host, in DataFrame functions only.

Variable path segments become wildcards: those that hold a digit, and the rare ones among many
siblings. Sibling branches whose labelled rates do not differ significantly from their parent's
are merged. What is left, a template, is rejected if its share of bad labels, smoothed
towards the host's and that towards all, is too high. Listed rules come before templates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

SIBLINGS = 16  # with more, rare siblings are variable
RARE = 50  # percent of an even share
PULL = 20  # labels that a parent's rate counts as
Z2 = 3.84  # square of the normal quantile for 5 %
WORST = 0.5  # smoothed share of bad labels above which a template is rejected

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """verdict and rule of the longest rule that fits the host or a domain above it and begins
    the path; null if none does. Of equally long ones the first in code point order."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The segments of a path, a wildcard where a digit stands."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x))


def _level(tree: DataFrame, k: int, value: str) -> tuple[DataFrame, DataFrame]:
    """Sums of ``value`` by branch of level ``k`` (``host, key``, with ``above``) and by what is above."""
    sums = [F.sum(c).alias(c) for c in value.split()]
    child = tree.where(F.size("t") > k).groupBy("host", F.slice("t", 1, k + 1).alias("key")).agg(*sums)
    child = child.withColumn("above", F.slice("key", 1, k))
    node = child.groupBy("host", "above").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in value.split()])
    return child, node


def _wild(tree: DataFrame, k: int, branches: DataFrame) -> DataFrame:
    """The tree with a wildcard at level ``k`` of the given branches, written once."""
    hit = branches.select("host", "key", F.lit(True).alias("hit"))
    wild = F.concat(F.slice("t", 1, k), F.array(F.lit("*")), F.slice("t", k + 2, F.size("t")))
    joined = tree.withColumn("key", F.slice("t", 1, k + 1)).join(hit, ["host", "key"], "left")
    return stored(joined.withColumn("t", F.when(F.col("hit"), wild).otherwise(F.col("t"))).drop("key", "hit"))


def templates(counted: DataFrame) -> DataFrame:
    """host, s (the segments as counted), t (those of the template), labels and bad of the template.
    ``counted``: host, s, pages, labels, bad.

    Works on one row per host and distinct shape. Each level, down to the deepest path, is a sum and
    a join by host and the branch above, over the paths that reach it."""
    tree = counted.withColumn("t", F.col("s"))
    deepest = counted.agg(F.coalesce(F.max(F.size("s")), F.lit(0)).alias("n")).first()["n"]
    for k in range(deepest):  # rare ones among many siblings
        child, node = _level(tree, k, "pages")
        rare = child.join(node, ["host", "above"]).where(
            (F.col("kinds") > SIBLINGS) & (100 * F.col("pages") * F.col("kinds") < RARE * F.col("all_pages")))
        tree = _wild(tree, k, rare)
    for k in reversed(range(deepest)):  # branches like the rest of their parent
        child, node = _level(tree, k, "labels bad")
        # (b - l r)^2 < z2 l r (1 - r) with r = all_b / all_l, in whole numbers but for z2
        off = F.col("bad") * F.col("all_labels") - F.col("labels") * F.col("all_bad")
        alike = (off * off).cast("double") <= Z2 * (
            F.col("labels") * F.col("all_bad") * (F.col("all_labels") - F.col("all_bad"))).cast("double")
        tree = _wild(tree, k, child.join(node, ["host", "above"]).where(alike))
    sums = tree.groupBy("host", "t").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    return tree.select("host", "s", "t").join(sums, ["host", "t"])


def judge(urls: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), id: str = "page_id", url: str = "url",
          bad: str = "bad") -> DataFrame:
    """One row for each row of ``urls``: page_id, host, path, template, purity (smoothed share of good
    labels), rule and verdict (``allow`` or ``block``).

    ``labels`` has ids of labelled urls and whether they are bad; null counts as no label. A null
    url or one without ``://`` has an empty host and path and counts as a host of its own. Without
    any label the shares are one half and nothing is blocked but by rules. The tree is as deep as the
    deepest path. Repeated rows are judged alike."""
    pages = urls.select(urls[id].alias("page_id"), host_of(urls[url]).alias("host"), path_of(urls[url]).alias("path"))
    pages = stored(pages.select("*", segments(F.col("path")).alias("s")))
    label = labels.where(labels[bad].isNotNull()).groupBy(labels[id].alias("page_id")).agg(F.max(labels[bad].cast("int")).alias("bad"))
    counted = pages.join(label, "page_id", "left").groupBy("host", "s").agg(
        F.count("*").alias("pages"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counted = stored(counted)
    tree = stored(templates(counted))
    total = counted.agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    base = (total["b"] + 1) / (total["l"] + 2)
    host = counted.groupBy(F.col("host").alias("_host")).agg(F.sum("labels").alias("hl"), F.sum("bad").alias("hb"))
    rate = (F.col("bad") + PULL * ((F.col("hb") + PULL * F.lit(base)) / (F.col("hl") + PULL))) / (F.col("labels") + PULL)
    shape = F.concat(F.lit("/"), F.array_join("t", "/"))
    decided = tree.join(host, F.col("host") == F.col("_host")).select("host", "s", shape.alias("template"), rate.alias("rate"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return pages.join(decided, ["host", "s"]).select(
        "page_id", "host", "path", "template", (1 - F.col("rate")).alias("purity"), rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("rate") > WORST, "block").otherwise("allow")).alias("verdict"))
