"""Operator 10, URL filters: given rules first, then a tree of path templates for each host.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path: the rest up to `?`, `#` or
the end. A null url, or one without `://`, has neither. A rule (host, path) fits its host and all subdomains if the path
starts with the rule's; the longest one wins and gives the verdict.

Elsewhere the method decides. Runs of digits in a path become `#`; urls that then have equal hosts and segments are one
shape with counts. From a host's root down, a segment that fewer than MIN_SUPPORT urls share below their node becomes `*`,
and below a `*` of fewer urls the rest becomes `**`; so shapes become templates, however deep. A node of the tree counts
its urls with a label and those labelled good. Branches whose share of good labels doesn't differ from their parent's by a
two-sided test at MERGE_Z, or that have fewer than MIN_SUPPORT labels, are merged into the parent; this goes for inner
nodes as for leaves, so that a template belongs to the deepest node on its way that stands alone, or to its host. Such a
branch's purity is the share of good labels among its templates, smoothed towards its host's with weight SMOOTHING, and
the host's likewise towards all labels'. Templates of purity below MIN_PURITY are rejected: verdict block. All else is
allowed, hosts without labels too.

A url's label is that of the document whose id LABEL_ID finds in the path: the last number of the last segment. Label rows
with nulls or negative ids are ignored, of repeated ones the worst holds. Rows with null page_ids or repeated rows are
judged like others; an empty table gives an empty result; other columns are ignored. Only shapes are joined level by level;
counts come from partial sums, and url rows meet one row a shape, so that hot hosts need no task of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MERGE_Z, SMOOTHING, MIN_PURITY, LABEL_ID = 5, 1.96, 4.0, 0.5, "([0-9]+)[^0-9/]*/?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    split = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    return split.withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), _UPPER, _LOWER)).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__rest")


def rule_columns(rules=RULES):
    """The longest fitting rule as `host/path`, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def shape():
    """The segments of a path with digits as `#`, without empty ones."""
    return F.array_join(F.filter(F.split(F.regexp_replace("path", r"[0-9]+", "#"), "/"), lambda s: s != ""), "/")


def templates(shapes: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(host, shape, n urls) -> the same with template; a level of all hosts' trees at a time, while nodes have urls enough."""
    columns = ["host", "shape", "n", "template"]
    done = shapes.where("shape = ''").withColumn("template", F.lit("")).select(columns)
    level = shapes.where("shape <> ''").select("host", "shape", "n", F.split("shape", "/").alias("parts"), F.lit("").alias("node"))
    depth = 0
    while True:
        level = level.withColumn("part", F.get("parts", F.lit(depth)))
        counts = materialize(level.groupBy("host", "node", "part").agg(F.sum("n").alias("c")), "url-nodes")
        common = counts.where(F.col("c") >= min_support).select("host", "node", "part", F.lit(True).alias("is_common"))
        rest = counts.where(F.col("c") < min_support).groupBy("host", "node").agg(F.sum("c").alias("c")).where(F.col("c") >= min_support).select("host", "node", F.lit(True).alias("is_large"))
        known = level.join(common, ["host", "node", "part"], "left").join(rest, ["host", "node"], "left")
        own = F.col("is_common").isNotNull()
        node = F.concat("node", F.lit("/"), F.when(own, F.col("part")).otherwise("*"))
        last = F.size("parts") == depth + 1
        level = materialize(known.select("host", "shape", "n", "parts", node.alias("node"), last.alias("last"), (last | (~own & F.col("is_large").isNull())).alias("closed")), "url-level")
        done = done.unionByName(level.where("closed").withColumn("template", F.concat("node", F.when(F.col("last"), "").otherwise("/**"))).select(columns))
        level = level.where("not closed").drop("last", "closed")
        depth += 1
        if level.isEmpty():
            return done


def branches(leaves: DataFrame) -> DataFrame:
    """(host, template, branch) of leaves (host, template, labels, good): the deepest node on the way that stands alone."""
    parts = F.split("template", "/")  # the first part is empty: the host's root
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ways = leaves.select("host", "template", "labels", "good", F.posexplode(prefixes).alias("depth", "node"))
    nodes = materialize(ways.groupBy("host", "depth", "node").agg(F.sum("labels").alias("labels"), F.sum("good").alias("good")), "url-tree")
    parent = nodes.select("host", F.col("depth") + 1, "node", "labels", "good").toDF("host", "depth", "parent", "of", "of_good")
    share = F.try_divide("of_good", "of")
    differs = F.abs(F.try_divide("good", "labels") - share) > MERGE_Z * F.sqrt(F.try_divide(share * (1 - share), F.col("labels")))
    alone = nodes.where(F.col("labels") >= MIN_SUPPORT).withColumn("parent", F.regexp_replace("node", r"/[^/]*$", "")).join(parent, ["host", "depth", "parent"]).where(differs).select("host", "depth", "node")
    deepest = ways.join(alone, ["host", "depth", "node"]).groupBy("host", "template").agg(F.max_by("node", "depth").alias("branch"))
    return leaves.select("host", "template", "labels", "good").join(deepest, ["host", "template"], "left").withColumn("branch", F.coalesce("branch", F.lit("")))


def purities(leaves: DataFrame) -> DataFrame:
    """(host, template, branch, purity)."""
    total = leaves.agg(F.sum("labels").alias("n"), F.sum("good").alias("g")).head()
    overall = total.g / total.n if total and total.n else 1.0
    host = leaves.groupBy("host").agg(F.sum("labels").alias("hn"), F.sum("good").alias("hg")).where("hn > 0").select("host", ((F.col("hg") + SMOOTHING * overall) / (F.col("hn") + SMOOTHING)).alias("host_purity"))
    judged = materialize(branches(leaves), "url-branches")
    branch = judged.groupBy("host", "branch").agg(F.sum("labels").alias("bn"), F.sum("good").alias("bg"))
    pure = branch.join(host, "host").select("host", "branch", ((F.col("bg") + SMOOTHING * F.col("host_purity")) / (F.col("bn") + SMOOTHING)).alias("purity"))
    return judged.select("host", "template", "branch").join(pure, ["host", "branch"])


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, label_id: str = LABEL_ID) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row."""
    rows = with_host_and_path(pages.select("page_id", "url")).withColumn("shape", shape())
    if labels is None:
        rows = rows.withColumn("good", F.lit(None).cast("double"))
    else:
        known = labels.where("doc_id >= 0 and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.expr("cast(quality = 1 and toxic = 0 as double)")).alias("good"))
        found = F.regexp_extract("path", label_id, 1).try_cast("long")
        nobody = -1 - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40))  # urls without an id are spread over tasks
        rows = rows.withColumn("id", F.coalesce(found, nobody)).join(known, "id", "left").drop("id")
    rows = materialize(rows.select("page_id", "host", "path", "shape", "good"), "url-rows")
    shapes = materialize(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("good").cast("double").alias("labels"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")), "url-shapes")
    named = materialize(templates(shapes).select("host", "shape", "template"), "url-templates")
    leaves = materialize(shapes.join(named, ["host", "shape"]).groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("good").alias("good")), "url-leaves")
    verdicts = materialize(named.join(purities(leaves).select("host", "template", "purity"), ["host", "template"], "left"), "url-purities")
    rule, said = rule_columns(rules)
    verdict = F.coalesce(said, F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow"))
    return rows.join(verdicts, ["host", "shape"], "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity")
