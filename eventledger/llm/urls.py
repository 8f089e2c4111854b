"""URL filters by rules and by path-template trees, in DataFrame operations.

Rules (host and path) decide first; a rule fits its host and all subdomains if the path starts with its path, and
the longest wins. URLs that rules decide are the labelled examples. From them a tree of path templates is learned per
host: numbers, hexadecimal and dated segments become wildcards by form; where a branch has more than FANOUT
children, those whose blocked shares don't differ significantly become one wildcard. Children are ordered by share and cut where a test
of two proportions tells the neighbours apart; unlabelled children are a wildcard of their own. The tree goes on as long as its
branches differ in labels, however deep that is: what is labelled all alike, or not at all, is one template. URLs without a
rule are judged by the deepest template of their path.

Rules fix the first segments of a path, so what they label is no fair sample of a host. A template is therefore rejected
only on blocked examples of its own: with some, its purity is its blocked share smoothed towards its parent's; without,
towards PRIOR, so an unlabelled template has PRIOR itself. A page that ends where other paths go on is judged by the
examples that end there too. Unlabelled siblings never join labelled ones, since no label shows that they are alike.

The tree is made from distinct paths of typed segments with their counts, so that a host with a third of all rows weighs no more
than its paths. Segments that all paths of a branch share are taken at once, so there are as many rounds as there are branchings one
below the other that differ in labels.

Defined results: a null url and one without `://` have an empty host and path, and are allowed unless a rule fits; rows
are independent, so repeated rows have equal verdicts (each counts as an example); an empty table gives an empty table.
Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged

#: (verdict, rule); the rule's host is what stands before its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Children that a branch may have unmerged, weight and value of the prior, standard deviations that tell two shares apart.
FANOUT, WEIGHT, PRIOR, APART = 20, 2.0, 0.1, 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null without."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def typed(path: Column) -> Column:
    """Segments of a path, those of variable form as wildcards."""
    kind = lambda s: (
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>").when(s.rlike(r"^[0-9]+$"), "<number>")
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "<hex>").otherwise(F.regexp_replace(s, r"[0-9]+", "#"))
    )
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def smoothed(n: str, bad: str, parent: Column) -> Column:
    """Blocked share of n examples, smoothed towards the parent's only if some are blocked."""
    return (F.col(bad) + WEIGHT * F.when(F.col(bad) > 0, parent).otherwise(F.lit(PRIOR))) / (F.col(n) + WEIGHT)


def in_common(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    go = f"zip_with({a}, {b}, (x, y) -> x <=> y)"
    return F.expr(f"aggregate({go}, named_struct('n', 0, 'on', true), (s, same) -> if(s.on and same, named_struct('n', s.n + 1, 'on', true), named_struct('n', s.n, 'on', false)), s -> s.n)")


def merged(children: DataFrame) -> DataFrame:
    """host, template, c_n, c_bad, class: of labelled children, by their counts; those of equal counts are one row before they are ordered."""
    kinds = children.where("c_n > 0").groupBy("host", "template", "c_n", "c_bad").agg((F.count("*") * F.col("c_n")).alias("all_n"), (F.count("*") * F.col("c_bad")).alias("all_bad"))
    by = Window.partitionBy("host", "template").orderBy(F.col("c_bad") / F.col("c_n"), "c_n")
    n0, bad0 = F.lag("all_n").over(by), F.lag("all_bad").over(by)
    n, bad = F.col("all_n"), F.col("all_bad")
    pool = (bad + bad0) / (n + n0)
    z = F.abs(bad / n - bad0 / n0) / F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-12)) * (1 / n + 1 / n0))
    kinds = kinds.withColumn("new", F.coalesce((z > APART).cast("int"), F.lit(0)))
    return kinds.select("host", "template", "c_n", "c_bad", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("class"))


def tree_of(paths: DataFrame) -> DataFrame:
    """paths (host, segments, n examples, bad ones, u unlabelled) with template and purity."""
    open_ = paths.select("*", F.lit("").alias("template"), F.lit(0).alias("at"), F.lit(PRIOR).alias("parent"))
    done = None
    while True:
        rest = F.expr("slice(segments, at + 1, greatest(size(segments) - at, 0))")
        node = open_.groupBy("host", "template").agg(
            F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("u").alias("all_u"), F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.first("parent").alias("parent")
        )
        alike = F.expr("all_n = 0 or (all_u = 0 and all_bad in (0, all_n))")
        node = node.select("host", "template", alike.alias("alike"), smoothed("all_n", "all_bad", F.col("parent")).alias("purity"), in_common("lo", "hi").alias("skip"))
        rows = open_.drop("parent").join(node, ["host", "template"])
        way = F.array_join(F.transform(F.slice("segments", F.col("at") + 1, F.col("skip")), lambda s: F.concat(F.lit("/"), s)), "")
        rows = staged(rows.withColumn("way", F.concat("template", way)).withColumn("at", F.col("at") + F.col("skip")).withColumn("seg", F.when(~F.col("alike"), F.coalesce(F.get("segments", F.col("at")), F.lit("")))), "branches")
        last = rows.where("alike").select("host", "segments", F.col("way").alias("template"), "purity")
        children = rows.where("not alike").groupBy("host", "template", "seg").agg(F.sum("n").alias("c_n"), F.sum("bad").alias("c_bad"))
        width = children.groupBy("host", "template").agg(F.count_if(F.col("seg") != "").alias("width"))
        wide = children.where("seg <> ''").join(width.where(F.col("width") > FANOUT), ["host", "template"])
        name = F.concat(F.lit("*"), F.coalesce(F.col("class").cast("string"), F.lit("")))
        names = wide.join(merged(wide), ["host", "template", "c_n", "c_bad"], "left").select("host", "template", "seg", name.alias("name"))
        ends = children.where("seg = ''").join(width, ["host", "template"]).select("host", "template", "seg", "c_n", "c_bad", "width")
        ended = rows.where("seg = ''").join(ends, ["host", "template", "seg"])
        own = F.when(F.col("width") > 0, smoothed("c_n", "c_bad", F.col("purity"))).otherwise(F.col("purity"))
        ended = ended.select("host", "segments", F.col("way").alias("template"), own.alias("purity"))
        last = staged(last.unionByName(ended), "templates")
        done = last if done is None else done.unionByName(last)
        on = rows.where("seg <> ''").join(names, ["host", "template", "seg"], "left")
        open_ = staged(on.select(*paths.columns, F.concat("way", F.lit("/"), F.coalesce("name", "seg")).alias("template"), (F.col("at") + 1).alias("at"), F.col("purity").alias("parent")), "paths")
        if open_.isEmpty():
            return done


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("*", typed(F.col("path")).alias("segments"), rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    urls = staged(urls.select("page_id", "host", "path", "segments", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled")), "urls")
    counted = urls.groupBy("host", "segments").agg(
        F.count(F.when(F.col("ruled").isNotNull(), 1)).alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"), F.count(F.when(F.col("ruled").isNull(), 1)).alias("u")
    )
    tree = tree_of(staged(counted, "paths"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= 0.5, "block").otherwise("allow")).alias("verdict")
    return urls.join(tree, ["host", "segments"]).select("page_id", "host", "path", "rule", verdict, "template", F.round("purity", 6).alias("purity"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))
