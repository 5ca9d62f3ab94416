"""URL verdicts from a tree of path templates per host, learnt from rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import materialise
from threadloom.llm.common import fresh, quoted

# Rules of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ADDED = ("_host", "_path", "_rule", "_template", "_share", "_verdict")
LEAST_PAGES = 8  # pages, or hosts, that keep a segment literal
LEAST_HOSTS = 3
STRENGTH = 4.0  # pages that the pooled share of a template weighs against a host's own
ALIKE = 1.96  # standard errors within which a branch is merged with its host's others


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host with A-Z lowered and path; both empty where the url is null or has no ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule, as struct(rule, verdict), that fits a host or its subdomains and begins its path; else null."""
    cases = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col(host) == rule_host) | F.endswith(F.col(host), F.lit("." + rule_host))) & F.startswith(F.col(path), F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _shape(path: str) -> Column:
    """Segments of a path with those that hold a digit as ``*``."""
    segments = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def _templates(counted: DataFrame, least_pages: int, least_hosts: int) -> DataFrame:
    """``counted`` with ``template``, grown by a segment a round until no path has a further one.

    What lies below a template that too few pages of its host and too few hosts have can only be
    wildcards: such paths are finished at once, so rounds go only as deep as paths are shared.
    """
    growing, done = materialise(counted.withColumn("template", F.lit(""))), []
    level = 0
    while not growing.isEmpty():
        segment = F.get("_shape", F.lit(level))
        done.append(growing.filter(segment.isNull()).drop("seen", "hosts"))
        open_ = growing.withColumn("segment", segment).filter("segment is not null")
        nodes = open_.groupBy("_host", "template", "segment").agg(F.sum("pages").alias("seen"))
        hosts = nodes.groupBy("template", "segment").agg(F.count(F.lit(1)).alias("hosts"))
        shared = (F.col("seen") >= least_pages) | (F.col("hosts") >= least_hosts)
        named = nodes.join(hosts, ["template", "segment"]).select("_host", "template", "segment", F.when(shared, F.col("segment")).otherwise("*").alias("name"))
        grown = open_.join(named, ["_host", "template", "segment"]).withColumn("template", F.concat("template", F.lit("/"), "name")).drop("segment", "name")
        level += 1
        own = grown.groupBy("_host", "template").agg(F.sum("pages").alias("seen"))
        spread = own.groupBy("template").agg(F.count(F.lit(1)).alias("hosts"))
        counts = own.join(spread, "template")
        grown = materialise(grown.join(counts, ["_host", "template"]))
        rare = (F.col("seen") < least_pages) & (F.col("hosts") < least_hosts)
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("_shape") - level))
        done.append(grown.filter(rare).withColumn("template", rest).drop("seen", "hosts"))
        growing = grown.filter(~rare).drop("seen", "hosts")
    return reduce(DataFrame.unionByName, done) if done else growing


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    least_pages: int = LEAST_PAGES,
    least_hosts: int = LEAST_HOSTS,
    strength: float = STRENGTH,
    alike: float = ALIKE,
) -> DataFrame:
    """``pages`` with _host, _path, _rule, _template, _share and _verdict (allow or block) added.

    A path becomes a template: segments with a digit are wildcards; another segment stays literal where
    at least ``least_pages`` of its host's pages with the same template before it have it, or pages of
    ``least_hosts`` hosts, and becomes a wildcard otherwise. Pages that a rule judges label templates. A
    host's template whose share of blocked pages lies within ``alike`` standard errors of its host's
    labelled pages is merged with them. The smoothed share is drawn towards that of the template on all
    hosts, and that towards the share of all labelled pages; a template is rejected from a half on.

    Pages are counted by host and shape before anything is shuffled, and the tree works on these counts.
    Null and broken urls have an empty host and path and are judged like other pages; rows that repeat
    are judged alike. Columns of ``pages`` with the names of the added ones are replaced by them.
    """
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    host, path = host_and_path(quoted(url))
    judged = pages.select(*[quoted(c) for c in kept], host.alias("_host"), path.alias("_path"))
    found, shape, own_host, own_shape, template, share_of = fresh(judged, "_found", "_shape", "_on_host", "_of_shape", "_template", "_share")
    judged = judged.withColumn(found, rule_of("_host", "_path", rules)).withColumn(shape, _shape("_path"))
    blocked = F.col(f"{found}.verdict") == "block"
    counted = judged.groupBy("_host", F.col(shape).alias("_shape")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(f"{found}.verdict").alias("labelled"),
        F.sum(F.when(blocked, 1).otherwise(0)).alias("blocked"),
    )
    tree = _templates(counted, least_pages, least_hosts)
    branches = materialise(tree.groupBy("_host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")))
    host_sums = branches.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("b").alias("host_b"))
    everywhere = branches.groupBy("template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    total = branches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_n"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_b")).first()
    overall = (total["total_b"] + 1.0) / (total["total_n"] + 2.0)
    own = F.try_divide(F.col("b").cast("double"), F.col("n").cast("double"))
    pooled = F.try_divide(F.col("host_b").cast("double"), F.col("host_n").cast("double"))
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), F.col("n").cast("double")) + F.try_divide(F.lit(1.0), F.col("host_n").cast("double"))))
    merged = F.coalesce(F.abs(own - pooled) <= F.lit(alike) * error, F.lit(False))  # never without labels
    usual = (F.col("all_b") + F.lit(strength) * F.lit(overall)) / (F.col("all_n") + F.lit(strength))
    share = (F.when(merged, F.col("host_b")).otherwise(F.col("b")) + F.lit(strength) * usual) / (
        F.when(merged, F.col("host_n")).otherwise(F.col("n")) + F.lit(strength)
    )
    scored = branches.join(host_sums, "_host").join(everywhere, "template").select("_host", "template", share.alias("share"))
    shapes = tree.join(scored, ["_host", "template"]).select(
        F.col("_host").alias(own_host), F.col("_shape").alias(own_shape), F.col("template").alias(template), F.col("share").alias(share_of)
    )
    out = judged.join(shapes, (F.col("_host") == F.col(own_host)) & (F.col(shape) == F.col(own_shape)), "left")
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(F.col(share_of) >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    added = (F.col("_host"), F.col("_path"), F.col(f"{found}.rule"), F.col(template), F.col(share_of), verdict)
    return out.select(*[quoted(c) for c in kept], *[column.alias(name) for column, name in zip(added, ADDED)])
