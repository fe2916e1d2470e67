"""A crawl as frontier rounds over a table of pages: which links are followed, which are refused and why.

Rules of hosts (robots) are (host, prefix, allow): the longest prefix of a path decides, of equally long ones the one that
allows; a path without one is free. They are found by a join on the prefixes of a path, of the lengths only that the host's
rules have. Null and relative urls have no host and are refused as such; a url is visited once, in the earliest round that
reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.sources.shared import stored


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def deciding_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, prefix, allow) of the distinct urls that a rule of their host applies to."""
    r = rules.filter("prefix <> ''").select(F.lower("host").alias("host"), "prefix", "allow").groupBy("host", "prefix").agg(F.max("allow").alias("allow"))
    lengths = r.select("host", F.length("prefix").alias("n")).distinct()
    u = urls.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    cut = u.join(lengths, "host").filter(F.length("path") >= F.col("n")).withColumn("prefix", F.expr("substring(path, 1, n)"))
    best = cut.join(r, ["host", "prefix"]).groupBy("url").agg(F.max_by(F.struct("prefix", "allow"), "n").alias("b"))
    return best.select("url", "b.*")


def judged(urls: DataFrame, rules: DataFrame, pages: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """``urls`` with ``reason``: no_host, other_host (where ``hosts`` (host) names the wanted ones), robots, absent (no such
    page) or null, which is to be fetched."""
    out = urls.withColumn("host", host_of(F.col("url"))).join(deciding_rules(urls, rules).drop("prefix"), "url", "left")
    out = out.join(pages.select("url", F.lit(True).alias("there")).distinct(), "url", "left")
    if hosts is not None:
        out = out.join(hosts.select(F.lower("host").alias("host"), F.lit(True).alias("wanted")).distinct(), "host", "left")
    else:
        out = out.withColumn("wanted", F.lit(True))
    reason = (
        F.when(F.coalesce("host", F.lit("")) == "", "no_host").when(F.col("wanted").isNull(), "other_host").when(~F.coalesce("allow", F.lit(True)), "robots").when(F.col("there").isNull(), "absent")
    )
    return out.withColumn("reason", reason).drop("host", "allow", "there", "wanted")


def crawl(seeds: DataFrame, links: DataFrame, rules: DataFrame, pages: DataFrame, depth: int, hosts: DataFrame | None = None) -> DataFrame:
    """(url, round, reason) of every url that ``seeds`` (url) lead to over ``links`` (url, target) within ``depth`` steps: list,
    post, attachment are three. Each round is one join of the last frontier's fetched pages with their links, and of what they
    name with what was seen."""
    seen = stored(judged(seeds.select("url").distinct(), rules, pages, hosts).withColumn("round", F.lit(0)), "crawl")
    frontier, parts = seen, [seen]
    for n in range(1, depth + 1):
        named = frontier.filter("reason is null").select("url").join(links, "url").select(F.col("target").alias("url")).distinct()
        for p in parts:
            named = named.join(p.select("url"), "url", "left_anti")
        frontier = stored(judged(named, rules, pages, hosts).withColumn("round", F.lit(n)), "crawl")
        parts.append(frontier)
        if frontier.filter("reason is null").isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("url", "round", "reason")
