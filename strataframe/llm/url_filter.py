"""URL rules, with block decisions carried to aliases along redirect and canonical-link edges."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import packed, saved, unpacked
from strataframe.llm.components import connected_components

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, name), or null.

    A rule fits its host and subdomains if the path starts with its own; rules of equal length keep
    their given order."""
    chosen = None
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(at + start).alias("name"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def node_of(url: Column) -> Column:
    """A URL as a graph node: no fragment, host in lower case; null stays null."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(_lower(head), F.substr(bare, F.length(head) + 1))


def _resolved(base: Column, link: Column) -> Column:
    """A link found in the page at ``base``, made absolute."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    slashed = F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("//"))), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(page, link))
        .otherwise(F.concat(slashed, link))
    )


CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def page_edges(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` -> edges (a, b) between URL nodes: canonical links and refresh redirects."""
    tag = F.regexp_extract("html", CANONICAL, 0)
    href = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    meta = F.regexp_extract("html", REFRESH, 0)
    move = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    links = pages.where("url is not null and html is not null").select("url", F.explode(F.array(href, move)).alias("link"))
    links = links.where("link != ''").select("url", F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link"))
    return links.select(node_of(F.col("url")).alias("a"), node_of(_resolved(F.col("url"), F.col("link"))).alias("b"))


def judge_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages(url, html, ...)`` and host, path, rule, verdict.

    A page that a rule fits gets that rule's verdict.  Any other page is an alias of all URLs in its
    connected component (edges from html, and ``edges(a, b)`` of a redirect log if given): it is
    allowed if a URL there is allowed by a rule, else blocked if one is blocked, else allowed.  Targets
    that are no page themselves count by the rules too.  Null and malformed urls have empty host and
    path, and are allowed; null html has no links; repeated rows get equal results."""
    links = page_edges(pages.select("url", "html"))
    if edges is not None:
        links = links.union(edges.select(node_of(F.col("a")), node_of(F.col("b"))))
    members = connected_components(links)
    ruled = members.withColumn("verdict", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    voted = ruled.groupBy("component").agg(F.min("verdict").alias("passed__"))  # allow sorts before block
    told = saved(members.join(voted, "component").where("passed__ is not null").select(F.col("node").alias("node__"), "passed__"))
    rows = packed(pages).withColumns({"n__": node_of(F.col("row__.url")), "h__": host_of(F.col("row__.url")), "p__": path_of(F.col("row__.url"))})
    both = rows.join(told, F.col("n__") == F.col("node__"), "left").withColumn("r__", rule_for(F.col("h__"), F.col("p__"), rules))
    return unpacked(
        both,
        pages.columns,
        host=F.col("h__"),
        path=F.col("p__"),
        rule=F.col("r__.name"),
        verdict=F.coalesce("r__.verdict", "passed__", F.lit("allow")),
    )
