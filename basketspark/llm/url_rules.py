"""Block and allow rules for urls, with blocks that reach every alias of a url.

A url is judged by the longest rule that fits it. Pages name other urls as the same resource: canonical links,
refresh redirects, and rows of a redirect log if one is given. These links join urls into classes by distributed
connected components; a class with a url that a rule blocks is blocked, apart from its urls that a rule allows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketspark.functions import stable

from .components import components
from .tables import broadcast_within

ALLOW, BLOCK = "allow", "block"

#: Parameters that name a visit, not a resource.
TRACKING = re.compile("(utm_[^=]*|gclid|fbclid)(=|$)")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)

# a tag inside these is no tag of the page; what is not closed runs to the end, so every scan ends at one match
_NOT_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|<textarea\b.*?(?:</textarea\s*>|\z)|<template\b.*?(?:</template\s*>|\z)"
)
_TAGS = r"(?is)<(?:link|meta)[\s/][^>]*>"
_REFRESH = re.compile(r"[\s\d.]*[;,]?\s*url\s*=\s*[\"']?\s*([^\"']*)", re.I)
_ATTRIBUTE = re.compile(r"[\s/\"']([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _raw_host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(_raw_host(url), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: str | None) -> str | None:
    """Host, path and query without scheme, default port, fragment, dot segments and tracking parameters; null without host."""
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    place, _, query = rest.partition("?")
    host, slash, path = place.partition("/")
    host = re.sub(":(80|443)?$", "", host.translate(_FOLD))
    if not host:
        return None
    done: list[str] = []
    parts = path.split("/")
    for part in parts:
        if part == "..":
            del done[-1:]
        elif part != ".":
            done.append(part)
    if parts[-1] in (".", ".."):
        done.append("")
    query = "&".join(p for p in query.split("&") if p and not TRACKING.match(p))
    return f"{host}/{'/'.join(done)}" + (f"?{query}" if query else "")


def resolved(base: str | None, link: str | None) -> str | None:
    """``link`` as an absolute url, seen from the page ``base``; null where it names no page."""
    link = (link or "").strip().replace("&amp;", "&").replace("&#38;", "&")
    if not link or link[0] == "#":
        return None
    if re.match("[A-Za-z][A-Za-z0-9+.-]*://", link):
        return link
    if base is None or "://" not in base or re.match("[A-Za-z][A-Za-z0-9+.-]*:", link):
        return None
    scheme, rest = base.split("://", 1)
    place = re.match("[^?#]*", rest)[0]
    if link.startswith("//"):
        return f"{scheme}:{link}"
    if link[0] == "?":
        return f"{scheme}://{place}{link}"
    host, _, path = place.partition("/")
    folder = "" if link[0] == "/" else "/" + path[: path.rfind("/") + 1]
    return f"{scheme}://{host}{folder}{link}"


def _attributes(tag: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), "".join(values))  # the first of a name counts
    return found


def tag_target(base: str | None, tag: str) -> str | None:
    """The url that a canonical link or a refresh redirect on the page ``base`` leads to; null for other tags."""
    attributes = _attributes(tag)
    if tag[1:5].lower() == "link":
        told = "canonical" in attributes.get("rel", "").lower().split()
        return resolved(base, attributes.get("href")) if told else None
    if attributes.get("http-equiv", "").strip().lower() != "refresh":
        return None
    to = _REFRESH.match(attributes.get("content", ""))
    return resolved(base, to[1]) if to else None


@F.pandas_udf(T.StringType())
def resource_of(url: pd.Series) -> pd.Series:
    return url.map(resource, na_action="ignore").astype(object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _targets(url: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([[t for t in (tag_target(u, tag) for tag in some) if t] for u, some in zip(url, tags)], dtype=object)


@F.pandas_udf(T.StringType())
def _resolved(url: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([resolved(u, t) for u, t in zip(url, target)], dtype=object)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) for the canonical links and refresh redirects in the pages' markup.

    Comments, scripts, styles, templates and text areas hold no tags. Pages without url or html have no links.
    """
    # pages without the words are done with here, in the scan
    some = pages.select("url", "html").where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").isNotNull())
    tags = F.regexp_extract_all(F.regexp_replace("html", _NOT_MARKUP, " "), F.lit(_TAGS), F.lit(0))
    found = some.select("url", tags.alias("tags")).select("url", F.explode(_targets("url", "tags")).alias("target"))
    return found.dropna()


def _rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): all rules for the host or a domain above it, whatever their paths.

    A host's parent domains are looked up by equality, so the number of rules may grow; the rules of one host and its
    parents are one row.
    """
    known = rules.select(
        F.col("host").alias("suffix"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict"),
    ).where("suffix is not null and verdict is not null")
    labels = known.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0] or 0
    if not labels:
        return hosts.select("host", F.lit(None).cast("array<struct<n:int,free:boolean,path:string,rule:string>>").alias("fits"))
    depth = F.least(F.size(F.split("host", r"\.")), F.lit(labels))
    above = hosts.where("host != ''").select("host", F.explode(F.sequence(F.lit(1), depth)).alias("k"))
    above = above.select("host", F.expr("substring_index(host, '.', -k)").alias("suffix"))
    rule = F.struct(
        F.length(F.concat("suffix", "path")).alias("n"),
        (F.col("verdict") == ALLOW).alias("free"),
        F.col("path").alias("path"),
        F.concat("suffix", "path").alias("rule"),
    )
    return stable(above.join(broadcast_within(known), "suffix").groupBy("host").agg(F.collect_set(rule).alias("fits")))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path and more) with ``rule`` and ``ruled``: the longest rule that fits, and what it says.

    Of rules of one length, an allowing one wins. Rows, repeated ones included, stay as they are.
    """
    hosts = _rules_by_host(urls.select("host").distinct(), rules)
    best = F.array_max(F.filter("fits", lambda r: F.col("path").startswith(r["path"])))
    return (
        urls.join(broadcast_within(hosts), "host", "left")
        .withColumn("_best", best)
        .withColumns(
            {
                "rule": F.col("_best.rule"),
                "ruled": F.when(F.col("_best.free"), ALLOW).when(~F.col("_best.free"), BLOCK),
            }
        )
        .drop("fits", "_best")
    )


def alias_blocks(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, alias_class) of the urls whose class holds a url that a rule blocks; ``links`` has url and target."""
    ends = links.select(resource_of("url").alias("a"), resource_of("target").alias("b")).where("a != b").distinct()
    ends = stable(ends)
    known = components(ends.select(F.md5("a").alias("u"), F.md5("b").alias("v")))
    names = ends.select("a").unionByName(ends.select(F.col("b").alias("a"))).distinct()
    # a resource's host and path are what a rule looks at
    full = F.concat(F.lit("http://"), F.col("a"))
    judged = with_rules(names.select(F.md5("a").alias("v"), host_of(full).alias("host"), path_of(full).alias("path")), rules)
    bad = stable(judged.where(F.col("ruled") == BLOCK).join(known, "v").select("root").distinct())
    hit = known.join(broadcast_within(bad), "root", "left_semi")
    return stable(hit.select(F.col("v").alias("id"), F.col("root").alias("alias_class")))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``alias_class`` of every page.

    ``rules`` has host, path and verdict (allow or block); a rule fits its host and all subdomains where the url's path
    starts with the rule's. Without a fitting rule a page is blocked if its class (see above) holds a blocked url, also
    one that no page has; ``alias_class`` then names that class. Allowing rules are never passed on to aliases.
    ``redirects`` may add links (url, target). Null urls and urls without ``://`` have empty host and path, fit no rule,
    and are allowed. Repeated rows and ids stay; other columns of ``pages`` are not read.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", _resolved("url", "target").alias("target")).dropna())
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.md5(resource_of("url")).alias("id"))
    judged = with_rules(rows, rules).join(broadcast_within(alias_blocks(links, rules)), "id", "left")
    verdict = F.coalesce("ruled", F.when(F.col("alias_class").isNotNull(), BLOCK).otherwise(ALLOW))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_class")
