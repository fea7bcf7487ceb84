"""URL rules, and block decisions that follow redirects and canonical links.

A rule is (verdict, host, path). It fits a url whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path; the longest rule (host and path together) wins, on ties the
longer host, then allow. Host: from after the first "://" to the next "/", "?", "#" or the end, A-Z
lower-cased. Path: from there to "?", "#" or the end. Null urls and urls without "://" have neither.

Urls that lead to each other are aliases: the same url apart from scheme, fragment, closing slash
and tracking parameters, and whatever redirects, meta refreshes and canonical links connect.
Connected components over these edges share decisions: a page that no rule fits is blocked if a rule
blocks any url of its component, pages and mere targets alike. A rule that allows a page wins over
what reaches it from its component; a page with no decision at all is allowed.

All canonical and refresh tags of a page count; "canonical" may stand among other words of a rel list.
Targets are resolved against the page's url ("//host", "/path", "?query", relative paths with "." and ".."),
and "&amp;" in them is "&".

Defined cases: pages with null or unusable urls have no aliases; targets that are empty, only a fragment or of
a scheme without "://" are ignored; null html has no links; repeated pages stay; null page ids stay; further
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 500  # up to so many rules are literals of the plan; more are joined by host
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)^<link\b.*[\s\"'/]rel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"
REFRESH = r"(?is)^<meta\b.*[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)[\s\"'/]href\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'\s>]+))"
TARGET = r"(?is)[\s\"';,]url\s*=\s*[\"']?([^\"'\s>]+)"
ABSOLUTE, SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z][A-Za-z0-9+.-]*:"
TRACKING = r"(?:^|&)(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?"


def after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """The 64-bit key of a url's alias class before links; null where there is no host."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.ltrim(F.regexp_replace(query, TRACKING, ""), F.lit("&"))
    return F.when(host_of(url) != "", F.xxhash64(host_of(url), F.rtrim(path_of(url), F.lit("/")), query))


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url and more) and rules (verdict, host, path) -> host, path, rule and decision added."""
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").distinct()
    if known.count() <= INLINE_RULES:
        found = F.array(*[F.struct(*[F.lit(x) for x in r]) for r in known.select("verdict", "host", "path").collect()]).cast("array<struct<verdict:string,host:string,path:string>>")
        fits = F.filter(found, lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]))
        best = F.array_max(F.transform(fits, _ranked))
        return urls.withColumn("best", best).select("*", F.concat("best.host", "best.path").alias("rule"), F.col("best.verdict").alias("decision")).drop("best")
    # One row for each parent domain of each different (host, path); only those meet the rules.
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = places.select("host", "path", F.explode(parents).alias("parent")).join(known.select("verdict", F.col("host").alias("parent"), F.col("path").alias("start")), "parent").where("startswith(path, start)")
    best = near.groupBy("host", "path").agg(F.max(_ranked({"host": F.col("parent"), "path": F.col("start"), "verdict": F.col("verdict")})).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.concat("best.host", "best.path").alias("rule"), F.col("best.verdict").alias("decision"))
    return urls.join(best, (urls["host"] == best["h"]) & (urls["path"] == best["p"]), "left").drop("h", "p")


def _ranked(r) -> Column:
    size = F.length(r["host"]) + F.length(r["path"])
    return F.struct(size.alias("size"), F.length(r["host"]).alias("of_host"), (r["verdict"] == "allow").alias("allows"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"))


def without_dots(path: Column) -> Column:
    """A path that starts with "/" without "." and ".." segments."""
    up = lambda acc: F.regexp_replace(acc, "/[^/]*$", "")
    folded = F.aggregate(F.split(F.substr(path, F.lit(2)), "/", -1), F.lit(""), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x)))
    return F.when(F.contains(path, F.lit("/.")), folded).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """A link's target as an absolute url; null where there is none."""
    scheme, host, path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), host_of(url), path_of(url)
    own, rest = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)", 1))
    site = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(to.rlike(ABSOLUTE), to)
        .when(to.rlike(SCHEME) | (to == "") | F.startswith(to, F.lit("#")), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, without_dots(own), rest))
        .when(F.startswith(to, F.lit("?")), F.concat(site, path, to))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )


def links(pages: DataFrame) -> DataFrame:
    """Canonical links and meta refreshes of pages (url, html) -> url, target, both absolute."""
    page = pages.where("instr(url, '://') > 0 and html rlike '(?i)refresh|canonical'")
    tags = page.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), 0)).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", HREF, k) for k in (1, 2, 3)])
    found = tags.select("url", F.when(F.col("tag").rlike(CANONICAL), href).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1)).alias("to")).where("to is not null")
    return found.select("url", resolved(F.col("url"), F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&"))).alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html), rules (verdict, host, path), redirects (url, target) ->
    page_id, host, path, rule, verdict, alias_root (the component's name, null without a url)."""
    own = with_rule(pages.select("page_id", "url"), rules).withColumn("key", alias_key(F.col("url")))
    all_links = links(pages)
    if redirects is not None:
        all_links = all_links.unionByName(redirects.select("url", "target"))
    edges = all_links.select(alias_key(F.col("url")).alias("u"), alias_key(F.col("target")).alias("v"))
    roots = connected_components(edges)
    ends = all_links.select(F.explode(F.array("url", "target")).alias("url")).distinct()
    decided = own.select("key", "decision").union(with_rule(ends, rules).select(alias_key(F.col("url")), "decision"))
    blocked = decided.where("decision = 'block' and key is not null").select("key").distinct()
    blocked = blocked.join(roots, blocked["key"] == roots["node"], "left").select(F.coalesce("root", "key").alias("bad")).distinct()
    placed = own.join(roots, own["key"] == roots["node"], "left").withColumn("alias_root", F.coalesce("root", "key"))
    return placed.join(blocked, placed["alias_root"] == blocked["bad"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decision", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"), "alias_root"
    )
