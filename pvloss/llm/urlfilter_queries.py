"""op9: the verdict on every page."""

from . import urlfilter
from .common import table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).drop("alias_root")


_AFTER = "CASE WHEN instr(coalesce({0}, ''), '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_KEY = r"CASE WHEN host <> '' THEN host || chr(1) || rtrim(path, '/') || chr(1) || ltrim(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?', '', 'g'), '&') END"
_HREF = r"""(?is)[\s"''/]href\s*=\s*(?:"([^"]*)|''([^'']*)|([^"''\s>]+))"""
ORACLE = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE instr(url, '://') > 0 AND regexp_matches(html, '(?i)refresh|canonical')
), found AS (
  SELECT url, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, lower(regexp_extract({_AFTER.format("url")}, '^[^/?#]*')) AS site,
         regexp_extract({_AFTER.format("url")}, '^[^/?#]*([^?#]*)', 1) AS page_path, replace(trim(
    CASE WHEN regexp_matches(tag, '(?is)^<link\b.*[\s"''/]rel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)')
           THEN concat(regexp_extract(tag, '{_HREF}', 1), regexp_extract(tag, '{_HREF}', 2), regexp_extract(tag, '{_HREF}', 3))
         WHEN regexp_matches(tag, '(?is)^<meta\b.*[\s"''/]http-equiv\s*=\s*["'']?\s*refresh\b')
           THEN regexp_extract(tag, '(?is)[\s"'';,]url\s*=\s*["'']?([^"''\s>]+)', 1) END), '&amp;', '&') AS t
  FROM tags
), placed AS (
  SELECT *, regexp_extract(t, '^[^?#]*(.*)$', 1) AS tail,
         CASE WHEN t LIKE '/%' THEN '' ELSE '/' || regexp_extract(page_path, '^/(.*/)', 1) END || regexp_extract(t, '^[^?#]*') AS whole FROM found
), links AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
                   WHEN t IS NULL OR t = '' OR t LIKE '#%' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                   WHEN t LIKE '//%' THEN scheme || ':' || t
                   WHEN t LIKE '?%' THEN scheme || '://' || site || page_path || t
                   ELSE scheme || '://' || site || list_reduce(list_prepend('', string_split(substr(whole, 2), '/')),
                     lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END) || tail END AS target
  FROM placed
), urls AS (
  SELECT url FROM pages UNION SELECT url FROM links WHERE target IS NOT NULL UNION SELECT target FROM links
), split AS (
  SELECT url, rest, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url, {_AFTER.format("url")} AS rest FROM urls)
), keyed AS (SELECT *, {_KEY} AS key FROM split),
judged AS (
  SELECT k.url, k.host, k.path, k.key,
         arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS decision
  FROM keyed k LEFT JOIN rules r ON (k.host = r.host OR suffix(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
  GROUP BY ALL
), pairs AS (
  SELECT a.key AS u, b.key AS v FROM links JOIN keyed a ON a.url = links.url JOIN keyed b ON b.url = links.target
), reach(a, b) AS (
  SELECT DISTINCT key, key FROM keyed WHERE key IS NOT NULL
  UNION SELECT reach.a, e.v FROM reach JOIN (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs) e ON e.u = reach.b
), bad AS (SELECT DISTINCT reach.a AS key FROM reach JOIN judged j ON j.key = reach.b WHERE j.decision = 'block')
SELECT p.page_id, j.host, j.path, j.rule, coalesce(j.decision, CASE WHEN bad.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN judged j ON j.url IS NOT DISTINCT FROM p.url LEFT JOIN bad ON bad.key = j.key
"""
