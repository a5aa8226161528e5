"""URL block and allow rules with redirect equivalence.

A rule has a host and a path; it fits urls of that host or a subdomain whose path starts with the rule's.  The longest
fitting rule decides (a longer host before a longer path, allow before block, where lengths tie).

A url without a rule takes the decision of its aliases.  Aliases are the connected components over redirect and canonical
edges: ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of the pages, and a table of redirects where there is one.
Decisions propagate from any member's url, whether or not that url is itself a page; a class with an explicitly allowed
member is allowed, else one with a blocked member is blocked.  What nothing decides is allowed.

A url's identity is its host, path and query; scheme and fragment make no difference.  Null urls, or urls without ``://``,
have empty host and path, fit no rule and have no aliases.  Links to a path are taken on the page's host, other relative
links on the page's directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, lower_ascii, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TO = r"(?is)\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """64-bit identity of a url; null where it has no host part."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.xxhash64(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))
    out = None
    for verdict, rule_host, rule_path in ranked:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def absolute(target: Column, base: Column) -> Column:
    """A link target as a url, seen from the page at ``base``."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` -> (source, target) urls of canonical links and immediate redirects."""
    html = F.col("html")
    found = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda t: F.regexp_extract(t, _TO, 1)),
    )
    rows = pages.where(F.col("url").isNotNull() & html.isNotNull()).select("url", F.explode(found).alias("to")).where("`to` <> ''")
    return rows.select(F.col("url").alias("source"), absolute(F.col("to"), F.col("url")).alias("target"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` (and ``redirects(source, target)``) -> page_id, url, host, path, rule, verdict."""
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target"))
    edges = cut(edges.distinct(), "url-edges")
    roots = connected_components(edges.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")), "url-classes")
    ends = edges.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    judged = ends.select(node_of(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v")).where("v is not null")
    # allow < block: the least verdict of a class decides
    classes = judged.join(roots, "node").groupBy("root").agg(F.min("v").alias("class_verdict"))
    inherited = cut(roots.join(classes, "root").select("node", "class_verdict"), "url-inherited")
    verdict = F.coalesce(F.col("own.verdict"), F.col("class_verdict"), F.lit("allow"))
    return own.join(inherited, "node", "left").select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM pages),
tags AS (
  SELECT url, regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS tgt
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS t FROM parsed WHERE url IS NOT NULL)
  UNION ALL
  SELECT url, regexp_extract(t, '(?is)\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*([^"''\s>;]+)', 1)
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS t FROM parsed WHERE url IS NOT NULL)),
links AS (
  SELECT url AS src, CASE WHEN contains(tgt, '://') THEN tgt
    WHEN starts_with(tgt, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || tgt
    WHEN starts_with(tgt, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || tgt
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || CASE WHEN regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1) END || tgt END AS dst
  FROM tags WHERE tgt <> ''),
urls AS (SELECT DISTINCT src AS url FROM links UNION SELECT DISTINCT dst FROM links),
nodes AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) AS query
  FROM urls WHERE contains(url, '://')),
named AS (SELECT url, host || chr(1) || path || chr(1) || query AS node, host, path FROM nodes),
e AS (SELECT DISTINCT a.node AS u, b.node AS v FROM links JOIN named a ON links.src = a.url JOIN named b ON links.dst = b.url),
sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(a, b) AS (SELECT u, u FROM sym UNION SELECT reach.a, sym.v FROM reach JOIN sym ON reach.b = sym.u),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
node_rule AS (
  SELECT node, arg_max(verdict, length(rhost || rpath)) AS verdict FROM named JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node),
classes AS (SELECT a AS node, min(verdict) AS verdict FROM reach JOIN node_rule ON reach.b = node_rule.node GROUP BY a),
own AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, classes.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN own ON own.page_id = p.page_id LEFT JOIN classes ON classes.node = p.host || chr(1) || p.path || chr(1) || p.query
"""
