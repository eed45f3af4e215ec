"""URL filters (operator 9), native DataFrame operations only.

Rules block or allow a host (with its subdomains) and a path prefix. Redirect
and canonical links make URLs aliases of one another: connected components over
those links carry a block decision to every alias. A page that a rule fits
keeps that rule's verdict, so an explicit allow is never overruled; any other
page is blocked if one of its aliases (a page or a link's target) is blocked by
a rule, and allowed otherwise.

The longest fitting rule wins; of equally long ones allow wins.

Links: ``<link rel=canonical href>`` (canonical among other rel values too) and
``<meta http-equiv=refresh>`` in the html, and a table of observed redirects
(source, target) where one is given. Relative targets are resolved against the
page. Aliases are compared as nodes: without the fragment, scheme and host in
lower case, an empty path as ``/``, and dot segments taken out. Edge cases: a
null url, or one without ``://``, has empty host and path, fits no rule, has no
alias and is allowed; null html has no links; repeated rows are judged each; an
empty table gives an empty result. Result columns replace same-named input
columns; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import cut, fresh, read_table, without

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Up to so many rules are a literal array in the plan; more are joined by host suffix.
MAX_LITERAL_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?i)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?:[\s>/]|$))"""
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (with host, path) with rule and its ``__verdict``, null where none fits."""
    if len(rules) > MAX_LITERAL_RULES:
        return _match_by_suffix(urls, rules)
    listed = F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(listed, lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, _rank))
    return urls.withColumn("__r", best).withColumns({"rule": F.col("__r.rule"), "__verdict": F.when(F.col("__r.allow"), "allow").when(~F.col("__r.allow"), "block")}).drop("__r")


def _rank(r: Column) -> Column:
    return F.struct(r["n"].alias("n"), (r["verdict"] == "allow").alias("allow"), F.concat(r["host"], r["path"]).alias("rule"))


def _match_by_suffix(urls: DataFrame, rules) -> DataFrame:
    """Many rules: distinct hosts are exploded into their suffixes and joined to
    the rules' hosts; candidates are gathered per host, so a hot host is one row."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(v, h, p, len(h + p)) for v, h, p in rules], "verdict string, rule_host string, path string, n int")
    hosts = urls.select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = hosts.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    found = suffixes.join(table, "rule_host").groupBy("host").agg(F.collect_list(F.struct("n", "verdict", F.col("rule_host").alias("host"), "path")).alias("__rules"))
    joined = urls.join(found.withColumnRenamed("host", "__h"), F.col("host") == F.col("__h"), "left").drop("__h")
    fits = F.filter(F.coalesce("__rules", F.array().cast("array<struct<n:int,verdict:string,host:string,path:string>>")), lambda r: F.startswith(F.col("path"), r["path"]))
    return joined.withColumn("__r", F.array_max(F.transform(fits, _rank))).withColumns({"rule": F.col("__r.rule"), "__verdict": F.when(F.col("__r.allow"), "allow").when(~F.col("__r.allow"), "block")}).drop("__r", "__rules")


def _resolve(base: Column, href: Column) -> Column:
    """``href`` as an absolute URL, seen from the page at ``base``."""
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.regexp_extract(page, r"(?s)^(.*?://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    out = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
    out = out.when(F.startswith(href, F.lit("/")), F.concat(origin, href)).when(F.startswith(href, F.lit("?")), F.concat(page, href))
    return out.when(F.startswith(href, F.lit("#")), base).otherwise(F.concat(folder, href))


def _without_dots(path: Column) -> Column:
    """A path from ``/`` on, less its ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(segments, empty, lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(s))))
    last = F.element_at(segments, -1)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def node_of(url: Column) -> Column:
    """What aliases are compared by, null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    clean = F.when(path == "", F.lit("/")).when(F.contains(path, F.lit("/.")), _without_dots(path)).otherwise(path)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), clean, query))


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) from each page's node to its canonical and redirect targets',
    and those of ``redirects`` (source, target)."""
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    heads = pages.where(F.contains(F.col("url"), F.lit("://")) & F.col("html").rlike(r"(?i)\b(canonical|refresh)\b")).select("url", F.explode(tags).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", _REFRESH, 1))
    links = heads.withColumn("href", F.replace(target, F.lit("&amp;"), F.lit("&"))).where("href <> ''").select("url", _resolve(F.col("url"), F.col("href")).alias("to"))
    if redirects is not None:
        links = links.union(redirects.select("source", _resolve(F.col("source"), F.col("target"))))
    return links.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b")).where("a <> b").distinct()


def blocked_aliases(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Nodes of components that hold a blocked url."""
    labels = cut(components(alias_links(pages, redirects)), "aliases")
    judged = match_rules(labels.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    bad = judged.where("__verdict = 'block'").select("label").distinct()
    return labels.join(bad, "label", "left_semi").select("node").distinct()


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    own = fresh(pages, "alias")
    blocked = cut(blocked_aliases(pages.select("url", "html"), rules, redirects), "blocked").select(F.col("node").alias(f"{own}_b"))
    kept = without(pages, "host", "path", "rule", "verdict")
    # The rules' own columns are made beside the pages' others, in a struct.
    inner = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    joined = match_rules(inner, rules).join(blocked, F.col("node") == F.col(f"{own}_b"), "left")
    verdict = F.coalesce("__verdict", F.when(F.col(f"{own}_b").isNotNull(), F.lit("block")), F.lit("allow"))
    return joined.select("row.*", "host", "path", "rule", verdict.alias("verdict"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_HOST_SQL = "translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH_SQL = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_DOTS_SQL = """array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, s) END)
  || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN [''] ELSE CAST([] AS VARCHAR[]) END, '/')"""


def _node_sql(u: str) -> str:
    """``node_of`` in SQL."""
    path = _PATH_SQL.format(u=u)
    clean = f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {_DOTS_SQL.format(p=path)} ELSE {path} END"
    scheme = f"translate(regexp_extract({u}, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"CASE WHEN contains({u}, '://') THEN {scheme} || '://' || {_HOST_SQL.format(u=u)} || {clean} || regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1) END"


_CANONICAL_SQL = _CANONICAL.replace("'", "''")
ORACLE = rf"""
WITH RECURSIVE
p AS (SELECT page_id, url, html, {_node_sql('url')} AS node FROM pages),
tags AS (SELECT url, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE contains(url, '://') AND regexp_matches(html, '(?i)\b(canonical|refresh)\b')),
hrefs AS (SELECT url, node, replace(CASE WHEN regexp_matches(tag, '{_CANONICAL_SQL}') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END, '&amp;', '&') AS h FROM tags),
whole AS (SELECT node, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || h WHEN starts_with(h, '?') THEN regexp_replace(url, '(?s)[?#].*$', '') || h WHEN starts_with(h, '#') THEN url
  ELSE rtrim(regexp_extract(regexp_replace(url, '(?s)[?#].*$', ''), '(?s)^(.*?://[^/]*(?:/.*/|/)?)', 1), '/') || '/' || h END AS t FROM hrefs WHERE h <> ''),
links AS (SELECT node AS a, {_node_sql('t')} AS b FROM whole),
e AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS s, a AS t FROM e UNION SELECT reach.s, e.b FROM reach JOIN e ON reach.t = e.a),
u AS (SELECT url AS x FROM p UNION SELECT t FROM reach),
hp AS (SELECT x, {_HOST_SQL.format(u='x')} AS host, {_PATH_SQL.format(u='x')} AS path FROM u WHERE x IS NOT NULL),
r(v, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (SELECT x, arg_max(v, length(h || q) * 2 + CAST(v = 'allow' AS INT)) AS v, arg_max(h || q, length(h || q) * 2 + CAST(v = 'allow' AS INT)) AS rule
  FROM hp JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY x),
bad AS (SELECT DISTINCT s FROM reach JOIN best ON best.x = reach.t AND best.v = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(best.v, CASE WHEN bad.s IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN hp ON hp.x = p.url LEFT JOIN best ON best.x = p.url LEFT JOIN bad ON bad.s = p.node
"""
