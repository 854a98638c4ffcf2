"""Operator 7 - URL filters with redirect equivalence.

A rule has a host, a path and a decision. It fits its host and all subdomains when the url's path starts with the rule's
path; the longest host + path wins (ties: allow, then the smaller rule text). Urls that no rule fits take the decision of
their aliases: redirect and canonical-link edges join urls into components, and a component with an explicitly allowed
url is allowed, else one with a blocked url is blocked. An explicit rule on the url itself stands. What is left is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, free
from rankloom.llm.components import connected_components

#: (host, path, decision) of the production query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: So many rules are compiled into the expression; longer lists are joined on host suffixes. The result is the same.
INLINE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\s[^>]*rel\s*=\s*["']?canonical["'\s/>][^>]*"""
REFRESH = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["'\s/>][^>]*"""
#: All such tags of a page, and rel lists that hold canonical among other words. The two above are the oracle's.
CANONICALS = r"""(?i)<link\s[^>]*rel\s*=\s*(?:["']?canonical(?=["'\s/>])|"(?:[^">]*\s)?canonical(?=["\s])|'(?:[^'>]*\s)?canonical(?=['\s]))[^>]*"""
REFRESHES = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh(?=["'\s/>])[^>]*"""
HREF = r"""(?i)href\s*=\s*["']?([^"'>\s]+)"""
URL_AT = r"""(?i)url\s*=\s*["']?([^"'>\s]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Host up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rank(rule: Column) -> Column:
    """Sorts the winning rule last."""
    text = F.concat(rule["host"], rule["path"])
    return F.struct(F.length(text).alias("n"), (rule["decision"] == "allow").alias("a"), F.transform(F.split(text, ""), lambda c: -F.ascii(c)).alias("t"), text.alias("rule"), rule["decision"].alias("decision"))


def _inline(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The winning rule as struct(rule, decision), or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,decision:string>")
    best = F.lit(None).cast("struct<rule:string,decision:string>")
    for h, p, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(decision).alias("decision"))).otherwise(best)
    return best


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, inline: int = INLINE, decision: str = "decision") -> DataFrame:
    """Adds host, path, rule and ``decision`` (null where no rule fits) to a table of distinct or repeated ``url``.

    Columns of these four names, in any case, are replaced. Empty rule hosts fit nothing but urls without a host. Rows are kept one for one.
    """
    df = urls.select(*[F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("host", "path", "rule", decision.lower())]).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if len(rules) <= inline:
        (best,) = free([*df.columns, "rule", decision], "_best")
        return df.withColumn(best, _inline(rules, F.col("host"), F.col("path"))).select("*", F.col(f"{best}.rule").alias("rule"), F.col(f"{best}.decision").alias(decision)).drop(best)
    spark = urls.sparkSession
    table = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, decision string")
    labels = F.split("host", r"\.")
    places = df.select("host", "path").distinct()
    suffixed = places.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))))
    r = table.select(F.col("host").alias("suffix"), F.struct("host", "path", "decision").alias("r"))
    best = suffixed.join(r, "suffix").where(F.startswith("path", F.col("r.path"))).groupBy("host", "path").agg(F.max(_rank(F.col("r"))).alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.decision").alias(decision))
    return df.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in df.columns], "rule", decision)


def normal(url: Column) -> Column:
    """A url as a node of the link graph: without its fragment, scheme and host in lower case (A-Z)."""
    bare = F.regexp_replace(url, "#.*", "")
    head = F.regexp_extract(bare, r"^[^:/?#]*://[^/?]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.length(bare)))


def _absolute(url: Column, link: Column) -> Column:
    """A link as an absolute :func:`normal` url, seen from the page it stands on; null for an empty link."""
    scheme = F.regexp_extract(url, r"^[^:/?#]*:", 0)
    base = F.concat(scheme, F.lit("//"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)?", 0)
    full = (
        F.when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(base, link))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    return F.when(F.length(link) > 0, normal(full))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) normal urls from each page's canonical links and refresh redirects; ``&amp;`` in a link is ``&``."""
    url, html = F.col("url"), F.col("html")
    links = lambda tags, at: F.transform(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda t: _absolute(url, F.replace(F.regexp_extract(t, at, 1), F.lit("&amp;"), F.lit("&"))))
    found = pages.where(url.isNotNull() & html.isNotNull()).select(normal(url).alias("src"), F.explode(F.concat(links(CANONICALS, HREF), links(REFRESHES, URL_AT))).alias("dst"))
    return found.where("dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, rule (null if none fits) and verdict ``allow`` or ``block``.

    ``edges``: (src, dst) urls that redirect or name each other; by default those found in the html. Null urls and urls
    without ``://`` have empty host and path, fit no rule and are allowed. Repeated rows stay; an empty table gives an
    empty result, and no edges an empty graph; other columns are kept, but for host, path, rule and verdict (in any case), which
    are replaced. Aliases are joined by their urls, without fragments and with scheme and host in lower case.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    given = link_edges(pages) if edges is None else edges.select(*[normal(F.col(c)).alias(c) for c in ("src", "dst")]).where("src <> dst").distinct()
    found = scratch.table(given, "edges")
    nodes = scratch.table(found.select(F.explode(F.array("src", "dst")).alias("url")).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    numbered = found.join(nodes.select(F.col("url").alias("src"), F.col("id").alias("a")), "src").join(nodes.select(F.col("url").alias("dst"), F.col("id").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = connected_components(numbered, scratch)
    judged = match_rules(nodes, rules).join(roots, "id").select("url", "root", "decision")
    groups = judged.groupBy("root").agg(F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked"))
    # Only pages that no rule fits look at their aliases, and only urls of groups with a decision are looked up.
    own, at, alias = free([*pages.columns, "host", "path", "rule", "verdict"], "decision", "at", "alias")
    decided = judged.where("decision is null").join(groups.where("allowed or blocked"), "root").select(F.col("url").alias(at), F.when(F.col("allowed"), F.lit("allow")).otherwise(F.lit("block")).alias(alias))
    matched = match_rules(pages.drop("verdict"), rules, decision=own)
    out = matched.withColumn(at, F.when(F.col(own).isNull(), normal(F.col("url")))).join(decided, at, "left")
    return out.withColumn("verdict", F.coalesce(own, alias, F.lit("allow"))).drop(own, alias, at)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``; nulls, repeats and empty tables as in :func:`judge`."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_url(expr: str) -> tuple[str, str]:
    rest = f"CASE WHEN instr({expr}, '://') > 0 THEN substr({expr}, instr({expr}, '://') + 3) END"
    return f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '')", f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def _sql_rule(what: str, host: str, path: str) -> str:
    fits = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p) if what == 'rule' else d}'" for h, p, d in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return "CASE " + " ".join(fits) + " END"


def oracle() -> str:
    """The same rows in DuckDB: rules, link edges and their components by a recursive closure."""
    q = lambda s: s.replace("'", "''")
    host, path = _sql_url("url")
    link = lambda tag, at: f"regexp_extract(regexp_extract(html, '{q(tag)}'), '{q(at)}', 1)"
    scheme = "regexp_extract(url, '^[^:/?#]*:')"
    folder = f"regexp_extract({path}, '^(.*/)?')"
    return f"""
WITH RECURSIVE l AS (SELECT url, unnest([{link(CANONICAL, HREF)}, {link(REFRESH, URL_AT)}]) AS k FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
a AS (SELECT regexp_replace(url, '#.*', '') AS src, regexp_replace(CASE WHEN contains(k, '://') THEN k WHEN starts_with(k, '//') THEN {scheme} || k
  WHEN starts_with(k, '/') THEN {scheme} || '//' || {host} || k ELSE {scheme} || '//' || {host} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || k END, '#.*', '') AS dst
  FROM l WHERE length(k) > 0),
e AS (SELECT src, dst FROM a WHERE src <> dst UNION SELECT dst, src FROM a WHERE src <> dst),
r AS (SELECT src AS url, src AS other FROM e UNION SELECT r.url, e.dst FROM r JOIN e ON r.other = e.src),
d AS (SELECT r.url AS at, max(CASE v WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS best FROM (SELECT r.url, {_sql_rule('verdict', *_sql_url('r.other'))} AS v FROM r) r GROUP BY r.url),
p AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
m AS (SELECT *, {_sql_rule('rule', 'host', 'path')} AS rule, {_sql_rule('verdict', 'host', 'path')} AS own FROM p)
SELECT page_id, host, path, rule, coalesce(own, CASE best WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM m LEFT JOIN d ON d.at = regexp_replace(m.url, '#.*', '')
"""
