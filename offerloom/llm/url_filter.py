"""URL filters: block and allow rules, and their spread over redirects and canonical links.

A rule names a host and the beginning of a path; it fits the host and all subdomains, and
the longest rule that fits wins (allow before block among equals).  Urls without a rule of
their own take the decision of their aliases: redirect and canonical-link edges make
classes of urls that are one page (distributed connected components); a class with an
explicitly allowed member is allowed, else one with a blocked member is blocked, else
allowed.  A url's own rule always stands.

Edges come from the pages themselves: every ``rel=canonical`` link and refresh redirect, its
target read relative to the page (comments declare nothing), and the url's spelling (scheme, ``www.``
or ``m.``, query, fragment, trailing slash and ``.html``), which links a url to its plain form.
More can be given.  Rules don't see queries, so what they decide on a plain form holds for its queries
too; but declared edges join one query of a path, not all: ``/go?u=1`` and ``/go?u=2`` are
two pages, unless an edge joins them.  Keys such as ``utm_source`` don't count, and a path's
only query is a spelling of the path.

Null urls and urls without ``://`` have an empty host and path, no rule and no aliases.
Repeated pages each keep their row; of rules equally long that fit, one that allows wins.  Very
long urls and html are read whole.  An empty table gives an empty result, and columns beside
``page_id``, ``url`` and ``html`` are not looked at.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ascii_lower, materialise
from offerloom.llm.graph import components

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Most rules that one literal map should hold; more are joined as a table.
MOST_RULES = 20_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct<length,allow,rule,verdict>`` of the longest rule that fits; null if none does.

    Rules stand in a literal map by host; a url looks up its host's suffixes.
    """
    if not rules:
        return F.lit(None).cast("struct<length:int,allow:boolean,rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("length"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(p).alias("path")))
    table = F.create_map(*(x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))))
    found = F.flatten(F.filter(F.transform(suffixes(host), lambda s: F.element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def suffixes(host: Column) -> Column:
    """A host and the domains it lies in."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rule(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rows(host, path)`` with ``r``, the rule that fits.

    Beyond ``MOST_RULES`` each distinct host and path meets the rules in a join on the host's
    suffixes, so neither side is bounded; the result is the same.
    """
    if len(rules) <= MOST_RULES:
        return rows.withColumn("r", matched_rule(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    places = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes(F.col("host"))))
    told = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), (F.col("verdict") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), "verdict", F.col("rule_path").alias("path"))
    met = places.join(table, "rule_host").where(F.startswith(F.col("path"), F.col("rule_path")))
    best = met.select("host", "path", told.alias("r")).groupBy("host", "path").agg(F.max("r").alias("r"))
    return rows.join(best, ["host", "path"], "left")


def plain_form(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.concat(bare, F.lit("/"), F.regexp_replace(F.regexp_replace(F.ltrim(path, F.lit("/")), r"\.html?$", ""), r"/+$", ""))


def resolved(target: Column, base: Column) -> Column:
    """``target`` as a url of its own, read on the page ``base``; null if it leads to no page."""
    t = F.trim(target)
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    at, tail = F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.regexp_extract(t, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.ltrim(path_of(base), F.lit("/")), r"[^/]*$", ""))
    steps = F.split(F.when(F.startswith(at, F.lit("/")), at).otherwise(F.concat(folder, at)), "/", -1)
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    path = F.when(at == "", path_of(base)).otherwise(F.array_join(walked, "/"))
    within = F.when(site != "", F.concat(site, path, tail))
    return F.when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(F.startswith(t, F.lit("//")), F.when(site != "", F.concat(scheme, F.lit(":"), t))).otherwise(within)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted or not; empty if there is none."""
    found = lambda value: F.regexp_extract(tag, rf"(?is)(?<![\w-]){name}\s*=\s*{value}", 1)
    return F.coalesce(*(F.nullif(found(v), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")), F.lit(""))


def unescaped(text: Column) -> Column:
    """Text with character references to numbers and to the characters of markup replaced."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
    number = lambda c: F.when(c.rlike("(?i)^&#x"), F.conv(F.regexp_extract(c, "(?i)x([0-9a-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(c, "([0-9]+)", 1)).cast("long")
    point = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    text = F.aggregate(codes, text, lambda done, c: F.replace(done, c, F.coalesce(point(number(c)), c)))
    for said, meant in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = F.regexp_replace(text, f"(?i)&{said};", meant)
    return text


def page_edges(pages: DataFrame) -> DataFrame:
    """``src, dst`` urls: all canonical links and refresh redirects that the pages' html declares, as they stand there.

    Comments declare nothing; a quoted target ends with its quote, and may hold spaces.
    """
    html = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|$)", "")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
    links = F.filter(tags("link"), lambda t: attribute(t, "rel").rlike(r"(?i)(?<![\w-])canonical(?![\w-])"))
    refresh = F.filter(tags("meta"), lambda t: attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$"))
    target = lambda t: F.regexp_replace(F.regexp_extract(attribute(t, "content"), r"(?is)\burl\s*=\s*(.*)$", 1), r"""(?s)^(["'])(.*?)\1.*$""", "$2")
    to = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(refresh, target))
    to = F.filter(F.transform(to, lambda u: F.trim(F.regexp_replace(unescaped(u), r"[\t\n\r\f]+", " "))), lambda u: u != "")
    return pages.select(F.col("url").alias("src"), F.explode(to).alias("dst")).where("src IS NOT NULL")


def node_of(url: Column) -> Column:
    """The plain form with the query, without keys that only tell where a visit comes from."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(?i)(?<![^&])(?:utm_[^=&]*|gclid|fbclid)(?:=[^&]*)?(?:&|$)", ""), r"&+$", "")
    return F.concat(plain_form(host_of(url), path_of(url)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def declared_classes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, plain, class`` of the nodes that ``edges(src, dst)`` join; ``nodes(plain, node)`` are all pages'.

    A path's queries are pages of their own, unless it has but one: that is a spelling of the path.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select(F.regexp_extract("node", r"(?s)^[^?]*", 0).alias("plain"), "node")
    queried = materialise(ends.where("node <> plain").select("plain").distinct())
    of_pages = nodes.where("node <> plain").join(queried, "plain", "left_semi").select("plain", "node")
    forms = ends.where("node <> plain").unionByName(of_pages).groupBy("plain").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    only = forms.where("low = high").select(F.col("low").alias("src"), F.col("plain").alias("dst"))
    return components(materialise(edges.unionByName(only))).select("node", F.regexp_extract("node", r"(?s)^[^?]*", 0).alias("plain"), F.col("component").alias("class"))


def aliased(judged: DataFrame) -> DataFrame:
    """``judged`` with ``plain`` replaced by the class that the edges from spellings to plain forms make."""
    edges = judged.where("spelling <> plain").select(F.col("spelling").alias("src"), F.col("plain").alias("dst")).distinct()
    named = components(materialise(edges))
    # a class goes by its plain form, by which declared links know it
    ends = edges.select(F.col("dst").alias("form")).distinct()
    form = named.join(ends, F.col("node") == F.col("form")).groupBy("component").agg(F.min("form").alias("form"))
    known = materialise(named.join(form, "component").select(F.col("node").alias("spelling"), "form"))
    return judged.join(known, "spelling", "left").withColumn("plain", F.coalesce("form", "plain")).drop("spelling", "form")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.  ``edges(src, dst)``: further urls that lead to each other."""
    links = page_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    judged = with_rule(judged, rules)
    there = lambda c: F.when(F.col("host") != "", c)
    judged = judged.withColumns({"plain": there(plain_form(F.col("host"), F.col("path"))), "node": there(F.col("node")), "spelling": there(F.concat("host", "path"))})
    judged = judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"), "plain", "node", "spelling")
    judged = materialise(aliased(materialise(judged)))
    # decisions by class of spellings first: only these few rows meet the declared classes
    said = judged.where("plain IS NOT NULL").groupBy("plain").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    said = materialise(said)
    shut = "blocked = 1 AND coalesce(allowed, 0) = 0"
    blocked = materialise(said.where(shut).select("plain", F.lit("block").alias("spread")))
    # declared links join urls with their queries; each has what was decided on its plain form
    known = materialise(links.select(node_of(F.col("src")).alias("src"), node_of(resolved(F.col("dst"), F.col("src"))).alias("dst")).where("src NOT LIKE '/%' AND dst NOT LIKE '/%'").distinct())
    named = materialise(declared_classes(known, judged.where("plain IS NOT NULL")))
    spread = named.join(said, "plain", "left").groupBy("class").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    spread = materialise(spread.select("class", F.when(F.expr(shut), "block").otherwise("allow").alias("declared")))
    declared = materialise(named.join(spread, "class").select("node", "declared"))
    open_rows = judged.where("own IS NULL").join(blocked, "plain", "left").join(declared, "node", "left")
    open_rows = open_rows.withColumn("spread", F.coalesce("declared", "spread"))
    shut_rows = judged.where("own IS NOT NULL")
    out = lambda df, verdict: df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    return out(shut_rows, F.col("own")).unionByName(out(open_rows, F.coalesce("spread", F.lit("allow"))))


_HOST_SQL = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH_SQL = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
#: The tables declare no redirects or canonical links, so classes are the plain forms here.
URL_SQL = f"""
WITH u AS (SELECT page_id, {_HOST_SQL} AS host, {_PATH_SQL} AS path FROM pages),
rules(verdict, h, p) AS (VALUES {_RULES_SQL}),
m AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS own
  FROM (SELECT u.*, r.* FROM u LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
  GROUP BY page_id, host, path),
n AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\\.', '') || '/' ||
    regexp_replace(regexp_replace(ltrim(path, '/'), '\\.html?$', ''), '/+$', '') END AS plain
  FROM m),
c AS (SELECT plain, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM n WHERE plain IS NOT NULL GROUP BY plain)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN c USING (plain)
"""
