"""Operator 7, URL filters: redirect equivalence.

URLs are normalised; a page's URL, its canonical link, its refresh target and any given redirects are edges between normalised
URLs. Connected components make aliases of one another, and a component with a blocked URL is blocked as a whole, except for URLs
that a rule allows: an explicit allow wins over a block of the URL and over one that comes from an alias, and an
allowed URL passes no block on.

Defined results: one row per page row (page_id, url, node, component, decision, blocked). node is the normalised URL,
component the least node of its aliases (links between pages are resolved against the page's URL, other schemes than a page's are none); decision is allow, block, alias or none. A null or empty URL has null node and component
and the decision none. Repeated rows give a row each. Null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

BLOCK = ["casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com"]
ALLOW = ["free-bets.example.com/fr/"]
#: Rows of all rules that are broadcast at most.
MAX_RULES = 1_000_000

_STEPS = [
    (r"#.*$", ""),
    (r"^[a-z][a-z0-9+.-]*://", ""),
    (r"^(www|m)\.", ""),
    (r"^([^/?]*):(80|443)([/?]|$)", r"$1$3"),
    (r"[?&](utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*", "&"),
    (r"&+", "&"),
    (r"^([^?&]*)&", r"$1?"),
    (r"[?&]+$", ""),
    (r"(/index)?\.html?$", ""),
    (r"/+$", ""),
]
_CANONICAL = r"(?is)<link\s[^>]*rel=[\"']?canonical[\"']?[^>]*>"
_REFRESH = r"(?is)<meta\s[^>]*http-equiv=[\"']?refresh[\"']?[^>]*>"


def normalise(url: Column) -> Column:
    """Lower case, without scheme, www. or m., default port, fragment, tracking parameters, .html and closing slashes."""
    out = F.lower(F.trim(url))
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(out != "", out)


def _link(html: str, pattern: str, attribute: str) -> Column:
    target = F.regexp_extract(F.regexp_extract(html, pattern, 0), attribute, 1)
    return F.when(target != "", target)


def absolute(target: Column, url: Column) -> Column:
    """The URL that a link on the page `url` leads to; null for links of other kinds (mailto:, javascript:) and where the page's URL has no host."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(F.substr(url, F.length(root) + 1), r"[?#].*$", "")
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    folder = F.regexp_replace(page, r"[^/]*$", "")
    full = F.when(path.startswith("/"), path).when(path == "", page).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    step = lambda done, part: F.when(part == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))
    walked = F.aggregate(F.slice(F.split(full, "/", -1), 2, 1 << 20), F.lit(""), step)
    own = F.concat(root, walked, F.substr(target, F.length(path) + 1))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (root != ""), own)


def rule_keys(rules: DataFrame | list[str], spark: SparkSession) -> DataFrame:
    """(key) of each rule: a host, or a host and a path that ends with a slash. Null and empty rules are none."""
    if isinstance(rules, list):
        rules = spark.createDataFrame([(r,) for r in rules], "rule string")
    bare = F.rtrim(F.lower(F.trim("rule")), F.lit("/"))
    return rules.select(F.when(bare.contains("/"), F.concat(bare, F.lit("/"))).otherwise(bare).alias("key")).where("key <> ''").distinct()


def node_keys(node: Column) -> Column:
    """The keys of the rules that may cover a node."""
    path = F.substring_index(node, "?", 1)
    labels = F.split(F.substring_index(F.substring_index(path, "/", 1), ":", 1), "[.]")
    parts = F.split(path, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(hosts, below)


def flags(nodes: DataFrame, block: DataFrame, allow: DataFrame, most: int = MAX_RULES) -> DataFrame:
    """(node, blocked, allowed) of the nodes that some rule covers."""
    rules = block.select("key", F.lit(True).alias("blocked"), F.lit(False).alias("allowed")).union(allow.select("key", F.lit(False), F.lit(True)))
    rules = rules.groupBy("key").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    if rules.limit(most + 1).count() <= most:
        rules = F.broadcast(rules)
    hit = nodes.select("node", F.explode(node_keys(F.col("node"))).alias("key")).join(rules, "key")
    return hit.groupBy("node").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))


def node_id(nodes: DataFrame, hashed: Column | None = None) -> Column:
    """A number for each node: its hash, or another one for those of nodes(node) whose hashes collide (birthdays: some among 10^10 nodes)."""
    hashed = F.xxhash64("node") if hashed is None else hashed
    twice = nodes.groupBy(hashed.alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h").toLocalIterator()
    bad = [r["h"] for r in twice]
    return F.when(hashed.isin(bad), F.xxhash64(F.lit("again"), F.reverse("node"))).otherwise(hashed) if bad else hashed


def filter_pages(spark: SparkSession, pages: DataFrame, block: DataFrame | list[str] = BLOCK, allow: DataFrame | list[str] = ALLOW, redirects: DataFrame | None = None) -> DataFrame:
    scratch = Scratch(spark)
    rows = pages.select("page_id", "url", normalise(F.col("url")).alias("node"), normalise(absolute(_link("html", _CANONICAL, r"(?is)\shref=[\"']?([^\"'\s>]+)"), F.col("url"))).alias("_c"), normalise(absolute(_link("html", _REFRESH, r"(?is)url=[\"']?([^\"'\s>]+)"), F.col("url"))).alias("_r"))
    rows = scratch.save(rows)
    edges = rows.select("node", F.explode(F.array("_c", "_r")).alias("to"))
    if redirects is not None:
        edges = edges.union(redirects.select(normalise(F.col("src")), normalise(F.col("dst"))))
    edges = scratch.save(edges.where("node is not null and to is not null and node <> to").distinct())
    nodes = scratch.save(rows.select("node").union(edges.select("to")).union(edges.select("node")).where("node is not null").distinct())
    number = node_id(nodes)
    ends = edges.select(number.alias("a"), F.col("to").alias("node")).select("a", number.alias("b"))
    comp = components(spark, ends, scratch)
    said = flags(nodes, rule_keys(block, spark), rule_keys(allow, spark))
    placed = nodes.withColumn("_h", number).join(comp.withColumnRenamed("node", "_n"), F.col("_h") == F.col("_n"), "left").join(said, "node", "left")
    placed = placed.select("node", F.coalesce("component", "_h").alias("_component"), F.coalesce("allowed", F.lit(False)).alias("_allow"), F.coalesce("blocked", F.lit(False)).alias("_block"))
    of = placed.groupBy("_component").agg(F.min("node").alias("component"), F.max(F.col("_block") & ~F.col("_allow")).alias("_spread"))
    judged = placed.join(of, "_component").select(F.col("node").alias("_node"), "component", F.when(F.col("_allow"), "allow").when(F.col("_block"), "block").when(F.col("_spread"), "alias").otherwise("none").alias("_decision"))
    out = rows.join(judged, F.col("node") == F.col("_node"), "left")
    decision = F.coalesce("_decision", F.lit("none"))
    return out.select("page_id", "url", "node", "component", decision.alias("decision"), decision.isin("block", "alias").alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(spark, table(spark, sf_dir, "pages"))


def _link_sql(tag: str, attribute: str) -> str:
    """The link of a page's tag, resolved against its URL: written out anew, not made from the patterns above."""
    return f"""
      SELECT page_id, url, nullif(regexp_extract(regexp_extract(html, '{tag}', 0, 'is'), '{attribute}', 1, 'is'), '') AS t,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS root,
             regexp_extract(substr(url, length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) + 1), '^[^?#]*') AS page
      FROM pages"""


def _resolved_sql(links: str) -> str:
    return f"""
      SELECT page_id, url, CASE
          WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
          WHEN t LIKE '//%' THEN 'http:' || t
          WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR root = '' THEN NULL
          ELSE root || list_reduce(string_split(CASE WHEN t LIKE '/%' THEN regexp_extract(t, '^[^?#]*')
                                                     WHEN regexp_extract(t, '^[^?#]*') = '' THEN page
                                                     ELSE coalesce(nullif(regexp_extract(page, '^.*/'), ''), '/') || regexp_extract(t, '^[^?#]*') END, '/')[2:],
                                   lambda done, part: CASE part WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || part END, '')
               || substr(t, length(regexp_extract(t, '^[^?#]*')) + 1) END AS link
      FROM ({links})"""


def _node_sql(url: str) -> str:
    """A URL's node in steps of plain SQL: host, path and the parameters that stay."""
    cut = f"regexp_replace(split_part(lower(trim({url})), '#', 1), '^[a-z][a-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(regexp_extract({cut}, '^[^/?]*'), '^(www|m)[.]', ''), ':(80|443)$', '')"
    path = f"regexp_extract({cut}, '^[^/?]*([^?]*)', 1)"
    tracked = "'^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='"
    params = f"array_to_string(list_filter(string_split(CASE WHEN contains({cut}, '?') THEN substr({cut}, strpos({cut}, '?') + 1) ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, {tracked})), '&')"
    bare = f"regexp_replace(regexp_replace({host} || {path}, '(/index)?[.]html?$', ''), '/+$', '')"
    return f"nullif(CASE WHEN {params} = '' THEN {bare} ELSE {host} || {path} || '?' || {params} END, '')"


_VALUES = ", ".join([f"('{r.strip('/')}', 'block')" for r in BLOCK] + [f"('{r.strip('/')}', 'allow')" for r in ALLOW])
SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, url, {_node_sql('url')} AS node FROM pages),
c AS ({_resolved_sql(_link_sql("<link\\s[^>]*rel=[\"'']?canonical[\"'']?[^>]*>", "\\shref=[\"'']?([^\"''\\s>]+)"))}),
r AS ({_resolved_sql(_link_sql("<meta\\s[^>]*http-equiv=[\"'']?refresh[\"'']?[^>]*>", "url=[\"'']?([^\"''\\s>]+)"))}),
t AS (SELECT {_node_sql('url')} AS a, {_node_sql('link')} AS b FROM (SELECT * FROM c UNION ALL SELECT * FROM r)),
e AS (SELECT DISTINCT a, b FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT node FROM p WHERE node IS NOT NULL UNION SELECT a FROM e UNION SELECT b FROM e),
reach AS (SELECT node, node AS far FROM n UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.far = both_ways.a),
comp AS (SELECT node, min(far) AS component FROM reach GROUP BY node),
rules(rule, kind) AS (VALUES {_VALUES}),
hit AS (SELECT DISTINCT node, kind FROM comp JOIN rules ON CASE WHEN contains(rule, '/') THEN starts_with(split_part(node, '?', 1) || '/', rule || '/')
        ELSE ('.' || split_part(split_part(split_part(node, '?', 1), '/', 1), ':', 1)) LIKE ('%.' || rule) END),
j AS (SELECT node, component, node IN (SELECT node FROM hit WHERE kind = 'allow') AS al, node IN (SELECT node FROM hit WHERE kind = 'block') AS bl FROM comp),
s AS (SELECT *, max(bl AND NOT al) OVER (PARTITION BY component) AS spread FROM j),
d AS (SELECT node, component, CASE WHEN al THEN 'allow' WHEN bl THEN 'block' WHEN spread THEN 'alias' ELSE 'none' END AS decision FROM s)
SELECT page_id, url, p.node, component, coalesce(decision, 'none') AS decision, coalesce(decision IN ('block', 'alias'), false) AS blocked
FROM p LEFT JOIN d ON p.node = d.node
"""
