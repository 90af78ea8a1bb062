import random

import pytest
from pyspark.sql import functions as F

from lotwise.llm import url_filter as U
from lotwise.llm.common import Scratch, components

SCHEMA = "page_id bigint, url string, html string"
BAD, OK = ["bad.example.com"], ["bad.example.com/good/", "fine.example.com"]


def link(u):
    return f'<html><head><LINK REL="canonical" href="{u}"></head></html>'


def refresh(u):
    return f'<html><head><meta http-equiv="refresh" content="0; url={u}"></head></html>'


def test_normal_forms(spark):
    urls = {
        "http://www.X.example.com/a/?utm_source=feed": "x.example.com/a",
        "https://m.x.example.com:443/a.html#top": "x.example.com/a",
        "x.example.com/a?b=2&ref=x&c=3": "x.example.com/a?b=2&c=3",
        "http://x.example.com/a?ref=x&b=2": "x.example.com/a?b=2",
        "http://x.example.com/": "x.example.com",
        "http://x.example.com/d/index.html": "x.example.com/d",
        "  ": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.normalise(F.col("url")).alias("n")).collect()
    assert {r.url: r.n for r in rows} == urls


def test_blocks_reach_aliases_and_allows_win(spark):
    pages = [
        (1, "http://bad.example.com/x", ""),
        (2, "http://alias.example.com/1", link("http://www.bad.example.com/x/")),
        (3, "http://alias.example.com/2", refresh("http://alias.example.com/1")),
        (4, "http://fine.example.com/a", link("http://bad.example.com/x")),
        (5, "http://bad.example.com/good/page", ""),
        (6, "http://friend.example.com/a", link("http://bad.example.com/good/page")),
        (7, "http://other.example.com/a", link("/b")),
        (8, "https://www.other.example.com/b.html", None),
        (9, "http://sub.bad.example.com/", ""),
        (10, "http://notbad.example.com/", ""),
        (11, None, ""),
        (12, "", link("http://bad.example.com/x")),
        (2, "http://alias.example.com/1", link("http://www.bad.example.com/x/")),
    ]
    df = spark.createDataFrame(pages, SCHEMA).withColumns({c: F.lit(1) for c in ("node", "component", "decision", "_h", "a")})
    rows = U.filter_pages(spark, df, BAD, OK).collect()
    got = {r.page_id: r.decision for r in rows}
    assert got == {1: "block", 2: "alias", 3: "alias", 4: "allow", 5: "allow", 6: "none", 7: "none", 8: "none", 9: "block", 10: "none", 11: "none", 12: "none"}
    comp = {r.page_id: r.component for r in rows}
    assert comp[1] == comp[2] == comp[3] == comp[4] and comp[7] == comp[8] and comp[11] is None
    assert len(rows) == len(pages) and all(r.blocked == (r.decision in ("block", "alias")) for r in rows)


def test_links_are_resolved_against_their_page(spark):
    page = "http://h.example.com/a/b.html?q=1#x"
    want = {
        "other.html": "http://h.example.com/a/other.html", "../x": "http://h.example.com/x", "../../x": "http://h.example.com/x", "./y/../z?k=1": "http://h.example.com/a/z?k=1",
        "?id=2": "http://h.example.com/a/b.html?id=2", "#top": "http://h.example.com/a/b.html#top", "/r/s/..": "http://h.example.com/r", "//k.example.com/1": "http://k.example.com/1",
        "https://k.example.com/": "https://k.example.com/", "mailto:x@y": None, "javascript:void(0)": None,
    }
    rows = spark.createDataFrame([(t, page) for t in want], "t string, url string").select("t", U.absolute(F.col("t"), F.col("url")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == want
    bare = spark.createDataFrame([("x", "http://h.example.com"), ("x", "no-scheme/a")], "t string, url string").select(U.absolute(F.col("t"), F.col("url")).alias("u")).collect()
    assert [r.u for r in bare] == ["http://h.example.com/x", None]


@pytest.mark.parametrize("most", [0, 100])
def test_rules_are_tables(spark, most):
    """Joined by key, broadcast or not, they cover what a plain search over all rules covers."""
    rng = random.Random(8)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    urls = sorted({h + "".join("/" + rng.choice("xyz") for _ in range(rng.randrange(4))) + rng.choice(["", "?q=1/2"]) for h in hosts for _ in range(4)})
    kinds = {k: sorted({h + "".join("/" + rng.choice("xyz") for _ in range(rng.randrange(3))) + rng.choice(["", "/"]) for h in rng.sample(hosts, 12)}) for k in ("block", "allow")}

    def covers(rule, node):
        path = node.split("?")[0]
        rule = rule.strip("/")
        return (path + "/").startswith(rule + "/") if "/" in rule else ("." + path.split("/")[0]).endswith("." + rule)

    tables = [U.rule_keys(spark.createDataFrame([(r, 1) for r in kinds[k]] + [(None, 1), (" ", 1)], "rule string, key int"), spark) for k in ("block", "allow")]
    got = {r.node: (r.blocked, r.allowed) for r in U.flags(spark.createDataFrame([(u,) for u in urls], "node string"), *tables, most).collect()}
    for u in urls:
        assert got.get(u, (False, False)) == tuple(any(covers(r, u) for r in kinds[k]) for k in ("block", "allow")), u


def test_colliding_hashes_are_told_apart(spark):
    nodes = spark.createDataFrame([("ab",), ("cd",), ("efg",)], "node string")
    number = U.node_id(nodes, F.length("node").cast("bigint"))
    assert len({r[0] for r in nodes.select(number).collect()}) == 3


def test_sql_agrees_on_pages_with_links(spark):
    import duckdb

    rng = random.Random(5)
    hosts = ["casino-win.example.com", "free-bets.example.com", "a.example.com", "b.example.com:8080", "www.c.example.com"]
    url = lambda: rng.choice(["http://", "https://m.", ""]) + rng.choice(hosts) + rng.choice(["", "/", "/fr/x", "/p/q.html", "/p/index.htm", "/p?utm_id=1&k=2", "?ref=a", "/p/?a=1&&b=2#f"])
    target = lambda: rng.choice([url(), "/p/q", "../x.html", "y?k=2", "//a.example.com/z", "?a=1", "mailto:x", "."])
    rows = [(i, rng.choice([url(), url(), url(), None]), rng.choice([None, "", link(target()), refresh(target()), link(target()) + refresh(target())])) for i in range(150)]
    got = sorted(map(str, U.filter_pages(spark, spark.createDataFrame(rows, SCHEMA)).collect()))
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    cur = con.execute(U.SQL)
    names = [c[0] for c in cur.description]
    assert got == sorted(str(spark_row) for spark_row in (__import__("pyspark").sql.Row(**dict(zip(names, r))) for r in cur.fetchall()))


def test_given_redirects(spark):
    df = spark.createDataFrame([(1, "http://a.example.com", None)], SCHEMA)
    red = spark.createDataFrame([("http://a.example.com/", "http://hop.example.com"), ("http://hop.example.com", "http://bad.example.com/z"), (None, "x"), ("x", None)], "src string, dst string")
    assert U.filter_pages(spark, df, BAD, OK, red).first()["decision"] == "alias"


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_a_plain_search(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (4, None), (5, 5)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), Scratch(spark)).collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
    assert got == want


def test_no_pages(spark):
    assert U.filter_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0
