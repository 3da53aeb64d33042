import random

import duckdb
import numpy as np
from tests.llm.helpers import by_key

from xylem.llm import hosts

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, n long, src string"


def link(*urls):
    return "".join(f'<p><A class="x" HREF="{u}">t</a>' for u in urls)


def pages(spark):
    rows = [
        (1, "http://a.net/x", link("http://hub.org/")), (2, "https://WWW.Example.NET/en/1?q", None), (3, "http://example.com/de/", ""), (4, "http://example.com/en/", ""), (5, "http://x.org/fr/1", link("//good.info/a?b", "http://x.org/")),
        (6, None, None), (7, "no scheme", link("http://a.net")), (8, "http://bad.info/", link("http://a.net/1", "http://b.net/", "/local")), (9, "http://good.info#f", link("http://x.org/")), (10, "http://net", None), (11, "http://notnet/", None),
        (12, "http://example.net/en", None), (13, "http://m.good.info/", None), (13, "http://m.good.info/", None), (14, "http://b.net/", None), (None, "http://lone.info/", None), (15, "http://u:p@a.net:80/z", None), (16, "HTTP://A.NET/a://b", None),
    ]
    return spark.createDataFrame([(*r, "h", "p", "r", 1, "s") for r in rows], SCHEMA)


def test_rules_and_graph(spark):
    got = {r.page_id: r for r in hosts.judged(pages(spark)).collect()}
    assert hosts.judged(pages(spark)).count() == 18
    assert (got[1].rule, got[1].verdict) == ("net/", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[3].rule, got[3].verdict, got[4].rule) == ("example.com/de/", "block", None)
    assert (got[5].rule, got[5].verdict) == ("org/fr/", "allow")
    for i in (6, 7):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow")
    assert (got[8].rule, got[8].verdict) == (None, "block")  # links to blocked hosts only
    assert (got[9].host, got[9].path, got[9].verdict) == ("good.info", "", "allow")
    assert got[10].rule is None and got[11].rule is None and got[12].rule == "net/"  # /en isn't below /en/
    assert got[15].host == "u:p@a.net:80" and got[15].rule is None
    assert (got[16].host, got[16].path) == ("a.net", "/a://b")


def web(spark, seed=2):
    """A table rich in links: hubs, chains, cycles and hosts that no page is of."""
    rng = random.Random(seed)
    hosts_ = [f"{rng.choice(['', 'www.', 'm.'])}h{k % 60}.{rng.choice(['net', 'org', 'info', 'com', 'info'])}" for k in range(90)] + ["hub.info"] * 20
    rows = []
    for k in range(500):
        host = rng.choice(hosts_)
        to = [f"http://{rng.choice(hosts_)}/" for _ in range(rng.choice([0, 1, 2, 9, 30]))] + ["http://hub.info/x", "//gone.info/"][: rng.randrange(3)]
        rows.append((k, f"http://{host}{rng.choice(['/', '/fr/', '/de/', '/en/'])}{k}", link(*to)))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_scores_equal_linear_equations(spark):
    """The limit of the rounds, solved as a system of equations."""
    ruled = hosts.with_rules(web(spark))
    seeds, edges = hosts.host_seeds(ruled), hosts.host_edges(ruled, hosts.host_seeds(ruled).select("host"))
    names = sorted({r.host for r in seeds.collect()} | {x for r in edges.collect() for x in (r.src, r.dst)})
    at = {n: k for k, n in enumerate(names)}
    for hub in (3, 10**6):
        got = {(r.kind, r.host): r.score for r in hosts.propagated(seeds, edges, hub).collect()}
        for kind in ("trust", "distrust"):
            m, s = np.zeros((len(names), len(names))), np.zeros(len(names))
            for r in edges.collect():
                a, b = (r.src, r.dst) if kind == "trust" else (r.dst, r.src)
                m[at[a], at[b]] += r.n
            m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
            for r in seeds.collect():
                s[at[r.host]] = r[kind]
            limit = np.linalg.solve(np.eye(len(names)) - hosts.DAMPING * m.T, s)
            assert s.sum() > 1 and np.abs(limit - [got.get((kind, n), 0.0) for n in names]).max() < 1e-4
    verdicts = {r.verdict for r in hosts.judged(web(spark)).where("rule IS NULL").collect()}
    assert verdicts == {"allow", "block"}


def test_long_url_and_html(spark):
    rows = [(1, "http://" + "a" * 50_000 + ".net/" + "x" * 50_000, link(*["http://b.info/"] * 5000)), (2, "http://b.info/", "<a " * 50_000)]
    got = {r.page_id: r for r in hosts.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].verdict == "block" and len(got[1].host) == 50_004 and len(got[1].path) == 50_001 and got[2].verdict == "allow"


def test_sql_counterpart(spark, sf):
    con = duckdb.connect()
    for source in (spark.read.parquet(f"{sf}/pages.parquet"), pages(spark).select("page_id", "url", "html"), web(spark), web(spark, 3)):
        con.register("pages", source.toPandas())
        got = hosts.judged(source)
        assert by_key(got, *got.columns) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({hosts.oracle()})").fetchall(), key=repr)
        con.unregister("pages")


def test_empty_table(spark):
    assert hosts.judged(pages(spark).limit(0)).count() == 0
