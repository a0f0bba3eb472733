"""Bounded crawls and bit-parallel searches against plain versions and worked cases."""

import random
from collections import deque

import pytest

from trailmill.operators import crawl, graph

SITE = "https://s.test"


def plain(pages, links, seeds, hops, most, collapse=()):
    """One site, one entry at a time; classes are looked up in a table, so no URL rules are repeated here."""
    nodes, edges, renamed, seen, log, slugs, visits = {}, {}, {}, set(), [], set(), 0
    for canonical, url in seeds:
        nodes.setdefault(canonical, url)
    waiting = deque((n, 0) for n in nodes)

    def now(n):
        while n in renamed:
            n = renamed[n]
        return n

    def kind(url):
        path = url.removeprefix(SITE).split("?")[0].split("#")[0]
        if path.startswith("/products/"):
            return "/products/<*>"
        if path.startswith("/pages/") and path[7:].rstrip("/") in slugs & set(collapse):
            return "/pages/<*>"
        return path

    while waiting:
        queued, depth = waiting.popleft()
        n = now(queued)
        if n in seen:
            log.append((n, depth, "skipped_visited", None))
            continue
        if visits >= most:
            log.append((n, depth, "skipped_cap", None))
            continue
        visits += 1
        page = pages.get(nodes[n])
        if page is None or (page[0] or 0) >= 400:
            seen.add(n)
            log.append((n, depth, "nav_error" if page is None else "http_error", None))
            continue
        end = page[1] or nodes[n]
        new = now(kind(end))
        if new != n:
            renamed[n] = new
            order = [(new if a == n else a, end if a == n else u) for a, u in nodes.items() if a != n or new not in nodes]
            nodes = dict(order)
            nodes.setdefault(new, end)
            fresh = {}
            for (a, b), h in edges.items():
                fresh.setdefault((now(a), now(b)), h)
            edges = fresh
        again = new in seen
        seen.add(new)
        log.append((n, depth, "ok", new if new != n else None))
        if again:
            continue
        slugs |= {h.removeprefix(SITE)[7:].split("?")[0].split("#")[0].rstrip("/") for h in links.get(end, ()) if h.removeprefix(SITE).startswith("/pages/")}
        for h in links.get(end, ()):
            url = SITE + h.removeprefix(SITE).split("?")[0].split("#")[0]
            t = now(kind(h))
            nodes.setdefault(t, url)
            edges.setdefault((new, t), url)
            if depth < hops and t not in seen:
                waiting.append((t, depth + 1))
    return nodes, edges, log


def run(spark, sites, hops, most, collapse=()):
    pages = [(u.replace(SITE, s), p[0], p[1] and p[1].replace(SITE, s)) for s, (ps, _, _) in sites.items() for u, p in ps.items()]
    links = [(u.replace(SITE, s), k, h.replace(SITE, s)) for s, (_, ls, _) in sites.items() for u, hs in ls.items() for k, h in enumerate(hs)]
    seeds = [(s, k, c, u.replace(SITE, s)) for s, (_, _, ss) in sites.items() for k, (c, u) in enumerate(ss)]
    out = crawl.bounded_crawl(
        spark.createDataFrame(pages, "url string, status int, final_url string"),
        spark.createDataFrame(links, "url string, pos int, href string"),
        spark.createDataFrame(seeds, "site string, pos int, canonical string, url string"),
        hops, most, spark.createDataFrame([(c,) for c in collapse], "slug string"),
    )
    back = lambda s, x: x.replace(s, SITE)
    got = {s: ({}, {}, []) for s in sites}
    for r in crawl.crawl_nodes(out).orderBy("site", "pos").collect():
        got[r.site][0][r.canonical] = back(r.site, r.url)
    for r in crawl.crawl_edges(out).orderBy("site", "pos").collect():
        got[r.site][1][r.source, r.target] = back(r.site, r.href)
    for r in crawl.crawl_log(out).orderBy("site", "pos").collect():
        got[r.site][2].append((r.node, r.depth, r.outcome, r.resolved))
    return got


def random_site(r):
    names = [f"/p{k}" for k in range(12)] + [f"/products/x{k}" for k in range(5)] + [f"/pages/m{k}" for k in range(6)]
    urls = [SITE + n for n in names]
    pages = {u: (r.choice([200, 200, None, 404] if r.random() < 0.4 else [200]), r.choice(urls) if r.random() < 0.3 else None) for u in urls if r.random() < 0.9}
    links = {u: [r.choice([SITE, ""]) + r.choice(names) + r.choice(["", "?a=1", "#x"]) for _ in range(r.randint(0, 6))] for u in urls}
    return pages, links, [("/p0", urls[0]), ("/products/<*>", urls[12]), ("/p0", urls[1])][: r.randint(1, 3)]


def test_random_sites(spark):
    r = random.Random(11)
    sites = {f"https://s{k}.test": random_site(r) for k in range(14)}
    for hops, most in ((3, 64), (2, 5), (0, 3)):
        got = run(spark, sites, hops, most, ("m1", "m2", "m4"))
        for s, (pages, links, seeds) in sites.items():
            nodes, edges, log = plain(pages, links, seeds, hops, most, ("m1", "m2", "m4"))
            assert list(got[s][0].items()) == list(nodes.items()), s
            assert list(got[s][1].items()) == list(edges.items()), s
            assert got[s][2] == log, s


def test_a_worked_crawl(spark):
    """A redirect merges two classes and rewires the edge; the second product is its class's first; the budget ends before the last page."""
    pages = {SITE + p: (200, None) for p in ("/", "/b", "/products/1")} | {SITE + "/old": (301, SITE + "/b"), SITE + "/c": (500, None)}
    links = {SITE + "/": ["/old", "/products/1?v=2", "/products/2", "/c", "//else.test/x"], SITE + "/b": ["/", "/d"], SITE + "/products/1": ["/e"]}
    nodes, edges, log = run(spark, {SITE: (pages, links, [("/", SITE + "/")])}, 3, 4)[SITE]
    assert log[:4] == [("/", 0, "ok", None), ("/old", 1, "ok", "/b"), ("/products/<*>", 1, "ok", None), ("/products/<*>", 1, "skipped_visited", None)]
    assert log[4:] == [("/c", 1, "http_error", None), ("/d", 2, "skipped_cap", None), ("/e", 2, "skipped_cap", None)]
    assert edges[("/", "/b")] == SITE + "/old" and nodes["/b"] == SITE + "/b" and "/old" not in nodes
    assert nodes["/products/<*>"] == SITE + "/products/1"


def test_eccentricity(spark):
    r = random.Random(2)
    for n, m in ((90, 200), (1100, 9000), (3, 0), (4, 1)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)} if n != 4 else {(0, 0)}
        out = {}
        for a, b in edges:
            out.setdefault(a, []).append(b)
        far, pairs = 0, 0
        for s in range(n):
            dist, todo = {s: 0}, deque([s])
            while todo:
                a = todo.popleft()
                for b in out.get(a, ()):
                    if b not in dist:
                        dist[b] = dist[a] + 1
                        todo.append(b)
            pairs += len(dist) - 1
            far = max(far, *dist.values())
        nodes = spark.range(n).select("id").withColumnRenamed("id", "node")
        got = graph.eccentricity(nodes, spark.createDataFrame(list(edges), "source long, target long")).first()
        assert (got.diameter, got.pairs) == (far if pairs else None, pairs)


@pytest.mark.parametrize("hops", [1, 3])
def test_empty(spark, hops):
    none = spark.createDataFrame([], "site string, pos int, canonical string, url string")
    out = crawl.bounded_crawl(spark.createDataFrame([], "url string, status int, final_url string"), spark.createDataFrame([], "url string, pos int, href string"), none, hops)
    assert crawl.crawl_log(out).count() == 0
