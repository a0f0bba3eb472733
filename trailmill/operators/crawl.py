"""Bounded breadth-first crawl over stored pages, many sites at once.

The order of a crawl matters: which page of a class is found first, which link
names an edge, what a redirect renames while other links still wait, and where
the budget ends. So the frontier of a site is one state row, and a round takes
the next pages that the budget allows, joins them with the stored pages and
their links, and carries the state on, all sites in parallel. A round ends where
a page is due that was not fetched yet, so there are about as many rounds as
levels. A site's state holds what `most` pages link to.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PAGES_PREFIX, canonical_link
from .ordering import cut

MOST_PAGES = 64
HTTP_ERROR = 400
_STATE = "site string, done boolean, state string, due array<struct<id:string,url:string>>"


class _Crawl:
    """The frontier of one site: nodes by class in order of discovery, edges by pair, renamed classes, classes seen, waiting entries, the log."""

    def __init__(self, state: dict):
        self.s = state

    def name(self, node: str) -> str:
        """What a class is called now."""
        met = set()
        while node in self.s["renamed"] and node not in met:
            met.add(node)
            node = self.s["renamed"][node]
        return node

    def class_of(self, link: dict) -> str:
        slug = link["slug"]
        return PAGES_PREFIX + "<*>" if slug and slug in self.s["slugs"] and link["collapses"] else link["canonical"]

    def rename(self, old: str, link: dict) -> str:
        """The page of class `old` turned out to be another one: nodes, seeds and edges follow."""
        s, new = self.s, self.name(self.class_of(link))
        if new == old:
            return old
        s["renamed"][old] = new
        nodes = {}
        for node, url in s["nodes"].items():
            if node != old:
                nodes[node] = url
            elif new not in s["nodes"]:
                nodes[new] = link["url"]
        nodes.setdefault(new, link["url"])
        s["nodes"] = nodes
        s["seeds"] = list(dict.fromkeys(new if x == old else x for x in s["seeds"]))
        edges = {}
        for (a, b), href in self.edges():
            edges.setdefault(f"{self.name(a)}\n{self.name(b)}", href)
        s["edges"] = edges
        return new

    def edges(self) -> list[tuple[tuple[str, str], str]]:
        return [(tuple(k.split("\n")), href) for k, href in self.s["edges"].items()]

    def scan(self, source: str, depth: int, links: list[dict], hops: int) -> None:
        s = self.s
        s["slugs"].update({x["slug"]: True for x in links if x["slug"]})
        for x in links:
            if x["canonical"] is None:
                continue
            target = self.name(self.class_of(x))
            s["nodes"].setdefault(target, x["url"])
            s["edges"].setdefault(f"{source}\n{target}", x["url"])
            if depth < hops and target not in s["seen"]:
                s["waiting"].append([target, depth + 1])

    def step(self, fetched: dict[str, dict], hops: int, most: int) -> None:
        """Carries on until the frontier is empty or a page is due that is not among the fetched ones."""
        s = self.s
        at = 0
        while at < len(s["waiting"]):
            queued, depth = s["waiting"][at]
            node = self.name(queued)
            url = s["nodes"].get(node)
            log = {"node": node, "url": url, "depth": depth, "status": None, "final_url": None, "resolved": None}
            if url is None:
                at += 1
                continue
            if node in s["seen"]:
                s["log"].append(log | {"outcome": "skipped_visited"})
            elif s["visits"] >= most:
                s["log"].append(log | {"outcome": "skipped_cap"})
            elif url not in fetched:
                break
            else:
                page = fetched[url]
                s["visits"] += 1
                if not page["known"]:
                    s["seen"][node] = True
                    s["log"].append(log | {"outcome": "nav_error"})
                elif page["status"] is not None and page["status"] >= HTTP_ERROR:
                    s["seen"][node] = True
                    s["log"].append(log | {"status": page["status"], "outcome": "http_error"})
                else:
                    final = page["final"] if page["final"]["canonical"] is not None else None
                    new = self.rename(node, final) if final else node
                    again = new in s["seen"]
                    s["seen"][new] = True
                    s["log"].append(log | {"status": page["status"], "outcome": "ok", "resolved": None if new == node else new, "final_url": final["url"] if final and new != node and final["url"] != url else None})
                    if final and not again:
                        self.scan(new, depth, page["links"], hops)
            at += 1
        del s["waiting"][:at]

    def due(self, most: int) -> list[dict[str, str]]:
        """The next pages that can be visited within the budget, by the address of their class."""
        s, out = self.s, {}
        for queued, _ in s["waiting"]:
            node = self.name(queued)
            if len(out) >= most - s["visits"]:
                break
            if node not in s["seen"] and node in s["nodes"]:
                out.setdefault(node, s["nodes"][node])
        return [{"id": n, "url": u} for n, u in out.items()]


def _row(site: str, crawl: _Crawl, most: int) -> pd.DataFrame:
    due = crawl.due(most)
    return pd.DataFrame({"site": [site], "done": [not crawl.s["waiting"]], "state": [json.dumps(crawl.s)], "due": [due]})


def bounded_crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, hops: int, most: int = MOST_PAGES, collapse: DataFrame | None = None) -> DataFrame:
    """(site, state): the finished crawl of each site, read by `crawl_nodes`, `crawl_edges` and `crawl_log`.

    pages is (url, status, final_url): where a visit ends; a null final_url means
    the page itself, a page that is missing cannot be reached. links is (url, pos,
    href) of the pages where visits end. seeds is (site, pos, canonical, url); site
    is the address that links must share the host of. collapse is (slug) of the
    /pages/ that are one class from the moment a link to them is seen. Depth 0 are
    the seeds; links of pages `hops` deep still make edges. At most `most` visits a
    site; pages that fail count.
    """
    slug = lambda c: F.regexp_extract(c, f"^{PAGES_PREFIX}(.*?)/*$", 1)
    link = lambda base, href: canonical_link(base, href)

    def start(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[str, str] = {}
        for x in table.sort_values("pos").itertuples():
            nodes.setdefault(x.canonical, x.url)
        crawl = _Crawl({"nodes": nodes, "seeds": list(nodes), "edges": {}, "renamed": {}, "seen": {}, "slugs": {}, "waiting": [[n, 0] for n in nodes], "log": [], "visits": 0})
        return _row(key[0], crawl, most)

    def carry_on(key: tuple, state: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, dict] = {}
        for x in fetched.sort_values("pos", na_position="first").itertuples():
            page = found.setdefault(x.url, {"known": bool(x.known), "status": None if pd.isna(x.status) else int(x.status), "final": {"canonical": x.final_canonical, "url": x.final_page, "slug": x.final_slug, "collapses": bool(x.final_collapses)}, "links": []})
            if not pd.isna(x.pos):
                page["links"].append({"canonical": x.canonical, "url": x.page, "slug": x.slug, "collapses": bool(x.collapses)})
        crawl = _Crawl(json.loads(state["state"].iloc[0]))
        crawl.step(found, hops, most)
        return _row(key[0], crawl, most)

    marked = (collapse.select("slug").distinct() if collapse is not None else seeds.select(F.lit("").alias("slug")).where(F.lit(False))).withColumn("__c", F.lit(True))
    stored = cut(pages.select("url", F.col("status").cast("long").alias("status"), F.coalesce("final_url", "url").alias("end")).dropDuplicates(["url"]))
    out_links = cut(links.select(F.col("url").alias("end"), F.col("pos").cast("long").alias("pos"), "href"))
    state = cut(seeds.groupBy("site").applyInPandas(start, _STATE))
    finished = None
    while True:
        over, open_ = state.where("done").select("site", "state"), state.where("NOT done")
        finished = over if finished is None else finished.unionAll(over)
        due = open_.select("site", F.explode("due").alias("d")).select("site", F.col("d.url").alias("url"))
        visited = due.join(stored, "url", "left").withColumn("known", F.col("end").isNotNull())
        visited = visited.withColumn("f", link(F.col("site"), F.coalesce("end", "url")))
        wide = visited.join(out_links, "end", "left").withColumn("l", link(F.col("site"), F.col("href")))
        wide = wide.select(F.col("site").alias("host"), "url", "known", "status", "pos", F.col("f.canonical").alias("final_canonical"), F.col("f.url").alias("final_page"), slug(F.col("f.path")).alias("final_slug"), F.col("l.canonical").alias("canonical"), F.col("l.url").alias("page"), slug(F.col("l.path")).alias("slug"))
        wide = wide.join(marked, "slug", "left").withColumnRenamed("__c", "collapses").join(marked.select(F.col("slug").alias("final_slug"), F.col("__c").alias("final_collapses")), "final_slug", "left").na.fill(False, ["collapses", "final_collapses"])
        if open_.isEmpty():
            return cut(finished)
        state = cut(open_.select("site", "state").groupBy("site").cogroup(wide.groupBy("host")).applyInPandas(carry_on, _STATE))


_SCHEMA = "struct<nodes:map<string,string>,seeds:array<string>,edges:map<string,string>,log:array<struct<node:string,url:string,depth:int,status:long,outcome:string,final_url:string,resolved:string>>>"


def _read(crawls: DataFrame) -> DataFrame:
    return crawls.select("site", F.from_json("state", _SCHEMA).alias("s"))


def crawl_nodes(crawls: DataFrame) -> DataFrame:
    """(site, pos, canonical, url) in order of discovery."""
    return _read(crawls).select("site", F.posexplode(F.map_entries("s.nodes")).alias("pos", "e")).select("site", "pos", F.col("e.key").alias("canonical"), F.col("e.value").alias("url"))


def crawl_edges(crawls: DataFrame) -> DataFrame:
    """(site, pos, source, target, href): one edge a pair, by the first link that made it."""
    e = _read(crawls).select("site", F.posexplode(F.map_entries("s.edges")).alias("pos", "e"))
    ends = F.split("e.key", "\n")
    return e.select("site", "pos", ends[0].alias("source"), ends[1].alias("target"), F.col("e.value").alias("href"))


def crawl_log(crawls: DataFrame) -> DataFrame:
    """(site, pos, node, url, depth, status, outcome, final_url, resolved) of every entry that left the frontier."""
    return _read(crawls).select("site", F.posexplode("s.log").alias("pos", "x")).select("site", "pos", "x.*")
