"""Connected components of a table of links, as DataFrame operations of bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shared

#: A node with more than this share of all edge ends is a hub; there are fewer than twice as many hubs, so their table is small enough to broadcast.
HUB_SHARE = 1024
#: Up to so many links the smallest neighbours of all nodes are broadcast, 16 MB at most; beyond that only those of hubs.
BROADCAST_LINKS = 250_000


def _with_least(rows: DataFrame, ends: int, few: bool) -> DataFrame:
    """(u, v, m): the rows with the smallest v of their u. The rows of a hub stay where they are, and all rows if they are few; else those of other nodes are shuffled."""
    if few:
        return rows.join(F.broadcast(rows.groupBy("u").agg(F.min("v").alias("m"))), "u")
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    hubs = F.broadcast(least.where(F.col("degree") * HUB_SHARE > ends).select("u", "m"))
    others = least.where(F.col("degree") * HUB_SHARE <= ends).select("u", "m")
    return rows.join(hubs, "u").unionAll(rows.join(hubs, "u", "left_anti").join(others, "u"))


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step: the edges (node, smaller node) after it. With few edges it is one job that shuffles two minima and the result."""
    few = n <= BROADCAST_LINKS
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both, 2 * n, few).select("u", "v", F.least("u", "m").alias("m"))
    large = near.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large if few else shared(large.distinct())
    lower = _with_least(large, n, few)
    hung = lower.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = shared(hung.unionAll(lower.where("v = m").select("u", "v")).distinct())
    release(large)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node that links reach.

    Alternating large-star and small-star steps: a node hands its neighbours on
    to the smallest one until every component is one star. A step takes minima
    (combined before they are shuffled) and joins them to the edges; the edges of
    a hub are not gathered for that, its minimum is broadcast, and so are all
    minima while the edges are few (`BROADCAST_LINKS`). Each step is kept
    in the shared folder and the one before deleted; their number grows with the
    logarithm of the longest chain. Nulls and links of a node with itself are
    passed over; no links give an empty table.
    """
    edges = shared(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    before = None
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = state(edges)
    while now != before and now[0]:
        after = _stars(edges, now[0])
        release(edges)
        edges, before, now = after, now, state(after)
    out = shared(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    release(edges)
    return out
