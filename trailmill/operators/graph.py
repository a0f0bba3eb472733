"""Transition graphs, link tables, trees and vectors between sessions."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot
from .ordering import apart, cut, sorted_places


def distances(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, depth): shortest paths from the start nodes along (source, target) edges, up to `most` steps if it is given.

    A frontier join a step; only new nodes go on, until there are none. Lineage
    is cut each step, so that long paths don't make long plans.
    """
    seen = cut(start.select("node").distinct().select(F.col("node").alias("source"), "node", F.lit(0).alias("depth")))
    frontier = seen
    e = cut(edges.select("source", "target").distinct().select(F.col("source").alias("node"), "target"))
    for depth in range(1, most + 1) if most is not None else count(1):
        step = frontier.select("source", "node").join(e, "node").select("source", F.col("target").alias("node")).distinct().join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth))
        step = cut(step)
        if step.isEmpty():
            break
        seen, frontier = seen.unionByName(step), step
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


WORDS = 16  # longs of a bitmap row: 1,024 sources


def eccentricity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diameter, pairs): the longest shortest path between two different nodes, and how many ordered pairs have one; null and 0 if none has.

    All breadth-first searches run at once: a row is a node and a block of 1,024
    sources, with a bit for each source that has reached it. A step ORs the new
    bits along the edges, so the state is nodes * sources / 8 bytes and no pair of
    nodes ever is a row.
    """
    bits = [f"b{k}" for k in range(WORDS)]
    numbered = cut(sorted_places(nodes.select("node").distinct(), "node", place="n").select("node", (F.col("n") - 1).cast("long").alias("n")))
    e = edges.select("source", "target").where("source <> target").distinct()
    e = cut(e.join(numbered.select(F.col("node").alias("source"), F.col("n").alias("s")), "source").join(numbered.select(F.col("node").alias("target"), F.col("n").alias("t")), "target").select("s", "t"))
    size = WORDS * 64
    own = [F.when(F.expr(f"(n % {size}) div 64 = {k}"), F.expr("shiftleft(1L, CAST(n % 64 AS INT))")).otherwise(F.lit(0).cast("long")).alias(b) for k, b in enumerate(bits)]
    seen = cut(numbered.select("n", F.expr(f"n div {size}").alias("block"), *own))
    fresh, steps, pairs = seen, 0, 0
    zero = F.lit(0).cast("long")
    while True:
        moved = fresh.join(e, fresh["n"] == e["s"]).groupBy(F.col("t").alias("n"), "block").agg(*[F.bit_or(b).alias(f"m{k}") for k, b in enumerate(bits)])
        both = cut(seen.join(moved, ["n", "block"], "full").na.fill(0, [*bits, *[f"m{k}" for k in range(WORDS)]]))
        new = [F.col(f"m{k}").bitwiseAND(F.bitwise_not(F.col(b))).alias(b) for k, b in enumerate(bits)]
        fresh = both.select("n", "block", *new)
        fresh = fresh.where(reduce(or_, [F.col(b) != zero for b in bits]))
        found = fresh.agg(F.sum(reduce(add, [F.bit_count(b) for b in bits]).cast("long")).alias("c")).first()["c"]
        if not found:
            break
        steps, pairs = steps + 1, pairs + found
        seen = both.select("n", "block", *[F.col(b).bitwiseOR(F.col(f"m{k}")).alias(b) for k, b in enumerate(bits)])
    spark = nodes.sparkSession
    return spark.createDataFrame([(steps if pairs else None, pairs)], "diameter long, pairs long")


def graph_metrics(nodes: DataFrame, edges: DataFrame, home: str, goal: str) -> DataFrame:
    """(name, value): sizes, mean degree, dead ends, longest shortest path, share reachable from home, steps from home to the goal."""
    e = edges.select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("d"))
    degrees = nodes.join(out, "node", "left").agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_edges"), F.count_if(F.col("d").isNull()).alias("dead_ends"))
    from_home = distances(edges, nodes.where(F.col("node") == home))
    near = from_home.agg(F.count("*").alias("reached"), F.min(F.when(F.col("node") == goal, F.col("depth"))).alias("to_goal"))
    one = degrees.crossJoin(eccentricity(nodes, edges)).crossJoin(near)  # one row each
    one = one.select(*[F.col(c).cast("double").alias(c) for c in ("n_nodes", "n_edges", "dead_ends", "diameter", "to_goal")], (F.col("reached") / F.col("n_nodes")).alias("reachable"))
    return one.unpivot([], one.columns, "name", "value")


def merge_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with both ends replaced by what they are an alias of, once each; loops that this makes go."""
    a = aliases.select(F.col("alias").alias("source"), F.col("canonical").alias("__s"))
    b = aliases.select(F.col("alias").alias("target"), F.col("canonical").alias("__t"))
    return edges.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("__s", "source").alias("source"), F.coalesce("__t", "target").alias("target")).where("source <> target").distinct()


#: State nodes by the action that leads to them; other states are explored.
STATE_CATEGORIES = {"cart_drawer": "open_cart", "search_overlay": "search", "predictive_panel": "search", "filter_panel_open": "filter", "sort_menu_open": "filter"}


def page_category(path: Column) -> Column:
    """The action that leads to a page, by its canonical path; whole path segments count, but any path that starts with /search is a search."""
    under = lambda p: (path == p) | path.startswith(p + "/")
    return (
        F.when(path == "/", "goto_home")
        .when(under("/cart"), "goto_cart")
        .when(path.startswith("/search"), "search")
        .when(under("/collections"), "goto_collection")
        .when(under("/products"), "goto_product")
        .when(under("/policies"), "goto_policy")
        .otherwise("explore")
    )


def edge_categories(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(category, n): edges by the action that leads to their target. Nodes are (node, kind, state_name); edges to unknown nodes don't count."""
    state = F.lit("explore")
    for name, category in STATE_CATEGORIES.items():
        state = F.when(F.col("state_name") == name, category).otherwise(state)
    category = F.when(F.col("kind") == "state", state).otherwise(page_category(F.col("node")))
    return edges.join(nodes.select("node", "kind", "state_name"), edges["target"] == nodes["node"]).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


#: Roles that add no step to the semantic depth.
UNSEEN_ROLES = ("none", "presentation", "generic", "Section", "StaticText", "InlineTextBox", "LineBreak", "LabelText", "ListMarker", "IframePresentational")


def tree_statistics(nodes: DataFrame, unseen: tuple[str, ...] = UNSEEN_ROLES) -> DataFrame:
    """(tree, n_nodes, n_leaves, depth, semantic_depth) of (tree, node, parent, role) rows; roots have no parent.

    Depths count the edges of the longest path from a root; the semantic one only
    those to a node whose role is named and seen. What no root reaches does not
    count; a node that is reached again (a cycle) is passed over. A join a level,
    kept in the shared folder.
    """
    counts = F.coalesce((F.col("role") != "") & ~F.col("role").isin(*unseen), F.lit(False)).cast("int")
    children = cut(nodes.where("parent IS NOT NULL AND parent <> node").select("tree", F.col("parent").alias("node"), F.col("node").alias("child"), counts.alias("step")))
    level = cut(nodes.where("parent IS NULL").select("tree", "node", F.lit(0).alias("depth"), F.lit(0).alias("semantic_depth")).distinct())
    every = level
    while not level.isEmpty():
        level = level.join(apart(children), ["tree", "node"]).groupBy("tree", F.col("child").alias("node")).agg((F.max("depth") + 1).alias("depth"), F.max(F.col("semantic_depth") + F.col("step")).alias("semantic_depth"))
        level = cut(level.join(apart(every), ["tree", "node"], "left_anti"))
        every = cut(every.unionByName(level))
    inner = children.select("tree", "node").distinct().withColumn("__p", F.lit(1))
    return every.join(apart(inner), ["tree", "node"], "left").groupBy("tree").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("__p").isNull()).alias("n_leaves"), F.max("depth").alias("depth"), F.max("semantic_depth").alias("semantic_depth"))


def role_counts(nodes: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Nodes per tree and group of roles; a role can be in several groups."""
    return nodes.groupBy("tree").agg(F.count("*").alias("n"), *[F.count_if(F.col("role").isin(*roles)).alias(name) for name, roles in groups.items()])


#: What can be done with a node by its role, and the roles that are a choice.
CLICKED = ("button", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "tab", "checkbox", "radio", "switch")
ROLE_ACTIONS = {"click": CLICKED, "dblclick": CLICKED, "hover": CLICKED, "clear": ("textbox", "searchbox"), "fill": ("textbox", "searchbox"), "press": ("textbox", "searchbox"), "select_option": ("combobox", "listbox", "option")}
CHOICES = ("checkbox", "combobox", "listbox", "option", "radio")


def action_space(nodes: DataFrame) -> DataFrame:
    """(tree, action, n): how many visible nodes of a tree each action has, and under `choice` how many are a choice by their role; actions without a node have no row. Rows are (tree, role, hidden)."""
    verbs = F.array_compact(F.array(*[F.when(F.col("role").isin(*roles), verb) for verb, roles in {**ROLE_ACTIONS, "choice": CHOICES}.items()]))
    shown = nodes.where(~F.coalesce("hidden", F.lit(False)))
    return shown.select("tree", F.explode(verbs).alias("action")).groupBy("tree", "action").agg(F.count("*").alias("n"))


def fingerprints_differ(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tree, differs): whether the number of nodes, the histogram of roles or the set of ids of a tree changed. Rows are (tree, role, bid); blank roles and missing ids don't count as such."""

    def marks(df: DataFrame, name: str) -> DataFrame:
        role = F.when(F.coalesce("role", F.lit("")) != "", F.concat(F.lit("role:"), "role"))
        bid = F.when(F.col("bid").isNotNull(), F.concat(F.lit("id:"), F.col("bid").cast("string")))
        every = df.select("tree", F.explode(F.array_compact(F.array(F.lit("node"), role, bid))).alias("mark")).groupBy("tree", "mark").agg(F.count("*").alias("n"))
        return every.select("tree", "mark", F.when(F.startswith("mark", F.lit("id:")), F.lit(1)).otherwise(F.col("n")).alias(name))

    both = marks(before, "a").join(marks(after, "b"), ["tree", "mark"], "full")
    return both.groupBy("tree").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


#: Fixed value: the labels of pages that are one class.
COLLAPSE_LABELS = ("marketing",)


def merge_classifications(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """(path, label, pos): known pages in their order, then those that are new, each by its first label. Rows are (path, label, pos)."""
    rows = known.select("path", "label", F.struct(F.lit(0).alias("k"), "pos").alias("__o")).unionByName(fresh.select("path", "label", F.struct(F.lit(1).alias("k"), "pos").alias("__o")))
    one = rows.groupBy("path").agg(F.min_by("label", "__o").alias("label"), F.min("__o").alias("__o"))
    return sorted_places(one, "__o", "path", place="pos").select("path", "label", (F.col("pos") - 1).alias("pos"))


def collapse_set(classified: DataFrame, labels: tuple[str, ...] = COLLAPSE_LABELS) -> DataFrame:
    """(slug) of the pages whose label makes them one class."""
    return classified.where(F.col("label").isin(*labels)).select(F.col("path").alias("slug")).distinct()


def coherence(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, coherence): mean cosine over all pairs of a group, from the sum of its unit vectors; groups of one go."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = vectors.select(key, F.posexplode(vector).alias("i", "x"), norm.alias("norm")).select(key, "i", (F.col("x").cast("double") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("u"))
    n = vectors.groupBy(key).agg(F.count("*").alias("n"))
    sums = unit.groupBy(key, "i").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q")).groupBy(key).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("t"))
    return sums.join(n, key).where("n > 1").select(key, "n", F.round(F.col("t") / (F.col("n") * (F.col("n") - 1)), 6).alias("coherence"))


def nearest_in_group(synth: DataFrame, real: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """(key, similarity, n): mean over synthetic vectors of the greatest cosine with a real one of the same group.

    Rows are (key, id, v). Both sides of a group are dealt into blocks of bounded
    size, so a large group is many tasks; a task is one product of two matrices
    of unit rows (a vector of zeros is similar to nothing: 0). One key for all
    rows gives the nearest of the whole corpus.
    """
    size = synth.groupBy(key).agg(F.count("*").alias("ns")).join(real.groupBy(key).agg(F.count("*").alias("nr")), key)
    blocks = size.select(key, F.ceil(F.col("ns") / block).cast("int").alias("bs"), F.ceil(F.col("nr") / block).cast("int").alias("br"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    v = F.col("v").cast("array<double>").alias("v")
    left = synth.join(blocks, key).select(key, own("id", "bs").alias("i"), every("br").alias("j"), F.lit(True).alias("asks"), "id", v)
    right = real.join(blocks, key).select(key, every("bs").alias("i"), own("v", "br").alias("j"), F.lit(False).alias("asks"), F.col("id").cast(synth.schema["id"].dataType).alias("id"), v)

    def best_of_block(group: pa.Table) -> pa.Table:
        asks = group.column("asks").combine_chunks()
        rows, others = group.filter(asks), group.filter(pc.invert(asks))
        if len(rows) == 0 or len(others) == 0:
            return rows.select([key, "id"]).slice(0, 0).append_column("m", pa.array([], pa.float64()))
        unit = []
        for part in (rows, others):
            x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            unit.append(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
        return rows.select([key, "id"]).append_column("m", pa.array((unit[0] @ unit[1].T).max(1)))

    kinds = ", ".join(f"`{c}` {synth.schema[c].dataType.simpleString()}" for c in (key, "id"))
    best = left.unionAll(right).groupBy(key, "i", "j").applyInArrow(best_of_block, f"{kinds}, m double").groupBy(key, "id").agg(F.max("m").alias("m"))
    return best.groupBy(key).agg(F.round(F.avg("m"), 6).alias("similarity"), F.count("*").alias("n"))


def corpus_similarity(synth: DataFrame, real: DataFrame) -> DataFrame:
    """(similarity, n_real, n_synth): mean over the distinct synthetic texts of the greatest cosine with a real one; 0 where a side has none. Rows are (text, v); blank texts don't count."""
    distinct = lambda df: df.where("trim(text) <> ''").groupBy("text").agg(F.min_by("v", F.to_json("v")).alias("v"))
    a, b = cut(distinct(synth)), cut(distinct(real))
    keyed = lambda df: df.select(F.lit("all").alias("g"), F.col("text").alias("id"), "v")
    counts = b.agg(F.count("*").alias("n_real")).crossJoin(a.agg(F.count("*").alias("n_synth")))  # one row each
    near = nearest_in_group(keyed(a), keyed(b), "g").agg(F.max("similarity").alias("similarity"))
    return near.crossJoin(counts).select(F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "n_real", "n_synth")  # one row each


def retrieve(memory: DataFrame, query: list[float], now: float, n: int, recent: dict[str, float] | None = None) -> DataFrame:
    """(id, part, rank, score): first all recent pieces of the kinds in `recent` (kind -> greatest age), by time; then the n best.

    A piece's score is (dot product with the query + e**(its time - now) +
    importance) * weight; equal scores go by id. A recent piece can come twice.
    Rows are (id, kind, v, at, importance, weight).
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    score = (dot(F.col("v"), q) + F.exp(F.col("at") - F.lit(now)) + F.col("importance")) * F.col("weight")
    best = memory.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(n)
    ranked = best.select("id", F.lit("ranked").alias("part"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score")  # n rows
    fresh = F.lit(False)
    for kind, age in (recent or {}).items():
        fresh = fresh | ((F.col("kind") == kind) & (F.col("at") >= now - age))
    first = memory.where(fresh).select("id", F.lit("recent").alias("part"), F.row_number().over(Window.orderBy("at", "id")).alias("rank"), F.lit(None).cast("double").alias("score"))  # a few steps back
    return first.unionAll(ranked)
