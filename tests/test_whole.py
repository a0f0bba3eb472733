"""Registered queries over all their rows: their SQL without its row filter, or a plain version."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import trailmill.plans  # noqa: E402, F401
from test_queries import TABLES, norm  # noqa: E402
from trailmill.operators import graph  # noqa: E402
from trailmill.plans import registry  # noqa: E402
from trailmill.plans.graph_queries import edges  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(df) -> list:
    return sorted((tuple(norm(x) for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def unfiltered(con, name: str, row_filter: str) -> list:
    r = con.execute(registry.oracle_sql()[name].replace(row_filter, ""))
    names = [x[0] for x in r.description]
    return sorted((tuple(norm(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall()), key=repr)


def links(df) -> set:
    """Consecutive pages of all sessions, as a plain loop over the emitted rows."""
    out, last = set(), {}
    for r in sorted(df.where("page <> ''").collect(), key=lambda r: (r.session_id, r.ord)):
        before = last.get(r.session_id)
        if before is not None and before != r.page:
            out.add((before, r.page))
        last[r.session_id] = r.page
    return out


def reached(found: set) -> dict:
    """Breadth-first search from every node."""
    out = {}
    for start in {x for e in found for x in e}:
        depth, level = {start: 0}, [start]
        while level:
            level = list(dict.fromkeys(t for n in level for s, t in found if s == n and t not in depth))
            depth |= dict.fromkeys(level, 1 + max(depth.values()))
        out.update(((start, n), k) for n, k in depth.items())
    return out


def test_graph_of_all_sessions(spark):
    from trailmill.plans.session_queries import emitted

    data = "/root/testdata/sf0.001"
    found = links(emitted(spark, data))
    assert {(r.source, r.target) for r in edges(spark, data).collect()} == found
    paths = reached(found)
    assert {(r.source, r.node): r.depth for r in registry.queries()["gra5_distances"](spark, data).collect()} == paths
    nodes = {s for s, _ in paths}
    got = {r.name: r.value for r in registry.queries()["gra5_env5_graph_metrics"](spark, data).collect()}
    home = "/products/p0"
    assert got == {"n_nodes": len(nodes), "n_edges": len(found), "dead_ends": len(nodes - {s for s, _ in found}), "diameter": max(paths.values()), "to_goal": paths[home, "/products/p3"], "reachable": sum(s == home for s, _ in paths) / len(nodes)}
    assert {(r.node, r.depth) for r in registry.queries()["env4_bounded_crawl"](spark, data).collect()} == {(n, k) for (s, n), k in paths.items() if s == home and k <= 2}
    alias = lambda x: home if x == "/products/p1" else x
    assert {tuple(r) for r in registry.queries()["gra6_merge_aliases"](spark, data).collect()} == {(alias(s), alias(t)) for s, t in found if alias(s) != alias(t)}
    assert sum(r.n for r in registry.queries()["env1_edge_categories"](spark, data).collect()) == len(found) + len(nodes)


def test_distances_beyond_64_steps(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(70)], "source long, target long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in graph.distances(path, start).collect()} == {i: i for i in range(71)}


def test_target_reward_takes_whole_texts(spark, tmp_path):
    from difflib import SequenceMatcher

    a, b = "x" * 100 + "a run that both texts share", "y" * 130 + "a run that both texts share"
    texts = [(0, a, b), (1, a, a), (2, "z" * 90, "z" * 200), (3, "short", "sort"), (4, "", "")]
    spark.createDataFrame([(i, k, "user", t) for i, *p in texts for k, t in enumerate(p)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.reward for r in registry.queries()["rwd1_target_reward"](spark, str(tmp_path)).collect()}
    share = lambda x, y: 2 * SequenceMatcher(None, x, y, False).find_longest_match().size / len(x + y) if x + y else 1.0
    assert got == pytest.approx({i: 0.6 * share(x, y) + 0.1 * (i % 2 == 0) + 0.3 * (x == y) for i, x, y in texts})


def test_holm_over_all_parts(spark, con):
    assert rows(registry.queries()["sta5_holm"](spark, DATA)) == unfiltered(con, "sta5_holm", " WHERE p_partkey <= 200")


def test_price_order_of_all_sessions(spark, con):
    assert rows(registry.queries()["srt3_price_nulls_last"](spark, DATA)) == unfiltered(con, "srt3_price_nulls_last", " WHERE session_id % 20 = 0")


def test_tokens_of_all_languages(spark):
    import re

    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len({w for w in re.findall("[a-z0-9]+", r.text.lower()) if len(w) >= 3 and w not in ("the", "and")}) for r in texts}
    assert {r.doc_id: r.n for r in registry.queries()["fn_tokens"](spark, DATA).collect()} == want


def test_recommendations_for_all_products(spark, con):
    assert rows(registry.queries()["top3_recommendations"](spark, DATA)) == unfiltered(con, "top3_recommendations", " WHERE product_id % 40 = 1")


def test_recommendations_of_repeated_and_missing_tags(spark):
    from trailmill.operators import catalog

    given = [("a", 1, "t", ["X", "y"]), ("b", 2, "t", ["x", "X", "q"]), ("c", 3, None, ["Y"]), ("d", 4, "u", []), ("e", 5, "t", None), ("f", 6, "u", ["y", "x"]), ("g", 7, "t", ["x", "Y"])]
    products = spark.createDataFrame(given, "product_handle string, place int, product_type string, tags array<string>")
    want = []
    for h, _, kind, tags in given:
        own = {x.lower() for x in tags or []}
        best = sorted((-1000 * (bool(kind) and k == kind) - sum(x.lower() in own for x in g or []), p, n) for n, p, k, g in given if n != h)
        want += [(h, i + 1, n, -s) for i, (s, _, n) in enumerate(best[:2])]
    assert sorted(map(tuple, catalog.recommendations(products, products, 2).collect())) == sorted(want)


def test_negatives_and_hash_places(spark):
    from hashlib import sha256

    from trailmill.operators import datasets, sequences

    items = spark.range(40).withColumnRenamed("id", "item")
    pairs = [(0, j) for j in range(1, 40)] + [(j, 0) for j in range(1, 40)] + [(1, j) for j in range(2, 35)]
    met = set(pairs)
    out = sequences.negatives(items, spark.createDataFrame(pairs, "i long, j long"), k=10).collect()
    by = {}
    for r in out:
        by.setdefault(r["item"], []).append(r["negative"])
    for i in range(40):
        free = {j for j in range(40) if j != i and (i, j) not in met}
        got = by.get(i, [])
        assert len(got) == len(set(got)) == min(10, len(free)) and set(got) <= free
    assert sequences.negatives(items.where("item = 0"), spark.createDataFrame([], "i long, j long")).count() == 0

    placed = {r["item"]: r["place"] for r in datasets.hash_places(items, 42, "item").collect()}
    order = sorted(range(40), key=lambda i: sha256(f"42|{i}".encode()).hexdigest())
    assert placed == {i: k for k, i in enumerate(order, 1)}
