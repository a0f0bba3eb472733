"""Rules of scoring, selection, trees, pages and catalogs on cases worked by hand or by plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import catalog, graph, scoring


def test_composite_reward(spark):
    """Right target: 1; wrong target: half; wrong action or format: 0; no target: the other terms over their own sum."""
    rows = [(True, True, 1.0, 1.0, 1.0, True), (True, True, 1.0, 1.0, 0.0, True), (True, False, 1.0, 1.0, 1.0, True), (False, True, 1.0, 1.0, 1.0, True), (True, True, 1.0, 1.0, 0.0, False), (True, True, 0.0, 1.0, 0.0, False), (True, True, 0.0, 0.0, 0.5, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f boolean, a boolean, g double, s double, t double, h boolean")
    got = df.select("i", scoring.composite_reward(*[F.col(c) for c in "fagsth"]).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == pytest.approx([1, 0.5, 0, 0, 1, (0.05 + 0.45 * 0.3) / 0.5, 0.05 + 0.25])


def test_token_f1(spark):
    rows = [(1, "a,b", "a b"), (2, "Straße", "STRASSE"), (3, "", None), (4, "x", ""), (5, "a a b", "a b b")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert {r.i: r.f1 for r in scoring.token_f1(df, "i", "a", "b").collect()} == pytest.approx({1: 1, 2: 1, 3: 1, 4: 0, 5: 2 / 3})


def plain_selection(rows, n, least, most):
    ok = {s: (o, set(p)) for s, o, k, p in rows if least <= k <= most and o in scoring.OUTCOMES}
    left = scoring.outcome_quotas({o: sum(x[0] == o for x in ok.values()) for o in scoring.OUTCOMES}, n)
    out, covered = [], set()
    while any(left.values()):
        best = min((s for s in ok if s not in out and left[ok[s][0]]), key=lambda s: (-len(ok[s][1] - covered), s))
        out.append(best)
        covered |= ok[best][1]
        left[ok[best][0]] -= 1
    return out


@pytest.mark.parametrize("batch", [7, 1000])
def test_session_selection(spark, batch):
    r = random.Random(3)
    rows = [(f"s{i:03}", r.choice(["checkout", "cart_abandoned", "browse_only", "browse_only", "other"]), r.randint(0, 9), r.choices([f"p{k}" for k in range(60)], k=r.randint(0, 9))) for i in range(150)]
    df = spark.createDataFrame(rows, "session_id string, outcome string, n_real int, products array<string>")
    assert scoring.select_sessions(df, 30, 2, 8, batch=batch) == plain_selection(rows, 30, 2, 8)
    assert scoring.select_sessions(df.limit(0), 3) == []


def test_quotas():
    assert scoring.outcome_quotas({"checkout": 9, "cart_abandoned": 9, "browse_only": 9}, 8) == {"checkout": 3, "cart_abandoned": 3, "browse_only": 2}
    assert scoring.outcome_quotas({"checkout": 1, "browse_only": 9}, 8) == {"checkout": 1, "cart_abandoned": 0, "browse_only": 7}
    assert scoring.outcome_quotas({"checkout": 1}, 8) == {"checkout": 1, "cart_abandoned": 0, "browse_only": 0}


def test_tree_depth(spark):
    """A root alone has depth 0; unseen roles add nothing; what no root reaches, and a ring, do not count or hang."""
    rows = [(1, "r", None, "RootWebArea"), (1, "a", "r", "generic"), (1, "b", "a", "button"), (1, "c", "b", ""), (2, "x", None, "RootWebArea"), (2, "y", "z", "link"), (2, "z", "y", "link"), (3, "s", None, "x"), (3, "s", "s", "x")]
    got = {r.tree: (r.n_nodes, r.n_leaves, r.depth, r.semantic_depth) for r in graph.tree_statistics(spark.createDataFrame(rows, "tree int, node string, parent string, role string")).collect()}
    assert got == {1: (4, 1, 3, 1), 2: (1, 1, 0, 0), 3: (1, 1, 0, 0)}


def test_page_categories(spark):
    want = {"/": "goto_home", "/cart": "goto_cart", "/cart/x": "goto_cart", "/cartoon": "explore", "/search?q=a": "search", "/searching": "search", "/collections": "goto_collection", "/collections/a": "goto_collection", "/products/a": "goto_product", "/productsx": "explore", "/policies/p": "goto_policy", "/pages/a": "explore"}
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", graph.page_category(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == want
    edges = spark.createDataFrame([("/", t) for t in ("d", "o", "f", "m", "gone", "/cart")], "source string, target string")
    nodes = spark.createDataFrame([("d", "state", "cart_drawer"), ("o", "state", "search_overlay"), ("f", "state", "sort_menu_open"), ("m", "state", "modal"), ("/cart", "page", None)], "node string, kind string, state_name string")
    assert {r.category: r.n for r in graph.edge_categories(edges, nodes).collect()} == {"open_cart": 1, "search": 1, "filter": 1, "explore": 1, "goto_cart": 1}


def test_encoded_variants(spark):
    rows = [(1, [0]), (1, [2]), (1, [1]), (2, [0, 1]), (2, [0, 0]), (2, [0, 1]), (2, [10, 0]), (3, [0, 1, 0]), (4, [])]
    got = {r.product: r.code for r in catalog.encoded_variants(spark.createDataFrame(rows, "product int, places array<int>")).collect()}
    assert got == {1: "v1_0 1 2", 2: "v1_0:0,0:1,10:0,", 3: "v1_0:1:0,,", 4: ""}


def test_blank_types_have_no_price_bins(spark):
    rows = [("a", "t", 1.0), ("b", "t", 6.0), ("c", " ", 2.0), ("d", None, 3.0), ("e", "u", None)]
    df = spark.createDataFrame(rows, "product_handle string, product_type string, price double")
    assert {r.product_type: r.edges for r in catalog.price_edges(df).collect()} == {"t": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}
    seen = spark.createDataFrame([(h,) for h in "abcdez"], "product_handle string")
    got = {r.product_handle: (r.product_category, r.price_bucket) for r in catalog.with_catalog(seen, df).collect()}
    assert got == {"a": ("t", "1"), "b": ("t", "5"), "c": ("", ""), "d": ("", ""), "e": ("", ""), "z": ("", "")}
