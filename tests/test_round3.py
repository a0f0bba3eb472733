"""What the findings of round 3 named, on small tables."""

import hashlib
import re

from pyspark.sql import functions as F

from trailmill.operators import catalog, datasets, fingerprints, graph, sequences, tasks, validation


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_exploded_texts_and_heads_are_dealt_out_by_key(spark):
    texts = spark.range(100).selectExpr("id", "concat('Read title ', id, '! now') AS text")
    names = spark.range(100).selectExpr("concat('title ', id, '!') AS name")
    found = tasks.mentions(texts, names, exact_case=True)
    assert "Broadcast" not in plan(found)
    assert found.count() == 100
    heads = tasks.prefix_matches(spark.createDataFrame([("title 1",)], "prefix string"), names)
    assert "Broadcast" not in plan(heads)
    assert heads.count() == 11


def test_strays_start_from_the_mentioned_products(spark):
    t = spark.createDataFrame([(1, "From Line 1; find title 1!"), (2, "From Line 1; find title 2!"), (3, "find title 2!"), (4, "From Line 1; Line 2; find title 2!")], "task_id int, intent string")
    collections = spark.createDataFrame([("a", "Line 1;", ["p1", None]), ("b", "Line 2;", ["p2"])], "collection string, title string, product_handles array<string>")
    about = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p2"), (4, "p2")], "task_id int, product_handle string")
    lost = validation.strays(t, None, collections, about)
    # The collections' products meet the mentioned ones by handle; no join on the collection alone lists them for each task.
    assert not re.search(r"SortMergeJoin \[collection#\d+\], \[collection#\d+\], Inner|BroadcastHashJoin \[collection#\d+\], \[collection#\d+\], Inner", plan(lost))
    assert [tuple(r) for r in lost.collect()] == [("product-not-in-collection", "warning", 2, "p2")]


def test_a_mean_at_the_threshold_is_not_below_it(spark):
    prices = [39.61, 88.91, 51.48]  # 180 in all, but not when added in this order
    rows = spark.createDataFrame([("at",), ("below",), ("none",)], "k string")
    scores = spark.createDataFrame([("at", p) for p in prices] + [("below", 59.99)], "k string, score double").coalesce(1)
    kept = datasets.gate_by_score(rows, scores, 60.0, "k")
    assert sorted(r["k"] for r in kept.collect()) == ["at", "none"]


def test_folding_ends_after_the_levels_asked_for(spark):
    sha = lambda *texts: hashlib.sha256(f"[{','.join(texts)}]".encode()).hexdigest()
    of = lambda n, **k: sorted(tuple(r) for r in fingerprints.list_fingerprint(spark.range(n).selectExpr("id", "CAST(id AS STRING) AS t"), "t", "id", chunk=2, **k).collect())
    a = [sha("0", "1"), sha("2", "3"), sha("4")]
    two = sha(f'"{a[0]}"', f'"{a[1]}"')
    assert of(5, levels=2) == sorted([(5, two), (5, a[2])])
    assert of(5) == [(5, sha(f'"{two}"', '"' + sha(f'"{a[2]}"') + '"'))]
    assert of(2, levels=2) == of(2) == [(2, a[0])]
    assert of(0, levels=2) == [] and of(0) == [(0, sha())]


def test_pairs_go_into_parts_that_grow_with_the_rows(spark):
    rows = spark.range(900_000).selectExpr("id div 2 AS session", "id % 2 AS pos", "id % 2 + 5 AS item")
    for by in ((), ("i",)):
        pairs = sequences.cooccurrence(rows, *by)
        assert re.findall(r"hashpartitioning\(session#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(pairs)) and set(re.findall(r"hashpartitioning\(session#\d+L?, (\d+)\)", plan(pairs))) == {"5"}
        assert sorted(tuple(r) for r in pairs.collect()) == [(5, 6, 450_000), (6, 5, 450_000)]


def test_tries_that_hit_no_neighbour_are_not_joined(spark):
    items = spark.range(40).select(F.col("id").alias("item"))
    pairs = items.alias("a").join(items.alias("b"), F.expr("a.item <> b.item AND (a.item = 0 OR b.item = 0)")).selectExpr("a.item AS i", "b.item AS j")
    out = sequences.negatives(items, pairs, k=3)
    assert "LeftAnti" not in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault(r["item"], []).append((r["rank"], r["negative"]))
    assert 0 not in got and len(got) == 39
    for item, ranks in got.items():
        assert sorted(r for r, _ in ranks) == [1, 2, 3] and not {0, item} & {x for _, x in ranks}


def test_levels_of_trees_are_dealt_out_by_key(spark):
    nodes = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, "b"), (1, 2, 1, "a")], "tree int, node int, parent int, role string")
    out = graph.tree_statistics(nodes, ("b",))
    assert "Broadcast" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, 3, 1, 2, 1)]


def test_products_are_dealt_out_before_they_are_ranked(spark):
    c = spark.range(60).selectExpr("concat('p', id) AS product_handle", "id AS place", "'t' AS product_type", "array('x') AS tags")
    out = catalog.recommendations(c, c)
    assert re.search(r"hashpartitioning\(product_handle#\d+, \d+\), REPARTITION_BY_NUM", plan(out))
    assert out.where("target = 'p1' AND rank = 1 AND product_handle = 'p0' AND score = 1001").count() == 1
    assert out.count() == 240
