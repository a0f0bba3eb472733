"""Answers, tails, salvaged sessions, page fingerprints and vectors against plain versions and worked cases."""

import hashlib
import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import trailmill.plans  # noqa: F401
from trailmill.functions import scalars as X
from trailmill.operators import datasets, fidelity, graph, scoring
from trailmill.plans import registry

DATA = "/root/testdata/sf0.001"


def test_answers(spark):
    ok = {"rationale": "r", "action": "back"}
    cases = [
        (ok, True), (ok | {"more": {"a": 1}}, True), ({"action": "back"}, False), (ok | {"rationale": None}, False), (ok | {"action": "fly"}, False), (ok | {"action": 3}, False),
        (ok | {"action": "click"}, False), (ok | {"action": "click", "target": ""}, True), (ok | {"action": "click", "target": None}, False), (ok | {"action": "type", "target": "t", "text": "x"}, True),
        (ok | {"action": "type", "target": "t", "text": "x", "enter": False}, True), (ok | {"action": "type", "target": "t", "text": "x", "enter": "yes"}, False), (ok | {"action": "type", "text": "x"}, False),
        (ok | {"action": "select", "value": "v"}, True), (ok | {"action": "select", "value": 1}, False), (ok | {"action": "key_press", "key": "a"}, True), (ok | {"action": "key_press", "key": "a", "target": 1}, False),
        (ok | {"action": "scroll", "direction": "down", "amount": 1}, True), (ok | {"action": "scroll", "direction": "down", "amount": 0.5, "target": "t"}, True), (ok | {"action": "scroll", "direction": "down", "amount": True}, False), (ok | {"action": "scroll", "direction": "side", "amount": 1}, False), (ok | {"action": "scroll", "direction": 1, "amount": 1}, False),
        (ok | {"action": "goto_url", "url": "u"}, True), (ok | {"action": "new_tab"}, False), (ok | {"action": "close_tab", "tab_id": 0}, True), (ok | {"action": "switch_tab", "tab_id": 1.5}, False), (ok | {"action": "switch_tab", "tab_id": True}, False), ([ok], False), ("text", False), (None, False), ({}, False),
    ]
    texts = [(json.dumps(v), w) for v, w in cases] + [("", False), ("{oops", False), ("  " + json.dumps(ok) + "\n", True), (json.dumps(ok) + " and more", False)]
    frame = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(texts)] + [(999, None, False)], "i int, t string, want boolean")
    for r in frame.select("t", "want", X.valid_answer(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_components(spark):
    page = "<i data-semantic-id='buy'><b parser-semantic-id=\"a&amp;b\">"
    rows = [
        (json.dumps({"rationale": "r", "action": "click", "target": "buy"}), "click", "buy", page, (1, 1, 1.0)),
        (json.dumps({"rationale": "r", "action": "click", "target": "a&b"}), "click", "buy", page, (1, 1, 0.1 + 0.6 * 2 / 6)),  # one letter in common: b
        (json.dumps({"action": "click"}), "click", None, page, (0, 1, 0.9)),
        ("broken", "click", "", None, (0, 0, 0.9)),
        (json.dumps({"rationale": "r", "action": "back"}), "", "x", page, (1, 0, 0.0)),
    ]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, a string, g string, p string")
    got = frame.select("i", X.answer_components(F.col("t"), F.col("a"), F.col("g"), F.col("p"), scoring.similar_share).alias("c")).select("i", "c.*").orderBy("i").collect()
    for r, (*_, want) in zip(got, rows, strict=True):
        assert (r.format, r.action, r.target) == pytest.approx(want), r


def test_tails(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.99, 3.0, 3.01, 4.2, 5.0, 8.0, 12.0, 26.0]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    got = frame.select("x", scoring.erfc(F.col("x")).alias("e"), scoring.normal_tail(-F.col("x")).alias("n"), *[scoring.chi_square_tail(F.col("x"), k).alias(f"c{k}") for k in range(1, 8)]).collect()

    def gamma_tail(k, x):
        """Midpoint sums of the density, by a substitution that is smooth at 0."""
        t = np.linspace(0, math.sqrt(x), 400_001)
        t = (t[1:] + t[:-1]) / 2
        return 1 - (2 * t ** (k - 1) * np.exp(-t * t / 2)).sum() * math.sqrt(x) / 400_000 / (2 ** (k / 2) * math.gamma(k / 2))

    for r in got:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-10, abs=1e-300) and r.n == pytest.approx(math.erfc(r.x / math.sqrt(2)), rel=1e-9)
        for k in range(1, 8):
            assert r[f"c{k}"] == pytest.approx(gamma_tail(k, r.x), abs=1e-8)
    value = {r.event_id: r.p for r in registry.queries()["sta_normal_tail"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "value").collect()
    assert len(value) == len(rows) and all(value[r.event_id] == pytest.approx(math.erfc(abs(r.value - 50) / 7 / math.sqrt(2)), rel=1e-8) for r in rows)


def test_chi_square_of_two_outcomes(spark):
    side = lambda n, m: spark.createDataFrame([(i, 0, "checkout" if i < n else "detail") for i in range(n + m)], "session_id int, ord int, action string")
    r = fidelity.chi_square(side(12, 5), side(9, 8)).first()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((12, 10.5), (5, 6.5), (9, 10.5), (8, 6.5)))
    assert (r.dof, r.statistic, r.p) == (1, pytest.approx(want), pytest.approx(math.erfc(math.sqrt(want / 2))))
    alone = fidelity.chi_square(side(3, 0), side(4, 0)).first()
    assert (alone.dof, alone.statistic, alone.p) == (0, 0.0, 1.0)
    z = fidelity.two_proportions(side(12, 5), side(9, 8)).first()
    assert z.p == pytest.approx(math.erfc(abs(z.z) / math.sqrt(2))) and fidelity.two_proportions(side(3, 0), side(4, 0)).first().p is None


def test_salvaged_sessions(spark):
    rows = [(s, k, k == at) for s, (n, at) in enumerate([(4, None)] * 6 + [(5, 3), (5, 2), (5, 1), (5, 0), (6, 4), (9, 8)]) for k in range(n)]
    frame = spark.createDataFrame(rows, "s int, k int, a boolean")
    order = sorted(range(6, 12), key=lambda i: hashlib.sha256(f"42|{i}".encode()).hexdigest())
    full, at = {s: sum(r[0] == s for r in rows) for s in range(12)}, {6: 3, 7: 2, 8: 1, 9: 0, 10: 4, 11: 8}

    def want(ratio, target):
        if ratio >= 1 or 6 <= (cap := int(ratio * 6 / (1 - ratio)) if ratio > 0 else 0):
            return full
        out = {s: 4 for s in range(6)} | {s: full[s] for s in order[:cap]}
        for s in order[cap:]:
            if target is not None and len(out) < target and at[s] >= 2:
                out[s] = at[s]
        return out

    for ratio, target in ((0.25, None), (0.25, 9), (0.25, 100), (0, 8), (0.5, 3), (1.0, None), (0.9, 4)):
        got = {r.s: r.n for r in datasets.control_adds(frame, "s", "k", F.col("a"), ratio, target).groupBy("s").agg(F.count("*").alias("n")).collect()}
        assert got == want(ratio, target), (ratio, target)


def test_page_fingerprints(spark):
    before = [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", "x"), (4, "a", "x"), (5, "a", None), (6, "", "x"), (7, "a", "x"), (7, "a", "x")]
    after = [(1, "b", "y"), (1, "a", "x"), (2, "a", "z"), (3, "c", "x"), (4, "a", "x"), (4, None, None), (5, "a", None), (6, None, "x"), (7, "a", "x"), (7, "a", "x"), (8, "a", "x")]
    frame = lambda rows: spark.createDataFrame(rows, "tree int, role string, bid string")
    got = {r.tree: r.differs for r in graph.fingerprints_differ(frame(before), frame(after)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: True}


def test_classifications(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, label string, pos int")
    merged = graph.merge_classifications(frame([("a", "info", 0), ("b", "marketing", 1)]), frame([("c", "marketing", 0), ("a", "marketing", 1), ("d", "info", 2), ("c", "info", 3)]))
    assert [(r.path, r.label) for r in merged.orderBy("pos").collect()] == [("a", "info"), ("b", "marketing"), ("c", "marketing"), ("d", "info")]
    assert {r.slug for r in graph.collapse_set(merged).collect()} == {"b", "c"}


def test_vectors(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {}
    for r in registry.queries()["vec5_text_vectors"](spark, DATA).collect():
        got.setdefault(r.doc_id, {})[r.i] = r.n
    words = {w for t in docs.values() for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w}
    place = {r.w: r.p for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("p")).collect()}
    for i, v in got.items():
        want = [0.0] * 64
        for w in re.split(r"[ \t\n\x0b\f\r]+", docs[i].lower()):
            if w:
                want[place[w]] += 1
        assert [v[k] for k in range(64)] == want
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found = {}
    for r in registry.queries()["vec6_principal_components"](spark, DATA).collect():
        found.setdefault(r.id, {})[r.i] = r.x
    ids = sorted(found)
    m = np.array([x[i] for i in ids])
    m = m - m.mean(0)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    want, have = m @ vt[:16].T, np.array([[found[i][k] for k in range(16)] for i in ids])
    assert np.allclose(np.abs(want), np.abs(have), atol=1e-6)  # a component's sign is free


def test_negatives_of_the_query(spark):
    from trailmill.operators import sequences
    from trailmill.plans.sequence_queries import clean

    rows = clean(spark, DATA)
    met = {(r.i, r.j) for r in sequences.cooccurrence(rows).collect()}
    items = {r.item for r in rows.select("item").distinct().collect()}
    got = {}
    for r in registry.queries()["smp8_negatives"](spark, DATA).collect():
        got.setdefault(r.item, {})[r["rank"]] = r.negative
    for i in items:
        own = got.get(i, {})
        free = len(items) - 1 - sum((i, j) in met for j in items if j != i)
        assert sorted(own) == list(range(1, min(10, free) + 1)) and len(set(own.values())) == len(own)
        assert all(j in items and j != i and (i, j) not in met for j in own.values())


def test_catalog_axes_and_tasks(spark):
    from trailmill.operators import catalog, tasks

    opts = "place int, options array<struct<name:string>>, variants array<int>"
    p = spark.createDataFrame([(2, [("Color",), (" size ",)], [1, 2]), (1, [("SIZE",), ("",), (None,)], [1]), (3, None, None), (4, [("Fit",), ("color",)], [])], opts)
    assert [r.axis for r in catalog.option_axes(p).orderBy("place").collect()] == ["size", "color", "fit"]
    assert tuple(catalog.multi_variant_share(p).first()) == (4, 0.25) and tuple(catalog.multi_variant_share(p.limit(0)).first()) == (0, 0.0)
    pages = spark.createDataFrame([(3, "Ship", "b"), (1, "x", "shipping"), (2, "about", "a")], "place int, title string, handle string")
    assert [r.url for r in tasks.policy_task(pages, "/policies/p", "ship").orderBy("pos").collect()] == ["/pages/shipping", "/pages/b", "/policies/p"]
    assert [r.url for r in tasks.policy_task(pages, "/pages/b", "ship").orderBy("pos").collect()] == ["/pages/shipping", "/pages/b"]
    assert [r.url for r in tasks.policy_task(pages, "/policies/p", "return").collect()] == ["/policies/p"]
    assert [r.title for r in catalog.point_lookup(pages.withColumn("k", F.lit("v")), "k", "v").collect()] == ["x"]


def test_carved_sessions(spark):
    keys = spark.range(40).withColumnRenamed("id", "session")
    order = sorted(range(40), key=lambda i: hashlib.sha256(f"42|{i}".encode()).hexdigest())
    for most in (None, 0, 7, 36):
        got = {r.session: r.split for r in datasets.carve(keys, 0.1, most).collect()}
        assert got == {i: "val" if k < 4 else "train" for k, i in enumerate(order[: 40 if most is None else 4 + most])}
    with pytest.raises(ValueError):
        datasets.carve(keys, 0.1, 37)
    assert datasets.carve(keys.limit(0), 0.1).count() == 0 and datasets.carve(keys.limit(1), 0.1).first().split == "val"


def test_action_space_and_corpus_similarity(spark):
    rows = [(1, "button", False), (1, "link", None), (1, "radio", False), (1, "searchbox", False), (1, "combobox", False), (1, "slider", False), (1, "button", True), (2, None, False)]
    got = {(r.tree, r.action): r.n for r in graph.action_space(spark.createDataFrame(rows, "tree int, role string, hidden boolean")).collect()}
    assert got == {(1, a): n for a, n in {"click": 3, "dblclick": 3, "hover": 3, "clear": 1, "fill": 1, "press": 1, "select_option": 1, "choice": 2}.items()}
    frame = lambda rows: spark.createDataFrame(rows, "text string, v array<double>")
    real = frame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("a", [1.0, 0.0]), (" ", [1.0, 1.0])])
    synth = frame([("x", [2.0, 0.0]), ("x", [2.0, 0.0]), ("y", [1.0, 1.0]), (None, [5.0, 5.0])])
    r = graph.corpus_similarity(synth, real).first()
    assert (r.similarity, r.n_real, r.n_synth) == (pytest.approx((1 + math.sqrt(0.5)) / 2, abs=1e-6), 2, 2)
    assert tuple(graph.corpus_similarity(synth.limit(0), real).first()) == (0.0, 2, 0)
