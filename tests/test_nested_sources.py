"""Nested documents, record fingerprints, simulated sessions, templated and polled sources, registries."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from tests import fakes

from trailmill.operators import fingerprints, nested, synthetic
from trailmill.sources import readers, warehouse, writers


def walk(v, path="", out=None):
    out = [] if out is None else out
    out.append((path, v))
    if isinstance(v, dict):
        for k in sorted(v):
            walk(v[k], f"{path}.{k}" if path else k, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            walk(x, f"{path}[{i}]", out)
    return out


DOCS = [
    {"b": [1, {"c": "x", "a": [[], {}]}], "a": None, "z": True, "m": 1.5},
    [],
    "alone",
    {"items": [{"title": "One", "url": "/1", "items": [{"title": "In", "url": None}, {"url": "/n"}]}, {"title": "Two", "url": "/2"}], "k": {"items": [{"title": "Other", "url": "/o"}]}},
]


def test_nodes_are_depth_first(spark):
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(8, "{no"), (9, None)], "id int, doc string")
    rows = nested.nodes(frame, "id", "doc").orderBy("id", "place").collect()
    for i, d in enumerate(DOCS):
        own = [r for r in rows if r.id == i]
        want = walk(d)
        assert [r.path for r in own] == [p for p, _ in want]
        for r, (_, v) in zip(own, want, strict=True):
            if isinstance(v, (dict, list)):
                assert r.kind == ("OBJECT" if isinstance(v, dict) else "ARRAY") and r.text is None
            elif v is None:
                assert r.kind == "VOID" and r.text is None
            else:
                assert r.text == (json.dumps(v) if not isinstance(v, str) else v)
    assert [(r.kind, r.path) for r in rows if r.id == 8] == [("INVALID", "")] and not [r for r in rows if r.id == 9]
    ordered = nested.nodes(frame.where("id = 0"), "id", "doc", order=("z", "m", "b")).orderBy("place").collect()
    assert [r.path for r in ordered if "." not in r.path and "[" not in r.path] == ["", "z", "m", "b", "a"]
    assert {r.pattern for r in ordered} >= {"b[].a[]", "b[].c"}
    assert nested.nodes(frame.limit(0), "id", "doc").count() == 0


def test_leaks(spark):
    docs = [{"products": [{"title": "plain"}, {"note": "An ACME lamp", "title": "acme"}], "pages": ["acmes", "Nikea"]}, {"a": "nike,", "b": {"c": "Acme"}}, {"x": ["none", 3]}, {"k": "c++ and C++x", "l": "acme.co"}]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    walked = nested.nodes(frame, "id", "doc")
    assert {r.id: (r.path, r.token) for r in nested.first_leaks(walked, "id", ["acme", "Nike", "c++"]).collect()} == {0: ("products[1].note", "ACME"), 1: ("a", "nike"), 3: ("k", "c++")}
    assert {r.id: (r.path, r.token) for r in nested.first_leaks(walked, "id", ["acme", "Nike"], ["ACME"]).collect()} == {1: ("a", "nike")}
    assert nested.first_leaks(walked, "id", []).count() == 0


def test_closed_schema(spark):
    f = nested.Field
    schema = {"": f(("OBJECT",)), "id": f(nested.WHOLE), "tags": f(("ARRAY",), required=False), "tags[]": f(nested.TEXT), "p": f(("OBJECT",), nullable=True), "p.price": f(nested.NUMBER), "p.on": f(nested.FLAG, required=False), "rows": f(("ARRAY",)), "rows[]": f(("OBJECT",)), "rows[].k": f(nested.TEXT)}
    docs = {
        0: {"id": 1, "p": {"price": 1.5, "on": True}, "rows": []},
        1: {"id": "1", "p": None, "rows": [{"k": "a"}, {}, {"k": 2, "x": {"deep": [1]}}], "tags": ["a", 1]},
        2: {"p": {}, "rows": {}, "more": {"a": 1}},
        3: [1],
    }
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(4, "nope")], "id int, doc string")
    got = {}
    for r in nested.schema_errors(nested.nodes(frame, "id", "doc"), "id", schema).collect():
        got.setdefault(r.id, set()).add((r.path, r.error))
    assert 0 not in got
    assert got[1] == {("id", "expected BIGINT, got STRING"), ("rows[1].k", "missing field"), ("rows[2].k", "expected STRING, got BIGINT"), ("rows[2].x", "extra field"), ("tags[1]", "expected STRING, got BIGINT")}
    assert got[2] == {("id", "missing field"), ("p.price", "missing field"), ("rows", "expected ARRAY, got OBJECT"), ("more", "extra field")}
    assert got[3] == {("", "expected OBJECT, got ARRAY"), ("[0]", "extra field")} and got[4] == {("", "not JSON")}


def test_menus(spark):
    frame = spark.createDataFrame([(3, json.dumps(DOCS[3]))], "id int, doc string")
    got = [(r.path, r.depth, r.title, r.url) for r in nested.menu_entries(nested.nodes(frame, "id", "doc"), "id").orderBy("place").collect()]
    assert got == [("items[0]", 0, "One", "/1"), ("items[0].items[0]", 1, "In", None), ("items[0].items[1]", 1, None, "/n"), ("items[1]", 0, "Two", "/2"), ("k.items[0]", 0, "Other", "/o")]


def test_fingerprint(spark):
    odd = 'a"b\\c\n\t\x01\x1f\x7f é😀 \\u000b /'
    records = [{"session_id": f"s{i}", "source": None if i % 3 else odd, "outcome": None if i % 2 else "buy", "events": [{"action": a} for a in ([odd, "", None, "x"] if i % 4 else [])]} for i in range(23)]
    texts = [json.dumps({"session_id": str(r["session_id"] or ""), "source": str(r["source"] or ""), "outcome": r["outcome"], "actions": [e["action"] for e in r["events"] if e["action"]]}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in records]
    frame = spark.createDataFrame([(i, r["session_id"], r["source"], r["outcome"], [e["action"] for e in r["events"]]) for i, r in enumerate(records)], "i int, s string, f string, o string, a array<string>")
    made = frame.select("i", fingerprints.protocol_record(F.col("s"), F.col("f"), F.col("o"), F.col("a")).alias("r"))
    assert [x.r for x in made.orderBy("i").collect()] == texts
    h = lambda items: hashlib.sha256(("[" + ",".join(items) + "]").encode()).hexdigest()
    got = fingerprints.list_fingerprint(made.repartition(5), "r", "i").first()
    assert (got.n, got.fingerprint) == (23, h(texts))

    def tree(items, chunk):
        while True:
            items = [h(items[k : k + chunk]) for k in range(0, len(items), chunk)]
            if len(items) == 1:
                return items[0]
            items = [f'"{x}"' for x in items]

    for chunk in (2, 4, 22, 23):
        assert fingerprints.list_fingerprint(made, "r", "i", chunk=chunk).first().fingerprint == tree(texts, chunk)
    assert tuple(fingerprints.list_fingerprint(made.limit(0), "r", "i").first()) == (0, h([]))


def test_synthetic_sessions(spark):
    act = lambda **k: json.dumps(k)
    rows = [
        ("a", "3", 1, act(action="scroll"), "/p", ""), ("a", "1", 2, act(action="click", target="search box"), "/p", ""), ("a", "2", 3, act(action="type", target="search", text=" lamp "), "/q", ""),
        ("a", "2", 4, act(action="click", target="search"), "/q", ""), ("a", "4", 5, act(action="move"), "/p", ""), ("a", "5", 6, act(action="click"), "/r", "https://x/Products/P1/?v"), ("a", "9", 7, act(action="terminate"), "/r", ""),
        ("a", "6", 8, act(action="click", target="search"), "/s", None), ("b", "1", 9, act(action="terminate"), "", ""), ("c", "1", 10, "{broken", "/z", "/collections/k"), (None, "1", 11, act(action="back"), "", ""),
    ]
    steps = spark.createDataFrame(rows, "session_id string, timestamp string, seq int, synthetic_action string, url string, clicked_url string")
    catalog = spark.createDataFrame([("p1", "Lamp", " Light ", "")], "product_handle string, product_title string, product_type string, product_description string")
    got = {}
    for r in synthetic.synthetic_sessions(steps, catalog).orderBy("session_id", "ord").collect():
        got.setdefault(r.session_id, []).append((r.ord, r.action, r.product_category, r.product_text, r.timestamp, r.search_query))
    assert got["a"] == [(0, "explore-search", "", "", "2", "lamp"), (1, "explore-stay", "", "", "3", ""), (2, "detail", " Light ", "Product Type: Light, Product Title: Lamp, Product Handle: p1", "5", ""), (3, "explore-search", "", "", "6", "Failure"), (4, "terminate", "", "", "6", "")]
    assert got["b"] == [(0, "terminate", "", "", "", "")] and [x[1] for x in got["c"]] == ["explore-goto", "terminate"] and set(got) == {"a", "b", "c"}
    folders = spark.createDataFrame([("persona/z",), ("persona/b",), ("traj_cond/m__actsingle_fee1_per1_pla1_verpre__n20",), ("traj_cond/a__actsingle_fee1_per1_pla1_verpre__n9",), ("traj_cond/m__what__n1",), ("traj_cond/m",), ("persona",), ("persona/a/deep",)], "path string")
    assert {r.method: r.path for r in synthetic.method_folders(folders).collect()} == {"persona": "persona/b", "Ours": "traj_cond/a__actsingle_fee1_per1_pla1_verpre__n9"}


def test_simulated_clickstream(spark, tmp_path):
    (tmp_path / "c.csv").write_text("session_id,timestamp,semantic_action,store_id,url\nb,5, Detail ,1,/x\na,1699.9,ADD,1,\na,bad,x,1,/first\n,1,x,1,/\na,,y,1,/second\nc,1,z,2,/\n")
    rows = lambda **k: [(r.session_id, r.ord, r.timestamp, r.semantic_action, r.url) for r in readers.simulated_clickstream(spark, str(tmp_path / "c.csv"), **k).orderBy("session_id", "ord").collect()]
    a = [("a", 0, 0, "x", "/first"), ("a", 1, 0, "y", "/second"), ("a", 2, 1699, "add", "")]
    assert rows(sessions=1) == a
    assert rows() == [*a, ("b", 0, 5, "detail", "/x"), ("c", 0, 1, "z", "/")] and rows(store="2") == [("c", 0, 1, "z", "/")]


def test_shop_files(spark, tmp_path):
    products = [{"id": 5, "title": "T", "handle": "t", "vendor": "v", "product_type": "", "tags": ["a"], "images": [{"src": "u"}, {"id": 9, "src": "w", "position": 7}], "variants": [{"id": 1, "price": "2.50", "available": True}], "options": [{"name": "Size", "position": 1, "values": ["S"]}], "other": {"x": 1}}, {"id": 6, "handle": "u"}]
    (tmp_path / "products.json").write_text(json.dumps(products))
    (tmp_path / "collections.json").write_text(json.dumps([{"id": 8, "handle": "c", "title": "C", "description": "<b>", "image": {"src": "i"}}, {"id": 9, "handle": "d"}]))
    (tmp_path / "navigation.json").write_text(json.dumps({"items": []}))
    p = readers.typed_products(readers.shop_records(spark, str(tmp_path / "products.json"))).orderBy("id").collect()
    assert [(r.id, r.description_html, r.created_at) for r in p] == [(5, "", ""), (6, "", "")]
    assert [(i.id, i.src, i.position) for i in p[0].images] == [(5, "u", 1), (9, "w", 7)] and p[1].images is None
    assert p[0].variants[0].price == "2.50" and p[0].options[0]["values"] == ["S"]
    members = spark.createDataFrame([("c", ["t", "u"])], "collection string, product_handles array<string>")
    c = readers.typed_collections(readers.shop_records(spark, str(tmp_path / "collections.json")), members).orderBy("id").collect()
    assert (c[0].description, c[0].description_html, c[0].product_handles, c[0].image.id, c[0].image.position) == (None, "<b>", ["t", "u"], 8, 1)
    assert (c[1].image, c[1].product_handles) == (None, [])
    assert readers.shop_records(spark, str(tmp_path / "navigation.json")).count() == 1


TEMPLATE = "SELECT s.* FROM {TABLE} s {WHERE} ORDER BY s.n"


def test_templates():
    assert warehouse.render(TEMPLATE, "t") == "SELECT s.* FROM t s  ORDER BY s.n"
    assert warehouse.render(TEMPLATE, "t", "7", True) == "SELECT s.* FROM t s WHERE s.shop_id = 7 AND s.session_id IN UNNEST(@session_ids) ORDER BY s.n"
    assert warehouse.render("{TABLE} {CAP}", "t", more={"CAP": "5"}) == "t 5"
    with pytest.raises(ValueError):
        warehouse.render(TEMPLATE, "t", "1 OR 1=1")


def test_warehouse_scan(spark):
    fakes.clear()
    scan = lambda **k: warehouse.warehouse_scan(spark, "tests.fakes:query", TEMPLATE, "facts", "shop_id long, session_id string, n long", **k)
    facts = [(i % 3, f"s{i % 10}", i) for i in range(60)]
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[2])
    assert rows(scan()) == facts and rows(scan(shop="1")) == [f for f in facts if f[0] == 1]
    sample = spark.createDataFrame([("s1",), ("s4",), ("s7",), ("s4",), (None,)], "session_id string")
    fakes.clear()
    chosen = scan(sessions=sample, chunk=2)
    assert chosen.rdd.getNumPartitions() == 2 and rows(chosen) == [f for f in facts if f[1] in ("s1", "s4", "s7")]
    with open(f"{fakes.PLACE}-log") as f:
        asked = [json.loads(x) for x in f]
    assert sorted(x[1]["session_ids"] for x in asked) == [["s1", "s4"], ["s7"]] and all("@session_ids" in x[0] for x in asked)
    fakes.clear()
    assert rows(scan().where("shop_id = 2 AND n > 30")) == [f for f in facts if f[0] == 2 and f[2] > 30]
    with open(f"{fakes.PLACE}-log") as f:
        assert all("s.shop_id = 2" in json.loads(x)[0] for x in f)  # the filter went into the scan
    assert scan(shop="1").where("shop_id = 2").count() == 0
    assert scan(sessions=sample.limit(0)).count() == 0


def test_polled_windows(spark, tmp_path):
    fakes.clear()

    def until(ms):
        with open(f"{fakes.PLACE}-now", "w") as f:
            f.write(str(ms))
        stream = warehouse.polled_windows(spark, "tests.fakes:fetch", "tests.fakes:now", 1_000, 100)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    first = until(1_250).collect()
    assert {r.window_ms for r in first} == {1_000, 1_100} and len(first) == 8
    assert {r.key for r in first if r.window_ms == 1_100} == {"l1100", "s1100", json.dumps({"id": "", "n": 1100}), "l1000"}
    again = until(1_290)
    assert again.count() == 8  # no whole window more
    later = until(1_430)
    assert later.count() == 16 and later.select("key", "window_ms").distinct().count() == 16
    assert later.dropDuplicates(["key"]).count() == 13  # a record that two windows have, once
    with open(f"{fakes.PLACE}-polls") as f:
        polls = [tuple(map(int, x.split())) for x in f]
    assert {p[0] for p in polls} == {1_000, 1_100, 1_200, 1_300} and all(p[1] - p[0] == 100 for p in polls)


def test_windows_newest_first():
    reader = warehouse._WindowReader({"since_ms": "0", "window_ms": "10", "now": "tests.fakes:now", "fetch": "tests.fakes:fetch"})
    assert [(p.begin, p.end) for p in reader.partitions({"at": 0}, {"at": 30})] == [(20, 30), (10, 20), (0, 10)] and reader.partitions({"at": 30}, {"at": 30}) == []


def test_registry(spark, tmp_path):
    lines = lambda *names: spark.createDataFrame([(n,) for n in names], "run string")
    at = str(tmp_path / "r")
    for batch, names in ((0, ("a",)), (1, ("b", "c")), (1, ("b", "c"))):
        writers.append_batch(lines(*names), batch, at)
    assert sorted((r.run, r.batch) for r in writers.read_registry(spark, at, "run string").collect()) == [("a", 0), ("b", 1), ("c", 1)]
    lines("x").write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("run string").json(str(tmp_path / "in"))
    for _ in range(2):
        writers.registry_stream(stream(), str(tmp_path / "s"), str(tmp_path / "log")).awaitTermination()
    for name in ("0", ".0.crc"):
        (tmp_path / "log" / "commits" / name).unlink()  # the batch was written, its end was not
    writers.registry_stream(stream(), str(tmp_path / "s"), str(tmp_path / "log")).awaitTermination()
    lines("y").write.mode("append").json(str(tmp_path / "in"))
    writers.registry_stream(stream(), str(tmp_path / "s"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.run for r in writers.read_registry(spark, str(tmp_path / "s"), "run string").collect()) == ["x", "y"]
