"""Rules of shops, tasks, links and actions on worked cases."""

from html import unescape
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from trailmill.functions import scalars as X
from trailmill.operators import catalog, datasets, tasks, validation


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_add_to_cart(spark):
    rows = [("add_to_cart", None, True), ("x.ADD_TO_BAG", "", True), ("add_item_3", None, True), ("Add-To-Cart", None, False), ("addtocart", "cart", False), (None, "please Add To Bag", True), (None, "add item", True), ("x", "add_item", False), (None, None, False)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string, want boolean").select("want", datasets.is_add_to_cart(F.col("t"), F.col("d")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_template_paths(spark):
    want = {"/products/red": "/products/<*>", "/products/": "/products/", "/products": "/products", "/collections/a/products/b": "/collections/<*>", "/policies/a": "/policies/<*>", "/blogs/news/post?x=1": "/blogs/<*>", "/account/orders/1": "/account/<*>", "/pages/faq": "/pages/faq", "/pages/sale/": "/pages/<*>", "/pages/": "/pages/", "": "/", "/cart#x": "/cart", "?q": "/", "/search?q=a": "/search", "/productsx/y": "/productsx/y"}
    assert column(spark, list(want), "string", lambda c: X.template_path(c, F.array(F.lit("sale")))) == list(want.values())
    assert column(spark, ["/pages/sale"], "string", X.template_path) == ["/pages/sale"]


def test_links_of_a_site(spark):
    base = "https://Shop.test:8443/a/b?x#y"
    cases = {"/cart?x=1#z": ("/cart", "https://Shop.test:8443/cart"), "c": ("/a/c", "https://Shop.test:8443/a/c"), " ../p ": ("/p", "https://Shop.test:8443/p"), "//Shop.test:8443": ("/", "https://Shop.test:8443/"), "http://Shop.test:8443/products/x": ("/products/<*>", "http://Shop.test:8443/products/x")}
    none = ["", "  ", "https://shop.test:8443/x", "https://Shop.test/x", "mailto:a@b", "tel:1", "javascript:void(0)", "ftp://Shop.test:8443/x", "data:x", "/sitemap.xml", "/A.JPG", "/b.Jpeg", "/cdn/a", "/fast-image/a", "/pages/mail to:a@b", "/x.pdf?page=1"]
    fine = ["/assets/x.js", "/static/a", "/x.css", "/cdnx", "/a.xml/b", "/x.html"]
    got = column(spark, [*cases, *none, *fine], "string", lambda c: X.canonical_link(F.lit(base), c))
    assert [(r.canonical, r.url) for r in got[: len(cases)]] == list(cases.values())
    assert got[len(cases) : len(cases) + len(none)] == [None] * len(none) and all(got[len(cases) + len(none) :])


def test_resolving_links(spark):
    bases = ["http://a.test/b/c/d?q=1#f", "https://a.test", "http://a.test:80/x/", "http://a.test/b//c", ""]
    links = ["", "g", "./g", "g/", "/g", "//h.test/x", "?y", "g?y", "#s", "g#s", "g?y#s", "../g", "../../g", "../../../g", ".", "./", "..", "../..", "g/./h", "g/../h", "/./g", "/../g", "g.", "..g", "mailto:a@b", "http:g", "a//b", "/a//b/", "?", "#", "x:y", "a/..//b", "a b", None]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string").select("b", "x", X.resolve_link(F.col("b"), F.col("x")).alias("u")).collect()
    for r in rows:
        assert r.u == (None if r.x is None else urljoin(r.b, r.x)), (r.b, r.x)


def test_semantic_ids(spark):
    html = ["<a data-semantic-id='a&amp;b '><i DATA-Semantic-ID = \"a&amp;b\"><b parser-semantic-id='z&eacute;'><u data-semantic-id=' '>x<p data-semantic-id=\"two\nlines\">", None, "<a semantic-id='q'>"]
    assert column(spark, html, "string", X.semantic_ids) == [sorted({"a&b", unescape("z&eacute;"), "two\nlines"}), [], []]


def test_leading_numbers_and_price_range(spark):
    want = {"12.345": 12.345, " 7 EUR": 7.0, "-.5x": -0.5, "1e3": 1000.0, "1e": 1.0, "free": None, "": None, "Infinity": None, "1e999": None, "5.": 5.0, None: None}
    assert column(spark, list(want), "string", catalog.leading_number) == list(want.values())
    got = column(spark, [[("12.345",), ("n/a",), ("3",)], [("x",)], []], "array<struct<price:string>>", catalog.price_range)
    assert [(r.least, r.greatest) for r in got] == [(3.0, 12.35), (0.0, 0.0), (0.0, 0.0)]


def test_predictive_limits(spark):
    assert [catalog.predictive_limit(x) for x in (None, 0, -3, float("nan"), float("inf"), 3.9, 20, 0.5)] == [10, 10, 10, 10, 10, 3, 20, 0]
    rows = spark.createDataFrame([(k % 2, k) for k in range(60)], "kind_order int, rank int")
    assert catalog.predictive(rows, 20).count() == 20 and catalog.predictive(rows, 20, each=True).count() == 40 and catalog.predictive(rows, 0).count() == 10


def test_recommendations(spark):
    """Blank types are no type; products without anything in common fill up by place, whatever their number."""
    given = [("a", 1, "", ["X"]), ("b", 2, "", ["y"]), ("c", 3, "t", ["x", "Y"]), ("d", 4, "t", []), ("e", 5, None, None), ("f", 6, "u", ["q"])]
    p = spark.createDataFrame(given, "product_handle string, place int, product_type string, tags array<string>")
    got = {}
    for r in catalog.recommendations(p, p).orderBy("target", "rank").collect():
        got.setdefault(r.target, []).append((r.product_handle, r.score))
    assert got["a"] == [("c", 1), ("b", 0), ("d", 0), ("e", 0)]
    assert got["c"] == [("d", 1000), ("a", 1), ("b", 1), ("e", 0)]
    assert got["e"] == [("a", 0), ("b", 0), ("c", 0), ("d", 0)] and got["f"] == got["e"]


def test_themes_and_picks(spark):
    titles = {"All": False, " gift cards ": False, "New Arrivals": False, "Promo Eligible Products": False, "Wholesale only": False, "homepage picks": True, "Dog Dentals": True, "alls": True, None: True}
    assert [not x for x in column(spark, list(titles), "string", tasks.is_generic)] == list(titles.values())
    p = spark.createDataFrame([(1, "Shoe"), (2, ""), (3, " shoe "), (4, None), (5, "Hat"), (6, "HAT"), (7, "shoe")], "place int, product_type string")
    assert [r.place for r in tasks.diverse_pick(p, 6).orderBy("rank").collect()] == [1, 2, 4, 5, 3, 6]
    assert [r.place for r in tasks.diverse_pick(p, 2).orderBy("rank").collect()] == [1, 2]
    pages = spark.createDataFrame([(1, "About", "about"), (2, "Shipping Info", "x"), (3, "Event Sponsorship", "sponsorship"), (4, None, "our-ship"), (5, "a.b", None), (6, "axb", "")], "i int, title string, handle string")
    assert [r.i for r in tasks.pages_matching(pages, "Ship").orderBy("i").collect()] == [2, 4]
    assert [r.i for r in tasks.pages_matching(pages, "a.b", "spon").orderBy("i").collect()] == [3, 5]
    ok = [("long", False, "active", True), ("long", None, None, True), ("abc", False, None, True), ("x" * 121, False, None, True), ("long", True, None, True), ("long", False, "draft", True), ("long", False, None, False), (None, False, None, True)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(ok)], "i int, t string, g boolean, s string, a boolean").orderBy("i").select(tasks.is_candidate(F.col("t"), F.col("g"), F.col("s"), F.col("a")).alias("r")).collect()
    assert [r.r for r in got] == [True, True, False, False, False, False, False, False]


def test_membership(spark):
    """A token of all five collections links nothing, one of two does, one of a single one always does; empty collections stay."""
    c = spark.createDataFrame([(f"c{k}", ["all", f"own{k}"] + (["pair"] if k < 2 else [])) for k in range(5)], "collection string, tokens array<string>")
    p = spark.createDataFrame([("p1", ["all"]), ("p2", ["pair", "all"]), ("p3", ["own3", "own3"])], "product_handle string, tokens array<string>")
    got = sorted((r.collection, r.product_handle) for r in tasks.membership(p, c).collect() if r.product_handle)
    assert got == [("c0", "p2"), ("c1", "p2"), ("c3", "p3")]
    assert {r.collection for r in tasks.membership(p, c).collect()} == {f"c{k}" for k in range(5)}
    one = tasks.membership(p, c.where("collection = 'c4'")).collect()
    assert sorted(r.product_handle for r in one) == ["p1", "p2"]


@pytest.mark.parametrize("few", [64, 0])
def test_mentions_and_prefixes(spark, monkeypatch, few):
    monkeypatch.setattr(tasks, "FEW_NAMES", few)
    texts = spark.createDataFrame([(1, "A red Shirt, and red"), (2, ""), (3, None), (4, "shirts"), (5, "ab")], "id int, text string")
    names = spark.createDataFrame([("Red",), ("shirt",), ("red shirt",), (" ",), ("b",), ("zz",)], "name string")
    got = sorted(map(tuple, tasks.mentions(texts, names).collect()))
    assert got == [(1, "Red"), (1, "red shirt"), (1, "shirt"), (4, "shirt"), (5, "b")]
    assert sorted(map(tuple, tasks.mentions(texts, names, exact_case=True).collect())) == [(4, "shirt"), (5, "b")]
    wanted = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), (None,)], "prefix string")
    have = spark.createDataFrame([("ab",), ("abd",), ("b",), (None,)], "name string")
    assert sorted(map(tuple, tasks.prefix_matches(wanted, have).collect())) == [("", "ab"), ("", "abd"), ("", "b"), ("a", "ab"), ("a", "abd"), ("ab", "ab"), ("ab", "abd")]
    assert tasks.prefix_matches(wanted.limit(0), have).count() == 0


def test_task_rules(spark):
    opts = "array<struct<name:string,values:array<string>>>"
    products = spark.createDataFrame(
        [("red-shirt", "Red Shirt", "Acme", "Top", [("Color", ["Red"]), ("Size", ["S", "M"])]), ("card", "Gift Card", "Acme", "Card", [("Title", ["Default Title"])]), ("book", "Blue Book", "Ink", "Book", [("Format", ["Hardcover", "Paper"])]), ("hat", "Hat", "Acme", "Top", None)],
        f"product_handle string, product_title string, vendor string, product_type string, options {opts}",
    )
    collections = spark.createDataFrame([("tops", "Tops", ["red-shirt", "gone"]), ("tops-new", "New Tops", ["hat"]), ("paper", "Paper Goods", ["book"]), ("none", "None", None)], "collection string, title string, product_handles array<string>")
    pages = spark.createDataFrame([("shipping-info",)], "page string")
    cases = {
        "a": ("", "/collections/toys", None),  # no such collection
        "b": ("", "/products/red?x=1", None),  # a prefix of a known one
        "c": ("", "/products/green/a", None),
        "d": ("", "/pages/ship", None),
        "e": ("", "/pages/return", None),
        "f": ("", "/products/", None),
        "g": (None, "/cart", None),
        "s-filter-1": ("use the Color filter (e.g. red)", "/collections/tops", None),
        "s-filter-2": ("use the Brand filter (e.g. ACME)", "/collections/tops", None),
        "s-filter-3": ("use the product type filter (e.g. book)", "/collections/tops", None),
        "s-filter-4": ("use the Farbe filter (e.g. rot)", "/collections/tops", None),
        "s-filter-5": ("use a filter", "/collections/tops", None),
        "s-filter-6": ("use the Color filter (e.g. red)", "/collections/toys", None),
        "s-filter-7": ("use the Size filter (e.g. L)", "/collections/paper", None),
        "filter-8x": ("use the Size filter (e.g. L)", "/collections/paper", None),
        "h": ("What is the CODE 9?", None, ["code 9", " ", "other"]),
        "i": ("Go to Tops and find Red Shirt", None, None),  # the title New Tops is not mentioned
        "j": ("Go to Paper Goods and find Red Shirt", None, None),
        "k": ("Find Blue Book and select your Color and Hardcover variant", None, None),
        "l": ("Find Red Shirt and select a Size option", None, None),
        "m": ("Find Hat and select a Weight option", None, None),  # a title of three letters is not looked for
        "n": ("Find Red Shirt and Select the red for the color option", None, None),
        "o": ("Find Gift Card and select Default Title for Title", None, None),
        "p": ("Find Red Shirt and select S for Size, then select the Red Color variant", None, None),
    }
    t = spark.createDataFrame([(k, *v) for k, v in cases.items()], "task_id string, intent string, url_contains string, response_contains array<string>")
    got = sorted(map(tuple, validation.validate(t, products, collections, pages).collect()))
    want = [
        ("unknown-collection", "error", "a", "toys"), ("unknown-product", "error", "c", "green"), ("unknown-page", "warning", "e", "return"), ("unknown-collection", "error", "s-filter-6", "toys"),
        ("infeasible-filter", "error", "s-filter-3", "product type=book"), ("filter-dim-unknown", "warning", "s-filter-4", "Farbe=rot"), ("filter-intent-malformed", "warning", "s-filter-5", ""), ("infeasible-filter", "error", "s-filter-7", "Size=L"),
        ("intent-answer-leak", "error", "h", "code 9"), ("product-not-in-collection", "warning", "j", "red-shirt"), ("option-mismatch", "warning", "k", "color"), ("option-mismatch", "warning", "p", "red color"),
        ("single-sku-value-selection", "warning", "n", "Color=Red"), ("single-sku-value-selection", "warning", "p", "Color=Red"),
    ]
    assert got == sorted(want)
    assert validation.validate(t, products, collections, pages.limit(0)).where("rule = 'unknown-page'").count() == 0
    assert validation.validate(t.limit(0), products, collections, pages).count() == 0


def test_rule_gate(spark):
    rows = [("infeasible", True, "/x", [], True), ("infeasible", False, None, [], False), ("infeasible", None, None, ["/x"], False), (None, False, "/x", ["a/x/b"], None), (None, False, "/x", ["/y"], False), (None, False, "/x", None, False), (None, False, "", [], None), ("ok", True, None, None, None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, r boolean, w string, u array<string>, want boolean").orderBy("i").select("want", tasks.rule_gate(F.col("e"), F.col("r"), F.col("w"), F.col("u")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_sort_orders(spark):
    rows = [(1, "b", None, 2.0), (2, "B", "2024", None), (3, "a", "2023", 1.0), (4, "Á", "2024", 1.0), (5, None, None, 3.0)]
    p = spark.createDataFrame(rows, "place int, product_title string, updated_at string, price double")
    order = lambda key, rev=False: [r.place for r in catalog.sort_products(p, key, rev).orderBy("rank").collect()]
    assert order("TITLE") == [5, 3, 4, 1, 2] and order("TITLE", True) == [2, 1, 4, 3, 5]
    assert order("UPDATED_AT") == [1, 5, 3, 2, 4] and order("PRICE") == [2, 3, 4, 1, 5]
    assert order("BEST_SELLING") == [1, 2, 3, 4, 5] and order("RELEVANCE", True) == [5, 4, 3, 2, 1]


def test_text_of_html(spark):
    """Worked pages, and the pages of the tables against a plain cut with regular expressions."""
    import os
    import re

    cases = {"<p>a&amp;b <b>c</b></p>\n<style>x{}</style>d": "a&b c d", "<script>var t='</p>';</script>x<br>y": "x y", "a<!-- no -->b": "a b", "&lt;i&gt; &eacute;": "<i> é", "": "", "plain": "plain", "<p title='a>b'>t": "t"}
    assert column(spark, [*cases, None], "string", lambda c: X.html_text()(c)) == [*cases.values(), None]
    data = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(data):
        pytest.skip("no test data here")
    rows = spark.read.parquet(data).select("html", X.html_text()(F.col("html")).alias("t")).collect()
    for r in rows:
        plain = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", r.html)
        assert r.t == " ".join(unescape(plain).split())
