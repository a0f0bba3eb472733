"""Queries of scalar functions, graphs, trees, vectors and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import crawl as W
from ..operators import graph as G
from ..operators import tasks as T
from ..operators import validation as V
from .catalog_queries import PLACED_SQL, placed
from .fixtures import CATALOG_SQL, catalog, table
from .registry import register
from .session_queries import SESSIONS_SQL, emitted

register("fn_hash16", lambda s, d: table(s, d, "pages").select("page_id", X.hash16(F.col("url")).alias("h")), "SELECT page_id, substr(sha256(url), 1, 16) AS h FROM pages")
register("fn_uuid5", lambda s, d: table(s, d, "pages").select("page_id", X.uuid5(F.col("url")).alias("u")), "WITH h AS (SELECT page_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages) SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u FROM h")
register("fn_hash_number", lambda s, d: table(s, d, "pages").select("page_id", X.hash_number("id", F.col("url")).alias("n")), "SELECT page_id, ('0x' || substr(sha256('id' || chr(0) || url), 1, 12))::BIGINT AS n FROM pages")
register("fn_fnv1a", lambda s, d: table(s, d, "pages").select("page_id", X.fnv1a(F.col("url")).alias("h")), "SELECT page_id, lpad(format('{:x}', list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(url, ''), lambda c : ascii(c)::HUGEINT)), lambda h, c : (xor(h, c) * 16777619) % 4294967296)::BIGINT), 8, '0') AS h FROM pages")
register("fn_content_id", lambda s, d: table(s, d, "pages").select("page_id", X.content_id(F.col("html").cast("binary"), ".png").alias("h")), "SELECT page_id, substr(sha256(html), 1, 24) || '.png' AS h FROM pages")
register("prj22_keyed_id", lambda s, d: table(s, d, "pages").select("page_id", F.length(X.keyed_id(b"key of a test")(F.col("url"))).alias("n")), "SELECT page_id, 36 AS n FROM pages")
register("fn_url_parts", lambda s, d: table(s, d, "pages").select("page_id", X.url_path(F.col("url")).alias("path"), X.url_host(F.col("url")).alias("host"), X.query_parameter(F.col("url"), "id").alias("q")), r"SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '[?&]id=([^&#]*)', 1) AS q FROM pages")
register("fn_slug_template", lambda s, d: catalog(s, d).select("product_handle", X.product_slug(F.concat(F.lit("https://x.test/a/Products/"), "product_handle", F.lit("/?v=1"))).alias("slug"), X.normal_handle(F.concat(F.lit(" A-"), "product_handle", F.lit("/#x"))).alias("handle"), X.template_path(F.concat(F.lit("/products/"), "product_handle", F.lit("/r"))).alias("template")), f"WITH {CATALOG_SQL} SELECT product_handle, product_handle AS slug, 'a-' || product_handle AS handle, '/products/<*>' AS template FROM cat")
register("fn_clock", lambda s, d: table(s, d, "events").select("event_id", X.clock_ms(F.concat_ws(":", (F.col("event_id") % 60).cast("string"), F.when(F.col("event_id") % 9 == 0, "x").otherwise("07"))).alias("ms"), F.round(X.seconds_of(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("2024-01-01T00:00:01Z")), 3).alias("sec")), "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ((event_id % 60) * 60 + 7) * 1000 END AS ms, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE ELSE 1704067201 END AS sec FROM events")
register("fn_strip_tags", lambda s, d: table(s, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("h")), r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
register("fn_html_text", lambda s, d: table(s, d, "pages").select("page_id", F.length(X.html_text()(F.col("html"))).alias("n")))
register("fn_links", lambda s, d: table(s, d, "pages").select("page_id", F.array_join(X.links(F.col("html")), " ").alias("links")), "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
LINKS = ("../x?y=1", "#top", "//other.example/x", "b/./c/..", "?q", "mailto:a@b")
register("flt16_admissible_links", lambda s, d: table(s, d, "pages").select("page_id", "url", F.explode(F.concat(X.links(F.col("html")), F.array(F.lit("/sitemap.xml"), F.lit("/fast-image/a"), F.lit("/A.JPG"), F.lit("/assets/x.js"), F.lit("/b:c"), F.lit("mailto:a@b")))).alias("link")).where(X.admissible_link(F.col("url"), F.col("link"))).groupBy("page_id").agg(F.count("*").alias("n")), r"""WITH l AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), ['/sitemap.xml', '/fast-image/a', '/A.JPG', '/assets/x.js', '/b:c', 'mailto:a@b'])) AS link FROM pages), p AS (SELECT page_id, host, lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS h, regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM l WHERE link <> '')
SELECT page_id, count(*) AS n FROM p WHERE s IN ('', 'http', 'https') AND h IN ('', host) AND NOT regexp_matches(p, '^/(cdn|fast-image)/|:') AND NOT regexp_matches(lower(p), '\.(xml|json|txt|pdf|jpg|jpeg|png|gif|webp|svg|ico)$') GROUP BY page_id""")
register("fn_click_text", lambda s, d: table(s, d, "events").select("event_id", X.click_text(F.concat(F.lit('button:attr="1"text="  '), F.col("event_type"), F.lit(' ";div'))).alias("t")), "SELECT event_id, event_type AS t FROM events")
register("fn_semantic_ids", lambda s, d: table(s, d, "pages").select("page_id", F.array_join(X.semantic_ids(F.concat(F.lit("<a data-semantic-id='u"), F.col("page_id").cast("string"), F.lit("'></a>"), F.lit('<b data-semantic-id="x">'), F.col("html"))), "|").alias("ids")), "SELECT page_id, 'u' || page_id || '|x' AS ids FROM pages")
register("fn_index_list", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(X.index_list(F.concat(F.lit("7, "), (F.col("p_partkey") % 5).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit(",,3"))), " ").alias("t")), "WITH n AS (SELECT p_partkey, list_concat(list_concat([7], range(p_partkey % 5, p_size + 1)), [3]) AS l FROM part) SELECT p_partkey, array_to_string(list_transform(list_filter(l, lambda x, i : list_position(l, x) = i), lambda x : x::VARCHAR), ' ') AS t FROM n")
register("flt16_resolve_link", lambda s, d: table(s, d, "pages").select("page_id", "url", F.posexplode(F.concat(F.array(*map(F.lit, LINKS)), X.links(F.col("html")))).alias("pos", "link")).select("page_id", "pos", X.resolve_link(F.col("url"), F.col("link")).alias("u")))
register("fn_tokens", lambda s, d: table(s, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"), ["the", "and"])).alias("n")), "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w : length(w) >= 3 AND w NOT IN ('the', 'and')))::INTEGER AS n FROM documents")
ANSWER = "CASE event_id % 4 WHEN 0 THEN '{\"action\":\"' || event_type || '\",\"target\":\"t\"}' WHEN 1 THEN '{\"action\":{\"action\":\"' || event_type || '\",\"target\":\"u\"}}' WHEN 2 THEN '{broken' ELSE '{\"action\":\"x\"}' END"
register("prj20_generated_action", lambda s, d: table(s, d, "events").selectExpr("event_id", f"{ANSWER} AS t").select("event_id", X.generated_action(F.col("t")).alias("r"), X.has_exact_keys(F.col("t"), ["action"]).alias("only_action")).select("event_id", "r.action", "r.target", "only_action"), "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 3 THEN 'x' END AS action, CASE event_id % 4 WHEN 0 THEN 't' WHEN 1 THEN 'u' END AS target, event_id % 4 IN (1, 3) AS only_action FROM events")
register("prj21_store_of", lambda s, d: table(s, d, "events").select("event_id", X.store_of(F.when(F.col("event_id") % 3 == 0, "9").otherwise(""), F.lit("none"), F.concat(F.lit("shop-"), F.col("user_id").cast("string"))).alias("store")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '9' ELSE user_id::VARCHAR END AS store FROM events")
register("prj15_labelled_text", lambda s, d: catalog(s, d).select("product_handle", X.labelled_text({"Title": F.col("product_title"), "Vendor": F.when(F.col("size") % 2 == 0, F.col("vendor")).otherwise(""), "Type": F.col("product_type")}).alias("t")), f"WITH {CATALOG_SQL} SELECT product_handle, 'Title: ' || product_title || CASE WHEN size % 2 = 0 THEN ', Vendor: ' || vendor ELSE '' END || ', Type: ' || product_type AS t FROM cat")
register("prj13_first_distinct", lambda s, d: catalog(s, d).groupBy("product_type").agg(F.array_sort(F.collect_list("vendor")).alias("v")).select("product_type", F.array_join(X.first_n_distinct(F.col("v"), 3, 5), "|").alias("t")), f"WITH {CATALOG_SQL} SELECT product_type, array_to_string(list_transform(list_sort(list_distinct(list(vendor)))[1:3], lambda x : substr(x, 1, 5)), '|') AS t FROM cat GROUP BY product_type")
register("prj12_intent_text", lambda s, d: catalog(s, d).groupBy("vendor").agg(F.concat(F.lit("I'm looking for "), F.array_join(F.array_sort(F.collect_set("product_type")), ", ")).alias("intent")), f"WITH {CATALOG_SQL} SELECT vendor, 'I''m looking for ' || array_to_string(list_sort(list_distinct(list(product_type))), ', ') AS intent FROM cat GROUP BY vendor")
register("math_cosine", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(X.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("c")), "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS c FROM embeddings")

# A graph from the emitted sessions: pages are nodes, consecutive pages edges.
GRAPH_SQL = SESSIONS_SQL + """, steps AS (SELECT page AS source, lead(page) OVER (PARTITION BY session_id ORDER BY ord) AS target FROM rows_ WHERE page <> ''),
ge AS (SELECT DISTINCT source, target FROM steps WHERE target IS NOT NULL AND source <> target), gn AS (SELECT source AS node FROM ge UNION SELECT target FROM ge)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emitted(spark, sf_dir).where("page <> ''")
    nxt = F.lead("page").over(Window.partitionBy("session_id").orderBy("ord"))
    return rows.select(F.col("page").alias("source"), nxt.alias("target")).where("target IS NOT NULL AND source <> target").distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select(F.col("source").alias("node")).union(e.select(F.col("target").alias("node"))).distinct()


register("gra5_distances", lambda s, d: G.distances(edges(s, d), nodes(s, d)), "WITH RECURSIVE " + GRAPH_SQL + ", walk(source, node, depth) AS (SELECT node, node, 0 FROM gn UNION SELECT w.source, ge.target, w.depth + 1 FROM walk w JOIN ge ON ge.source = w.node WHERE w.depth < (SELECT count(*) FROM gn)) SELECT source, node, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL")
register("gra5_env5_graph_metrics", lambda s, d: G.graph_metrics(nodes(s, d), edges(s, d), "/products/p0", "/products/p3"), "WITH RECURSIVE " + GRAPH_SQL + """, walk(source, node, depth) AS (SELECT node, node, 0 FROM gn UNION SELECT w.source, ge.target, w.depth + 1 FROM walk w JOIN ge ON ge.source = w.node WHERE w.depth < (SELECT count(*) FROM gn)), p AS (SELECT source, node, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT 'n_nodes' AS name, count(*)::DOUBLE AS value FROM gn UNION ALL SELECT 'n_edges', count(*)::DOUBLE FROM ge UNION ALL SELECT 'dead_ends', count(*)::DOUBLE FROM gn WHERE node NOT IN (SELECT source FROM ge) UNION ALL SELECT 'diameter', max(depth)::DOUBLE FROM p
UNION ALL SELECT 'to_goal', min(depth)::DOUBLE FROM p WHERE source = '/products/p0' AND node = '/products/p3' UNION ALL SELECT 'reachable', count(*) FILTER (source = '/products/p0') / (SELECT count(*) FROM gn) FROM p""")
register("gra6_merge_aliases", lambda s, d: G.merge_aliases(edges(s, d), s.createDataFrame([("/products/p1", "/products/p0")], "alias string, canonical string")), f"WITH {GRAPH_SQL}, m AS (SELECT replace(source, '/products/p1', '/products/p0') AS source, replace(target, '/products/p1', '/products/p0') AS target FROM ge) SELECT DISTINCT source, target FROM m WHERE source <> target")
#: Every third product is left for a state, every other collection is a page of its own.
STATES = "element_at(array('cart_drawer', 'search_overlay', 'filter_panel_open', 'sort_menu_open', 'modal'), CAST(length(node) % 5 + 1 AS INT))"


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir)
    known = n.selectExpr("node", "'page' AS kind", "CAST(NULL AS STRING) AS state_name")
    states = n.selectExpr("concat('state:', node) AS node", "'state' AS kind", f"{STATES} AS state_name")
    more = n.selectExpr("node AS source", "concat('state:', node) AS target").unionAll(n.selectExpr("node AS source", "'/nowhere' AS target"))
    return G.edge_categories(e.unionAll(more), known.unionAll(states))


register("env1_edge_categories", _categories, f"""WITH {GRAPH_SQL}, c AS (SELECT CASE WHEN target LIKE '/products/%' THEN 'goto_product' WHEN target LIKE '/search%' THEN 'search' WHEN target LIKE '/collections/%' THEN 'goto_collection' ELSE 'explore' END AS category FROM ge
UNION ALL SELECT CASE length(node) % 5 WHEN 0 THEN 'open_cart' WHEN 1 THEN 'search' WHEN 2 THEN 'filter' WHEN 3 THEN 'filter' ELSE 'explore' END FROM gn) SELECT category, count(*) AS n FROM c GROUP BY 1""")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("tree"), F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 14, F.floor(F.col("p_partkey") / 14) * 7 + F.col("p_partkey") % 7).alias("parent"), F.col("p_type").alias("role"))


TREE_SQL = "tr AS (SELECT p_partkey % 7 AS tree, p_partkey AS node, CASE WHEN p_partkey >= 14 THEN (p_partkey // 14) * 7 + p_partkey % 7 END AS parent, p_type AS role FROM part)"
register("gra7_tree_statistics", lambda s, d: G.tree_statistics(tree(s, d), ("TYPE0", "TYPE1")), f"WITH RECURSIVE {TREE_SQL}, w(tree, node, depth, sd) AS (SELECT tree, node, 0, 0 FROM tr WHERE parent IS NULL UNION ALL SELECT w.tree, tr.node, w.depth + 1, w.sd + CASE WHEN tr.role IN ('TYPE0', 'TYPE1') THEN 0 ELSE 1 END FROM w JOIN tr ON tr.tree = w.tree AND tr.parent = w.node) SELECT tree, count(*) AS n_nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM tr c WHERE c.tree = w.tree AND c.parent = w.node)) AS n_leaves, max(depth)::INTEGER AS depth, max(sd)::INTEGER AS semantic_depth FROM w GROUP BY tree")
register("agg34_35_role_counts", lambda s, d: G.role_counts(tree(s, d), {"a": ["TYPE0", "TYPE1"], "b": ["TYPE1"]}), f"WITH {TREE_SQL} SELECT tree, count(*) AS n, count(*) FILTER (role IN ('TYPE0', 'TYPE1')) AS a, count(*) FILTER (role = 'TYPE1') AS b FROM tr GROUP BY tree")
register("env2_signatures", lambda s, d: tree(s, d).select("tree", "role").distinct(), f"WITH {TREE_SQL} SELECT DISTINCT tree, role FROM tr")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree 3 loses nodes, of tree 4 an id changes, of tree 5 a role, of tree 6 nothing but an id that is there twice."""
    t = tree(spark, sf_dir).select("tree", "role", F.col("node").alias("bid"))
    after = t.where("NOT (tree = 3 AND bid % 5 = 0)").select("tree", F.when(F.col("tree") == 5, F.lower("role")).otherwise(F.col("role")).alias("role"), F.when((F.col("tree") == 4) & (F.col("bid") % 100 == 4), -F.col("bid")).otherwise(F.col("bid")).alias("bid"))
    return G.fingerprints_differ(t, after)


register("env3_fingerprints", _fingerprints, f"WITH {TREE_SQL} SELECT tree, tree = 3 OR tree = 5 OR (tree = 4 AND bool_or(node % 100 = 4)) AS differs FROM tr GROUP BY tree")


def _merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("page_id") % 3 == 0, "marketing").otherwise("info")
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 150).cast("string").alias("path"), label.alias("label"), F.col("page_id").alias("pos"))
    return G.merge_classifications(p.where("pos % 2 = 0"), p.where("pos % 2 = 1"))


register("env6_merged_classes", _merged_labels, "WITH r AS (SELECT (page_id % 150)::VARCHAR AS path, CASE WHEN page_id % 3 = 0 THEN 'marketing' ELSE 'info' END AS label, page_id % 2 AS k, page_id FROM pages), o AS (SELECT path, arg_min(label, k * 1000000000 + page_id) AS label, min(k * 1000000000 + page_id) AS o FROM r GROUP BY path) SELECT path, label, row_number() OVER (ORDER BY o, path) - 1 AS pos FROM o")
register("env6_collapse_set", lambda s, d: G.collapse_set(_merged_labels(s, d)), "WITH r AS (SELECT (page_id % 150)::VARCHAR AS path, CASE WHEN page_id % 3 = 0 THEN 'marketing' ELSE 'info' END AS label, page_id % 2 AS k, page_id FROM pages) SELECT path AS slug FROM r GROUP BY path HAVING arg_min(label, k * 1000000000 + page_id) = 'marketing'")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.col("embedding").alias("v"))


register("vec1_coherence", lambda s, d: G.coherence(vectors(s, d), "g", "v"), "SELECT a.label AS g, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS coherence FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
register("vec2_3_nearest_in_group", lambda s, d: G.nearest_in_group(vectors(s, d).where("id % 2 = 1"), vectors(s, d).where("id % 2 = 0"), "g"), "WITH m AS (SELECT a.label AS g, a.vec_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY ALL) SELECT g, round(avg(m), 6) AS similarity, count(*) AS n FROM m GROUP BY g")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("observation"), F.lit("action"), F.lit("plan")), (F.col("id") % 3 + 1).cast("int"))
    m = vectors(spark, sf_dir).select("id", kind.alias("kind"), "v", (F.col("id") % 24).cast("double").alias("at"), (F.col("id") % 10 / 10).alias("importance"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5).alias("weight"))
    return G.retrieve(m, [1.0] + [0.0] * 63, 24.0, 10, {"observation": 3, "action": 5}).withColumn("score", F.round("score", 6))


register("top2_memory_retrieval", _memory, """WITH s AS (SELECT vec_id AS id, vec_id % 3 AS kind, vec_id % 24 AS ts, round((embedding[1]::DOUBLE + exp(vec_id % 24 - 24) + (vec_id % 10) / 10) * CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0.5 END, 9) AS sc FROM embeddings)
SELECT id, 'ranked' AS part, rank, round(sc, 6) AS score FROM (SELECT id, sc, row_number() OVER (ORDER BY sc DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 10
UNION ALL SELECT id, 'recent', row_number() OVER (ORDER BY ts, id)::INTEGER, NULL FROM s WHERE (kind = 0 AND ts >= 21) OR (kind = 1 AND ts >= 19)""")


# Tasks: vendors are the collections.
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).groupBy(F.lower(F.regexp_replace("vendor", "#", "-")).alias("collection")).agg(F.array_sort(F.collect_list("product_handle")).alias("product_handles"))


COLL_SQL = CATALOG_SQL + ", col AS (SELECT lower(replace(vendor, '#', '-')) AS collection, list_sort(list(product_handle)) AS product_handles FROM cat GROUP BY 1)"
TITLE_SQL = "CASE WHEN ends_with(collection, '1') THEN ' New Arrivals' WHEN ends_with(collection, '2') THEN 'Promo Eligible Products' WHEN ends_with(collection, '3') THEN 'Homepage Picks' ELSE collection END"
register("flt12_min_products", lambda s, d: T.with_min_products(collections(s, d).withColumn("title", F.expr(TITLE_SQL.replace("ends_with", "endswith"))), 6).select("collection", F.size("product_handles").alias("n")), f"WITH {COLL_SQL} SELECT collection, len(product_handles)::INTEGER AS n FROM col WHERE len(product_handles) >= 6 AND NOT ends_with(collection, '1') AND NOT ends_with(collection, '2')")
register("flt13_tsk2_pages_matching", lambda s, d: T.pages_matching(table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "Our Shipping").otherwise("Hardship (a.b)").alias("title"), F.when(F.col("page_id") % 5 == 0, "all-ships").when(F.col("page_id") % 7 == 0, "the-returns-page").otherwise("x").alias("handle")), "ship", "Return", "axb").select("page_id"), "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0")
register("flt14_candidates", lambda s, d: catalog(s, d).where(T.is_candidate(F.col("product_title"), F.col("size") % 5 == 0, F.when(F.col("size") % 4 == 0, "draft"), F.col("size") % 3 != 0)).select("product_handle"), f"WITH {CATALOG_SQL} SELECT product_handle FROM cat WHERE length(product_title) BETWEEN 4 AND 120 AND size % 5 <> 0 AND size % 4 <> 0 AND size % 3 <> 0")
register("top4_diverse_pick", lambda s, d: T.diverse_pick(placed(s, d).withColumn("product_type", F.when(F.col("place") % 3 == 0, " ").when(F.col("place") % 2 == 0, F.concat(F.upper("product_type"), F.lit(" "))).otherwise(F.col("product_type"))), 400).select("product_handle", "rank"), f"WITH {PLACED_SQL}, k AS (SELECT *, CASE WHEN place % 3 = 0 OR row_number() OVER (PARTITION BY lower(product_type), place % 3 = 0 ORDER BY place) = 1 THEN 0 ELSE 1 END AS k FROM pl) SELECT product_handle, rank FROM (SELECT *, row_number() OVER (ORDER BY k, place)::INTEGER AS rank FROM k) WHERE rank <= 400")
register("tsk1_browse_tasks", lambda s, d: T.browse_tasks(collections(s, d), 8), f"WITH {COLL_SQL} SELECT collection, place FROM (SELECT collection, row_number() OVER (ORDER BY sha256('42|' || collection), collection)::INTEGER AS place FROM col) WHERE place <= 8")
register("val2_filter_tasks", lambda s, d: T.filter_tasks(catalog(s, d).select(F.col("vendor").alias("collection"), F.when(F.col("size") % 2 == 0, "size").otherwise("type").alias("dimension"), F.col("product_type").alias("value")), ["size", "type"]), f"WITH {CATALOG_SQL}, r AS (SELECT vendor AS collection, CASE WHEN size % 2 = 0 THEN 'size' ELSE 'type' END AS dimension, product_type AS value FROM cat), m AS (SELECT collection, min(struct_pack(r := CASE dimension WHEN 'size' THEN 1 ELSE 2 END, d := dimension, v := value)) AS m FROM r GROUP BY collection) SELECT collection, m.d AS dimension, m.v AS value FROM m")


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens s0 ... s8 by size, of which a few collections each have one; all have t5, which is generic; some have none that a product has."""
    p = catalog(spark, sf_dir).select("product_handle", F.array(F.concat(F.lit("s"), (F.col("size") % 9).cast("string")), F.concat(F.lit("t"), (F.col("product_id") % 13).cast("string"))).alias("tokens"))
    c = collections(spark, sf_dir).select("collection", F.array(F.concat(F.lit("s"), (F.regexp_extract("collection", r"(\d+)$", 1).cast("int") % 12).cast("string")), F.lit("t5")).alias("tokens"))
    return T.membership(p, c)


register("join22_membership", _membership, f"WITH {COLL_SQL}, c AS (SELECT collection, regexp_extract(collection, '(\\d+)$', 1)::INTEGER % 12 AS k FROM col), f AS (SELECT k, count(*) AS n FROM c GROUP BY k), d AS (SELECT c.* FROM c JOIN f USING (k) WHERE n = 1 OR n <= 0.4 * (SELECT count(*) FROM c)) SELECT c.collection, cat.product_handle FROM c LEFT JOIN d USING (collection, k) LEFT JOIN cat ON cat.size % 9 = d.k AND d.k < 9")
register("join23_env10_mentions", lambda s, d: T.mentions(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), s.createDataFrame([("the",), ("para",), ("zzzz",)], "name string")), "SELECT doc_id AS id, name FROM documents, (VALUES ('the'), ('para'), ('zzzz')) n(name) WHERE contains(lower(text), name)")
register("join24_prefix_matches", lambda s, d: T.prefix_matches(s.createDataFrame([("p1",), ("p99",)], "prefix string"), catalog(s, d).select(F.col("product_handle").alias("name"))), f"WITH {CATALOG_SQL} SELECT prefix, product_handle AS name FROM cat, (VALUES ('p1'), ('p99')) w(prefix) WHERE starts_with(product_handle, prefix)")


#: Tasks on customers: what they ask is a matter of their key, which SQL below repeats.
def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return table(spark, sf_dir, "customer").selectExpr(
        f"CASE WHEN {k} % 4 = 0 THEN concat('shop-filter-', {k}) ELSE concat('shop-exact-', {k}) END AS task_id",
        f"CASE WHEN {k} % 4 = 0 THEN concat('/collections/brand-', {k} % 60) WHEN {k} % 4 = 1 THEN concat('/products/p', {k}, '?v=1') WHEN {k} % 4 = 2 THEN concat('/pages/a', {k} % 20) END AS url_contains",
        f"CASE WHEN {k} % 4 = 0 AND {k} % 3 = 0 THEN 'Filter it' WHEN {k} % 4 = 0 THEN concat('Open it and use the ', CASE {k} % 5 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Grosse' ELSE 'SIZE' END, ' filter (e.g. ', CASE {k} % 5 WHEN 0 THEN concat('brand#', {k} % 60) ELSE concat('size ', {k} % 50) END, ')') WHEN {k} % 4 = 1 THEN concat('Read title ', {k}, '! and select the Colour and Size options') WHEN {k} % 4 = 3 THEN concat('From Line ', {k} % 60, '; find title ', {k}, '! and select blue for the Shade option') ELSE 'Say YES now' END AS intent",
        f"CASE WHEN {k} % 4 = 2 THEN array(' yes ', 'no', '') END AS response_contains",
    )


def _shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = catalog(spark, sf_dir)
    opt = "array(named_struct('name', 'Size', 'values', array(concat('size ', size), 'L')), named_struct('name', CASE WHEN product_id % 3 = 0 THEN 'Shade' ELSE 'Title' END, 'values', array('Blue')))"
    products = c.select("product_handle", F.concat(F.lit("title "), F.col("product_id").cast("string"), F.lit("!")).alias("product_title"), "vendor", "product_type", F.expr(opt).alias("options"))
    own = collections(spark, sf_dir).withColumn("title", F.concat(F.lit("Line "), F.regexp_extract("collection", r"(\d+)$", 1), F.lit(";")))
    pages = table(spark, sf_dir, "region").select(F.concat(F.lit("a"), F.col("r_regionkey").cast("string"), F.lit("-page")).alias("page"))
    return products, own, pages


def _val1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(_tasks(spark, sf_dir), *_shop(spark, sf_dir))


register("val1_validate_tasks", _val1, f"""WITH {COLL_SQL}, t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'shop-filter-' ELSE 'shop-exact-' END || c_custkey AS task_id FROM customer),
pre AS (SELECT k, task_id, 'brand-' || (k % 60) AS prefix FROM t WHERE k % 4 = 0), met AS (SELECT pre.k, col.collection FROM pre JOIN col ON starts_with(col.collection, prefix)),
asked AS (SELECT k, task_id, CASE k % 5 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Grosse' ELSE 'SIZE' END AS dim, CASE k % 5 WHEN 0 THEN 'brand#' || (k % 60) ELSE 'size ' || (k % 50) END AS value FROM pre WHERE k % 3 <> 0 AND k IN (SELECT k FROM met)),
done AS (SELECT a.k FROM asked a JOIN met USING (k) JOIN cat ON lower(replace(vendor, '#', '-')) = met.collection WHERE (dim = 'Brand' AND lower(vendor) = value) OR (dim = 'SIZE' AND 'size ' || cat.size = value)),
about AS (SELECT t.k, task_id, product_handle, vendor, product_id FROM t JOIN cat ON product_id = t.k WHERE t.k % 4 IN (1, 3))
SELECT 'unknown-collection' AS rule, 'error' AS severity, task_id, prefix AS detail FROM pre WHERE k NOT IN (SELECT k FROM met)
UNION ALL SELECT 'unknown-product', 'error', task_id, 'p' || k FROM t WHERE k % 4 = 1 AND NOT EXISTS (SELECT 1 FROM cat WHERE starts_with(product_handle, 'p' || k))
UNION ALL SELECT 'unknown-page', 'warning', task_id, 'a' || (k % 20) FROM t WHERE k % 4 = 2 AND NOT EXISTS (SELECT 1 FROM region WHERE starts_with('a' || r_regionkey || '-page', 'a' || (k % 20)))
UNION ALL SELECT 'filter-intent-malformed', 'warning', task_id, '' FROM pre WHERE k % 3 = 0 AND k IN (SELECT k FROM met)
UNION ALL SELECT CASE dim WHEN 'Grosse' THEN 'filter-dim-unknown' ELSE 'infeasible-filter' END, CASE dim WHEN 'Grosse' THEN 'warning' ELSE 'error' END, task_id, dim || '=' || value FROM asked WHERE k NOT IN (SELECT k FROM done)
UNION ALL SELECT 'intent-answer-leak', 'error', task_id, ' yes ' FROM t WHERE k % 4 = 2 UNION ALL SELECT 'intent-answer-leak', 'error', task_id, 'no' FROM t WHERE k % 4 = 2
UNION ALL SELECT 'product-not-in-collection', 'warning', task_id, product_handle FROM about WHERE k % 4 = 3 AND 'brand-' || (k % 60) IN (SELECT collection FROM col) AND lower(replace(vendor, '#', '-')) <> 'brand-' || (k % 60)
UNION ALL SELECT 'option-mismatch', 'warning', task_id, 'colour' FROM about WHERE k % 4 = 1
UNION ALL SELECT 'option-mismatch', 'warning', task_id, 'shade' FROM about WHERE k % 4 = 3 AND product_id % 3 <> 0
UNION ALL SELECT 'single-sku-value-selection', 'warning', task_id, 'Shade=Blue' FROM about WHERE k % 4 = 3 AND product_id % 3 = 0""")
register("val3_rule_gate", lambda s, d: table(s, d, "pages").select("page_id", T.rule_gate(F.when(F.col("page_id") % 5 == 0, "infeasible"), F.col("page_id") % 10 == 0, F.when(F.col("page_id") % 2 == 0, "1"), F.array("url")).alias("verdict")), "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id % 10 = 0 WHEN page_id % 2 = 0 AND NOT contains(url, '1') THEN false END AS verdict FROM pages")
register("val3_url_gate", lambda s, d: table(s, d, "pages").select("page_id", T.url_gate(F.lit(True), F.array("url"), F.when(F.col("page_id") % 2 == 0, "1")).alias("ok")), "SELECT page_id, page_id % 2 <> 0 OR contains(url, '1') AS ok FROM pages")
register("env7_gaps", lambda s, d: T.gaps(table(s, d, "documents").select(F.col("source").alias("area")), s.createDataFrame([("src1",), ("src2",)], "area string"), s.createDataFrame([("src3",)], "area string")), "SELECT DISTINCT source AS area FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')")
register("env8_brand_leaks", lambda s, d: T.leaks(table(s, d, "documents").select("doc_id", "text"), ["the", "zzz"]).select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(the|zzz)\b')")
register("env6_latest", lambda s, d: T.latest(table(s, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey"), "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
register("env9_unused_fields", lambda s, d: table(s, d, "documents").select(F.col("source").alias("f")).subtract(table(s, d, "documents").where("doc_id % 2 = 0 AND source < 'src4'").select(F.col("source").alias("f"))), "SELECT source AS f FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 2 = 0 AND source < 'src4'")


def stored_site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, links and seeds of a crawl: every page links to what its text names and to the next three pages of its host; some fail, some lead on."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("site"), X.canonical_link(F.col("url"), F.col("url")).alias("c"))
    p = p.select("page_id", "html", "site", F.col("c.url").alias("url"), F.col("c.canonical").alias("canonical"), F.row_number().over(Window.partitionBy("c.url").orderBy("page_id")).alias("k")).where("k = 1 AND url IS NOT NULL")
    order = Window.partitionBy("site").orderBy("page_id")
    ahead = [F.lead("url", k).over(order) for k in (1, 2, 3)]
    p = p.withColumns({"next": ahead[0], "near": F.array_compact(F.array(*[F.concat(a, F.lit("?from=list")) for a in ahead])), "place": F.row_number().over(order)})
    pages = p.select("url", F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 2 == 0, 200).alias("status"), F.when(F.col("page_id") % 7 == 0, F.col("next")).alias("final_url"))
    links = p.select("url", F.posexplode(F.concat("near", X.links(F.col("html")))).alias("pos", "href"))
    return pages, links, p.where("place = 1").select("site", F.lit(0).alias("pos"), "canonical", "url")


register("env4_stored_crawl", lambda s, d: W.crawl_log(W.bounded_crawl(*stored_site(s, d), hops=3, most=8)))
register("env4_crawl_edges", lambda s, d: W.crawl_edges(W.bounded_crawl(*stored_site(s, d), hops=3, most=8)))


def _action_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by the key of a part; every ninth node is hidden."""
    roles = ("button", "textbox", "option", "generic", "radio", "link")
    role = F.element_at(F.array(*map(F.lit, roles)), (F.col("node") % 6 + 1).cast("int"))
    return G.action_space(tree(spark, sf_dir).select("tree", role.alias("role"), (F.col("node") % 9 == 0).alias("hidden")))


register("agg35_action_space", _action_space, f"""WITH {TREE_SQL}, n AS (SELECT tree, node % 6 AS k FROM tr WHERE node % 9 <> 0), v AS (SELECT tree, unnest(CASE k WHEN 0 THEN ['click', 'dblclick', 'hover'] WHEN 1 THEN ['clear', 'fill', 'press'] WHEN 2 THEN ['select_option', 'choice'] WHEN 4 THEN ['click', 'dblclick', 'hover', 'choice'] WHEN 5 THEN ['click', 'dblclick', 'hover'] ELSE [] END) AS action FROM n) SELECT tree, action, count(*) AS n FROM v GROUP BY ALL""")


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.when(F.col("page_id") % 90 == 7, "Shipping").otherwise("Hardship").alias("title"), F.concat(F.lit("h-"), "page_id").alias("handle"))
    return T.policy_task(p, "/policies/shipping-policy", "ship", "deliver")


register("tsk2_policy_task", _policy, "WITH h AS (SELECT '/pages/h-' || page_id AS url, page_id AS p FROM pages WHERE page_id % 90 = 7 UNION ALL SELECT '/policies/shipping-policy', NULL) SELECT (row_number() OVER (ORDER BY p NULLS LAST, url) - 1)::INTEGER AS pos, url FROM h")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat: a text is a vector's label and its id by hundreds, its vector that of the smallest of them."""
    v = vectors(spark, sf_dir).withColumn("text", F.concat_ws("-", "g", (F.col("id") % 100).cast("string")))
    first = v.groupBy("text").agg(F.min_by("v", "id").alias("v"))
    same = v.select("id", "text").join(first, "text")
    return G.corpus_similarity(same.where("id % 2 = 1"), same.where("id % 2 = 0 AND id % 100 < 60"))


register("vec2_corpus_similarity", _corpus, "WITH t AS (SELECT label || '-' || (vec_id % 100) AS text, arg_min(embedding, vec_id)::DOUBLE[] AS v, min(vec_id % 100) AS k FROM embeddings GROUP BY 1), m AS (SELECT a.text, max(list_cosine_similarity(a.v, b.v)) AS m FROM t a, t b WHERE a.k % 2 = 1 AND b.k % 2 = 0 AND b.k < 60 GROUP BY a.text) SELECT round(avg(m), 6) AS similarity, (SELECT count(*) FROM t WHERE k % 2 = 0 AND k < 60) AS n_real, count(*) AS n_synth FROM m")
