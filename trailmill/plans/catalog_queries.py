"""Queries of the catalog, search and carts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from .fixtures import CATALOG_SQL, catalog, provider_events, table
from .registry import register
from .session_queries import SESSIONS_SQL, emitted


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    return catalog(spark, sf_dir).withColumns({"place": F.col("product_id"), "created_at": day(F.col("size")), "updated_at": F.when(F.col("size") % 5 != 0, day(F.col("product_id"))), "tags": F.array(F.upper(F.split("vendor", "#")[0]), F.concat(F.lit("s"), (F.col("size") % 7).cast("string")), F.col("product_type"))})


PLACED_SQL = CATALOG_SQL + ", pl AS (SELECT *, product_id AS place, '2024-01-' || lpad((size % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS created_at, CASE WHEN size % 5 <> 0 THEN '2024-01-' || lpad((product_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' ELSE '' END AS updated_at, [upper(string_split(vendor, '#')[1]), 's' || (size % 7), product_type] AS tags FROM cat)"
EDGES_SQL = CATALOG_SQL + """, span AS (SELECT product_type, min(price) AS lo, max(price) AS hi FROM cat GROUP BY product_type), ed AS (SELECT product_type, CASE WHEN lo = hi THEN [lo - 0.5, hi + 0.5] ELSE list_transform(range(6), lambda i : lo + (hi - lo) * i / 5) END AS edges FROM span),
binned AS (SELECT cat.*, least(len(list_filter(edges[2:], lambda e : e < price)) + 1, len(edges) - 1)::INTEGER AS bucket FROM cat JOIN ed USING (product_type))"""

register("src7_clean_catalog", lambda s, d: C.clean_catalog(placed(s, d).withColumn("product_title", F.when(F.col("product_id") % 11 != 0, F.col("product_title"))).unionByName(placed(s, d).withColumns({"place": F.col("place") + 10**6, "price": F.lit(1.0)}))).select("product_handle", "price", "place"),
         "SELECT 'p' || p_partkey AS product_handle, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice ELSE 1.0 END AS price, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey ELSE p_partkey + 1000000 END AS place FROM part")
register("math_price_edges", lambda s, d: C.price_edges(catalog(s, d)).select("product_type", F.array_join(F.transform("edges", lambda e: F.round(e, 6).cast("string")), ",").alias("e")).select("product_type", F.size(F.split("e", ",")).alias("n")), f"WITH {EDGES_SQL} SELECT product_type, len(edges)::INTEGER AS n FROM ed")
register("join2_price_bucket", lambda s, d: catalog(s, d).join(C.price_edges(catalog(s, d)), "product_type").select("product_handle", C.price_bucket(F.col("price"), F.col("edges")).alias("bucket")), f"WITH {EDGES_SQL} SELECT product_handle, bucket FROM binned")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_catalog(emitted(spark, sf_dir), catalog(spark, sf_dir)).groupBy("action", "product_category", "price_bucket").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))


register("join1_catalog_enrichment", _enriched, f"WITH {SESSIONS_SQL}, {EDGES_SQL} SELECT action, coalesce(product_type, '') AS product_category, coalesce(bucket::VARCHAR, '') AS price_bucket, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM rows_ LEFT JOIN binned USING (product_handle) GROUP BY ALL")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = provider_events(spark, sf_dir).where("product_handle <> ''").groupBy("product_handle").agg(F.max("price").alias("price")).withColumns({"product_title": F.when(F.col("product_handle") == "p1", "Own title").otherwise(""), "vendor": F.lit("")})
    return C.products_export(seen, catalog(spark, sf_dir)).withColumn("price", F.round("price", 6))


register("join4_products_export", _export, f"""WITH {SESSIONS_SQL}, {CATALOG_SQL}, seen AS (SELECT product_handle, max(price) AS price FROM ev WHERE product_handle <> '' GROUP BY product_handle)
SELECT product_handle, CASE WHEN product_handle = 'p1' THEN 'Own title' ELSE c.product_title END AS product_title, round(coalesce(c.price, s.price), 6) AS price, c.vendor AS vendor FROM seen s LEFT JOIN cat c USING (product_handle)""")
register("search_and_terms", lambda s, d: table(s, d, "documents").where(C.matches_all(F.col("text"), F.lit("the AND  of"))).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'of')")
register("search_occurrences", lambda s, d: table(s, d, "documents").select("doc_id", C.occurrences(F.lower("text"), F.lit("the")).alias("n")), "SELECT doc_id, ((length(text) - length(replace(lower(text), 'the', ''))) / 3)::INTEGER AS n FROM documents")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = placed(spark, sf_dir).withColumn("product_title", F.when(F.col("place") % 3 == 0, "fine fine item").when(F.col("place") % 3 == 1, "a fine item").otherwise("item"))
    return C.search(titled, "FINE brand", F.when(F.col("place") % 2 == 0, "brand fine brand").otherwise("brand")).select("product_handle", "score", "rank")


register("srt6_search_relevance", _search, f"""WITH {PLACED_SQL}, t AS (SELECT *, CASE place % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS ft, CASE WHEN place % 2 = 0 THEN 1 ELSE 0 END AS fb, CASE WHEN place % 2 = 0 THEN 2 ELSE 1 END AS bb FROM pl)
SELECT product_handle, (3 * ft + fb + bb)::INTEGER AS score, row_number() OVER (ORDER BY 3 * ft + fb + bb DESC, place)::INTEGER AS rank FROM t WHERE ft + fb > 0""")


def _search_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = placed(spark, sf_dir).withColumn("price", F.when(F.col("place") % 4 != 0, F.floor("price")))
    return C.search(priced, "brand", F.lit("a brand"), "PRICE", True).select("product_handle", "rank")


register("srt6_search_price_reverse", _search_price, f"WITH {PLACED_SQL} SELECT product_handle, row_number() OVER (ORDER BY CASE WHEN place % 4 <> 0 THEN floor(price) ELSE 'infinity'::DOUBLE END DESC, place DESC)::INTEGER AS rank FROM pl")
for _key, _col in (("TITLE", "product_title"), ("PRICE", "price"), ("VENDOR", "vendor"), ("PRODUCT_TYPE", "product_type"), ("CREATED_AT", "created_at"), ("UPDATED_AT", "updated_at"), ("ID", "product_id"), ("BEST_SELLING", None)):
    for _rev in (False, True):
        _o = ", ".join(f"{c} {'DESC NULLS FIRST' if _rev else 'ASC NULLS LAST'}" for c in (_col, "place") if c)
        register(f"srt4_{_key.lower()}{'_reverse' if _rev else ''}", lambda s, d, k=_key, r=_rev: C.sort_products(placed(s, d), k, r).select("product_handle", "rank"), f"WITH {PLACED_SQL} SELECT product_handle, row_number() OVER (ORDER BY {_o})::INTEGER AS rank FROM pl")
register("pag1_cursor_page", lambda s, d: C.page(C.sort_products(placed(s, d), "PRICE"), first=7, after="Y3Vyc29yOjQ=").select("product_handle", "index", "cursor"), f"WITH {PLACED_SQL}, r AS (SELECT product_handle, (row_number() OVER (ORDER BY price, place) - 1)::INTEGER AS index FROM pl) SELECT product_handle, index, base64(('cursor:' || index)::BLOB) AS cursor FROM r WHERE index BETWEEN 5 AND 11")
register("pag1_last_page", lambda s, d: C.page(C.sort_products(placed(s, d), "PRICE"), last=3, before="Y3Vyc29yOjEw").select("product_handle", "index"), f"WITH {PLACED_SQL}, r AS (SELECT product_handle, (row_number() OVER (ORDER BY price, place) - 1)::INTEGER AS index FROM pl) SELECT product_handle, index FROM r WHERE index BETWEEN 7 AND 9")
register("pag2_predictive", lambda s, d: C.predictive(C.sort_products(placed(s, d), "PRICE").withColumn("kind_order", F.col("place") % 3), 4, each=True).select("kind_order", "product_handle"), f"WITH {PLACED_SQL} SELECT kind_order, product_handle FROM (SELECT place % 3 AS kind_order, product_handle, row_number() OVER (PARTITION BY place % 3 ORDER BY price, place) AS k FROM pl) WHERE k <= 4")
register("pag2_predictive_total", lambda s, d: C.predictive(C.sort_products(placed(s, d), "PRICE").withColumn("kind_order", F.col("place") % 3), 20.7).select("kind_order", "product_handle"), f"WITH {PLACED_SQL} SELECT kind_order, product_handle FROM (SELECT place % 3 AS kind_order, product_handle, row_number() OVER (ORDER BY place % 3, price, place) AS k FROM pl) WHERE k <= 20")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of which some have no type, and some no tag that another has."""
    p = placed(spark, sf_dir)
    return p.withColumns({"product_type": F.when(F.col("place") % 10 == 0, "").when(F.col("place") % 10 == 1, None).otherwise(F.col("product_type")), "tags": F.when(F.col("place") % 20 == 0, F.array(F.concat(F.lit("only "), "product_handle"))).otherwise(F.col("tags"))})


register("top3_recommendations", lambda s, d: C.recommendations(_typed(s, d), _typed(s, d)), f"""WITH {PLACED_SQL.replace(", pl AS", ", raw_pl AS")}, pl AS (SELECT * REPLACE (CASE WHEN place % 10 < 2 THEN '' ELSE product_type END AS product_type, CASE WHEN place % 20 = 0 THEN ['only ' || product_handle] ELSE tags END AS tags) FROM raw_pl), t AS (SELECT product_handle AS target, product_type AS tt, list_transform(tags, lambda x : lower(x)) AS ttags FROM pl),
s AS (SELECT target, product_handle, place, CASE WHEN product_type = tt AND tt <> '' THEN 1000 ELSE 0 END + len(list_filter(tags, lambda x : list_contains(ttags, lower(x)))) AS score FROM pl JOIN t ON product_handle <> target)
SELECT target, rank, product_handle, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, place)::INTEGER AS rank FROM s) WHERE rank <= 4""")


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).groupBy(F.col("vendor").alias("collection")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("product_id")).alias("o"), F.when(F.col("product_id") % 5 == 0, "gone").otherwise(F.col("product_handle")).alias("h")))), lambda x: x["h"]).alias("product_handles"))
    return C.collection_products(c, catalog(spark, sf_dir)).select("collection", "pos", "product_handle")


register("join17_collection_products", _collections, f"WITH {CATALOG_SQL} SELECT vendor AS collection, pos, product_handle FROM (SELECT *, (row_number() OVER (PARTITION BY vendor ORDER BY product_id DESC) - 1)::INTEGER AS pos FROM cat) WHERE product_id % 5 <> 0")


def _cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cart"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"))
    return C.cart_totals(lines.join(catalog(spark, sf_dir).where("product_id % 10 <> 3").select("product_id", "price"), "product_id"))


register("agg33_join18_cart_totals", _cart, "SELECT l_orderkey AS cart, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity, sum(round(p_retailprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT / 100 AS subtotal FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 10 <> 3 GROUP BY l_orderkey")
register("join19_availability", lambda s, d: catalog(s, d).select("product_handle", C.available(F.when(F.col("size") % 3 != 0, F.col("size") % 5), F.col("size") % 2 == 0).alias("available")), "SELECT 'p' || p_partkey AS product_handle, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 > 0 ELSE p_size % 2 = 0 END AS available FROM part")
register("agg30_catalog_statistics", lambda s, d: C.catalog_statistics(catalog(s, d)), f"WITH {CATALOG_SQL}, n AS (SELECT count(*) AS n FROM cat GROUP BY product_type) SELECT (SELECT round(avg(n), 6) FROM n) AS mean_products, (SELECT median(n) FROM n) AS median_products, (SELECT max(n) FROM n) AS most_products, min(price) AS least_price, max(price) AS greatest_price, median(price) AS median_price FROM cat WHERE price > 0")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.round("l_extendedprice", 2).cast("decimal(12,2)").cast("string")).alias("price"))).alias("v"))
    r = C.price_range(F.col("v"))
    return v.select(F.col("l_partkey").alias("product_id"), r["least"].alias("least"), r["greatest"].alias("greatest"))


register("agg32_price_range", _ranges, "SELECT l_partkey AS product_id, coalesce(min(round(l_extendedprice, 2)) FILTER (l_linenumber <> 1), 0) AS least, coalesce(max(round(l_extendedprice, 2)) FILTER (l_linenumber <> 1), 0) AS greatest FROM lineitem GROUP BY l_partkey")
PLACES = "CASE l_orderkey % 3 WHEN 0 THEN array(l_linenumber, CAST(l_partkey % 6 AS INT), CAST(l_suppkey % 3 AS INT)) WHEN 1 THEN array(CAST(l_partkey % 6 AS INT)) ELSE array(l_linenumber, CAST(l_partkey % 6 AS INT)) END"
register("encoded_variants", lambda s, d: C.encoded_variants(table(s, d, "lineitem").selectExpr("l_orderkey AS product", f"{PLACES} AS places")), """WITH o AS (SELECT DISTINCT l_orderkey AS product, CASE WHEN l_orderkey % 3 = 1 THEN 0 ELSE l_linenumber END AS a, l_partkey % 6 AS b, CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey % 3 ELSE 0 END AS c FROM lineitem)
SELECT product, 'v1_' || CASE product % 3 WHEN 1 THEN string_agg(b::VARCHAR, ' ' ORDER BY b) WHEN 0 THEN string_agg(a || ':' || b || ':' || c || ',,', '' ORDER BY a, b, c) ELSE string_agg(a || ':' || b || ',', '' ORDER BY a, b) END AS code FROM o GROUP BY product""")
_VARIANTS = "transform(sequence(0, 3), i -> named_struct('options', map('size', CAST((p_size + i) % 3 AS STRING)), 'available', (p_partkey + i) % 4 = 0, 'id', i))"
register("fn_select_variant", lambda s, d: table(s, d, "part").selectExpr("p_partkey", f"{_VARIANTS} AS v", "CASE WHEN p_partkey % 5 = 0 THEN map() ELSE map('size', CAST(p_partkey % 4 AS STRING)) END AS o").select("p_partkey", C.select_variant(F.col("v"), F.col("o"))["id"].alias("chosen")), """WITH v AS (SELECT p_partkey, i, (p_size + i) % 3 AS size, (p_partkey + i) % 4 = 0 AS sold FROM part, range(4) r(i))
SELECT p_partkey, coalesce(min(i) FILTER (p_partkey % 5 <> 0 AND size = p_partkey % 4), min(i) FILTER (sold), 0)::INTEGER AS chosen FROM v GROUP BY p_partkey""")
register("fn_metafield", lambda s, d: table(s, d, "part").selectExpr("p_partkey", "array(named_struct('namespace', 'a', 'key', p_type, 'value', 'x'), named_struct('namespace', 'b', 'key', p_type, 'value', p_name)) AS f").select("p_partkey", C.metafield(F.col("f"), "b", "TYPE1").alias("value")), "SELECT p_partkey, CASE WHEN p_type = 'TYPE1' THEN p_name END AS value FROM part")


def _optioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = "CASE product_id % 4 WHEN 0 THEN array(named_struct('name', ' Size '), named_struct('name', product_type)) WHEN 1 THEN array(named_struct('name', 'SIZE')) WHEN 2 THEN array(named_struct('name', '')) END"
    return placed(spark, sf_dir).select("place", F.expr(opts).alias("options"), F.expr("sequence(1, CAST(product_id % 3 AS INT) + 1)").alias("variants"))


register("agg30_option_axes", lambda s, d: C.option_axes(_optioned(s, d)), f"WITH {PLACED_SQL}, o AS (SELECT 'size' AS axis, place * 10 AS spot FROM pl WHERE product_id % 4 < 2 UNION ALL SELECT lower(trim(product_type)), place * 10 + 1 FROM pl WHERE product_id % 4 = 0), f AS (SELECT axis, min(spot) AS spot FROM o GROUP BY axis) SELECT axis, row_number() OVER (ORDER BY spot, axis) - 1 AS place FROM f")
register("agg30_multi_variant_share", lambda s, d: C.multi_variant_share(_optioned(s, d)), f"WITH {PLACED_SQL} SELECT count(*) AS n, count(*) FILTER (product_id % 3 > 0) / count(*) AS share FROM pl")
register("tsk4_first_of_handle", lambda s, d: C.point_lookup(placed(s, d).withColumn("handle", F.lower("product_type")), "handle", "promo").select("product_handle"), f"WITH {PLACED_SQL} SELECT product_handle FROM pl WHERE lower(product_type) = 'promo' ORDER BY place LIMIT 1")
