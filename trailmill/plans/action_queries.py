"""Queries of actions, costs, sampling tiers and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions as A
from ..operators import catalog as C
from ..operators import datasets as D
from ..operators import fidelity
from ..operators import scoring as R
from ..operators.ordering import sorted_places
from ..sources import readers
from .catalog_queries import PLACED_SQL, placed
from .dataset_queries import ACTIONS_SQL, BOOT_SQL, _actions, _boot
from .fixtures import CATALOG_SQL, EVENTS_SQL, catalog, item_events, provider_events, table
from .graph_queries import vectors
from .registry import register
from .sequence_queries import EX_SQL, clean
from .session_queries import SESSIONS_SQL, STEPS_SQL, emitted, sides, steps
from ..operators import sequences as Q


def raw_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provider_events(spark, sf_dir).select("session_id", F.col("seq").alias("ord"), F.element_at(F.array(F.lit("click"), F.lit("type"), F.lit("back"), F.lit("scroll"), F.lit("terminate"), F.lit("click"), F.lit("click")), (F.col("seq") % 7 + 1).cast("int")).alias("type"),
        F.concat(F.lit("https://x.test/p"), (F.col("seq") % 3).cast("string"), F.when(F.col("seq") % 4 == 0, "?q=1").otherwise("")).alias("url"), F.when(F.col("seq") % 5 == 0, F.concat(F.lit("/Products/"), F.col("product_handle"))).when(F.col("seq") % 5 == 1, "/cart").when(F.col("seq") % 5 == 2, "/p1").alias("clicked_url"),
        F.when(F.col("seq") % 11 == 0, "Buy_Now").otherwise("t").alias("target"), F.when(F.col("seq") % 13 == 0, "Please ADD to bag").alias("description"))


RAW_SQL = EVENTS_SQL + """, rs AS (SELECT session_id, seq AS ord, ['click','type','back','scroll','terminate','click','click'][seq % 7 + 1] AS type, 'https://x.test/p' || (seq % 3) || CASE WHEN seq % 4 = 0 THEN '?q=1' ELSE '' END AS url,
  CASE seq % 5 WHEN 0 THEN '/Products/' || product_handle WHEN 1 THEN '/cart' WHEN 2 THEN '/p1' END AS clicked, CASE WHEN seq % 11 = 0 THEN 'buy_now' ELSE 't' END AS target, CASE WHEN seq % 13 = 0 THEN 'please add to bag' ELSE '' END AS descr FROM ev),
l AS (SELECT *, coalesce(lag(url) OVER w, '') AS pu, coalesce(lag(clicked) OVER w, '') AS pc FROM rs WINDOW w AS (PARTITION BY session_id, type = 'terminate' ORDER BY ord))"""
register("prj5_classify_steps", lambda s, d: A.classify_steps(raw_steps(s, d)).select("session_id", "ord", "semantic"), f"""WITH {RAW_SQL} SELECT session_id, ord, CASE WHEN type = 'terminate' THEN 'terminate' WHEN type = 'back' THEN 'explore-back' WHEN type = 'scroll' THEN 'explore-stay' WHEN contains(lower(coalesce(clicked, '')), '/products/') THEN 'detail'
 WHEN clicked = '/cart' THEN 'add' WHEN target = 'buy_now' THEN 'checkout' WHEN descr <> '' THEN 'add' WHEN type = 'type' AND contains(url, '?q=') THEN 'explore-search'
 WHEN url = pu OR ends_with(split_part(url, '?', 1), lower(pc)) OR split_part(pu, '?', 1) = split_part(url, '?', 1) THEN 'explore-stay' ELSE 'explore-goto' END AS semantic FROM l""")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("click", "input", "terminate", "scroll", "navigation", "tab_activate", "odd")]), (F.col("seq") % 7 + 1).cast("int"))
    r = A.flat_action(kind, F.col("product_handle"), F.col("query"), F.when(F.col("seq") % 2 == 0, "Reload"), F.lit("/u"), F.when(F.col("seq") % 3 == 0, "-5").otherwise("5"))
    return e.select("seq", r.alias("r")).select("seq", "r.*")


register("prj6_prj19_flat_action", _flat, f"""WITH {EVENTS_SQL}, k AS (SELECT *, seq % 7 AS k FROM ev) SELECT seq, CASE k WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'terminate' WHEN 3 THEN 'scroll' WHEN 4 THEN CASE WHEN seq % 2 = 0 THEN 'refresh' ELSE 'goto_url' END WHEN 5 THEN 'switch_tab' END AS action,
 CASE WHEN k IN (0, 1, 3) THEN product_handle END AS target, CASE WHEN k = 1 THEN query END AS text, CASE WHEN k = 4 AND seq % 2 <> 0 THEN '/u' END AS url, CASE WHEN k = 3 THEN CASE WHEN seq % 3 = 0 THEN 'up' ELSE 'down' END END AS direction FROM k""")


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emitted(spark, sf_dir).withColumn("j", A.raw_action(F.col("action"), F.col("page"), F.col("product_handle"), F.lit(""), F.lit("q")))
    return rows.select("session_id", "ord", F.get_json_object("j", "$.url").alias("url"), F.get_json_object("j", "$.product").alias("product"), F.size(F.json_object_keys("j")).alias("n"))


register("prj7_raw_action", _payload, f"""WITH {SESSIONS_SQL} SELECT session_id, ord, CASE WHEN action IN ('explore-back', 'detail', 'add', 'checkout', 'explore-goto', 'Other') THEN page END AS url, CASE WHEN action = 'detail' THEN product_handle WHEN action = 'add' THEN nullif(product_handle, '') END AS product,
 (CASE WHEN action IN ('explore-back', 'detail') THEN 2 WHEN action = 'add' THEN 1 + (product_handle <> '')::INTEGER ELSE 1 END)::INTEGER AS n FROM rows_""")
register("prj8_clickstream_rows", lambda s, d: A.clickstream_rows(emitted(s, d)).select("session_id", "ord", "product_hash", "url_hash", "created_at"), f"WITH {SESSIONS_SQL} SELECT session_id, ord, CASE WHEN product_handle <> '' THEN substr(sha256(product_handle), 1, 16) ELSE '' END AS product_hash, CASE WHEN page <> '' THEN substr(sha256(page), 1, 16) ELSE '' END AS url_hash, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS created_at FROM rows_")
register("prj11_session_flags", lambda s, d: fidelity.session_flags(sides(s, d)[0]), f"WITH {STEPS_SQL} SELECT session_id, bool_or(action = 'checkout') AS has_checkout, bool_or(action = 'add') AS has_add_to_cart, bool_and(action IN ('detail','explore-search','explore-goto','explore-back','explore-stay','terminate')) AS browse_only, bool_or(action = 'add') AND NOT bool_or(action = 'checkout') AS abandoned FROM steps WHERE side = 0 GROUP BY session_id")
register("prj14_16_texts", lambda s, d: catalog(s, d).select("product_handle", A.persona_text(F.when(F.col("size") % 3 == 0, " "), F.when(F.col("size") % 2 == 0, F.col("vendor"))).alias("persona"), A.product_text(F.when(F.col("size") % 2 == 0, F.col("product_title")), F.lit(""), F.when(F.col("size") % 5 > 0, F.col("product_handle"))).alias("text")), f"WITH {CATALOG_SQL} SELECT product_handle, CASE WHEN size % 2 = 0 THEN vendor ELSE '' END AS persona, CASE WHEN size % 2 = 0 THEN product_title WHEN size % 5 > 0 THEN product_handle ELSE 'product' END AS text FROM cat")
register("prj17_external_fields", lambda s, d: A.clickstream_rows(emitted(s, d)).withColumns({"user_id": F.lit("u"), "store_id": F.lit("s"), "timestamp": F.col("ts_ms"), "semantic_action": F.col("action"), "product_category": F.lit(""), "price_bucket": F.lit("")}).select(readers.EXTERNAL_FIELDS).groupBy("semantic_action").agg(F.count("*").alias("n")), f"WITH {SESSIONS_SQL} SELECT action AS semantic_action, count(*) AS n FROM rows_ GROUP BY action")
register("prj23_relative_path", lambda s, d: table(s, d, "pages").select("page_id", A.relative_path(F.concat(F.when(F.col("page_id") % 2 == 0, "/runs/a/").otherwise("/other/"), F.col("page_id").cast("string")), "/runs/").alias("p")), "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' ELSE '/other/' END || page_id AS p FROM pages")
register("flt15_open_runs", lambda s, d: A.open_runs(table(s, d, "documents").select("doc_id"), table(s, d, "labels").where("quality = 1"), "doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")


def _buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emitted(spark, sf_dir).withColumns({"persona": F.when((F.col("session_id") % 3 == 0) & (F.col("ord") > 1), F.concat(F.lit("u"), (F.col("session_id") % 5).cast("string"))), "user_id": F.when(F.col("session_id") % 3 == 1, F.floor(F.col("session_id") / 10).cast("string")), "store_id": F.lit("s1")})
    return A.buyer_of_session(rows)


BUYERS_SQL = SESSIONS_SQL + ", buy AS (SELECT session_id, CASE WHEN session_id % 3 = 0 AND max(ord) > 1 THEN 'u' || (session_id % 5) WHEN session_id % 3 = 1 THEN (session_id // 10) || '-s1' ELSE session_id::VARCHAR END AS buyer FROM rows_ GROUP BY session_id)"
register("join3_session_buyer", _buyers, f"WITH {BUYERS_SQL} SELECT session_id, buyer FROM buy")
register("agg3_clickstream_features", lambda s, d: A.clickstream_features(emitted(s, d).join(catalog(s, d).select("product_handle", "price"), "product_handle", "left"), _buyers(s, d), 5), f"""WITH {BUYERS_SQL}, {CATALOG_SQL}, r AS (SELECT rows_.*, coalesce(price, 0) AS price FROM rows_ LEFT JOIN cat USING (product_handle)),
s AS (SELECT buyer, session_id, (max(ts_ms) - min(ts_ms)) / 1000 AS d, count(*) FILTER (action = 'explore-search') AS se, count(*) FILTER (action = 'detail') AS v, bool_or(action = 'add') AS a, bool_or(action = 'checkout') AS b, sum(price) FILTER (action = 'add') AS cart, arg_max(price, ord) FILTER (action = 'detail') AS last FROM r JOIN buy USING (session_id) GROUP BY ALL)
SELECT buyer, count(*) AS total_sessions, round(avg(d), 5) AS avg_duration, round(avg(se), 5) AS avg_searches, round(avg(v), 5) AS avg_views, round(avg(a::INTEGER), 5) AS add_rate, round(avg(b::INTEGER), 5) AS checkout_rate, round(coalesce(avg(cart) FILTER (a), 0), 5) AS avg_cart, round(coalesce(avg(coalesce(cart, last, 0)) FILTER (b), 0), 5) AS avg_order FROM s GROUP BY buyer""")
register("agg14_coherence_stats", lambda s, d: fidelity.descriptive(vectors(s, d).select("g", F.col("v")[0].alias("x")), "x").select("mean", "std", "n"), "SELECT round(avg(embedding[1]), 6) AS mean, round(stddev_pop(embedding[1]), 6) AS std, count(*) AS n FROM embeddings")
register("agg15_16_cost_rollup", lambda s, d: A.cost_rollup(provider_events(s, d).select("session_id", F.length("event_name").alias("tokens"), F.coalesce("price", F.lit(0.0)).alias("price"), F.concat(F.lit("m"), (F.col("seq") % 2).cast("string")).alias("model"))), f"WITH {EVENTS_SQL} SELECT session_id, count(*) AS calls, sum(length(event_name))::BIGINT AS tokens, round(sum(coalesce(price, 0)), 4) AS price, array_to_string(list_sort(list_distinct(list('m' || (seq % 2)))), ',') AS models FROM ev GROUP BY ROLLUP (session_id)")
register("agg27_group_sums", lambda s, d: provider_events(s, d).groupBy(F.col("side").alias("seed"), F.col("session_id").alias("grp")).agg(F.round(F.sum("price"), 4).alias("total"), F.count("*").alias("n")), f"WITH {EVENTS_SQL} SELECT side AS seed, session_id AS grp, round(sum(price), 4) AS total, count(*) AS n FROM ev GROUP BY ALL")
register("agg31_seed_statistics", lambda s, d: A.merge_seed_statistics(catalog(s, d).groupBy("vendor").agg(F.count("*").alias("products"), F.min(F.when(F.col("vendor") == "Brand#11", 0.0).otherwise(F.col("price"))).alias("least"), F.max("price").alias("greatest"), F.avg("price").alias("mean"))), f"""WITH {CATALOG_SQL}, v AS (SELECT vendor, count(*) AS n, CASE WHEN vendor = 'Brand#11' THEN 0 ELSE min(price) END AS lo, max(price) AS hi, avg(price) AS m FROM cat GROUP BY vendor)
SELECT count(*) AS n_seeds, round_even(median(n), 0)::BIGINT AS products, min(lo) FILTER (lo > 0) AS least, max(hi) FILTER (lo > 0) AS greatest, round(avg(m) FILTER (lo > 0), 6) AS mean_price FROM v""")
register("agg36_rollup_over_nodes", lambda s, d: steps(s, d).groupBy("side", "action").agg(F.count("*").alias("n"), F.max("ord").alias("most"), F.countDistinct("session_id").alias("n_sessions")), f"WITH {STEPS_SQL} SELECT side, action, count(*) AS n, max(ord) AS most, count(DISTINCT session_id) AS n_sessions FROM steps GROUP BY ALL")
register("agg37_latest_tallies", lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count("*").alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("last")), "SELECT o_custkey AS session, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY o_custkey")
register("srt1_stable_order", lambda s, d: sorted_places(provider_events(s, d).select("session_id", "seq", "ts_ms"), "session_id", "ts_ms", "seq").drop("ts_ms"), f"WITH {EVENTS_SQL} SELECT session_id, seq, row_number() OVER (ORDER BY session_id, ts_ms, seq) AS place FROM ev")
register("srt2_text_order", lambda s, d: sorted_places(table(s, d, "pages").select("page_id", "url"), "url", "page_id").drop("url"), "SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS place FROM pages")
register("srt3_price_nulls_last", lambda s, d: sorted_places(provider_events(s, d).select("seq", "price"), F.asc_nulls_last("price"), "seq").drop("price"), f"WITH {EVENTS_SQL} SELECT seq, row_number() OVER (ORDER BY price NULLS LAST, seq) AS place FROM ev")
register("srt5_collection_sort", lambda s, d: C.sort_products(placed(s, d).groupBy(F.col("vendor").alias("product_title")).agg(F.min("place").alias("place")), "TITLE", True).select("product_title", "rank"), f"WITH {PLACED_SQL}, c AS (SELECT vendor AS product_title, min(place) AS place FROM pl GROUP BY vendor) SELECT product_title, row_number() OVER (ORDER BY product_title DESC, place DESC)::INTEGER AS rank FROM c")
register("lim1_2_session_cap", lambda s, d: readers.store_sessions(item_events(s, d).withColumnsRenamed({"session": "session_id", "store": "store_id"}), 50, 1).select("session_id", "item"), "WITH i AS (SELECT l_orderkey AS session_id, l_partkey AS item FROM lineitem WHERE l_suppkey % 5 = 1) SELECT session_id, item FROM i WHERE session_id IN (SELECT DISTINCT session_id FROM i ORDER BY session_id LIMIT 50)")
register("set6_option_values", lambda s, d: A.option_values(catalog(s, d).select(F.concat(F.lit("c"), (F.col("product_id") % 4).cast("string")).alias("collection"), "product_handle"), placed(s, d)), f"WITH {PLACED_SQL}, x AS (SELECT 'c' || (product_id % 4) AS collection, * FROM pl) SELECT DISTINCT collection, 'vendor' AS dimension, vendor AS value FROM x UNION SELECT collection, 'type', product_type FROM x UNION SELECT collection, 'tag', unnest(tags) FROM x")
SAMPLE_SQL = ACTIONS_SQL + ", ns AS (SELECT * FROM (SELECT store, session, row_number() OVER (PARTITION BY store ORDER BY sha256('42|' || session), session)::INTEGER AS place FROM (SELECT DISTINCT store, session FROM act)) WHERE place <= 30)"
register("smp2_5_sampled_events", lambda s, d: _actions(s, d).join(D.nested_sample(_actions(s, d).select("store", "session").distinct(), "store", "session", 30), ["store", "session"], "left_semi").select("store", "session", "item"), f"WITH {SAMPLE_SQL} SELECT store, session, item FROM act WHERE (store, session) IN (SELECT store, session FROM ns)")
register("smp9_tiers", lambda s, d: A.cumulative_tiers(D.nested_sample(_actions(s, d).select("store", "session").distinct(), "store", "session", 30), [10, 20, 30]).groupBy("store", "tier").agg(F.count("*").alias("n")), f"WITH {SAMPLE_SQL} SELECT store, t::INTEGER AS tier, count(*) AS n FROM ns, (VALUES (10), (20), (30)) v(t) WHERE place <= t GROUP BY ALL")
register("smp6_7_capped_examples", lambda s, d: A.capped_examples(Q.prefixes(clean(s, d)).select("session", "length", "label"), 200, 42, "session", "length"), f"WITH {EX_SQL} SELECT session, length, label FROM (SELECT *, row_number() OVER (ORDER BY sha256('42|' || session || '|' || length), session, length) AS k FROM ex) WHERE k <= 200")
register("sta6_seed_interval", lambda s, d: A.seed_interval(provider_events(s, d).where("price IS NOT NULL").select(F.col("price").alias("value")), _boot(s, d)), f"WITH {BOOT_SQL}, o AS (SELECT list_sort(list(value)) AS v FROM b) SELECT (SELECT round(avg(price), 6) FROM ev) AS mean, (SELECT round(stddev_samp(price), 6) FROM ev) AS std, round(v[251], 6) AS low, round(v[9750], 6) AS high, (SELECT count(price) FROM ev) AS n FROM o")
register("sta7_random_prior", lambda s, d: A.random_prior(catalog(s, d).agg(F.count("*").alias("n")), F.col("n"), 10), "SELECT round(10 / count(*), 9) AS hr, round(2.9289682539682538 / count(*), 9) AS mrr FROM part")
register("sta8_deviations", lambda s, d: A.deviations(catalog(s, d).select(F.col("product_handle").alias("name"), F.col("price").alias("value")), catalog(s, d).where("product_id % 7 <> 0").select(F.col("product_handle").alias("name"), (F.col("price") + F.when(F.col("product_id") % 5 == 0, 1.0).otherwise(1e-9)).alias("value")), 1e-6).select("name"), f"WITH {CATALOG_SQL} SELECT product_handle AS name FROM cat WHERE product_id % 7 = 0 OR product_id % 5 = 0")
register("sta9_contrasts", lambda s, d: R.mean_and_deviation(_boot(s, d).withColumn("half", F.col("replicate") % 2), "value", "half"), f"WITH {BOOT_SQL} SELECT (replicate % 2)::INTEGER AS half, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM b GROUP BY 1")
register("vec4_centroids", lambda s, d: A.centroid_similarity(vectors(s, d).where("id % 2 = 0"), vectors(s, d).where("id % 2 = 1")), "WITH e AS (SELECT vec_id % 2 AS s, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, avg(x::DOUBLE) FILTER (s = 0) AS p, avg(x::DOUBLE) FILTER (s = 1) AS q FROM e GROUP BY i) SELECT round(sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 6) AS similarity FROM m")
register("vec5_text_vectors", lambda s, d: A.hashed_text_vector(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("v").alias("i", "n")))
register("vec6_principal_components", lambda s, d: A.principal_components(vectors(s, d), "id", "v", 16).select("id", F.posexplode("v").alias("i", "x")))
register("gra4_parallel_sequences", lambda s, d: item_events(s, d).join(Q.price_levels(catalog(s, d)).select(F.col("product_id").alias("item"), "level"), "item").groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "level"))), lambda x: x["level"].cast("string")), ",").alias("levels")), "WITH p AS (SELECT p_partkey, CASE WHEN hi > lo THEN CAST(trunc((p_retailprice - lo) / (hi - lo) * 99) AS INTEGER) + 1 ELSE 1 END AS level FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_type) AS lo, max(p_retailprice) OVER (PARTITION BY p_type) AS hi FROM part)), i AS (SELECT l_orderkey AS session, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS pos FROM lineitem) SELECT session, string_agg(level, ',' ORDER BY pos) AS levels FROM i JOIN p USING (l_partkey) GROUP BY session".replace("USING (l_partkey)", "ON p_partkey = l_partkey"))
register("rwd2_4_constraint_reward", lambda s, d: table(s, d, "events").select("event_id", F.round(A.constraint_reward((F.col("event_id") % 2).cast("double"), (F.col("event_id") % 3 / 2).cast("double"), F.col("value") / 1000, (0.2, 0.3, 0.5)), 6).alias("reward")), "SELECT event_id, round(-0.2 * (1 - event_id % 2) + (event_id % 2) * (0.3 * (event_id % 3) / 2 + 0.5 * value / 1000), 6) AS reward FROM events")
register("env11_extra_keys", lambda s, d: table(s, d, "events").select("event_id", F.array_join(A.extra_keys(F.col("props"), ["x"]), ",").alias("extra")), "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS extra FROM events")
register("env12_runtime", lambda s, d: table(s, d, "events").select("event_id", A.runtime_of(F.when(F.col("event_id") % 4 == 0, '{"type":1,"message":2}').when(F.col("event_id") % 4 == 1, '{"event":1}').when(F.col("event_id") % 4 == 2, '{"role":1}').otherwise("{oops")).alias("runtime")), "SELECT event_id, ['messages', 'events', 'chat', 'unknown'][event_id % 4 + 1] AS runtime FROM events")
register("tsk3_substitute_tasks", lambda s, d: catalog(s, d).select("product_handle", A.substitute_task(F.when(F.col("size") % 2 == 0, F.concat(F.lit('Find "'), F.col("product_title"), F.lit('" now'))).otherwise("Find it")).alias("t")), f"WITH {CATALOG_SQL} SELECT product_handle, CASE WHEN size % 2 = 0 THEN 'Find something like ' || product_title END AS t FROM cat")
register("tsk4_point_lookup", lambda s, d: placed(s, d).where("product_handle = 'p7'").orderBy("place").limit(1).select("product_handle", "product_title", "price"), f"WITH {CATALOG_SQL} SELECT product_handle, product_title, price FROM cat WHERE product_handle = 'p7'")
register("src3_candidates", lambda s, d: readers.candidates(provider_events(s, d), 20).select("session_id", "outcome"), f"""WITH {EVENTS_SQL}, o AS (SELECT session_id, CASE WHEN bool_or(event_name IN ('checkout_started', 'checkout_completed')) THEN 'checkout' WHEN bool_or(event_name = 'product_added_to_cart') THEN 'cart_abandoned' ELSE 'browse_only' END AS outcome FROM ev GROUP BY session_id)
SELECT session_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY sha256('42|' || session_id), session_id) AS k FROM o) WHERE k <= 20""")
register("src5_time_range", lambda s, d: table(s, d, "events").where("event_type IN ('view', 'click') AND ts BETWEEN '2024-01-05' AND '2024-01-12'").orderBy("ts", "event_id").limit(100).select("event_id"), "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND ts BETWEEN '2024-01-05' AND '2024-01-12' ORDER BY ts, event_id LIMIT 100")
