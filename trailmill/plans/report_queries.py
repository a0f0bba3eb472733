"""Queries of records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, fidelity, graph
from ..operators import reports as P
from ..operators import scoring as R
from ..sources import writers
from .catalog_queries import EDGES_SQL
from .dataset_queries import BOOT_SQL, _boot
from .fixtures import EVENTS_SQL, catalog, provider_events, table
from .graph_queries import GRAPH_SQL, edges
from .registry import register
from .session_queries import SESSIONS_SQL, STEPS_SQL, emitted, sides
from ..operators import catalog as C


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_catalog(emitted(spark, sf_dir), catalog(spark, sf_dir)).select("session_id", F.col("ts_ms").alias("timestamp"), F.col("ord").alias("seq"), F.col("action").alias("semantic_action"), "product_category", "price_bucket")
    j = writers.sessions_json(rows)
    return j.select("session_id", F.array_join("trajectory", ">").alias("trajectory"), F.array_join("product_categories", ",").alias("categories"), F.size("price_bucket").alias("n_buckets"), "intent")


register("snk3_session_records", _records, f"""WITH {SESSIONS_SQL}, {EDGES_SQL}, r AS (SELECT session_id, ts_ms, ord, action, coalesce(product_type, '') AS c, bucket AS b FROM rows_ LEFT JOIN binned USING (product_handle)),
f AS (SELECT session_id, c, min(struct_pack(t := ts_ms, o := ord)) AS k FROM r WHERE c <> '' GROUP BY ALL), g AS (SELECT session_id, coalesce(string_agg(c, ',' ORDER BY k), '') AS cats, coalesce(string_agg(c, ', ' ORDER BY k), '') AS it FROM f GROUP BY session_id)
SELECT r.session_id, string_agg(action, '>' ORDER BY ts_ms, ord) AS trajectory, coalesce(any_value(cats), '') AS categories, count(DISTINCT b)::INTEGER AS n_buckets, 'I''m looking for ' || coalesce(any_value(it), '') AS intent FROM r LEFT JOIN g USING (session_id) GROUP BY r.session_id""")
register("snk4_buyer_records", lambda s, d: P.buyer_records(features.buyer_features(provider_events(s, d)), features.product_summaries(provider_events(s, d), 3)).select("client_id", F.get_json_object("record", "$.total_sessions").cast("long").alias("n"), F.get_json_object("record", "$.browsed_products[0].product_handle").alias("first")), f"""WITH {EVENTS_SQL}, v AS (SELECT client_id, arg_min(product_handle, struct_pack(a := ts_ms, b := seq)) AS f FROM ev WHERE product_handle <> '' AND event_name IN ('product_page_viewed','page_viewed','entity_clicked') GROUP BY client_id)
SELECT client_id, count(DISTINCT session_id) AS n, any_value(f) AS first FROM ev LEFT JOIN v USING (client_id) GROUP BY client_id""")
register("snk6_report", lambda s, d: P.long_metrics(fidelity.descriptive(fidelity.lengths(sides(s, d)[0]), "n"), "lengths"), f"""WITH {STEPS_SQL}, l AS (SELECT session_id, count(*) AS n FROM steps WHERE side = 0 GROUP BY session_id), m AS (SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.75)::DOUBLE AS p75, count(*)::DOUBLE AS n FROM l)
SELECT 'lengths' AS section, name, value FROM m UNPIVOT (value FOR name IN (mean, std, p25, p50, p75, n))""")


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = sides(spark, sf_dir)
    env = P.envelope({"outcomes": fidelity.outcome_rates(real), "lengths": fidelity.length_jsd(real, synth), "edit": fidelity.edit_distances(real, synth).agg(F.round(F.avg("normalized"), 6).alias("mean"))})
    return P.simple(env, {"n_real": "outcomes.n", "checkout_rate": "outcomes.checkout_rate", "mean_edit": "edit.mean"})


register("snk8_prj18_envelope", _envelope, f"""WITH {STEPS_SQL}, o AS (SELECT session_id, bool_or(action = 'checkout') AS c FROM steps WHERE side = 0 GROUP BY session_id), t AS (SELECT side, session_id, string_agg(substr('abcdefghijO', coalesce(idx, 9)::INTEGER + 1, 1), '' ORDER BY ord) AS w, count(*) AS n FROM steps LEFT JOIN dom USING (action) GROUP BY ALL)
SELECT (SELECT count(*) FROM o) AS n_real, (SELECT round(count(*) FILTER (c) / count(*), 9) FROM o) AS checkout_rate, (SELECT round(avg(round(levenshtein(r.w, s.w) / greatest(r.n, s.n), 9)), 6) FROM t r JOIN t s ON r.session_id = s.session_id AND r.side = 0 AND s.side = 1) AS mean_edit""")
register("snk9_interval_table", lambda s, d: P.long_metrics(R.interval(_boot(s, d)), "mean value"), f"WITH {BOOT_SQL}, m AS (SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*)::DOUBLE AS n FROM b) SELECT 'mean value' AS section, name, value FROM m UNPIVOT (value FOR name IN (low, high, n))")


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.lit("m").alias("method"), F.lit("c").alias("condition"), (F.col("l_suppkey") % 3).alias("seed"), F.col("l_orderkey").alias("example"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.lit(1.0).alias("hit10"), F.lit(0.5).alias("rr10"), F.lit(1.0).alias("hit5"), ((F.col("l_partkey") * 10 + F.col("l_linenumber")) % 100 / 100).alias("rr5"))
    return writers.first_outcomes(e).select("seed", "example", "rr5")


register("snk13_first_outcomes", _dump, "SELECT l_suppkey % 3 AS seed, l_orderkey AS example, min(l_partkey * 10 + l_linenumber) % 100 / 100 AS rr5 FROM lineitem GROUP BY ALL")
register("agg39_feature_count", lambda s, d: table(s, d, "events").select("event_id", P.count_features()(F.when(F.col("event_id") % 3 == 0, '{"a":true,"b":[1,{"c":true}],"d":{"e":false}}').when(F.col("event_id") % 3 == 1, "[]").otherwise("{oops")).alias("n")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END::BIGINT AS n FROM events")
register("env4_bounded_crawl", lambda s, d: graph.distances(edges(s, d), s.createDataFrame([("/products/p0",)], "node string"), most=2).select("node", "depth"), "WITH RECURSIVE " + GRAPH_SQL + ", walk(node, depth) AS (SELECT '/products/p0', 0 UNION SELECT ge.target, w.depth + 1 FROM walk w JOIN ge ON ge.source = w.node WHERE w.depth < 2) SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node")
register("src21_typed_variants", lambda s, d: table(s, d, "orders").select("o_orderkey", P.typed_variants(F.array(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, "1.50").otherwise("free").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, True).alias("available")))).alias("v")).select("o_orderkey", F.col("v")[0]["price"].alias("price"), F.col("v")[0]["available"].alias("available")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 END::DOUBLE AS price, o_orderkey % 3 = 0 AS available FROM orders")
register("src6_poll_dedup", lambda s, d: table(s, d, "pages").unionByName(table(s, d, "pages").where("page_id % 2 = 0")).select(F.coalesce(F.nullif("url", F.lit("")), F.col("page_id").cast("string")).alias("key"), "page_id").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("page_id"))).where("k = 1").select("key", "page_id"), "SELECT url AS key, min(page_id) AS page_id FROM pages GROUP BY url")
