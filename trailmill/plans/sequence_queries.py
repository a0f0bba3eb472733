"""Queries of item sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as Q
from ..operators.ordering import cut, sorted_places
from .fixtures import ITEMS_SQL, catalog, item_events
from .registry import register
from .session_queries import SESSIONS_SQL, emitted

CLEAN_SQL = ITEMS_SQL + """, c0 AS (SELECT *, lag(item) OVER (PARTITION BY session ORDER BY pos) AS b FROM items), c1 AS (SELECT session, item, store, pos, day FROM c0 WHERE item IS DISTINCT FROM b),
m1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM c1) WHERE n > 1), m2 AS (SELECT * FROM (SELECT * EXCLUDE n, count(*) OVER (PARTITION BY item) AS n FROM m1) WHERE n >= 20),
m3 AS (SELECT session, item, store, pos, day FROM (SELECT * EXCLUDE n, count(*) OVER (PARTITION BY session) AS n FROM m2) WHERE n >= 2),
vocab AS (SELECT item, row_number() OVER (ORDER BY min(struct_pack(s := session, p := pos))) AS id FROM m3 GROUP BY item)"""
EX_SQL = CLEAN_SQL + """, s AS (SELECT session, list(item ORDER BY pos) AS items FROM m3 GROUP BY session),
ex AS (SELECT session, CAST(len AS INTEGER) AS length, items[1:len] AS prefix, items[len + 1] AS label FROM (SELECT session, items, unnest(range(1, len(items))) AS len FROM s))"""
CO_SQL = CLEAN_SQL + ", co AS (SELECT a.item AS i, b.item AS j, count(*) AS n FROM m3 a JOIN m3 b ON a.session = b.session AND a.pos <> b.pos AND a.item <> b.item GROUP BY ALL)"
LEAST = 20


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.min_frequency(Q.collapse_repeats(item_events(spark, sf_dir)), LEAST)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned rows computed once, for what counts them and uses them twice."""
    return cut(clean(spark, sf_dir).select("session", "pos", "item"))


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("session % 2 = 0"), rows.where("session % 2 = 1")


register("win10_collapse_repeats", lambda s, d: Q.collapse_repeats(item_events(s, d)).select("session", "pos", "item"), f"WITH {CLEAN_SQL} SELECT session, pos, item FROM c1")
register("flt10_min_frequency", lambda s, d: clean(s, d).select("session", "pos", "item"), f"WITH {CLEAN_SQL} SELECT session, pos, item FROM m3")
register("win17_vocabulary", lambda s, d: Q.vocabulary(clean(s, d)), f"WITH {CLEAN_SQL} SELECT item, id FROM vocab")
register("win11_prefixes", lambda s, d: Q.prefixes(clean(s, d)).select("session", "length", F.array_join("prefix", ",").alias("prefix"), "label"), f"WITH {EX_SQL} SELECT session, length, array_to_string(prefix, ',') AS prefix, label FROM ex")
register("win12_prefix_groups", lambda s, d: Q.groups_of_prefixes(Q.prefixes(clean(s, d)).withColumn("o", F.col("session") * 1000 - F.col("length")), "o").groupBy("grp").agg(F.count("*").alias("n"), F.min("session").alias("a"), F.max("session").alias("b")),
         f"WITH {EX_SQL} SELECT row_number() OVER (ORDER BY session) AS grp, count(*) AS n, session AS a, session AS b FROM ex GROUP BY session")


def _cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(clean(spark, sf_dir))
    return Q.to_ids(test, Q.vocabulary(train))


register("join12_cold_items", _cold, f"""WITH {CLEAN_SQL}, v AS (SELECT item, row_number() OVER (ORDER BY min(struct_pack(s := session, p := pos))) AS id FROM m3 WHERE session % 2 = 0 GROUP BY item),
k AS (SELECT session, pos, id AS item, count(*) OVER (PARTITION BY session) AS n FROM m3 JOIN v USING (item) WHERE session % 2 = 1) SELECT session, pos, item FROM k WHERE n > 1""")
register("agg17_counters", lambda s, d: Q.counters(Q.prefixes(clean(s, d)), clean(s, d)).select("kind", F.col("key").cast("string").alias("key"), "n"), f"""WITH {EX_SQL}, c AS (SELECT 'item' AS kind, item::VARCHAR AS key, count(*) AS n FROM m3 GROUP BY ALL UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM ex GROUP BY ALL
UNION ALL SELECT 'transition', item || '>' || nx, count(*) FROM (SELECT item, lead(item) OVER (PARTITION BY session ORDER BY pos) AS nx FROM m3) WHERE nx IS NOT NULL GROUP BY ALL) SELECT kind, key, n FROM c""")


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(clean(spark, sf_dir))
    n = lambda x: x.groupBy(F.col("item").alias("key")).agg(F.count("*").alias("n"))
    return Q.distribution_distance(n(a), n(b))


register("math_total_variation", _distance, f"""WITH {CLEAN_SQL}, c AS (SELECT item, count(*) FILTER (session % 2 = 0) AS x, count(*) FILTER (session % 2 = 1) AS y FROM m3 GROUP BY item), f AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM c)
SELECT round(sum(abs(p - q)) / 2, 9) AS tv, round(sum(least(p, q)) / sum(greatest(p, q)), 9) AS overlap FROM f""")
register("agg18_alignment", lambda s, d: Q.alignment(*halves(item_events(s, d))), f"""WITH {ITEMS_SQL}, f AS (SELECT store, item, bool_or(session % 2 = 0) AS r, bool_or(session % 2 = 1) AS s FROM items GROUP BY ALL)
SELECT store, count(*) FILTER (r) AS n_real, count(*) FILTER (s) AS n_synth, count(*) FILTER (r AND s) AS n_both, round(count(*) FILTER (r AND s) / count(*) FILTER (r), 9) AS covered_real, round(count(*) FILTER (r AND s) / count(*) FILTER (s), 9) AS covered_synth FROM f GROUP BY store""")
register("agg19_popularity", lambda s, d: Q.popularity(clean(s, d), 20), f"WITH {CLEAN_SQL} SELECT item, n, CAST(row_number() OVER (ORDER BY n DESC, item) AS INTEGER) AS rank FROM (SELECT item, count(*) AS n FROM m3 GROUP BY item ORDER BY n DESC, item LIMIT 20)")
register("top1_popularity_ties", lambda s, d: Q.popularity_ties(clean(s, d), 20), f"WITH {CLEAN_SQL}, c AS (SELECT item, count(*) AS n FROM m3 GROUP BY item), t AS (SELECT min(n) AS cutoff FROM (SELECT n FROM c ORDER BY n DESC, item LIMIT 20)) SELECT cutoff, count(*) FILTER (n > cutoff) AS sure, count(*) FILTER (n = cutoff) AS tied, 20 - count(*) FILTER (n > cutoff) AS open FROM c, t GROUP BY cutoff")
register("top1_popularity_range", lambda s, d: Q.popularity_range(clean(s, d), Q.prefixes(clean(s, d)).select("label"), 20), f"""WITH {EX_SQL}, pc AS (SELECT item, count(*) AS n FROM m3 GROUP BY item), pt AS (SELECT min(n) AS cutoff FROM (SELECT n FROM pc ORDER BY n DESC, item LIMIT 20)),
ph AS (SELECT pc.item, n, cutoff, (SELECT count(*) FROM ex WHERE ex.label = pc.item) AS h FROM pc, pt WHERE n >= cutoff), pk AS (SELECT 20 - count(*) FILTER (n > cutoff) AS slots, count(*) FILTER (n = cutoff) AS tied, coalesce(sum(h) FILTER (n > cutoff), 0) AS sure FROM ph),
pr AS (SELECT h, row_number() OVER (ORDER BY item) AS a, row_number() OVER (ORDER BY h, item) AS b, row_number() OVER (ORDER BY h DESC, item) AS c FROM ph WHERE n = cutoff), pn AS (SELECT count(*) AS n FROM ex)
SELECT round((any_value(sure) + coalesce(sum(h) FILTER (a <= slots), 0)) / any_value(pn.n), 9) AS hr_by_id, round((any_value(sure) + coalesce(sum(h) FILTER (b <= slots), 0)) / any_value(pn.n), 9) AS hr_min, round((any_value(sure) + coalesce(sum(h) FILTER (c <= slots), 0)) / any_value(pn.n), 9) AS hr_max, any_value(tied)::BIGINT AS n_tied, any_value(slots)::BIGINT AS n_slots FROM pr, pk, pn""")
register("agg26_hr_mrr", lambda s, d: Q.score_ranking(Q.prefixes(clean(s, d)).select("label"), Q.popularity(clean(s, d), 20), 10), f"""WITH {EX_SQL}, r AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM m3 GROUP BY item)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 9) AS hr, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 9) AS mrr FROM ex LEFT JOIN r ON r.item = ex.label""")
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir)
    return Q.neighbour_flags(Q.prefixes(rows), Q.top_neighbours(Q.cooccurrence(rows, "i"))).select("session", "length", "flag")


register("gra1_cooccurrence", lambda s, d: Q.cooccurrence(kept(s, d)), f"WITH {CO_SQL} SELECT i, j, n FROM co")
register("gra2_adjacency", lambda s, d: Q.adjacency(Q.cooccurrence(kept(s, d), "i")).select("i", "j", "w"), f"WITH {CO_SQL} SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 9) AS w FROM co")
register("win19_top_neighbours", lambda s, d: Q.top_neighbours(Q.cooccurrence(kept(s, d), "i")), f"WITH {CO_SQL} SELECT * FROM (SELECT i, j, n, CAST(row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS INTEGER) AS rank FROM co) WHERE rank <= 10")
register("gra3_neighbour_flags", _flags, f"""WITH {CO_SQL}, t AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS rank FROM co) WHERE rank <= 10),
s AS (SELECT session, list(item ORDER BY pos) AS items FROM m3 GROUP BY session), ex AS (SELECT session, len, items[1:len] AS prefix, items[len + 1] AS label FROM (SELECT session, items, unnest(range(1, len(items))) AS len FROM s)),
u AS (SELECT session, len, label, unnest(prefix) AS i FROM ex), h AS (SELECT session, len, max(CASE WHEN t.j IS NOT NULL THEN 1 ELSE -1 END) AS flag FROM u LEFT JOIN t ON t.i = u.i AND t.j = u.label GROUP BY session, len) SELECT session, len AS length, flag FROM h""")
register("math_price_level", lambda s, d: Q.price_levels(catalog(s, d)).select("product_handle", "level"), "SELECT 'p' || p_partkey AS product_handle, CASE WHEN hi > lo THEN CAST(trunc((p_retailprice - lo) / (hi - lo) * 99) AS INTEGER) + 1 ELSE 1 END AS level FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_type) AS lo, max(p_retailprice) OVER (PARTITION BY p_type) AS hi FROM part)")
register("win18_first_seen_codes", lambda s, d: Q.first_seen_codes(catalog(s, d), "product_type", "product_id"), "SELECT p_type AS product_type, row_number() OVER (ORDER BY min(p_partkey), p_type) AS code FROM part GROUP BY p_type")


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir)
    return Q.negatives(rows.select("item").distinct(), Q.cooccurrence(rows, "i")).select("item", "negative", "rank")


register("smp8_negatives", _negatives)
register("join8_held_out", lambda s, d: halves(clean(s, d))[1].join(item_events(s, d).where("session % 3 = 0").select("session").distinct(), "session", "left_anti").select("session", "pos", "item"), f"WITH {CLEAN_SQL} SELECT session, pos, item FROM m3 WHERE session % 2 = 1 AND session NOT IN (SELECT session FROM items WHERE session % 3 = 0)")
register("join9_paired_ids", lambda s, d: clean(s, d).select("session").distinct().join(item_events(s, d).where("store = 1").select("session").distinct(), "session", "left_semi"), f"WITH {CLEAN_SQL} SELECT DISTINCT session FROM m3 WHERE session IN (SELECT session FROM items WHERE store = 1)")
register("set1_shared_items", lambda s, d: halves(clean(s, d))[0].select("item").intersect(halves(clean(s, d))[1].select("item")), f"WITH {CLEAN_SQL} SELECT item FROM m3 WHERE session % 2 = 0 INTERSECT SELECT item FROM m3 WHERE session % 2 = 1")
register("srt7_sessions_by_date", lambda s, d: sorted_places(item_events(s, d).groupBy("session").agg(F.min("day").alias("day")), "day", "session"), f"WITH {ITEMS_SQL} SELECT session, min(day) AS day, row_number() OVER (ORDER BY min(day), session) AS place FROM items GROUP BY session")


def _handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by id, or by the handle where the id is blank; what maps to nothing is null."""
    rows = item_events(spark, sf_dir).select("session", "pos", F.when(F.col("item") % 3 == 0, "").otherwise(F.col("item").cast("string")).alias("product_id"), F.concat(F.lit("p"), (F.col("item") + F.when(F.col("item") % 50 == 0, 10**9).otherwise(0)).cast("string")).alias("product_handle"))
    mapped = rows.join(catalog(spark, sf_dir).select("product_handle", F.col("product_id").cast("string").alias("by_handle")), "product_handle", "left")
    return mapped.select("session", "pos", F.coalesce(F.nullif(F.col("product_id"), F.lit("")), F.col("by_handle")).alias("item"))


register("join10_11_item_by_handle", _handles, f"""WITH {ITEMS_SQL}, r AS (SELECT session, pos, CASE WHEN item % 3 = 0 THEN NULL ELSE item::VARCHAR END AS id, 'p' || (item + CASE WHEN item % 50 = 0 THEN 1000000000 ELSE 0 END) AS h FROM items)
SELECT session, pos, coalesce(id, p_partkey::VARCHAR) AS item FROM r LEFT JOIN part ON 'p' || p_partkey = h""")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emitted(spark, sf_dir).select("session_id", "ord", "action", F.when((F.col("action") == "explore-search") & (F.col("ts_ms") % 2 == 0), F.col("page")).otherwise("").alias("query"))
    return Q.stay_runs(rows).select("session_id", "ord", "action", "query")


register("win15_run_dedup", _runs, f"""WITH {SESSIONS_SQL}, q AS (SELECT session_id, ord, action, CASE WHEN action = 'explore-search' AND ts_ms % 2 = 0 THEN page ELSE '' END AS query FROM rows_),
f AS (SELECT *, coalesce(CAST(action <> lag(action) OVER (PARTITION BY session_id ORDER BY ord) AS INTEGER), 1) AS f FROM q), i AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY ord) AS i FROM f),
m AS (SELECT *, max(CAST(query <> '' AS INTEGER)) OVER (PARTITION BY session_id, i) AS typed, row_number() OVER (PARTITION BY session_id, i ORDER BY ord) AS k FROM i)
SELECT session_id, ord, action, CASE WHEN action = 'explore-search' AND typed = 0 THEN 'Failure' ELSE query END AS query FROM m WHERE CASE WHEN action = 'explore-stay' THEN k = 1 WHEN action = 'explore-search' AND typed = 1 THEN query <> '' WHEN action = 'explore-search' THEN k = 1 ELSE true END""")
register("win16_search_clicks", lambda s, d: Q.drop_search_clicks(emitted(s, d), F.col("action") == "detail").select("session_id", "ord", "action"), f"WITH {SESSIONS_SQL} SELECT session_id, ord, action FROM (SELECT *, lead(action) OVER (PARTITION BY session_id ORDER BY ord) AS n FROM rows_) WHERE NOT (action = 'detail' AND coalesce(n = 'explore-search', false))")
