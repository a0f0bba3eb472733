"""Queries of the sessioniser and of what follows from its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, fidelity
from ..operators import sessionize as S
from .fixtures import EVENTS_SQL, provider_events, table
from .registry import register

DWELL = 21_600_000

#: Labelled events, rows up to the cut and emitted rows, as SQL over `ev`.
SESSIONS_SQL = EVENTS_SQL + f""", based AS (
  SELECT *, CASE event_name WHEN 'product_page_viewed' THEN 'detail' WHEN 'page_viewed' THEN 'detail' WHEN 'entity_clicked' THEN 'detail' WHEN 'search_submitted' THEN 'explore-search'
    WHEN 'collection_page_viewed' THEN 'explore-goto' WHEN 'product_added_to_cart' THEN 'add' WHEN 'product_removed_from_cart' THEN 'remove' WHEN 'checkout_started' THEN 'checkout' WHEN 'checkout_completed' THEN 'checkout' ELSE 'Other' END AS base
  FROM ev WHERE session_id IS NOT NULL AND ts_ms IS NOT NULL
), paged AS (
  SELECT *, CASE WHEN product_handle <> '' THEN '/products/' || product_handle WHEN base = 'explore-search' AND query <> '' THEN '/search?q=' || replace(query, ' ', '+')
    WHEN base = 'explore-goto' AND collection_handle <> '' THEN '/collections/' || collection_handle ELSE '' END AS page FROM based
), lagged AS (
  SELECT *, coalesce(lag(page, 1) OVER w, '') AS page1, coalesce(lag(page, 2) OVER w, '') AS page2, lag(event_name) OVER w AS name1, lag(ts_ms) OVER w AS prev_ts, coalesce(lag(product_handle) OVER w, '') AS prev_product
  FROM paged WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, seq)
), marked AS (
  SELECT *, coalesce(page <> '' AND page = page1 AND event_name = name1, false) AS is_repeat FROM lagged
), labelled AS (
  SELECT *, CASE WHEN base = 'Other' THEN 'Other' WHEN is_repeat THEN 'explore-stay' WHEN page <> '' AND page = page2 AND page <> page1 THEN 'explore-back' ELSE base END AS action FROM marked
), cut AS (
  SELECT * FROM (SELECT *, coalesce(max(CASE WHEN action = 'checkout' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM labelled) WHERE c = 0
), flagged AS (
  SELECT *, coalesce(lag(action = 'explore-stay') OVER (PARTITION BY session_id ORDER BY ts_ms, seq), false) AS last_stay FROM cut
), gapped AS (
  SELECT *, NOT is_repeat AND prev_ts IS NOT NULL AND ts_ms - prev_ts > {DWELL} AND action <> 'explore-stay' AND NOT last_stay AS gap, is_repeat AND last_stay AS joins FROM flagged
), islands AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS island FROM gapped
), firsts AS (
  SELECT * FROM (SELECT *, max(ts_ms) OVER (PARTITION BY session_id, island) AS run_ts FROM islands) WHERE NOT joins
), body AS (
  SELECT session_id, island, 1 AS part, run_ts AS ts_ms, action, page, product_handle FROM firsts
  UNION ALL SELECT session_id, island, 0, prev_ts + 1, 'explore-stay', CASE WHEN prev_product <> '' THEN '/products/' || prev_product ELSE '' END, prev_product FROM firsts WHERE gap
  UNION ALL SELECT session_id, 1073741824, 0, max(ts_ms) + 1, 'terminate', '', '' FROM cut GROUP BY session_id
), rows_ AS (
  SELECT session_id, ts_ms, CAST(row_number() OVER (PARTITION BY session_id ORDER BY island, part) AS INTEGER) AS ord, action, page, product_handle FROM body
)"""


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(provider_events(spark, sf_dir), DWELL)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_events(S.drop_unplaced(provider_events(spark, sf_dir), "session_id", "ts_ms"))


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = provider_events(spark, sf_dir)
    out = emitted(spark, sf_dir).join(S.session_outcome(events), "session_id")
    return out.groupBy("outcome", F.col("action").alias("semantic_action")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))


OUTCOME_SQL = """outcomes AS (
  SELECT session_id, CASE WHEN bool_or(event_name IN ('checkout_started', 'checkout_completed')) THEN 'checkout' WHEN bool_or(event_name = 'product_added_to_cart') THEN 'cart_abandoned' ELSE 'browse_only' END AS outcome FROM ev GROUP BY session_id
)"""

register("m1_session_funnel", _funnel, f"WITH {SESSIONS_SQL}, {OUTCOME_SQL} SELECT outcome, action AS semantic_action, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM rows_ JOIN outcomes USING (session_id) GROUP BY ALL")
register("win1_6_session_rows", emitted, f"WITH {SESSIONS_SQL} SELECT session_id, ts_ms, ord, action, page, product_handle FROM rows_")
register("prj1_semantic_action", lambda s, d: provider_events(s, d).select("seq", "event_name", S.semantic_action(F.col("event_name")).alias("action")), f"WITH {SESSIONS_SQL} SELECT seq, event_name, base AS action FROM based")
register("prj2_page_url", lambda s, d: labelled(s, d).select("seq", "page"), f"WITH {SESSIONS_SQL} SELECT seq, page FROM paged")
register("win1_2_relabel", lambda s, d: labelled(s, d).select("session_id", "seq", "is_repeat", "action"), f"WITH {SESSIONS_SQL} SELECT session_id, seq, is_repeat, action FROM labelled")
register("win4_cut_after_checkout", lambda s, d: S.cut_after_checkout(labelled(s, d)).select("session_id", "seq", "action"), f"WITH {SESSIONS_SQL} SELECT session_id, seq, action FROM cut")
register("win4_raw_truncate", lambda s, d: S.truncate_raw_checkout(provider_events(s, d)).select("session_id", "seq"), f"""WITH {EVENTS_SQL} SELECT session_id, seq FROM (
  SELECT *, coalesce(max(CASE WHEN event_name IN ('checkout_started','checkout_completed') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ev) WHERE c = 0""")
register("win6_terminate", lambda s, d: emitted(s, d).where("action = 'terminate'").select("session_id", "ts_ms"), f"WITH {SESSIONS_SQL} SELECT session_id, ts_ms FROM rows_ WHERE action = 'terminate'")
register("prj9_session_outcome", lambda s, d: S.session_outcome(provider_events(s, d)), f"WITH {EVENTS_SQL}, {OUTCOME_SQL} SELECT * FROM outcomes")
register("win7_dwell", lambda s, d: S.dwell_rows(labelled(s, d), DWELL).select("session_id", "seq", "action", "ts_ms", "part"), f"""WITH {SESSIONS_SQL}, n AS (SELECT *, lead(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS nxt FROM labelled)
SELECT session_id, seq, action, CASE WHEN coalesce(nxt - ts_ms > {DWELL}, false) THEN nxt ELSE ts_ms END AS ts_ms, 1 AS part FROM n UNION ALL SELECT session_id, seq, 'explore-stay', ts_ms, 0 FROM n WHERE nxt - ts_ms > {DWELL}""")


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir)
    return S.trim_noise(e, F.col("product_handle") == "p3").select("session_id", "seq")


register("flt2_noise_trim", _noise, f"WITH {EVENTS_SQL} SELECT session_id, seq FROM (SELECT *, min(CASE WHEN product_handle = 'p3' THEN ts_ms END) OVER (PARTITION BY session_id) AS f FROM ev) WHERE f IS NULL OR ts_ms > f")
register("flt1_drop_unplaced", lambda s, d: S.drop_unplaced(provider_events(s, d), "session_id", "ts_ms", "price").select("session_id", "seq"), f"WITH {EVENTS_SQL} SELECT session_id, seq FROM ev WHERE session_id IS NOT NULL AND ts_ms IS NOT NULL AND price IS NOT NULL")


def _pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("session_id", "ts_ms", "seq", F.col("page").alias("url"), F.concat("page", F.lit("/cart")).alias("cart_url"))
    rows = S.revisits(rows)
    return rows.select("session_id", "seq", S.pageview_action(F.col("url"), F.lit(""), F.col("visited")).alias("by_url"), S.pageview_action(F.lit("https://x.test/cart"), F.col("url"), F.col("visited")).alias("by_referrer"), "visited")


register("prj3_win9_pageview_action", _pageviews, f"""WITH {SESSIONS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id, page ORDER BY ts_ms, seq) > 1 AS visited FROM paged)
SELECT session_id, seq, visited, CASE WHEN page LIKE '/search%' THEN 'explore-search' WHEN page LIKE '/products/%' THEN 'detail' WHEN visited THEN 'explore-back' ELSE 'explore-goto' END AS by_url,
 CASE WHEN page LIKE '/products/%' THEN 'add' ELSE 'explore-goto' END AS by_referrer FROM v""")
register("prj4_click_action", lambda s, d: table(s, d, "pages").select("page_id", S.click_action(F.element_at(F.array(F.lit("Add to Cart "), F.lit("Proceed to checkout"), F.lit("Remove item"), F.lit("Read more"), F.lit(None)), (F.col("page_id") % 5 + 1).cast("int"))).alias("action")),
         "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'checkout' WHEN 2 THEN 'remove' END AS action FROM pages")


def _personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir).withColumn("persona", F.when(F.col("seq") % 6 == 0, F.concat(F.lit("u"), (F.col("seq") % 4).cast("string"))).otherwise(""))
    return S.split_by_persona(e).select("session_id", "seq", "session_part")


register("win8_persona_split", _personas, f"""WITH {EVENTS_SQL}, p AS (SELECT *, CASE WHEN seq % 6 = 0 THEN 'u' || (seq % 4) END AS persona FROM ev),
c AS (SELECT *, last_value(persona IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS q FROM p),
g AS (SELECT *, CASE WHEN row_number() OVER o > 1 AND q IS DISTINCT FROM lag(q) OVER o THEN 1 ELSE 0 END AS ch FROM c WINDOW o AS (PARTITION BY session_id ORDER BY ts_ms, seq)),
i AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g)
SELECT session_id, seq, CASE WHEN max(part) OVER (PARTITION BY session_id) > 0 THEN session_id || '::p' || coalesce(max(q) OVER (PARTITION BY session_id, part), '') || '::' || part ELSE CAST(session_id AS VARCHAR) END AS session_part FROM i""")

# Features of sessions and buyers.
register("agg1_session_summary", lambda s, d: features.session_summary(provider_events(s, d)), f"""WITH {EVENTS_SQL}, {OUTCOME_SQL}, t AS (
  SELECT *, coalesce(max(CASE WHEN event_name IN ('checkout_started','checkout_completed') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ev)
SELECT session_id, outcome, count(*) FILTER (event_name <> 'entity_impression') AS n_real, array_to_string(list_sort(list_distinct(coalesce(list(product_handle) FILTER (product_handle <> ''), []))), ',') AS products
FROM t JOIN outcomes USING (session_id) WHERE c = 0 GROUP BY session_id, outcome""")
register("agg2_buyer_features", lambda s, d: features.buyer_features(provider_events(s, d), decimals=5), f"""WITH {EVENTS_SQL}, s AS (
  SELECT client_id, session_id, (max(ts_ms) - min(ts_ms)) / 1000.0 AS dur, count(*) FILTER (event_name = 'search_submitted') AS searches,
    count(*) FILTER (event_name IN ('product_page_viewed','page_viewed','entity_clicked')) AS views, count(DISTINCT product_handle) FILTER (event_name IN ('product_page_viewed','page_viewed','entity_clicked') AND product_handle <> '') AS dviews,
    count(*) FILTER (event_name = 'collection_page_viewed') AS colls, bool_or(event_name = 'product_added_to_cart') AS cart, bool_or(event_name = 'checkout_completed') AS done, bool_or(event_name IN ('checkout_started','checkout_completed')) AS co,
    coalesce(sum(coalesce(price, 0) * quantity) FILTER (event_name = 'product_added_to_cart'), 0) AS cart_value, coalesce(sum(coalesce(price, 0) * quantity) FILTER (event_name IN ('checkout_started','checkout_completed')), 0) AS order_value
  FROM ev GROUP BY client_id, session_id)
SELECT client_id, count(*) AS total_sessions, round(avg(dur), 5) AS avg_session_duration_seconds, round(avg(searches), 5) AS avg_number_of_searches, round(avg(views), 5) AS avg_number_of_product_views, round(avg(dviews), 5) AS avg_distinct_products_viewed,
  round(avg(colls), 5) AS avg_number_of_collection_views, round(avg(CAST(views > 0 AS INTEGER)), 5) AS product_view_rate, round(avg(CAST(cart AS INTEGER)), 5) AS add_to_cart_rate, round(avg(CAST(done AS INTEGER)), 5) AS checkout_complete_rate,
  round(coalesce(avg(cart_value) FILTER (cart), 0), 5) AS avg_max_cart_value_usd, round(coalesce(avg(order_value) FILTER (co), 0), 5) AS avg_order_value_usd FROM s GROUP BY client_id""")
register("agg4_product_summaries", lambda s, d: features.product_summaries(provider_events(s, d), 3), f"""WITH {EVENTS_SQL}, v AS (SELECT * FROM ev WHERE product_handle <> '' AND event_name IN ('product_page_viewed','page_viewed','entity_clicked')),
g AS (SELECT client_id, product_handle, min(struct_pack(a := ts_ms, b := seq)) AS f, arg_min(price, struct_pack(a := ts_ms, b := seq)) FILTER (price IS NOT NULL) AS price FROM v GROUP BY ALL)
SELECT client_id, product_handle, price, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY f, product_handle) AS rank FROM g) WHERE rank <= 3""")
register("agg5_trajectories", lambda s, d: features.trajectories(emitted(s, d)), f"""WITH {SESSIONS_SQL} SELECT session_id, string_agg(action, '>' ORDER BY ord) AS trajectory, string_agg(product_handle, ',' ORDER BY first) FILTER (product_handle <> '' AND ord = first) AS products
FROM (SELECT *, min(ord) OVER (PARTITION BY session_id, product_handle) AS first FROM rows_) GROUP BY session_id""")
register("agg6_session_size_stats", lambda s, d: features.size_statistics(provider_events(s, d)), f"""WITH {EVENTS_SQL}, n AS (SELECT count(*) AS n FROM ev GROUP BY session_id)
SELECT 'mean' AS name, round(avg(n), 6) AS value FROM n UNION ALL SELECT 'std', round(stddev_samp(n), 6) FROM n UNION ALL SELECT 'min', min(n) FROM n UNION ALL SELECT 'median', median(n) FROM n UNION ALL SELECT 'max', max(n) FROM n
UNION ALL SELECT 'p' || CAST(p AS INTEGER), round((SELECT quantile_cont(n, p / 100.0) FROM n), 6) FROM (VALUES (1), (5), (10), (25), (50), (75), (90), (95), (99)) t(p)""".replace("(SELECT quantile_cont(n, p / 100.0) FROM n)", "q") .replace("FROM (VALUES (1), (5), (10), (25), (50), (75), (90), (95), (99)) t(p)", "FROM (SELECT unnest([1,5,10,25,50,75,90,95,99]) AS p, unnest(quantile_cont(n, [0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99])) AS q FROM n)"))
register("agg7_value_counts", lambda s, d: features.value_counts(provider_events(s, d), "event_name"), f"WITH {EVENTS_SQL} SELECT event_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, event_name) AS INTEGER) AS rank FROM ev GROUP BY event_name")
register("agg8_unprocessable", lambda s, d: features.unprocessable(provider_events(s, d)), f"WITH {SESSIONS_SQL} SELECT event_name, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM based WHERE base = 'Other' GROUP BY event_name")
register("win20_last_detail", lambda s, d: features.last_detail(emitted(s, d)), f"WITH {SESSIONS_SQL} SELECT session_id, arg_max(product_handle, ord) AS product_handle, max(ord) AS ord FROM rows_ WHERE action = 'detail' GROUP BY session_id")
register("win21_first_seen_order", lambda s, d: features.first_seen(provider_events(s, d), "client_id"), f"WITH {EVENTS_SQL} SELECT client_id, CAST(row_number() OVER (ORDER BY min(seq)) AS BIGINT) AS place FROM ev GROUP BY client_id")

# Real against synthetic: the two sides are the even and odd events of a session.
STEPS_SQL = EVENTS_SQL + """, steps AS (
  SELECT side, session_id, CAST(row_number() OVER (PARTITION BY side, session_id ORDER BY ts_ms, seq) AS INTEGER) AS ord, CASE event_name WHEN 'product_page_viewed' THEN 'detail' WHEN 'entity_clicked' THEN 'detail' WHEN 'search_submitted' THEN 'explore-search' WHEN 'collection_page_viewed' THEN 'explore-goto' WHEN 'product_added_to_cart' THEN 'add' WHEN 'checkout_started' THEN 'checkout' ELSE 'Other' END AS action
  FROM ev
), dom AS (SELECT unnest(['detail','explore-search','explore-goto','explore-back','explore-stay','add','checkout','remove','terminate']) AS action, unnest(range(9)) AS idx)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir)
    w = Window.partitionBy("side", "session_id").orderBy("ts_ms", "seq")
    return e.select("side", "session_id", F.row_number().over(w).alias("ord"), S.semantic_action(F.col("event_name")).alias("action"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = steps(spark, sf_dir)
    return both.where("side = 0").drop("side"), both.where("side = 1").drop("side")


JS = "0.5 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))"
register("agg9_length_stats", lambda s, d: fidelity.descriptive(fidelity.lengths(steps(s, d), "side"), "n", "side"), f"""WITH {STEPS_SQL}, l AS (SELECT side, session_id, count(*) AS n FROM steps GROUP BY ALL)
SELECT side, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, count(*) AS n FROM l GROUP BY side""")
register("agg10_action_frequencies", lambda s, d: fidelity.action_frequencies(steps(s, d), "side").select("side", "idx", "action", F.round("freq", 9).alias("freq")), f"""WITH {STEPS_SQL}, t AS (SELECT side, count(*) AS total FROM steps GROUP BY side)
SELECT t.side, CAST(idx AS INTEGER) AS idx, dom.action, round(count(s.action) / total, 9) AS freq FROM t CROSS JOIN dom LEFT JOIN steps s ON s.side = t.side AND s.action = dom.action GROUP BY t.side, idx, dom.action, total""")
register("agg11_transition_matrix", lambda s, d: fidelity.transition_matrix(steps(s, d), "side").select("side", "i", "j", F.round("p", 9).alias("p")), f"""WITH {STEPS_SQL}, n AS (SELECT *, lead(action) OVER (PARTITION BY side, session_id ORDER BY ord) AS nxt FROM steps),
c AS (SELECT n.side, a.idx AS i, b.idx AS j, count(*) AS c FROM n JOIN dom a ON a.action = n.action JOIN dom b ON b.action = n.nxt GROUP BY ALL)
SELECT s.side, CAST(a.idx AS INTEGER) AS i, CAST(b.idx AS INTEGER) AS j, round(coalesce(c.c / sum(c.c) OVER (PARTITION BY s.side, a.idx), 0), 9) AS p FROM (VALUES (0), (1)) s(side) CROSS JOIN dom a CROSS JOIN dom b LEFT JOIN c ON c.side = s.side AND c.i = a.idx AND c.j = b.idx""")
register("agg12_length_jsd", lambda s, d: fidelity.length_jsd(*sides(s, d)), f"""WITH {STEPS_SQL}, l AS (SELECT side, session_id, count(*) AS n FROM steps GROUP BY ALL), m AS (SELECT max(n) AS m FROM l), b AS (SELECT unnest(range(m + 1)) AS n FROM m),
h AS (SELECT b.n, count(l.n) FILTER (side = 0) AS r, count(l.n) FILTER (side = 1) AS s FROM b LEFT JOIN l USING (n) GROUP BY b.n),
e AS (SELECT r / sum(r) OVER () + 1e-12 AS p0, s / sum(s) OVER () + 1e-12 AS q0 FROM h), f AS (SELECT p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM e) SELECT round(sum({JS}), 9) AS jsd FROM f""")
register("math_action_jsd", lambda s, d: fidelity.action_jsd(*sides(s, d)), f"""WITH {STEPS_SQL}, c AS (SELECT dom.idx, count(s.action) FILTER (side = 0) / (SELECT count(*) FROM steps WHERE side = 0) + 1e-12 AS p0, count(s.action) FILTER (side = 1) / (SELECT count(*) FROM steps WHERE side = 1) + 1e-12 AS q0 FROM dom LEFT JOIN steps s USING (action) GROUP BY idx),
f AS (SELECT p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM c) SELECT round(sum({JS}), 9) AS jsd FROM f""")
register("agg13_outcome_flags", lambda s, d: fidelity.outcome_rates(steps(s, d), "side"), f"""WITH {STEPS_SQL}, f AS (SELECT side, session_id, bool_or(action = 'checkout') AS c, bool_or(action = 'add') AS a, bool_and(action IN ('detail','explore-search','explore-goto','explore-back','explore-stay','terminate')) AS b FROM steps GROUP BY ALL)
SELECT side, count(*) AS n, count(*) FILTER (c) AS has_checkout, count(*) FILTER (a) AS has_add_to_cart, count(*) FILTER (b) AS browse_only, count(*) FILTER (a AND NOT c) AS abandoned, round(count(*) FILTER (c) / count(*), 9) AS checkout_rate, round(count(*) FILTER (a) / count(*), 9) AS add_rate, round(count(*) FILTER (b) / count(*), 9) AS browse_rate, round(count(*) FILTER (a AND NOT c) / count(*), 9) AS abandoned_rate FROM f GROUP BY side""")
PRIMARY = "CASE WHEN bool_or(action = 'checkout') THEN 'checkout' WHEN bool_or(action = 'add') THEN 'abandoned' ELSE 'browse_only' END"
register("join5_prj10_paired_outcomes", lambda s, d: fidelity.paired_outcomes(*sides(s, d)), f"WITH {STEPS_SQL}, o AS (SELECT side, session_id, {PRIMARY} AS o FROM steps GROUP BY ALL) SELECT r.session_id, r.o AS real_outcome, s.o AS synth_outcome, CAST(r.o = s.o AS INTEGER) AS outcome_score FROM o r JOIN o s ON r.session_id = s.session_id AND r.side = 0 AND s.side = 1")
register("join6_matched_real", lambda s, d: fidelity.matched(*sides(s, d)).select("session_id", "ord", "action"), f"WITH {STEPS_SQL} SELECT session_id, ord, action FROM steps WHERE side = 0 AND session_id IN (SELECT session_id FROM steps WHERE side = 1)")
register("join7_without_excluded", lambda s, d: fidelity.without(sides(s, d)[1], sides(s, d)[0].where("action = 'checkout'").select("session_id")).select("session_id", "ord", "action"), f"WITH {STEPS_SQL} SELECT session_id, ord, action FROM steps WHERE side = 1 AND session_id NOT IN (SELECT session_id FROM steps WHERE side = 0 AND action = 'checkout')")
CODE = "string_agg(substr('abcdefghijO', CAST(coalesce(idx, 9) AS INTEGER) + 1, 1), '' ORDER BY ord)"
register("str_action_levenshtein", lambda s, d: fidelity.edit_distances(*sides(s, d)), f"""WITH {STEPS_SQL}, t AS (SELECT side, session_id, {CODE} AS w, count(*) AS n FROM steps LEFT JOIN dom USING (action) GROUP BY ALL)
SELECT r.session_id, levenshtein(r.w, s.w) AS distance, round(levenshtein(r.w, s.w) / greatest(r.n, s.n), 9) AS normalized FROM t r JOIN t s ON r.session_id = s.session_id AND r.side = 0 AND s.side = 1""")
register("math_matrix_distance", lambda s, d: fidelity.matrix_distance(*sides(s, d)), f"""WITH {STEPS_SQL}, n AS (SELECT *, lead(action) OVER (PARTITION BY side, session_id ORDER BY ord) AS nxt FROM steps),
c AS (SELECT n.side, a.idx AS i, b.idx AS j, count(*) AS c FROM n JOIN dom a ON a.action = n.action JOIN dom b ON b.action = n.nxt GROUP BY ALL), p AS (SELECT side, i, j, c / sum(c) OVER (PARTITION BY side, i) AS p FROM c),
x AS (SELECT coalesce(a.p, 0) - coalesce(b.p, 0) AS e FROM (SELECT * FROM p WHERE side = 0) a FULL JOIN (SELECT * FROM p WHERE side = 1) b USING (i, j)) SELECT round(sum(abs(e)), 9) AS l1, round(sqrt(sum(e * e)), 9) AS frobenius FROM x""")
register("math_chi_square", lambda s, d: fidelity.chi_square(*sides(s, d)).select(F.round("statistic", 6).alias("statistic"), "dof", F.round("p", 9).alias("p")), f"""WITH {STEPS_SQL}, o AS (SELECT side, session_id, {PRIMARY} AS o FROM steps GROUP BY ALL), c AS (SELECT side, o, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT s.side, k.o, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT side FROM c) s CROSS JOIN (SELECT DISTINCT o FROM c) k LEFT JOIN c ON c.side = s.side AND c.o = k.o),
e AS (SELECT n, sum(n) OVER (PARTITION BY side) * sum(n) OVER (PARTITION BY o) / sum(n) OVER () AS x, o FROM g) SELECT round(sum((n - x) ** 2 / x), 6) AS statistic, CAST(count(DISTINCT o) - 1 AS INTEGER) AS dof, round(exp(-sum((n - x) ** 2 / x) / 2), 9) AS p FROM e""")
register("math_two_proportions", lambda s, d: fidelity.two_proportions(*sides(s, d)).select(F.round("z", 6).alias("z")), f"""WITH {STEPS_SQL}, f AS (SELECT side, session_id, bool_or(action = 'checkout') AS c FROM steps GROUP BY ALL), g AS (SELECT count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2, count(*) FILTER (side = 0 AND c) AS x1, count(*) FILTER (side = 1 AND c) AS x2 FROM f)
SELECT round((x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM g""")
register("flt3_valid_sessions", lambda s, d: fidelity.valid_sessions(fidelity.arrays(steps(s, d).where("side = 0"))).select("session_id", "n"), f"WITH {STEPS_SQL} SELECT session_id, CAST(count(*) AS INTEGER) AS n FROM steps WHERE side = 0 GROUP BY session_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = sides(spark, sf_dir)
    outcome = fidelity.paired_outcomes(real, synth).select("session_id", F.col("outcome_score").cast("double").alias("outcome"))
    edit = fidelity.edit_distances(real, synth).select("session_id", (1 - F.col("normalized")).alias("sequence"))
    length = fidelity.lengths(synth).select("session_id", (F.col("n") / 100).alias("size"))
    return fidelity.merge_scores({"outcome": outcome, "sequence": edit, "size": length}).withColumn("mean", F.round("mean", 6)).select("session_id", "mean", "n_scores")


register("join21_merge_scores", _scores, f"""WITH {STEPS_SQL}, t AS (SELECT side, session_id, {CODE} AS w, count(*) AS n, {PRIMARY} AS o FROM steps LEFT JOIN dom USING (action) GROUP BY ALL),
p AS (SELECT r.session_id, CAST(r.o = s.o AS INTEGER) AS a, 1 - round(levenshtein(r.w, s.w) / greatest(r.n, s.n), 9) AS b FROM t r JOIN t s ON r.session_id = s.session_id AND r.side = 0 AND s.side = 1), l AS (SELECT session_id, n / 100 AS c FROM t WHERE side = 1)
SELECT session_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER)), 6) AS mean, CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER) AS n_scores FROM p FULL JOIN l USING (session_id)""")
