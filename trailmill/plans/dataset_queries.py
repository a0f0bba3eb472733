"""Queries of datasets, scores and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import datasets as D
from ..operators import features
from ..operators import inference as I
from ..operators import scoring as R
from .fixtures import EVENTS_SQL, ITEMS_SQL, item_events, provider_events, table
from .registry import register
from .session_queries import sides

SHA = "sha256('42|' || {})"
register("win13_sliding_windows", lambda s, d: D.sliding_windows(provider_events(s, d), "session_id", "seq", 6, 4), f"""WITH {EVENTS_SQL}, n AS (SELECT session_id, seq, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM ev),
c AS (SELECT DISTINCT session_id, n FROM n), st AS (SELECT session_id, CASE WHEN n <= 6 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, n - 6 + 1, 4), [n - 6]))) END AS st FROM c), w AS (SELECT session_id, unnest(st) AS s, unnest(range(len(st))) AS w FROM st)
SELECT n.session_id, n.session_id || '#w' || w AS window, s::INTEGER AS start, (i - s)::INTEGER AS place, seq FROM n JOIN w ON w.session_id = n.session_id AND i >= s AND i < s + 6""")
register("win14_turns", lambda s, d: D.turns(table(s, d, "conversations")), """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nb, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ui FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS turn_idx, nb::INTEGER AS n_before, ui, text AS completion FROM p WHERE role = 'assistant'""")
register("flt9_first_windows", lambda s, d: D.first_windows(D.sliding_windows(provider_events(s, d), "session_id", "seq", 6, 4)).select("window", "seq", D.base_session(F.col("window")).alias("base")), f"""WITH {EVENTS_SQL}, n AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM ev) SELECT session_id || '#w0' AS window, seq, session_id::VARCHAR AS base FROM n WHERE i <= 6""")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir)
    return D.gate_by_score(e, e.where("price IS NOT NULL AND side = 1").select("session_id", F.col("event_name").alias("criterion"), F.col("price").alias("score")), 60.0, "session_id").select("session_id", "seq")


register("flt4_score_gate", _gate, f"WITH {EVENTS_SQL}, l AS (SELECT session_id FROM ev WHERE price IS NOT NULL AND side = 1 GROUP BY session_id HAVING avg(price) < 60.0) SELECT session_id, seq FROM ev WHERE session_id NOT IN (SELECT session_id FROM l)")
register("flt5_clean_actions", lambda s, d: D.clean_actions(table(s, d, "events").withColumn("action", F.when(F.col("event_type") == "view", "Type").otherwise(F.col("event_type")))).select("event_id"), "SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
register("flt6_add_to_cart", lambda s, d: table(s, d, "events").select("event_id", D.is_add_to_cart(F.when(F.col("event_id") % 3 == 0, "btn.ADD_to_Bag").when(F.col("event_id") % 3 == 1, "Add-To-Cart"), F.when(F.col("event_id") % 5 == 0, "please ADD Item").when(F.col("event_id") % 5 == 1, "add_item")).alias("add")), "SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS add FROM events")
register("flt7_before_first_add", lambda s, d: D.truncate_before_add(provider_events(s, d), "session_id", "seq", F.col("event_name") == "product_added_to_cart").select("session_id", "seq"), f"WITH {EVENTS_SQL} SELECT session_id, seq FROM (SELECT *, min(CASE WHEN event_name = 'product_added_to_cart' THEN seq END) OVER (PARTITION BY session_id) AS f FROM ev) WHERE f IS NULL OR seq < f")
register("flt8_drop_runs", lambda s, d: D.drop_runs_with(provider_events(s, d), "session_id", F.col("event_name") == "entity_impression").select("session_id", "seq"), f"WITH {EVENTS_SQL} SELECT session_id, seq FROM ev WHERE session_id NOT IN (SELECT session_id FROM ev WHERE event_name = 'entity_impression')")
register("flt11_min_steps", lambda s, d: D.min_steps(provider_events(s, d), "session_id", 12).select("session_id", "seq"), f"WITH {EVENTS_SQL} SELECT session_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ev) WHERE n >= 12")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_events(spark, sf_dir).select("session", "store", F.concat(F.lit("a"), (F.col("item") % 4).cast("string")).alias("action"), F.when(F.col("session") % 5 == 0, "test").otherwise("train").alias("split"), "item")


ACTIONS_SQL = ITEMS_SQL + ", act AS (SELECT session, store, 'a' || (item % 4) AS action, CASE WHEN session % 5 = 0 THEN 'test' ELSE 'train' END AS split, item FROM items)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("store"), F.col("o_orderkey").alias("session"), F.col("o_orderstatus").alias("persona"))


register("join13_action_user", lambda s, d: D.join_users(_actions(s, d), users(s, d), ["store", "session"]).select("store", "session", "item", "persona"), f"WITH {ACTIONS_SQL} SELECT store, session, item, o_orderstatus AS persona FROM act JOIN orders ON o_orderkey = session AND o_custkey % 5 = store")
register("join14_missing_users", lambda s, d: D.missing_keys(_actions(s, d), users(s, d), ["store", "session"]), f"WITH {ACTIONS_SQL} SELECT DISTINCT store, session FROM act WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = session AND o_custkey % 5 = store)")
register("join15_referenced", lambda s, d: D.referenced(users(s, d), _actions(s, d), ["store", "session"]), f"WITH {ACTIONS_SQL} SELECT o_custkey % 5 AS store, o_orderkey AS session, o_orderstatus AS persona FROM orders WHERE EXISTS (SELECT 1 FROM act WHERE session = o_orderkey AND store = o_custkey % 5)")
register("join25_table_differences", lambda s, d: D.differences(_actions(s, d).select("action", "split"), _actions(s, d).where("item % 10 <> 3").select("action", "split")), f"WITH {ACTIONS_SQL} SELECT 'left' AS side, count(*) AS n FROM act WHERE item % 10 = 3 HAVING count(*) > 0")
register("smp3_nested_sample", lambda s, d: D.nested_sample(_actions(s, d).select("store", "session").distinct(), "store", "session", 25), f"WITH {ACTIONS_SQL} SELECT store, session, place FROM (SELECT store, session, row_number() OVER (PARTITION BY store ORDER BY {SHA.format('session')}, session)::INTEGER AS place FROM (SELECT DISTINCT store, session FROM act)) WHERE place <= 25")
register("smp4_ratio_cap", lambda s, d: D.cap_ratio(_actions(s, d).groupBy("session").agg(F.bool_or(F.col("action") == "a1").alias("add")), F.col("add"), 0.4), f"""WITH {ACTIONS_SQL}, k AS (SELECT session, bool_or(action = 'a1') AS add FROM act GROUP BY session), c AS (SELECT trunc(0.4 * count(*) FILTER (NOT add) / (1 - 0.4)) AS cap FROM k),
r AS (SELECT session, add, row_number() OVER (ORDER BY {SHA.format('session')}, session) AS k FROM k WHERE add) SELECT session, add FROM k WHERE NOT add UNION ALL SELECT session, add FROM r, c WHERE r.k <= cap""")
register("set8_split_groups", lambda s, d: D.split_groups(_actions(s, d).select("session").distinct(), 0.1), f"WITH {ACTIONS_SQL}, k AS (SELECT session, row_number() OVER (ORDER BY {SHA.format('session')}, session) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM act)) SELECT session, CASE WHEN k <= greatest(1, round_even(0.1 * n, 0)) THEN 'test' ELSE 'train' END AS split FROM k")
register("set3_leak_check", lambda s, d: D.leaks(_actions(s, d).where("item % 3 = 0"), _actions(s, d).where("split = 'test'"), "session"), f"WITH {ACTIONS_SQL} SELECT session FROM act WHERE item % 3 = 0 INTERSECT SELECT session FROM act WHERE split = 'test'")
register("set4_pool_runs", lambda s, d: D.pool({"a": _actions(s, d).where("store = 1").select("session", "action"), "b": _actions(s, d).where("store = 2").select("session", "action")}, "session").groupBy("session").agg(F.count("*").alias("n")), f"WITH {ACTIONS_SQL} SELECT CASE store WHEN 1 THEN 'a' ELSE 'b' END || '__' || session AS session, count(*) AS n FROM act WHERE store IN (1, 2) GROUP BY store, session")
register("set7_upsert", lambda s, d: D.upsert(users(s, d).select("session", "persona"), users(s, d).where("session % 4 = 0").select("session", F.lit("new").alias("persona")), "session"), "SELECT o_orderkey AS session, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS persona FROM orders")
register("set2_shared_ids", lambda s, d: D.shared_ids(_actions(s, d), "action", "session"), f"WITH {ACTIONS_SQL} SELECT session, count(DISTINCT action) = (SELECT count(DISTINCT action) FROM act) AS shared FROM act GROUP BY session")
register("set5_merge_fields", lambda s, d: D.merge_fields(_actions(s, d).select(F.concat(F.lit("f"), (F.col("session") % 50).cast("string")).alias("path"), F.col("action").alias("value"), F.struct("session", "item", "action").alias("source"))), f"WITH {ACTIONS_SQL} SELECT 'f' || (session % 50) AS path, arg_max(action, struct_pack(a := session, b := item, c := action)) AS value, count(DISTINCT action) - 1 AS conflicts FROM act GROUP BY session % 50")
register("agg20_grouping_sets", lambda s, d: D.dataset_statistics(_actions(s, d)), f"WITH {ACTIONS_SQL} SELECT store, split, count(*) AS n_actions, count(DISTINCT session) AS n_sessions, count(DISTINCT action) AS n_types FROM act GROUP BY GROUPING SETS ((), (store), (split))")
register("agg21_distribution", lambda s, d: D.distribution(_actions(s, d).groupBy("store", "session").count(), "count", "store"), f"WITH {ACTIONS_SQL}, n AS (SELECT store, session, count(*) AS c FROM act GROUP BY ALL) SELECT store, count(c) AS n, round(avg(c), 2) AS mean, round(median(c), 2) AS median, round(stddev_pop(c), 2) AS std, round(min(c)::DOUBLE, 2) AS least, round(quantile_cont(c, 0.25), 2) AS p25, round(quantile_cont(c, 0.75), 2) AS p75, round(max(c)::DOUBLE, 2) AS most FROM n GROUP BY store")
register("agg22_completeness", lambda s, d: D.completeness(provider_events(s, d), ["price", "query", "product_handle"]), f"WITH {EVENTS_SQL} SELECT 'price' AS field, count(price) AS n, round(100 * count(price) / count(*), 2) AS percent FROM ev UNION ALL SELECT 'query', count(*) FILTER (query <> ''), round(100 * count(*) FILTER (query <> '') / count(*), 2) FROM ev UNION ALL SELECT 'product_handle', count(*) FILTER (product_handle <> ''), round(100 * count(*) FILTER (product_handle <> '') / count(*), 2) FROM ev")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), F.when(F.col("doc_id") % 17 != 0, (F.col("quality") + (F.col("doc_id") % 3 == 0).cast("int")) % 2).alias("p"), (F.col("doc_id") % 2).alias("seed"))


LABELS_SQL = "lab AS (SELECT doc_id, quality AS y, CASE WHEN doc_id % 17 <> 0 THEN (quality + (doc_id % 3 = 0)::INTEGER) % 2 END AS p, doc_id % 2 AS seed FROM labels)"
register("agg23_binary_metrics", lambda s, d: R.binary_metrics(_labels(s, d), "y", "p", "seed"), f"""WITH {LABELS_SQL}, c AS (SELECT seed, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND (p IS NULL OR p = 1)) AS fp, count(*) FILTER (y = 1 AND (p IS NULL OR p = 0)) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (p IS NULL) AS invalid FROM lab GROUP BY seed)
SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy FROM c""")
register("agg24_action_metrics", lambda s, d: R.action_metrics(table(s, d, "events").select(F.when(F.col("event_id") % 13 != 0, F.col("event_type")).otherwise("").alias("action"), F.when(F.col("event_id") % 5 == 0, "click").when(F.col("event_id") % 7 == 0, "tab").otherwise(F.col("event_type")).alias("predicted"))), """WITH r AS (SELECT event_type AS a, CASE WHEN event_id % 5 = 0 THEN 'click' WHEN event_id % 7 = 0 THEN 'tab' ELSE event_type END AS p FROM events WHERE event_id % 13 <> 0),
k AS (SELECT a AS c FROM r UNION SELECT p FROM r), s AS (SELECT c, (SELECT count(*) FROM r WHERE a = c) AS sup, (SELECT count(*) FROM r WHERE p = c) AS pr, (SELECT count(*) FROM r WHERE a = c AND p = c) AS h FROM k), f AS (SELECT *, CASE WHEN sup + pr > 0 THEN 2 * h / (sup + pr) ELSE 0 END AS f1 FROM s)
SELECT sum(sup)::BIGINT AS n, round(sum(h) / sum(sup), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * sup) / sum(sup), 9) AS weighted_f1 FROM f""")
register("agg25_mean_scores", lambda s, d: R.mean_scores(table(s, d, "labels").select(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("scores"))), "SELECT 'quality' AS criterion, round(avg(quality), 6) AS mean, count(*) AS n FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 6), count(*) FROM labels")
register("agg28_mean_std", lambda s, d: R.mean_and_deviation(provider_events(s, d), "price", "side"), f"WITH {EVENTS_SQL} SELECT side, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, count(price) AS n FROM ev GROUP BY side")
register("agg29_bucket_rates", lambda s, d: R.bucket_rates(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), (F.col("quality") == 1).alias("ok")).where("ok IS NOT NULL"), "lang", "ok"), "SELECT CASE WHEN lang <> 'es' THEN lang ELSE '<unknown>' END AS bucket, count(*) AS n, round(avg(quality), 9) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
register("agg38_join26_agreement", lambda s, d: R.agreement(table(s, d, "labels"), "quality", "toxic"), "SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (toxic > quality) AS gained, count(*) FILTER (toxic < quality) AS lost FROM labels")
register("agg40_ranked_summary", lambda s, d: features.value_counts(table(s, d, "documents"), "source").orderBy(F.desc_nulls_last("n")).select("source", "n"), "SELECT source, count(*) AS n FROM documents GROUP BY source")
register("join20_backfill", lambda s, d: R.backfill(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("bad").alias("verdict")), "doc_id"), "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'bad' ELSE 'missing' END AS verdict FROM documents d FULL JOIN labels l USING (doc_id)")
register("join16_paired_difference", lambda s, d: R.paired_difference(provider_events(s, d).where("side = 0").groupBy("session_id").agg(F.count("*").alias("v")), provider_events(s, d).where("side = 1").groupBy("session_id").agg(F.count("*").alias("v")), "session_id", "v"), f"WITH {EVENTS_SQL}, c AS (SELECT session_id, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM ev GROUP BY session_id) SELECT count(*) FILTER (x > 0 AND y > 0) AS n, round(avg(x - y) FILTER (x > 0 AND y > 0), 9) AS mean_difference, count(*) FILTER (x = 0 OR y = 0) AS unpaired FROM c")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where("turn = 0").select("conv_id", F.col("text").alias("a")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("b")), "conv_id")


register("str_token_f1", lambda s, d: R.token_f1(_pairs(s, d), "conv_id", "a", "b"), r"""WITH p AS (SELECT x.conv_id, replace(replace(lower(x.text), 'ß', 'ss'), 'ς', 'σ') AS a, replace(replace(lower(y.text), 'ß', 'ss'), 'ς', 'σ') AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = 0 AND y.turn = 1),
w AS (SELECT conv_id, 0 AS s, unnest(regexp_extract_all(a, '[\p{L}\p{N}_]+')) AS w FROM p UNION ALL SELECT conv_id, 1, unnest(regexp_extract_all(b, '[\p{L}\p{N}_]+')) FROM p), c AS (SELECT conv_id, w, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM w GROUP BY ALL)
SELECT p.conv_id, round(coalesce(2 * sum(least(x, y)) / (sum(x) + sum(y)), 1), 9) AS f1 FROM p LEFT JOIN c ON c.conv_id = p.conv_id GROUP BY p.conv_id""")
register("rwd1_target_reward", lambda s, d: _pairs(s, d).select("conv_id", F.round(R.target_reward(R.similar_share(F.col("a"), F.col("b")), F.col("conv_id") % 2 == 0, F.col("a") == F.col("b")), 9).alias("reward")))
register("rwd3_composite_reward", lambda s, d: table(s, d, "events").select("event_id", F.round(R.composite_reward(F.col("event_id") % 11 != 0, F.col("event_id") % 3 != 0, F.col("event_id") % 5 / 4, F.col("event_id") % 8 / 8, F.col("event_id") % 16 / 16, F.col("event_id") % 2 == 0), 6).alias("reward")), """WITH c AS (SELECT event_id, 0.05 + 0.45 * (0.7 * (event_id % 5 / 4) + 0.3 * (event_id % 8 / 8)) AS plain, event_id % 16 / 16 AS target FROM events)
SELECT event_id, round(CASE WHEN event_id % 11 = 0 OR event_id % 3 = 0 THEN 0 WHEN event_id % 2 = 0 THEN plain + 0.5 * target ELSE plain / 0.5 END, 6)::DOUBLE AS reward FROM c""")


def _ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), F.col("p_partkey").cast("string").alias("name"), (F.col("p_partkey") % 37 / 400).alias("p"))


register("sta5_holm", lambda s, d: R.holm(_ps(s, d), "p", "family").withColumn("adjusted", F.round("adjusted", 9)).withColumn("p", F.round("p", 9)), """WITH q AS (SELECT p_type AS family, p_partkey::VARCHAR AS name, p_partkey % 37 / 400 AS p FROM part),
h AS (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) AS h FROM q) SELECT family, name, round(p, 9) AS p, round(least(1.0, max(h) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM h""")
def _mix_sql(x: str, out: str) -> str:
    """Steps of the finalizer as select items, the last one named `out`."""
    times = "({0} * {1}::UBIGINT) % 4294967296::UBIGINT"
    return f"{times.format(f'xor({x}, {x} >> 16)', 2246822507)} AS {out}_1, {times.format(f'xor({out}_1, {out}_1 >> 13)', 3266489909)} AS {out}_2, xor({out}_2, {out}_2 >> 16) AS {out}"


def draws_sql(keys: str, key: str, seed: int, replicates: int = 10_000) -> str:
    """CTEs up to `drawn`: the rows of `keys` in every replicate r, with the hash h of inference.hashes."""
    half = lambda at: f"('0x' || substr(md5({key}::VARCHAR), {at}, 8))::UBIGINT"
    return f"""reps AS (SELECT r, {_mix_sql("x", "e")} FROM (SELECT r, xor(r::UBIGINT, {seed}::UBIGINT) AS x FROM range({replicates}) g(r))),
halves AS (SELECT *, {half(1)} AS ka, {half(9)} AS kb FROM {keys}),
inner_ AS (SELECT *, {_mix_sql("x", "f")} FROM (SELECT h.*, r, xor(kb, e) AS x FROM halves h, reps)),
drawn AS (SELECT * EXCLUDE (x2), {_mix_sql("x2", "h")} FROM (SELECT *, xor(ka, f) AS x2 FROM inner_))"""


#: The cumulative Poisson probabilities over all 32-bit values.
POISSON_SQL = " + ".join(f"(h >= {int(c * 4294967296)})::INTEGER" for c in I.POISSON)
BOOT_SQL = EVENTS_SQL + f""", st AS (SELECT session_id, sum(round(coalesce(price, 0) * 100)::BIGINT)::BIGINT AS t, count(*) AS c FROM ev GROUP BY session_id), {draws_sql("st", "session_id", 42)},
b AS (SELECT r AS replicate, ((20000 * sum(t * w)::BIGINT + sum(c * w)::BIGINT) // (2 * sum(c * w)::BIGINT)) / 1e6 AS value FROM (SELECT r, t, c, {POISSON_SQL} AS w FROM drawn) GROUP BY r)"""


def _boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices of 10,000 resamples, in whole millionths: sums of whole cents, divided once."""
    st = provider_events(spark, sf_dir).groupBy("session_id").agg(F.sum(F.round(F.coalesce("price", F.lit(0.0)) * 100).cast("long")).alias("t"), F.count("*").alias("c"))
    drawn = I.bootstrap_ratio(st, "session_id", "t", "c", 10_000)
    return drawn.select("replicate", F.expr("((20000 * CAST(total AS LONG) + CAST(count AS LONG)) div (2 * CAST(count AS LONG))) / 1e6D").alias("value"))


register("sta1_3_bootstrap", _boot, f"WITH {BOOT_SQL} SELECT replicate, value FROM b")
register("sta4_interval", lambda s, d: R.interval(_boot(s, d)), f"WITH {BOOT_SQL} SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS n FROM b")


def _permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return I.permutation_p(e, "session_id", "a", "b", 10_000).select(F.round("difference", 6).alias("difference"), F.round("p", 9).alias("p"))


register("sta2_permutation", _permutation, f"""WITH {EVENTS_SQL}, e AS (SELECT session_id, count(*) FILTER (side = 0) - count(*) FILTER (side = 1) AS d FROM ev GROUP BY session_id), {draws_sql("e", "session_id", 42)},
x AS (SELECT r, sum(d * CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS x FROM drawn GROUP BY r), b AS (SELECT sum(d) AS total, avg(d) AS m FROM e)
SELECT round(m, 6) AS difference, round((count(*) FILTER (abs(x) >= abs(total)) + 1) / (count(*) + 1), 9) AS p FROM x, b GROUP BY m""")


def _methods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """Sessions of even events as the real ones; of odd events, and of these without every third step, as two methods; prices as scores."""
    real, synth = sides(spark, sf_dir)
    thin = synth.where("ord % 3 <> 0 OR ord = 1")
    e = provider_events(spark, sf_dir).groupBy("session_id", "side").agg(F.avg("price").alias("x"), F.count("price").alias("n"))
    scores = lambda side, k: e.where(F.col("side") == side).select("session_id", F.when(F.col("n") > k, F.col("x") / 1000).alias("coherence"), F.when(F.col("session_id") % 5 != k, F.col("x") / 2000).alias("similarity"))
    return real, {"odd events": synth, "thinned": thin}, {"real": scores(0, 1), "odd events": scores(1, 1), "thinned": scores(1, 2)}


def _fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synths, scores = _methods(spark, sf_dir)
    table_ = I.fidelity_table(real, synths, "odd events", scores, 10_000, 10_000)
    return table_.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in table_.dtypes])


register("sta1_2_fidelity_table", _fidelity)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and reciprocal ranks of two methods under two conditions and three seeds, by hashes of the events."""
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("condition"), F.lit(s).cast("long").alias("seed"), F.lit(7 * i + 3 * j + s).alias("salt"), F.lit(j).alias("j")) for i, m in enumerate(("narm", "rain")) for j, c in enumerate((I.BASELINE, "synth_to_real")) for s in range(3)])).alias("run")
    e = provider_events(spark, sf_dir).select("session_id", "seq", runs).select("session_id", "seq", "run.*")
    rank = F.conv(F.substr(F.md5(F.concat_ws("|", "salt", "seq")), F.lit(1), F.lit(6)), 16, 10).cast("long") % (20 + F.col("j")) + 1
    return e.withColumn("rank", rank).select("method", "condition", "seed", F.col("session_id").alias("session"), F.col("seq").alias("example"), *[F.when(F.col("rank") <= k, 1.0).otherwise(0.0).alias(f"hit{k}") for k in (5, 10)], F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0).alias("rr10"))


METRICS = ["hit5", "hit10", "rr10"]


def _contrasts(spark: SparkSession, sf_dir: str, again: bool = False, relative: float | None = None) -> DataFrame:
    found = I.contrast_table(I.contrast_replicates(_predictions(spark, sf_dir), METRICS, replicates=10_000, resample_seeds=again), relative_margin=relative)
    return found.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


register("sta3_4_9_contrast_table", _contrasts, f"""WITH {EVENTS_SQL}, runs AS (SELECT m.method, c.condition, s.seed, 7 * i + 3 * j + s.seed AS salt, j FROM (VALUES ('narm', 0), ('rain', 1)) m(method, i), (VALUES ('real_to_real', 0), ('synth_to_real', 1)) c(condition, j), range(3) s(seed)),
ranks AS (SELECT session_id, method, condition, ('0x' || substr(md5(salt || '|' || seq), 1, 6))::BIGINT % (20 + j) + 1 AS rank FROM ev, runs),
per AS (SELECT session_id, method, condition, sum((rank <= 5)::INTEGER) / 3 AS hit5, sum((rank <= 10)::INTEGER) / 3 AS hit10, sum(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END) / 3 AS rr10 FROM ranks GROUP BY ALL),
sizes AS (SELECT session_id, count(*) AS n FROM ev GROUP BY session_id), {draws_sql("sizes", "session_id", 42)},
weights AS (SELECT session_id, n, r, {POISSON_SQL} AS w FROM drawn UNION ALL SELECT session_id, n, -1, 1 FROM sizes),
long AS (SELECT session_id, method, condition, metric, value FROM per UNPIVOT (value FOR metric IN (hit5, hit10, rr10))),
arms AS (SELECT r, method, condition, metric, sum(value * w) / sum(n * w) AS mean FROM long JOIN weights USING (session_id) GROUP BY ALL),
d AS (SELECT r, a.method, a.condition, a.metric, 100 * a.mean AS arm, 100 * b.mean AS base, round(100 * (a.mean - b.mean), 9) AS d FROM arms a JOIN arms b USING (r, method, metric) WHERE a.condition <> 'real_to_real' AND b.condition = 'real_to_real'),
t AS (SELECT method, condition, metric, max(arm) FILTER (r < 0) AS arm, max(base) FILTER (r < 0) AS baseline, quantile_cont(d, 0.025) FILTER (r >= 0) AS ci_low, quantile_cont(d, 0.975) FILTER (r >= 0) AS ci_high, quantile_cont(d, 0.05) FILTER (r >= 0) AS lower_bound, stddev_samp(d) FILTER (r >= 0) AS se,
  least(1.0, 2 * least(count(*) FILTER (r >= 0 AND d <= 0), count(*) FILTER (r >= 0 AND d >= 0)) / 10000) AS p FROM d GROUP BY ALL),
h AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, method || '|' || metric || '|' || condition) + 1) AS h FROM t)
SELECT method, condition, metric, round(arm, 6) AS arm, round(baseline, 6) AS baseline, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(lower_bound, 6) AS lower_bound, round(se, 6) AS se, round(p, 6) AS p, round(arm - baseline, 6) AS delta, round((arm - baseline) / baseline, 6) AS relative, 2.0::DOUBLE AS margin,
  lower_bound > -2 AS non_inferior, ci_low > -2 AND ci_high < 2 AS equivalent, round(least(1.0, max(h) OVER (ORDER BY p, method || '|' || metric || '|' || condition ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h""")
register("sta3_seed_resample", lambda s, d: _contrasts(s, d, True, 0.1))
register("sta_normal_tail", lambda s, d: table(s, d, "events").select("event_id", R.normal_tail((F.col("value") - 50) / 7).alias("p")))
register("math_chi_square_tail", lambda s, d: table(s, d, "events").select("event_id", *[R.chi_square_tail(F.col("value") / 3, k).alias(f"p{k}") for k in (1, 2, 3, 4)]))


def _controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider_events(spark, sf_dir).select("session_id", "seq", "event_name")
    n = e.select("session_id").distinct().count()
    return D.control_adds(e, "session_id", "seq", F.col("event_name") == "product_added_to_cart", 0.2, target=n * 3 // 4).select("session_id", "seq")


register("smp4_salvaged_sessions", _controlled, f"""WITH {EVENTS_SQL}, k AS (SELECT session_id, bool_or(event_name = 'product_added_to_cart') AS has, min(CASE WHEN event_name = 'product_added_to_cart' THEN seq END) AS first_add FROM ev GROUP BY session_id),
c AS (SELECT trunc(0.2 * count(*) FILTER (NOT has) / (1 - 0.2)) AS cap, count(*) FILTER (NOT has) AS others, count(*) * 3 // 4 AS target FROM k), p AS (SELECT session_id, first_add, row_number() OVER (ORDER BY sha256('42|' || session_id), session_id) AS place FROM k WHERE has),
b AS (SELECT ev.session_id, place, count(*) AS n FROM ev JOIN p USING (session_id), c WHERE place > cap AND seq < first_add GROUP BY ALL), f AS (SELECT session_id FROM (SELECT session_id, row_number() OVER (ORDER BY place) AS r FROM b WHERE n >= 2), c WHERE r <= target - others - cap)
SELECT session_id, seq FROM ev WHERE session_id IN (SELECT session_id FROM k WHERE NOT has UNION ALL SELECT session_id FROM p, c WHERE place <= cap) UNION ALL SELECT ev.session_id, seq FROM ev JOIN p USING (session_id) WHERE seq < first_add AND ev.session_id IN (SELECT session_id FROM f)""")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every kind on the events: fields too few, of other kinds, broken texts."""
    texts = ['{"rationale":"r","action":"click","target":"%"}', '{"rationale":"r","action":"type","target":"t","text":"x","enter":true}', '{"rationale":"r","action":"type","target":"t","text":"x","enter":1}', '{"rationale":"r","action":"scroll","direction":"up","amount":2.5}', '{"rationale":"r","action":"scroll","direction":"left","amount":2}', '{"rationale":1,"action":"back"}', '{"rationale":"r","action":"back","extra":[1]} ', '[1]', 'no', '{"rationale":"r","action":"switch_tab","tab_id":3}', '{"rationale":"r","action":"switch_tab","tab_id":true}', '{"rationale":"r","action":"dance"}']
    pick = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.replace(pick, F.lit("%"), F.col("event_type")).alias("answer"), "event_type")


register("rwd2_valid_answers", lambda s, d: _answers(s, d).select("event_id", X.valid_answer(F.col("answer")).alias("valid")), "SELECT event_id, event_id % 12 IN (0, 1, 3, 6, 9) AS valid FROM events")
register("rwd2_components", lambda s, d: _answers(s, d).select("event_id", X.answer_components(F.col("answer"), F.lit("click"), F.when(F.col("event_id") % 24 == 0, F.col("event_type")).otherwise(""), F.concat(F.lit("<a data-semantic-id='"), "event_type", F.lit("'>")), lambda a, b: F.when((a == "") & (b == ""), 1.0).when(a == b, 1.0).otherwise(0.0)).alias("c")).select("event_id", "c.format", "c.action", F.round("c.target", 6).alias("target")), "SELECT event_id, (event_id % 12 IN (0, 1, 3, 6, 9))::INTEGER::DOUBLE AS format, (event_id % 12 = 0)::INTEGER::DOUBLE AS action, CASE WHEN event_id % 24 = 0 THEN 1.0 WHEN event_id % 12 = 0 THEN 0.1 WHEN event_id % 12 IN (1, 2) THEN 0 ELSE 0.9 END::DOUBLE AS target FROM events")


def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.session_summary(provider_events(spark, sf_dir)).select("session_id", "outcome", "n_real", F.split("products", ",").alias("products"))
    ids = R.select_sessions(found, 40, least=2)
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "session_id string, place int")


register("smp1_greedy_coverage", _greedy)
register("smp7_carved_sessions", lambda s, d: D.carve(_actions(s, d).select("session").distinct(), 0.1, 50).select("session", "split"), f"""WITH {ACTIONS_SQL}, k AS (SELECT session, row_number() OVER (ORDER BY sha256('42|' || session), session) AS place, greatest(1, trunc(0.1 * count(*) OVER ())) AS val FROM (SELECT DISTINCT session FROM act))
SELECT session, CASE WHEN place <= val THEN 'val' ELSE 'train' END AS split FROM k WHERE place <= val + 50""")
