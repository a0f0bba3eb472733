"""Recorded and generated actions as semantic ones, their payloads and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .datasets import ADD_PHRASES, ADD_TARGETS, hash_places

#: Parts of targets and descriptions that tell an action.
CHECKOUT_TARGETS = ("buy_it_now", "buy_now", "checkout", "check_out")
CHECKOUT_TEXTS = ("buy it now", "buy now", "proceed to checkout", "checkout")


def _has(value: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(value, F.lit(p))
    return out


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def classify_steps(steps: DataFrame) -> DataFrame:
    """Steps (session_id, ord, type, url, clicked_url, target, description) with `semantic`; the order of the rules decides.

    Terminate steps are their own action and are passed over when a later step
    looks at the previous one. A step whose previous click has no URL counts as
    staying: its page ends with nothing.
    """
    w = Window.partitionBy("session_id", "__end").orderBy("ord")
    rows = steps.withColumn("__end", F.coalesce(F.lower("type") == "terminate", F.lit(False)))
    rows = rows.withColumns({"__p": F.coalesce(F.lag("url").over(w), F.lit("")), "__c": F.coalesce(F.lag("clicked_url").over(w), F.lit(""))})
    kind, url, clicked, target, text = (_low(c) for c in ("type", "url", "clicked_url", "target", "description"))
    page = lambda u: F.substring_index(u, "?", 1)
    searches = lambda u: _has(u, ("/search", "?q="))
    stays = ((url != "") & (url == F.lower("__p"))) | F.endswith(page(url), F.lower("__c")) | (page(F.col("__p")) == page(url))
    rules = [
        (F.col("__end"), "terminate"),
        (kind == "back", "explore-back"),
        (kind.isin("scroll", "hover", "move"), "explore-stay"),
        (F.contains(clicked, F.lit("/products/")), "detail"),
        (searches(clicked) | F.contains(target, F.lit("search")), "explore-search"),
        (F.contains(clicked, F.lit("/collections/")), "explore-goto"),
        (F.contains(clicked, F.lit("/cart")), "add"),
        (F.contains(clicked, F.lit("/checkout")), "checkout"),
        (_has(target, ADD_TARGETS), "add"),
        (_has(target, CHECKOUT_TARGETS), "checkout"),
        (_has(text, ADD_PHRASES), "add"),
        (_has(text, CHECKOUT_TEXTS), "checkout"),
        ((kind == "type") & searches(url), "explore-search"),
        (stays, "explore-stay"),
    ]
    out = F
    for hit, name in rules:
        out = out.when(hit, name)
    return rows.withColumn("semantic", out.otherwise("explore-goto")).drop("__end", "__p", "__c")


def flat_action(kind: Column, target: Column, text: Column, navigation: Column, url: Column, scrolled: Column) -> Column:
    """(action, target, text, url, direction) of a recorded action; null for kinds without one."""
    none = F.lit(None).cast("string")
    nav = F.lower(F.trim(F.coalesce(navigation, F.lit(""))))
    method = F.when(nav == "back", "back").when(nav == "forward", "forward").when(nav == "reload", "refresh").otherwise("goto_url")
    make = lambda action, target=none, text=none, url=none, direction=none: F.struct(action.alias("action"), target.alias("target"), text.alias("text"), url.alias("url"), direction.alias("direction"))
    aim = F.coalesce(target, F.lit(""))
    return (
        F.when(kind == "click", make(F.lit("click"), aim))
        .when(kind == "input", make(F.lit("type"), aim, F.coalesce(text, F.lit(""))))
        .when(kind == "terminate", make(F.lit("terminate")))
        .when(kind == "scroll", make(F.lit("scroll"), aim, direction=F.when(F.startswith(F.coalesce(scrolled, F.lit("")), F.lit("-")), "up").otherwise("down")))
        .when(kind == "navigation", make(method, url=F.when(method == "goto_url", F.coalesce(url, F.lit("")))))
        .when(kind == "tab_activate", make(F.lit("switch_tab")))
    )


def raw_action(action: Column, url: Column, slug: Column, text: Column, query: Column) -> Column:
    """The payload of an action as JSON; compare parsed values, since spacing is Spark's."""
    blank = lambda c: F.nullif(c, F.lit(""))
    button = F.when(text != "", F.to_json(F.struct(text.alias("button_text")))).otherwise(F.to_json(F.struct(url.alias("url"))))
    return (
        F.when(action == "explore-search", F.to_json(F.struct(query.alias("query"))))
        .when(action == "explore-back", F.to_json(F.struct(url.alias("url"), F.lit("back").alias("direction"))))
        .when(action == "explore-stay", F.to_json(F.struct(F.lit("scroll/browse").alias("action"))))
        .when(action == "detail", F.to_json(F.struct(slug.alias("product"), url.alias("url"))))
        .when(action == "add", F.to_json(F.struct(blank(slug).alias("product"), blank(text).alias("button_text"), F.when(text == "", url).alias("url"))))
        .when(action == "checkout", button)
        .when(action == "remove", F.to_json(F.struct(F.coalesce(blank(text), F.lit("Remove")).alias("button_text"))))
        .when(action == "terminate", F.to_json(F.struct(F.lit("session_end").alias("action"))))
        .otherwise(F.to_json(F.struct(url.alias("url"))))
    )


def clickstream_rows(rows: DataFrame) -> DataFrame:
    """Session rows with hashes of product and page and the time as ISO text; an empty page has no hash."""
    from ..functions.scalars import hash16

    hashed = lambda c: F.when(F.col(c) != "", hash16(F.col(c))).otherwise("")
    return rows.withColumns({"product_hash": hashed("product_handle"), "url_hash": hashed("page"), "created_at": F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS")})


def persona_text(*parts: Column) -> Column:
    """The first of the texts that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in parts], F.lit(""))


def product_text(title: Column, kind: Column, handle: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", title, kind)), F.lit("")), F.nullif(handle, F.lit("")), F.lit("product"))


def relative_path(path: Column, root: str) -> Column:
    """A path below a root, from there; others as they are."""
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)


def buyer_of_session(rows: DataFrame) -> DataFrame:
    """(session_id, buyer): the first persona, else user and store, else the session itself."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord")))
    one = rows.groupBy("session_id").agg(first("persona").alias("p"), first("user_id").alias("u"), first("store_id").alias("s"))
    return one.select("session_id", F.coalesce("p", F.when(F.col("u").isNotNull(), F.concat_ws("-", "u", F.coalesce("s", F.lit("")))), F.col("session_id").cast("string")).alias("buyer"))


def clickstream_features(rows: DataFrame, buyers: DataFrame, decimals: int = 2) -> DataFrame:
    """Buyer features of session rows; an order is worth its adds, or its last viewed product if there was none."""
    a = F.col("action")
    price = F.coalesce("price", F.lit(0.0))
    s = rows.join(buyers, "session_id").groupBy("buyer", "session_id").agg(
        ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("duration"),
        F.count_if(a == "explore-search").alias("searches"),
        F.count_if(a == "detail").alias("views"),
        F.bool_or(a == "add").alias("adds"),
        F.bool_or(a == "checkout").alias("bought"),
        F.sum(F.when(a == "add", price)).alias("cart"),
        F.max_by(F.when(a == "detail", price), F.when(a == "detail", F.col("ord"))).alias("last"),
    )
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), decimals)
    return s.groupBy("buyer").agg(F.count("*").alias("total_sessions"), mean(F.col("duration")).alias("avg_duration"), mean(F.col("searches")).alias("avg_searches"), mean(F.col("views")).alias("avg_views"), mean(F.col("adds").cast("int")).alias("add_rate"), mean(F.col("bought").cast("int")).alias("checkout_rate"), mean(F.when(F.col("adds"), F.col("cart"))).alias("avg_cart"), mean(F.when(F.col("bought"), F.coalesce("cart", "last", F.lit(0.0)))).alias("avg_order"))


def cost_rollup(traces: DataFrame) -> DataFrame:
    """(session_id, calls, tokens, price, models) per session, and in total where session_id is null."""
    return traces.rollup("session_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("price"), 4).alias("price"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def open_runs(planned: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Planned runs that are not complete yet."""
    return planned.join(finished.select(key).distinct(), key, "left_anti")


def merge_seed_statistics(seeds: DataFrame) -> DataFrame:
    """(n_seeds, products, least, greatest, mean_price): the rounded median of counts; seeds without prices don't count for prices."""
    priced = F.col("least") > 0
    return seeds.agg(F.count("*").alias("n_seeds"), F.bround(F.percentile("products", F.lit(0.5)), 0).cast("long").alias("products"), F.min(F.when(priced, F.col("least"))).alias("least"), F.max(F.when(priced, F.col("greatest"))).alias("greatest"), F.round(F.avg(F.when(priced, F.col("mean"))), 6).alias("mean_price"))


def option_values(collections: DataFrame, products: DataFrame) -> DataFrame:
    """(collection, dimension, value) of vendors, types and tags of a collection's products."""
    p = collections.join(products, "product_handle")
    parts = [p.select("collection", F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("vendor", F.col("vendor")), ("type", F.col("product_type")), ("tag", F.explode("tags")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value <> ''").distinct()


def capped_examples(examples: DataFrame, most: int, seed: int, *key: str) -> DataFrame:
    """`most` examples by hash order, in their own order."""
    return hash_places(examples, seed, *key, place="__k").where(F.col("__k") <= most).drop("__k")


def cumulative_tiers(sampled: DataFrame, sizes: list[int]) -> DataFrame:
    """Each row of a nested sample (place) in every tier that is large enough for it."""
    tiers = F.filter(F.array(*[F.lit(s) for s in sorted(sizes)]), lambda s: F.col("place") <= s)
    return sampled.withColumn("tier", F.explode(tiers))


def seed_interval(values: DataFrame, replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(mean, std, low, high, n): bounds are the replicate means at fixed places of their order, not interpolated."""
    a = (1 - level) / 2
    ordered = replicates.agg(F.array_sort(F.collect_list("value")).alias("v"))  # a stated number of replicates
    at = lambda i: F.element_at("v", F.greatest(F.lit(1), F.least(F.size("v"), i.cast("int"))))
    stats = values.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count("value").alias("n"))
    return stats.crossJoin(ordered).select("mean", "std", F.round(at(F.floor(a * F.size("v") + 1e-9) + 1), 6).alias("low"), F.round(at(F.floor((1 - a) * F.size("v") + 1e-9)), 6).alias("high"), "n")  # one row each


def random_prior(labels: DataFrame, n_items: Column, k: int) -> DataFrame:
    """Expected HR@k and MRR@k of a random ranking of n items: k/n, and the mean of 1/rank over the first k places over n."""
    harmonic = sum(1 / r for r in range(1, k + 1))
    return labels.select(F.round(F.least(F.lit(1.0), k / n_items), 9).alias("hr"), F.round(F.lit(harmonic) / n_items, 9).alias("mrr"))


def deviations(computed: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """Metrics (name, value) that differ from stored ones by more than a tolerance, or are on one side only."""
    both = computed.select("name", F.col("value").alias("a")).join(stored.select("name", F.col("value").alias("b")), "name", "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def centroid_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of the mean vectors of two sides; rows are (v)."""
    mean = lambda df, n: df.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias(n))
    both = mean(a, "p").join(mean(b, "q"), "i")
    return both.agg(F.round(F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q"))), 6).alias("similarity"))


def hashed_text_vector(texts: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, v): word counts hashed into `size` places; stands in for a language model's vector."""
    words = texts.select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("w"))
    counts = words.groupBy(key, F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("i")).agg(F.count("*").cast("double").alias("c"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    return maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))


def principal_components(vectors: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """(key, v): centred vectors on their first d principal components, padded with zeros; rows without a vector count as the mean."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = vectors.where(F.col(vector).isNotNull()).select(F.size(vector)).first()[0]
    k = min(d, size)
    means = vectors.agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(size)])
    mean = F.array(*[f"m{i}" for i in range(size)])
    centred = vectors.crossJoin(F.broadcast(means)).select(key, F.coalesce(F.zip_with(F.col(vector).cast("array<double>"), mean, lambda x, m: x - m), F.array(*[F.lit(0.0)] * size)).alias("c"))  # one row of means
    ready = centred.select(key, array_to_vector("c").alias("features"))
    out = PCA(k=k, inputCol="features", outputCol="out").fit(ready).transform(ready)
    return out.select(key, F.concat(vector_to_array("out"), F.array(*[F.lit(0.0)] * (d - k)).cast("array<double>")).alias("v"))


def constraint_reward(format_score: Column, action: Column, target: Column, weights: tuple[float, float, float]) -> Column:
    """A penalty for what the format lacks; the rest counts as far as the format is met."""
    f, a, t = weights
    return -f * (1 - format_score) + format_score * (a * action + t * target)


def runtime_of(line: Column) -> Column:
    """Which agent wrote a log line, by the keys of its JSON; unknown for anything else."""
    keys = F.json_object_keys(line)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return F.when(has("type") & has("message"), "messages").when(has("event"), "events").when(has("role"), "chat").otherwise("unknown")


def extra_keys(records: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed schema does not have."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(records), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed])))


def substitute_task(intent: Column) -> Column:
    """A task for a substitute, from the quoted title of an exact one; null without a title."""
    title = F.nullif(F.regexp_extract(intent, r'"([^"]+)"', 1), F.lit(""))
    return F.concat(F.lit("Find something like "), title)
