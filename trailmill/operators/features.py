"""Per-session and per-buyer aggregates of provider events and of session rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import sorted_places
from .sessionize import CHECKOUT_EVENTS, session_outcome, semantic_action, truncate_raw_checkout

VIEW_EVENTS = ("product_page_viewed", "page_viewed", "entity_clicked")
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def session_summary(events: DataFrame) -> DataFrame:
    """(session_id, outcome, n_real, products): events with an action and the distinct products up to the first checkout."""
    cut = truncate_raw_checkout(events).groupBy("session_id").agg(F.count_if(semantic_action(F.col("event_name")) != "Other").alias("n_real"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("product_handle") != "", F.col("product_handle")))), ",").alias("products"))
    return session_outcome(events).join(cut, "session_id").select("session_id", "outcome", "n_real", "products")


def buyer_features(events: DataFrame, buyer: str = "client_id", decimals: int = 2) -> DataFrame:
    """One row a buyer: means over sessions, rates, and mean values over the sessions that have one. Rounded; 0 where there is nothing."""
    name = F.col("event_name")
    view, cart, checkout = name.isin(*VIEW_EVENTS), name == "product_added_to_cart", name.isin(*CHECKOUT_EVENTS)
    value = F.coalesce("price", F.lit(0.0)) * F.coalesce("quantity", F.lit(1))
    by_session = events.groupBy(buyer, "session_id").agg(
        ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("duration"),
        F.count_if(name == "search_submitted").alias("searches"),
        F.count_if(view).alias("views"),
        F.countDistinct(F.when(view & (F.col("product_handle") != ""), F.col("product_handle"))).alias("distinct_views"),
        F.count_if(name == "collection_page_viewed").alias("collections"),
        F.bool_or(cart).alias("has_cart"),
        F.bool_or(name == "checkout_completed").alias("completed"),
        F.bool_or(checkout).alias("has_checkout"),
        F.sum(F.when(cart, value)).alias("cart_value"),
        F.sum(F.when(checkout, value)).alias("order_value"),
    )
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), decimals)
    return by_session.groupBy(buyer).agg(
        F.count("*").alias("total_sessions"),
        mean(F.col("duration")).alias("avg_session_duration_seconds"),
        mean(F.col("searches")).alias("avg_number_of_searches"),
        mean(F.col("views")).alias("avg_number_of_product_views"),
        mean(F.col("distinct_views")).alias("avg_distinct_products_viewed"),
        mean(F.col("collections")).alias("avg_number_of_collection_views"),
        mean((F.col("views") > 0).cast("int")).alias("product_view_rate"),
        mean(F.col("has_cart").cast("int")).alias("add_to_cart_rate"),
        mean(F.col("completed").cast("int")).alias("checkout_complete_rate"),
        mean(F.when(F.col("has_cart"), F.coalesce("cart_value", F.lit(0.0)))).alias("avg_max_cart_value_usd"),
        mean(F.when(F.col("has_checkout"), F.coalesce("order_value", F.lit(0.0)))).alias("avg_order_value_usd"),
    )


def product_summaries(events: DataFrame, most: int = 50, buyer: str = "client_id") -> DataFrame:
    """(buyer, product_handle, price, rank): a buyer's viewed products in first-seen order, with their first price, `most` at most."""
    views = events.where((F.col("product_handle") != "") & F.col("event_name").isin(*VIEW_EVENTS))
    at = F.struct("ts_ms", "seq")
    one = views.groupBy(buyer, "product_handle").agg(F.min(at).alias("first"), F.min_by("price", F.when(F.col("price").isNotNull(), at)).alias("price"))
    rank = F.row_number().over(Window.partitionBy(buyer).orderBy("first", "product_handle"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select(buyer, "product_handle", "price", "rank")


def trajectories(rows: DataFrame) -> DataFrame:
    """(session_id, trajectory, products): actions in order, and distinct products in first-seen order, as texts."""
    ordered = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "action", "product_handle"))).alias("r"))
    products = F.array_distinct(F.filter(F.transform("r", lambda x: x["product_handle"]), lambda p: p != ""))
    return ordered.select("session_id", F.array_join(F.transform("r", lambda x: x["action"]), ">").alias("trajectory"), F.when(F.size(products) > 0, F.array_join(products, ",")).alias("products"))


def size_statistics(events: DataFrame) -> DataFrame:
    """(name, value): mean, sample deviation, extremes, median and percentiles of events a session."""
    n = events.groupBy("session_id").agg(F.count("*").alias("n"))
    stats = n.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").cast("double").alias("min"), F.median("n").alias("median"), F.max("n").cast("double").alias("max"), *[F.round(F.percentile("n", F.lit(p / 100)), 6).alias(f"p{p}") for p in PERCENTILES])
    return stats.unpivot([], stats.columns, "name", "value")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share, rank) by descending count, names ascending among equals."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumns({"share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9), "rank": F.row_number().over(Window.orderBy(F.desc("n"), column))})


def unprocessable(events: DataFrame) -> DataFrame:
    """(event_name, n, n_sessions) of the events without an action."""
    return events.where(semantic_action(F.col("event_name")) == "Other").groupBy("event_name").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))


def last_detail(rows: DataFrame) -> DataFrame:
    """The last detail row of each session."""
    return rows.where("action = 'detail'").groupBy("session_id").agg(F.max_by("product_handle", "ord").alias("product_handle"), F.max("ord").alias("ord"))


def first_seen(events: DataFrame, column: str) -> DataFrame:
    """(value, place) of the distinct values in order of first appearance, from 1."""
    return sorted_places(events.groupBy(column).agg(F.min("seq").alias("__f")), "__f").select(column, "place")
