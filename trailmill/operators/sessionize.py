"""From provider events to ordered sessions of semantic actions.

Rules that look stateful (what was emitted last) are conditions on neighbours:
all windows share one partitioning by session, so the chain has one shuffle.
Events are ordered by (ts_ms, seq); seq comes from the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The semantic actions in their order.
SEMANTIC_ACTIONS = ["detail", "explore-search", "explore-goto", "explore-back", "explore-stay", "add", "checkout", "remove", "terminate"]
#: Provider event names and the actions that they stand for.
EVENT_ACTION = {
    "product_page_viewed": "detail",
    "page_viewed": "detail",
    "entity_clicked": "detail",
    "search_submitted": "explore-search",
    "collection_page_viewed": "explore-goto",
    "product_added_to_cart": "add",
    "product_removed_from_cart": "remove",
    "checkout_started": "checkout",
    "checkout_completed": "checkout",
}
CHECKOUT_EVENTS = ("checkout_started", "checkout_completed")
DWELL_MS = 10_000


def semantic_action(event_name: Column) -> Column:
    """The action of an event name; names without one are Other."""
    out = F
    for name, action in EVENT_ACTION.items():
        out = out.when(event_name == name, action)
    return out.otherwise("Other")


def page_url(action: Column, product: Column, query: Column, collection: Column) -> Column:
    """The page of an event: product before search before collection, else empty."""
    return (
        F.when(product != "", F.concat(F.lit("/products/"), product))
        .when((action == "explore-search") & (query != ""), F.concat(F.lit("/search?q="), F.url_encode(query)))
        .when((action == "explore-goto") & (collection != ""), F.concat(F.lit("/collections/"), F.regexp_replace(collection, r"\.0$", "")))
        .otherwise("")
    )


def drop_unplaced(events: DataFrame, *keys: str) -> DataFrame:
    """Events that have all of the keys."""
    return events.dropna(subset=list(keys))


def session_outcome(events: DataFrame) -> DataFrame:
    """(session_id, outcome) over all events of a session: a checkout beats an add to cart beats browsing."""
    return events.groupBy("session_id").agg(
        F.when(F.bool_or(F.col("event_name").isin(*CHECKOUT_EVENTS)), "checkout").when(F.bool_or(F.col("event_name") == "product_added_to_cart"), "cart_abandoned").otherwise("browse_only").alias("outcome")
    )


def label_events(events: DataFrame) -> DataFrame:
    """Events with `page`, `is_repeat` and the relabelled `action`.

    A repeat of the previous page under the same event name is a stay; a return
    to the page before the previous one is a back; Other is never relabelled.
    """
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq")
    base = semantic_action(F.col("event_name"))
    paged = events.withColumn("base", base).withColumn("page", page_url(F.col("base"), F.col("product_handle"), F.col("query"), F.col("collection_handle")))
    one, two = F.coalesce(F.lag("page", 1).over(w), F.lit("")), F.coalesce(F.lag("page", 2).over(w), F.lit(""))
    seen = paged.withColumns({"page1": one, "page2": two, "name1": F.lag("event_name").over(w), "prev_ts": F.lag("ts_ms").over(w), "prev_product": F.coalesce(F.lag("product_handle").over(w), F.lit(""))})
    repeat = (F.col("page") != "") & (F.col("page") == F.col("page1")) & (F.col("event_name") == F.col("name1"))
    marked = seen.withColumn("is_repeat", F.coalesce(repeat, F.lit(False)))
    back = (F.col("page") != "") & (F.col("page") == F.col("page2")) & (F.col("page") != F.col("page1"))
    action = F.when(F.col("base") == "Other", "Other").when(F.col("is_repeat"), "explore-stay").when(back, "explore-back").otherwise(F.col("base"))
    return marked.withColumn("action", action).drop("base", "page1", "page2", "name1")


def cut_after_checkout(labelled: DataFrame) -> DataFrame:
    """Events up to the first one that is still a checkout after relabelling."""
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("action") == "checkout").cast("int")).over(w), F.lit(0))
    return labelled.withColumn("__cut", before).where("__cut = 0").drop("__cut")


def truncate_raw_checkout(events: DataFrame) -> DataFrame:
    """Events up to the first checkout by raw event name; the rule by which sessions are eligible."""
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("event_name").isin(*CHECKOUT_EVENTS).cast("int")).over(w), F.lit(0))
    return events.withColumn("__cut", before).where("__cut = 0").drop("__cut")


def emit_rows(labelled: DataFrame, dwell_ms: int = DWELL_MS, gap_stays: bool = True) -> DataFrame:
    """(session_id, ts_ms, ord, action, page, product_handle): runs of repeats as one stay, stays in gaps, and a terminate.

    A run of repeats is one row at the time of its last repeat. With gap_stays, a
    gap of over dwell_ms before an event that is no repeat, with no stay beside
    it, has a stay 1 ms after the gap's start on the previous product's page.
    """
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq")
    stay = (F.col("action") == "explore-stay")
    # `Other` repeats stay Other: they are rows of their own, but never a stay that a run could extend.
    last_stay = F.coalesce(F.lag(stay).over(w), F.lit(False))
    cut = cut_after_checkout(labelled)
    flagged = cut.withColumns({"stay": stay, "last_stay": last_stay})
    gap = (~F.col("is_repeat")) & F.col("prev_ts").isNotNull() & (F.col("ts_ms") - F.col("prev_ts") > dwell_ms) & (F.col("action") != "explore-stay") & ~F.col("last_stay")
    flagged = flagged.withColumns({"gap": gap if gap_stays else F.lit(False), "joins": F.col("is_repeat") & F.col("last_stay")})
    island = F.sum((~F.col("joins")).cast("int")).over(w)
    rows = flagged.withColumn("island", island)
    run = Window.partitionBy("session_id", "island")
    first = rows.withColumn("run_ts", F.max("ts_ms").over(run)).where(~F.col("joins"))
    own = F.struct(F.col("run_ts").alias("ts_ms"), F.lit(1).alias("part"), F.col("action").alias("action"), F.col("page").alias("page"), F.col("product_handle").alias("product_handle"))
    added = F.struct((F.col("prev_ts") + 1).alias("ts_ms"), F.lit(0).alias("part"), F.lit("explore-stay").alias("action"), F.when(F.col("prev_product") != "", F.concat(F.lit("/products/"), F.col("prev_product"))).otherwise("").alias("page"), F.col("prev_product").alias("product_handle"))
    out = first.select("session_id", "island", F.explode(F.when(F.col("gap"), F.array(added, own)).otherwise(F.array(own))).alias("r"))
    body = out.select("session_id", "island", "r.*")
    end = cut.groupBy("session_id").agg((F.max("ts_ms") + 1).alias("ts_ms")).select("session_id", F.lit(1 << 30).alias("island"), "ts_ms", F.lit(0).alias("part"), F.lit("terminate").alias("action"), F.lit("").alias("page"), F.lit("").alias("product_handle"))
    both = body.withColumn("island", F.col("island").cast("long")).unionByName(end.withColumn("island", F.col("island").cast("long")))
    ord_ = F.row_number().over(Window.partitionBy("session_id").orderBy("island", "part"))
    return both.select("session_id", "ts_ms", ord_.alias("ord"), "action", "page", "product_handle")


def sessions(events: DataFrame, dwell_ms: int = DWELL_MS, gap_stays: bool = True) -> DataFrame:
    """The whole chain: placed events, relabelled, cut, collapsed, with gaps and ends."""
    return emit_rows(label_events(drop_unplaced(events, "session_id", "ts_ms")), dwell_ms, gap_stays)


def trim_noise(rows: DataFrame, is_start: Column) -> DataFrame:
    """Rows after the first one of their session for which is_start holds, by time; ties with it go; sessions without one stay whole."""
    w = Window.partitionBy("session_id")
    return rows.withColumn("__from", F.min(F.when(is_start, F.col("ts_ms"))).over(w)).where("__from IS NULL OR ts_ms > __from").drop("__from")


def pageview_action(url: Column, referrer: Column, seen_before: Column) -> Column:
    """The action of a page view from its URL; a visited page is a back."""
    path = F.lower(F.rtrim(F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), F.lit("/")))
    ref = F.lower(F.regexp_extract(referrer, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1))
    asks = url.rlike(r"[?&]q=[^&#]")
    return (
        F.when(path.contains("/search") | asks, "explore-search")
        .when(path.contains("/products/"), "detail")
        .when(path.contains("/checkout"), "checkout")
        .when(path.endswith("/cart") | path.contains("/cart/"), F.when(ref.contains("/products/"), "add").otherwise("explore-goto"))
        .when(seen_before, "explore-back")
        .otherwise("explore-goto")
    )


def revisits(rows: DataFrame) -> DataFrame:
    """Rows with `visited`: whether their URL came before in the session."""
    w = Window.partitionBy("session_id", "url").orderBy("ts_ms", "seq")
    return rows.withColumn("visited", F.row_number().over(w) > 1)


#: Parts of button texts, tried in this order.
CLICK_TEXTS = {
    "add": ("add to cart", "add to bag", "add item"),
    "checkout": ("check out", "checkout", "proceed to checkout", "buy now", "buy it now"),
    "remove": ("remove", "delete", "remove item"),
}


def click_action(text: Column) -> Column:
    """add, checkout or remove by the text of what was clicked, else null."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F
    for action, parts in CLICK_TEXTS.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | t.contains(p)
        out = out.when(hit, action)
    return out


def split_by_persona(rows: DataFrame) -> DataFrame:
    """Rows with `session_part`: a session is split at each row that names another persona than the last named one; the id has a suffix if it was split.

    Rows before the first name are a part of their own, of no persona.
    """
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq")
    carried = rows.withColumn("__p", F.last(F.when(F.col("persona") != "", F.col("persona")), True).over(w))
    before = F.lag("__p").over(w)
    opens = F.col("__p").isNotNull() & ~F.col("__p").eqNullSafe(before) & (F.row_number().over(w) > 1)
    part = carried.withColumn("__c", opens.cast("int")).withColumn("__i", F.sum("__c").over(w))
    many = F.max("__i").over(Window.partitionBy("session_id"))
    named = F.max("__p").over(Window.partitionBy("session_id", "__i"))
    return part.withColumns({"__m": many, "__n": named}).withColumn("session_part", F.when(F.col("__m") > 0, F.concat(F.col("session_id").cast("string"), F.lit("::p"), F.coalesce("__n", F.lit("")), F.lit("::"), F.col("__i").cast("string"))).otherwise(F.col("session_id").cast("string"))).drop("__p", "__c", "__i", "__m", "__n")


def dwell_rows(pageviews: DataFrame, dwell_ms: int = DWELL_MS) -> DataFrame:
    """Each page view, and a stay after it where the next one comes over dwell_ms later; the view moves to the end of the dwell."""
    w = Window.partitionBy("session_id").orderBy("ts_ms", "seq")
    nxt = F.lead("ts_ms").over(w)
    long = F.coalesce(nxt - F.col("ts_ms") > dwell_ms, F.lit(False))
    own = F.struct(F.col("action"), F.when(F.col("__long"), F.col("__next")).otherwise(F.col("ts_ms")).alias("ts_ms"), F.lit(1).alias("part"))
    stay = F.struct(F.lit("explore-stay").alias("action"), F.col("ts_ms").alias("ts_ms"), F.lit(0).alias("part"))
    return pageviews.withColumns({"__long": long, "__next": nxt}).select("session_id", "seq", F.explode(F.when(F.col("__long"), F.array(stay, own)).otherwise(F.array(own))).alias("r")).select("session_id", "seq", "r.*")
