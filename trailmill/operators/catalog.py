"""Catalog lookups, price bins, search, sorting, paging, recommendations and carts.

Catalog frames have product_handle, product_title, product_type, price, vendor
and `place`, the position in the dataset, which ties and relevance depend on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import shares, sorted_places

BINS = 5
NO_TYPE = "<unknown>"


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Rows with a title, numeric prices, and the first row of each handle."""
    ok = raw.where(F.col("product_title").isNotNull()).withColumn("price", F.col("price").cast("string").try_cast("double"))
    return ok.withColumn("__k", F.row_number().over(Window.partitionBy("product_handle").orderBy("place"))).where("__k = 1").drop("__k")


def price_edges(catalog: DataFrame, bins: int = BINS) -> DataFrame:
    """(product_type, edges): equal-width bins of each type's prices; one bin of half a unit each way where all prices are equal. Blank types have none."""
    span = catalog.where("price IS NOT NULL AND trim(product_type) <> ''").groupBy("product_type").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    steps = F.sequence(F.lit(0), F.lit(bins))
    edges = F.when(F.col("lo") == F.col("hi"), F.array(F.col("lo") - 0.5, F.col("hi") + 0.5)).otherwise(F.transform(steps, lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins))
    return span.select("product_type", edges.alias("edges"))


def price_bucket(price: Column, edges: Column) -> Column:
    """The first bin (from 1) whose upper edge the price does not exceed; beyond the last edge the last bin."""
    upper = F.slice(edges, F.lit(2), F.size(edges) - 1)
    over = F.size(F.filter(upper, lambda e: e < price))
    return F.least(over + 1, F.size(upper))


def with_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with category, price bucket and price of their product; blanks where the catalog has none or no price."""
    priced = catalog.join(price_edges(catalog), "product_type").where("price IS NOT NULL")
    info = priced.select("product_handle", F.col("product_type").alias("product_category"), price_bucket(F.col("price"), F.col("edges")).cast("string").alias("price_bucket"), F.col("price").cast("string").alias("price"))
    return rows.drop("product_category", "price_bucket", "price").join(info, "product_handle", "left").na.fill("", ["product_category", "price_bucket", "price"])


def products_export(seen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products of events with what the catalog knows: price and description of the catalog win, all else of the events wins."""
    c = catalog.select("product_handle", F.col("product_title").alias("__title"), F.col("price").alias("__price"), F.col("vendor").alias("__vendor"))
    blank = lambda x: F.nullif(F.col(x), F.lit(""))
    return seen.join(c, "product_handle", "left").select("product_handle", F.coalesce(blank("product_title"), "__title").alias("product_title"), F.coalesce("__price", "price").alias("price"), F.coalesce(blank("vendor"), "__vendor").alias("vendor")).orderBy(F.asc_nulls_last("price"), "product_handle")


def matches_all(text: Column, query: Column) -> Column:
    """Whether a text has every term of a query, in any case; an empty query matches all."""
    low = F.lower(text)
    return F.forall(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: t != ""), lambda t: F.contains(low, t))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs in a text, without overlaps."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("int")


def relevance(title: Column, body: Column, query: Column) -> Column:
    """Occurrences of all terms, those in the title counting three times."""
    terms = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: t != "")
    return F.aggregate(terms, F.lit(0), lambda s, t: s + 3 * occurrences(F.lower(title), t) + occurrences(F.lower(body), t))


def search(catalog: DataFrame, query: str, body: Column, key: str = "RELEVANCE", reverse: bool = False) -> DataFrame:
    """The rows that match all terms, with `score` and `rank`: by falling relevance or, with PRICE, by rising price; then by place. reverse turns the whole order round.

    Rows without a price come behind all others.
    """
    q = F.lit(query)
    hit = catalog.where(matches_all(F.concat_ws(" ", "product_title", body), q)).withColumn("score", relevance(F.col("product_title"), body, q))
    by = F.coalesce(F.col("price").cast("double"), F.lit(float("inf"))) if key == "PRICE" else -F.col("score")
    order = [F.desc("__by"), F.desc("place")] if reverse else [F.asc("__by"), F.asc("place")]
    return _ranked(hit.withColumn("__by", by), *order).drop("__by")


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with `rank` from 1, numbered range by range."""
    return sorted_places(df, *order, place="rank").withColumn("rank", F.col("rank").cast("int"))


#: Sort keys and their columns; texts compare as readers expect (letters before case), times as ISO texts.
SORT_KEYS = {"TITLE": "product_title", "VENDOR": "vendor", "PRODUCT_TYPE": "product_type", "CREATED_AT": "created_at", "UPDATED_AT": "updated_at", "PRICE": "price", "ID": "product_id", "BEST_SELLING": None, "RELEVANCE": None}


def sort_products(catalog: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """Products with `rank` in the order of a sort key; ties and keyless orders by place; reverse turns the whole order round.

    price is the least one of a product's variants, and 0 where none has one; a
    text that is missing counts as ''. Collections sort the same way by TITLE,
    UPDATED_AT, ID and RELEVANCE.
    """
    column = SORT_KEYS[key]
    if column is None:
        by = F.lit(0)
    elif column == "price":
        by = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    elif column == "product_id":
        by = F.col(column)
    else:
        by = F.collate(F.coalesce(F.col(column).cast("string"), F.lit("")), "UNICODE")
    order = [F.desc("__by"), F.desc("place")] if reverse else [F.asc("__by"), F.asc("place")]
    return _ranked(catalog.withColumn("__by", by), *order).drop("__by")


def page(ranked: DataFrame, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None) -> DataFrame:
    """A page of ranked rows by cursors (base64 of cursor:<index from 0>), each row with its own."""
    from base64 import b64decode

    at = lambda c: int(b64decode(c).decode().removeprefix("cursor:"))
    lo = at(after) + 1 if after else 0
    out = ranked.withColumn("index", F.col("rank") - 1).where(F.col("index") >= lo)
    if before:
        out = out.where(F.col("index") < at(before))
    if first is not None:
        out = out.where(F.col("index") < lo + first)
    if last is not None:
        top = out.agg(F.max("index")).first()[0]
        out = out.where(F.col("index") > (-1 if top is None else top) - last)
    return out.withColumn("cursor", F.base64(F.concat(F.lit("cursor:"), F.col("index").cast("string")).cast("binary")))


PREDICTIVE_LIMIT = 10


def predictive_limit(limit: float | None) -> int:
    """A positive limit, rounded down; anything else is the default."""
    if limit is None or not math.isfinite(limit) or limit <= 0:
        return PREDICTIVE_LIMIT
    return math.floor(limit)


def predictive(results: DataFrame, limit: float | None = None, each: bool = False) -> DataFrame:
    """Results (kind_order, rank) up to `limit` per kind, or in total in the order of kinds."""
    most = predictive_limit(limit)
    if each:
        return results.withColumn("__k", F.row_number().over(Window.partitionBy("kind_order").orderBy("rank"))).where(F.col("__k") <= most).drop("__k")
    return results.orderBy("kind_order", "rank").limit(most)


def recommendations(catalog: DataFrame, target: DataFrame, k: int = 4) -> DataFrame:
    """For each target the k other products of highest similarity: 1000 for its type, unless that is blank, and one for each tag that it shares; ties by place.

    Products without anything in common have 0 and fill up by place. Products of
    equal type and tags score alike, so scores are taken between such kinds that
    have a type or tag in common; of a kind the first k + 1 products are enough,
    one of them being the target at most. What fills up is among the first
    2 * k + 1 of all. Handles are unique.
    """
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    kind = F.coalesce("product_type", F.lit(""))
    parts = shares(catalog, 50_000)  # files of few bytes a row would leave one task with millions
    catalog, target = catalog.repartition(parts, "product_handle"), target.repartition(parts, "product_handle")
    c = catalog.select("product_handle", "place", kind.alias("product_type"), F.array_sort(tags).alias("__ctags")).withColumn("__ckind", F.to_json(F.struct("product_type", "__ctags")))
    t = target.select(F.col("product_handle").alias("target"), kind.alias("__type"), F.array_sort(tags).alias("__tags")).withColumn("__kind", F.to_json(F.struct("__type", "__tags")))
    of = lambda kind, own: F.explode(F.concat(F.when(F.col(kind) != "", F.array(F.concat(F.lit("type:"), F.col(kind)))).otherwise(F.array().cast("array<string>")), F.array_distinct(F.transform(own, lambda x: F.concat(F.lit("tag:"), x))))).alias("__token")
    ckinds, kinds = c.select("__ckind", "product_type", "__ctags").distinct(), t.select("__kind", "__type", "__tags").distinct()
    near = kinds.select("__kind", of("__type", "__tags")).join(ckinds.select("__ckind", of("product_type", "__ctags")), "__token").select("__kind", "__ckind").distinct()
    score = F.when((F.col("product_type") == F.col("__type")) & (F.col("__type") != ""), 1000).otherwise(0) + F.size(F.filter("__ctags", lambda x: F.array_contains(F.col("__tags"), x)))
    scored = near.join(kinds, "__kind").join(ckinds, "__ckind").select("__kind", "__ckind", score.alias("score")).where("score > 0")
    first = c.withColumn("__n", F.row_number().over(Window.partitionBy("__ckind").orderBy("place"))).where(F.col("__n") <= k + 1).select("__ckind", "product_handle", "place")
    order = (F.desc("score"), "place")
    best = scored.join(first, "__ckind").withColumn("__n", F.row_number().over(Window.partitionBy("__kind").orderBy(*order))).where(F.col("__n") <= k + 1)
    likely = t.select("target", "__kind").join(best, "__kind").where("product_handle <> target").select("target", "product_handle", "place", "score")
    front = c.orderBy("place").limit(2 * k + 1).select("product_handle", "place")
    row = front.agg(F.array_sort(F.collect_list(F.struct("place", "product_handle"))).alias("__front"))  # one row of 2 * k + 1 places
    rest = t.select("target").crossJoin(F.broadcast(row)).select("target", F.inline("__front")).where("product_handle <> target").select("target", "product_handle", "place", F.lit(0).alias("score"))
    both = likely.unionByName(rest).repartition(parts, "target").groupBy("target", "product_handle").agg(F.max("place").alias("place"), F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*order))).where(F.col("rank") <= k).select("target", "rank", "product_handle", "score")


def collection_products(collections: DataFrame, catalog: DataFrame) -> DataFrame:
    """(collection, pos, product_handle) of the listed products that exist, in list order."""
    listed = collections.select("collection", F.posexplode("product_handles").alias("pos", "product_handle"))
    return listed.join(catalog.select("product_handle", "product_title"), "product_handle")


def leading_number(text: Column) -> Column:
    """The finite number that a text begins with, blanks before it aside; null if there is none."""
    n = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def price_range(variants: Column) -> Column:
    """Least and greatest price of an array of variants whose prices are texts, in whole cents; 0 where none begins with a number."""
    prices = F.transform(variants, lambda v: leading_number(v["price"]))
    return F.struct(F.round(F.coalesce(F.array_min(prices), F.lit(0.0)), 2).alias("least"), F.round(F.coalesce(F.array_max(prices), F.lit(0.0)), 2).alias("greatest"))


def available(quantity: Column, declared: Column) -> Column:
    """Whether a variant can be sold: stock if it is known, else what the variant says."""
    return F.coalesce(quantity > 0, declared)


def cart_totals(lines: DataFrame) -> DataFrame:
    """(cart, n_lines, quantity, subtotal): money summed in whole cents."""
    cents = F.round(F.col("price") * 100).cast("long") * F.col("quantity").cast("long")
    return lines.groupBy("cart").agg(F.count("*").alias("n_lines"), F.sum(F.col("quantity").cast("long")).alias("quantity"), (F.sum(cents) / 100).alias("subtotal"))


def catalog_statistics(catalog: DataFrame) -> DataFrame:
    """Products a type (mean, median, most) and prices (least, greatest, median), ignoring prices of 0."""
    sizes = catalog.groupBy("product_type").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_products"), F.median("n").alias("median_products"), F.max("n").alias("most_products"))
    prices = catalog.where("price > 0").agg(F.min("price").alias("least_price"), F.max("price").alias("greatest_price"), F.median("price").alias("median_price"))
    return sizes.crossJoin(prices)  # one row each


def option_axes(products: DataFrame) -> DataFrame:
    """(axis, place): names of the options of all products, in small letters without blanks around, in the order in which they first come up; from 0. Rows are (place, options: array of (name, ...))."""
    named = products.select("place", F.posexplode("options").alias("pos", "o")).select(F.lower(F.trim("o.name")).alias("axis"), F.struct("place", "pos").alias("__at")).where("axis <> ''")
    first = named.groupBy("axis").agg(F.min("__at").alias("__at"))
    return sorted_places(first, "__at", "axis", place="place").select("axis", (F.col("place") - 1).alias("place"))


def multi_variant_share(products: DataFrame) -> DataFrame:
    """(n, share): products, and the share of those that have more than one variant; 0 without products."""
    many = F.count_if(F.coalesce(F.size("variants"), F.lit(0)) > 1)
    return products.agg(F.count("*").alias("n"), F.when(F.count("*") > 0, many / F.count("*")).otherwise(0.0).alias("share"))


def point_lookup(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The first row by place whose column is the value: a product, collection, page, blog, article, menu or policy by its handle."""
    return rows.where(F.col(column) == value).orderBy("place").limit(1)


def encoded_variants(variants: DataFrame) -> DataFrame:
    """(product, code): the combinations of option values that exist, from (product, places) rows, places being one index an option.

    v1_ and the combinations in order: of one option, values with blanks between;
    of more, values with colons between and a comma less than options behind each.
    Products without a combination get an empty code. One product's variants meet
    in one row.
    """
    own = variants.groupBy("product").agg(F.array_sort(F.collect_set(F.when(F.size("places") > 0, F.col("places")))).alias("c"))
    options = F.size(F.col("c")[0])
    joined = F.transform("c", lambda p: F.array_join(p.cast("array<string>"), ":"))
    end = F.repeat(F.lit(","), options - 1)
    many = F.concat(F.lit("v1_"), F.array_join(F.transform(joined, lambda t: F.concat(t, end)), ""))
    code = F.when(F.size("c") == 0, "").when(options == 1, F.concat(F.lit("v1_"), F.array_join(joined, " "))).otherwise(many)
    return own.select("product", code.alias("code"))


def select_variant(variants: Column, chosen: Column) -> Column:
    """Of an array of variants (options: map of name to value, available) the first with all chosen options; nothing chosen, or none such: the first that can be sold, else the first."""
    fits = F.filter(variants, lambda v: F.forall(F.map_entries(chosen), lambda e: F.element_at(v["options"], e["key"]).eqNullSafe(e["value"])))
    sold = F.filter(variants, lambda v: v["available"])
    asked = F.coalesce(F.size(chosen) > 0, F.lit(False))
    return F.when(asked & (F.size(fits) > 0), F.get(fits, F.lit(0))).when(F.size(sold) > 0, F.get(sold, F.lit(0))).otherwise(F.get(variants, F.lit(0)))


def metafield(fields: Column, namespace: str, key: str) -> Column:
    """The value of the first metafield of a namespace and key in an array of (namespace, key, value), else null."""
    return F.get(F.filter(fields, lambda f: (f["namespace"] == namespace) & (f["key"] == key)), F.lit(0))["value"]
