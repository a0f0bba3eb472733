"""Task generation and validation over a shop's catalog."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import apart

#: Titles of collections, and parts of them, that name no theme.
GENERIC_TITLES = ("all", "sale", "new arrival", "new arrivals", "gift card", "gift cards", "best seller", "best sellers", "featured")
GENERIC_PARTS = ("promo", "eligible", "test collection", "internal", "staff only", "wholesale", "draft", "automation")


def is_generic(title: Column) -> Column:
    """Whether a collection's title names no theme, in any case."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return reduce(or_, [t.contains(p) for p in GENERIC_PARTS], t.isin(*GENERIC_TITLES))


def with_min_products(collections: DataFrame, least: int = 3) -> DataFrame:
    """Collections (title, product_handles) of a theme with at least `least` products."""
    return collections.where(~is_generic(F.col("title")) & (F.coalesce(F.size("product_handles"), F.lit(0)) >= least))


def literal(text: str | Column) -> str | Column:
    """A pattern that matches a text as it is."""
    if isinstance(text, str):
        return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def pages_matching(pages: DataFrame, *words: str) -> DataFrame:
    """Pages whose title or handle has a word that starts with one of `words`; hyphens of a handle part words, case doesn't matter."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = F.concat(low(F.col("title")), F.lit(" "), F.replace(low(F.col("handle")), F.lit("-"), F.lit(" ")))
    return pages.where(reduce(or_, [text.rlike(r"(?U)\b" + literal(w.lower())) for w in words], F.lit(False)))


def is_candidate(title: Column, gift_card: Column, status: Column, any_available: Column, least: int = 4, most: int = 120) -> Column:
    """Whether a product makes a search task: a title of fair length, no gift card, active where a status is given, something of it for sale."""
    return F.coalesce(F.length(title).between(least, most) & ~F.coalesce(gift_card, F.lit(False)) & (F.coalesce(status, F.lit("active")) == "active") & any_available, F.lit(False))


def diverse_pick(products: DataFrame, n: int) -> DataFrame:
    """n products: in order of place the first of each type and all without a type, then the rest in order; case and blanks around a type don't count."""
    kind = F.trim(F.lower(F.coalesce("product_type", F.lit(""))))
    k = F.row_number().over(Window.partitionBy("__kind").orderBy("place"))
    firsts = products.withColumn("__kind", kind).withColumn("__k", F.when((F.col("__kind") == "") | (k == 1), 0).otherwise(1))
    top = firsts.orderBy("__k", "place").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("__k", "place"))).drop("__k", "__kind")  # n rows


def browse_tasks(collections: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n collections by hash order."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "collection"), 256)
    top = collections.select("collection", order.alias("__o")).orderBy("__o", "collection").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("__o", "collection"))).select("collection", "place")  # n rows


def filter_tasks(values: DataFrame, priority: list[str]) -> DataFrame:
    """(collection, dimension, value): of each collection's (dimension, value) the first dimension by priority, and its first value."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("dimension"))
    return values.where(rank > 0).groupBy("collection").agg(F.min(F.struct(rank.alias("r"), F.col("dimension"), F.col("value"))).alias("m")).select("collection", "m.dimension", "m.value")


def policy_task(pages: DataFrame, fallback: str, *words: str) -> DataFrame:
    """(pos, url): where a policy can be found: the pages that the words begin words of, by place, then the fallback unless it is among them. The first one is what a task asks for."""
    found = pages_matching(pages, *words).select(F.concat(F.lit("/pages/"), "handle").alias("url"), F.col("place").cast("long").alias("__p"))
    last = pages.sparkSession.range(1).select(F.lit(fallback).alias("url"), F.lit(None).cast("long").alias("__p"))
    every = found.unionByName(last.join(found.select("url"), "url", "left_anti"))
    return every.select((F.row_number().over(Window.orderBy(F.asc_nulls_last("__p"), "url")) - 1).alias("pos"), "url")  # a shop's pages about one policy


GENERIC_SHARE = 0.4


def membership(products: DataFrame, collections: DataFrame, generic_share: float = GENERIC_SHARE) -> DataFrame:
    """(collection, product_handle) that share a distinctive token; a collection without products has one row of null.

    Tokens of more than `generic_share` of the collections are generic, those of
    one collection never are; they go before the join, so only distinctive ones
    make rows.
    """
    a = products.select("product_handle", F.explode(F.array_distinct("tokens")).alias("t"))
    b = collections.select("collection", F.explode(F.array_distinct("tokens")).alias("t")).distinct()
    n = collections.select("collection").distinct().agg(F.count("*").alias("n"))
    common = b.groupBy("t").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") > 1) & (F.col("df") > generic_share * F.col("n"))).select("t")  # one row
    met = a.join(b.join(common, "t", "left_anti"), "t").select("collection", "product_handle").distinct()
    return collections.select("collection").distinct().join(met, "collection", "left")


FEW_NAMES = 64
GRAM = 12  # names often begin alike, so short heads would bring most of them together


def mentions(texts: DataFrame, names: DataFrame, exact_case: bool = False) -> DataFrame:
    """(id, name) of the names that a text (id, text) contains; blank names are nowhere.

    A few names, counted first, are looked for in every text. More are joined on
    their first `GRAM` characters with all runs of as many characters of each text
    and compared in full then, so no text meets a name that it has no run of.
    """
    fold = (lambda c: c) if exact_case else F.lower
    named = names.select("name").where("trim(name) <> ''").distinct()
    if named.count() <= FEW_NAMES:
        return texts.join(F.broadcast(named), F.contains(fold(F.col("text")), fold(F.col("name")))).select("id", "name")
    keyed = named.withColumn("gram", F.substring(fold(F.col("name")), 1, GRAM)).withColumn("n", F.length("gram"))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # GRAM numbers at most
    runs = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__t") - (n - 1), F.lit(1))), lambda i: F.substr(F.col("__t"), i, F.lit(n))))
    folded = texts.select("id", "text", fold(F.col("text")).alias("__t")).where("text IS NOT NULL")
    grams = folded.select("id", "text", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in sizes])))).alias("gram"))
    return grams.join(apart(keyed.select("name", "gram")), "gram").where(F.contains(fold(F.col("text")), fold(F.col("name")))).select("id", "name").distinct()


def prefix_matches(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(prefix, name) of the names that start with a wanted prefix, by a join on heads of the lengths that are wanted."""
    asked = wanted.select("prefix").where("prefix IS NOT NULL").distinct()
    sizes = sorted(r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect())  # lengths of names
    if not sizes:
        return asked.withColumn("name", F.lit(None).cast("string")).where(F.lit(False))
    heads = F.explode(F.array(*[F.when(F.length("name") >= n, F.substring("name", 1, n)) for n in sizes]))
    return names.select("name", heads.alias("prefix")).where("prefix IS NOT NULL").join(apart(asked), "prefix").select("prefix", "name")


def rule_gate(expected: Column, refused: Column, wanted: Column, urls: Column) -> Column:
    """The verdict that needs no judge, else null: a task that cannot be done passes if and only if the agent says so; a wanted URL that was never visited fails."""
    infeasible = F.coalesce(expected == "infeasible", F.lit(False))
    missed = (F.coalesce(wanted, F.lit("")) != "") & ~F.coalesce(F.exists(urls, lambda u: F.contains(u, wanted)), F.lit(False))
    return F.when(infeasible, F.coalesce(refused, F.lit(False))).when(missed, F.lit(False))


def url_gate(verdict: Column, urls: Column, wanted: Column) -> Column:
    """A success counts only if one of the visited URLs contains the wanted one."""
    return F.when(wanted.isNull(), verdict).otherwise(verdict & F.exists(urls, lambda u: F.contains(u, wanted)))


def gaps(evidence: DataFrame, planned: DataFrame, omitted: DataFrame) -> DataFrame:
    return evidence.distinct().join(planned, "area", "left_anti").join(omitted, "area", "left_anti")


def leaks(leaves: DataFrame, brands: list[str]) -> DataFrame:
    """String leaves that name a brand."""
    return leaves.where(F.col("text").rlike("(?i)\\b(" + "|".join(brands) + ")\\b"))


def latest(rows: DataFrame, key: str, value: str, version: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, version).alias(value))
