"""Rules that generated tasks must keep, each as a join of the tasks with an inverted side of the catalog.

Tasks are (task_id, intent, url_contains, response_contains: array); products
(product_handle, product_title, vendor, product_type, options: array of (name,
values)), collections (collection, title, product_handles), pages (page).
Findings are (rule, severity, task_id, detail).

Titles are looked for in intents by their first characters, handles by heads of
the lengths that are asked for, and filter values by (collection, dimension,
value), so no task meets a product that it has nothing in common with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import apart, cut
from .tasks import literal, mentions, prefix_matches

#: Titles up to this length are too common to count as mentioned.
SHORT_TITLE = 4
#: Names under which a filter shows vendor and product type; option names and values that offer no choice; words that name no option.
VENDOR_NAMES = ("brand", "vendor")
TYPE_NAMES = ("type", "producttype", "product type")
NO_OPTIONS = ("title", "default")
NO_VALUES = ("default title", "no color")
NO_NAMES = ("and", "or", "any", "a", "the", "an", "variant", "option", "product", "item", "page", "card", "this", "that", "these", "those", "first", "second", "third")
#: Ids of filter tasks, and the phrases of intents that name a filter and options.
FILTER_ID = r"(?U)^[\w-]+-filter-\d+$"
FILTER_PHRASE = r"(?U)use the ([^\s]+(?:\s+[^\s]+){0,3}?) filter \(e\.g\. ([^)]+?)\)"
OPTION_PHRASE = r"(?U)[Ss]elect\s+([\w ,/]+?)\s+(?:variant|option|value)s?\b"
OPTION_NAME = r"(?U)\b([A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?)\b"
KINDS = {"collection": "/collections/", "product": "/products/", "page": "/pages/"}


def folded(text: Column) -> Column:
    """Caseless text: lower case, and the letters whose case lower() does not tell."""
    return F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def _finding(rows: DataFrame, rule: str | Column, severity: str | Column, detail: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(lit(rule).alias("rule"), lit(severity).alias("severity"), "task_id", detail.alias("detail"))


def _options(products: DataFrame) -> DataFrame:
    """(product_handle, product_title, option, values) of the products' options."""
    return products.select("product_handle", "product_title", F.explode("options").alias("o")).select("product_handle", "product_title", F.trim(F.coalesce("o.name", F.lit(""))).alias("option"), F.coalesce("o.values", F.array().cast("array<string>")).alias("values"))


def unknown_handles(tasks: DataFrame, products: DataFrame, collections: DataFrame, pages: DataFrame) -> DataFrame:
    """Tasks whose wanted URL begins no known handle of its kind. A shop without pages has no unknown ones; unknown pages are warnings."""
    url = F.coalesce("url_contains", F.lit(""))
    handle = lambda p: F.trim(F.regexp_extract(F.substr(url, F.lit(len(p) + 1)), r"^([^?/]*)", 1))
    known = {"collection": collections.select(F.col("collection").alias("name")), "product": products.select(F.col("product_handle").alias("name")), "page": pages.select(F.col("page").alias("name"))}
    some_page = pages.select(F.lit(1).alias("__some")).limit(1)
    out = []
    for kind, prefix in KINDS.items():
        asked = tasks.where(url.startswith(prefix)).select("task_id", handle(prefix).alias("prefix")).where("prefix <> ''")
        lost = asked.join(apart(prefix_matches(asked, known[kind].where("name <> ''")).select("prefix").distinct()), "prefix", "left_anti")
        if kind == "page":
            lost = lost.crossJoin(F.broadcast(some_page))  # one row or none
        out.append(_finding(lost, f"unknown-{kind}", "warning" if kind == "page" else "error", F.col("prefix")))
    return reduce(DataFrame.unionAll, out)


def filter_findings(tasks: DataFrame, products: DataFrame, collections: DataFrame) -> DataFrame:
    """Filter tasks that no product of a collection satisfies, that name an unknown dimension, or that name none."""
    url, prefix = F.coalesce("url_contains", F.lit("")), KINDS["collection"]
    asked = tasks.where(F.coalesce(F.col("task_id").cast("string"), F.lit("?")).rlike(FILTER_ID) & url.startswith(prefix))
    intent = F.coalesce("intent", F.lit(""))
    asked = asked.select("task_id", F.substr(url, F.lit(len(prefix) + 1)).alias("prefix"), *[F.trim(F.regexp_extract(intent, FILTER_PHRASE, k)).alias(n) for k, n in ((1, "dim"), (2, "value"))], intent.rlike(FILTER_PHRASE).alias("formed")).where("prefix <> ''")
    met = prefix_matches(asked, collections.select(F.col("collection").alias("name"))).withColumnRenamed("name", "collection")
    placed = asked.join(apart(met.select("prefix").distinct()), "prefix", "left_semi")  # unknown collections have their own finding
    malformed = placed.where("NOT formed")
    options = _options(products)
    pair = lambda names, c: [F.struct(F.lit(n).alias("dim"), folded(F.col(c)).alias("value")) for n in names]
    fields = products.select("product_handle", F.explode(F.array(*pair(VENDOR_NAMES, "vendor"), *pair(TYPE_NAMES, "product_type"))).alias("x")).select("product_handle", "x.*")
    offered = fields.unionAll(options.select("product_handle", folded(F.col("option")).alias("dim"), F.explode("values").alias("v")).select("product_handle", "dim", folded(F.col("v"))))
    wanted = placed.where("formed").withColumns({"__dim": folded(F.col("dim")), "__value": folded(F.col("value"))})
    # Only values that a task asks for go on to the collections.
    asked_for = wanted.select(F.col("__dim").alias("dim"), F.col("__value").alias("value")).distinct()
    held = offered.join(apart(asked_for), ["dim", "value"], "left_semi").distinct()
    listed = collections.join(apart(met.select("collection").distinct()), "collection", "left_semi").select("collection", F.explode("product_handles").alias("product_handle"))
    realised = listed.join(apart(held), "product_handle").select("collection", "dim", "value").distinct().join(apart(met), "collection").select("prefix", F.col("dim").alias("__dim"), F.col("value").alias("__value")).distinct()
    open_ = wanted.join(apart(realised), ["prefix", "__dim", "__value"], "left_anti")
    known = options.select(folded(F.col("option")).alias("__dim")).where("__dim <> ''").distinct().withColumn("__known", F.lit(True))
    judged = open_.join(apart(known), "__dim", "left").withColumn("__known", F.coalesce("__known", F.col("__dim").isin(*VENDOR_NAMES, *TYPE_NAMES)))
    rule, severity = F.when(F.col("__known"), "infeasible-filter").otherwise("filter-dim-unknown"), F.when(F.col("__known"), "error").otherwise("warning")
    return _finding(malformed, "filter-intent-malformed", "warning", F.lit("")).unionAll(_finding(judged, rule, severity, F.concat("dim", F.lit("="), "value")))


def answer_leaks(tasks: DataFrame) -> DataFrame:
    """Expected answers that the intent gives away, in any case."""
    answers = tasks.select("task_id", F.lower(F.coalesce("intent", F.lit(""))).alias("__i"), F.explode("response_contains").alias("answer"))
    return _finding(answers.where("trim(answer) <> ''").where(F.contains("__i", F.lower(F.trim("answer")))), "intent-answer-leak", "error", F.col("answer"))


def mentioned(tasks: DataFrame, titled: DataFrame, key: str, title: str, longer_than: int = 0) -> DataFrame:
    """(task_id, key) of the titles that an intent has, letter by letter."""
    named = titled.select(key, F.col(title).alias("name")).where((F.length("name") > longer_than) & (F.trim("name") != ""))
    found = mentions(tasks.select(F.col("task_id").alias("id"), F.col("intent").alias("text")), named, exact_case=True)
    return found.join(apart(named), "name").select(F.col("id").alias("task_id"), key).distinct()


def strays(tasks: DataFrame, products: DataFrame, collections: DataFrame, about: DataFrame) -> DataFrame:
    """Mentioned products that are in none of the mentioned collections, of tasks that mention both."""
    places = mentioned(tasks, collections, "collection", "title")
    both = about.join(apart(places.select("task_id").distinct()), "task_id", "left_semi")
    # From the mentioned product to its collections: a task must not meet all products of the collections that it mentions.
    listed = both.join(apart(collections.select("collection", F.explode("product_handles").alias("product_handle"))), "product_handle").join(apart(places), ["task_id", "collection"], "left_semi")
    lost = both.join(apart(listed.select("task_id", "product_handle").distinct()), ["task_id", "product_handle"], "left_anti")
    return _finding(lost, "product-not-in-collection", "warning", F.col("product_handle"))


def option_mismatches(tasks: DataFrame, products: DataFrame, about: DataFrame) -> DataFrame:
    """Options that an intent says to select and no product that it mentions has, as a name or a value."""
    phrases = F.regexp_extract_all(F.coalesce("intent", F.lit("")), F.lit(OPTION_PHRASE), F.lit(1))
    names = F.array_distinct(F.flatten(F.transform(phrases, lambda p: F.transform(F.regexp_extract_all(p, F.lit(OPTION_NAME), F.lit(1)), lambda t: folded(F.trim(t))))))
    asked = tasks.join(apart(about.select("task_id").distinct()), "task_id", "left_semi").select("task_id", F.explode(names).alias("token")).where(~F.col("token").isin(*NO_NAMES))
    options = about.join(apart(_options(products).drop("product_title")), "product_handle")
    own = options.select("task_id", folded(F.col("option")).alias("token")).where(~F.col("token").isin("", *NO_OPTIONS))
    values = options.select("task_id", F.explode("values").alias("v")).select("task_id", folded(F.trim("v")).alias("token")).where(~F.col("token").isin("", *NO_VALUES))
    return _finding(asked.join(apart(own.unionAll(values).distinct()), ["task_id", "token"], "left_anti"), "option-mismatch", "warning", F.col("token"))


def single_values(tasks: DataFrame, products: DataFrame, about: DataFrame) -> DataFrame:
    """Values that an intent says to select where the product offers no other."""
    sole = _options(products).where((F.size("values") == 1) & (F.col("option") != "") & ~folded(F.col("option")).isin(*NO_OPTIONS)).withColumn("value", F.trim(F.coalesce(F.col("values")[0], F.lit(""))))
    sole = sole.where((F.col("value") != "") & (folded(F.col("value")) != NO_VALUES[0])).select("product_handle", "option", "value")
    rows = about.join(apart(sole), "product_handle").join(apart(tasks.select("task_id", "intent")), "task_id")
    v, o = literal(F.col("value")), literal(F.col("option"))
    start = F.lit(r"(?iuU)select\s+(?:the\s+)?")
    says = F.regexp_like("intent", F.concat(start, v, F.lit(r"\s+for\s+(?:the\s+)?"), o)) | F.regexp_like("intent", F.concat(start, v, F.lit(r"\s+"), o, F.lit(r"\s+(?:variant|option)")))
    return _finding(rows.where(says), "single-sku-value-selection", "warning", F.concat_ws("=", "option", "value"))


def validate(tasks: DataFrame, products: DataFrame, collections: DataFrame, pages: DataFrame) -> DataFrame:
    """All findings: (rule, severity, task_id, detail).

    Errors: unknown-collection, unknown-product, infeasible-filter,
    intent-answer-leak. Warnings: unknown-page, filter-intent-malformed,
    filter-dim-unknown, product-not-in-collection, option-mismatch,
    single-sku-value-selection. Null fields count as empty. Handles are unique.
    """
    collections = cut(collections)
    about = cut(mentioned(tasks, products, "product_handle", "product_title", SHORT_TITLE))  # three rules read it
    parts = [
        unknown_handles(tasks, products, collections, pages),
        filter_findings(tasks, products, collections),
        answer_leaks(tasks),
        strays(tasks, products, collections, about),
        option_mismatches(tasks, products, about),
        single_values(tasks, products, about),
    ]
    # One rule after the other: in one plan, the driver would hold the code and the broadcasts of all of them at once.
    return reduce(DataFrame.unionAll, [cut(p.select("rule", "severity", F.col("task_id").cast("string").alias("task_id"), "detail")) for p in parts])
