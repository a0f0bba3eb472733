"""Readers of the provider and dataset formats, with explicit schemas and checks at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the raw clickstream, in order.
RAW_FIELDS = ["session_id", "user_id", "store_id", "timestamp", "semantic_action", "raw_action", "product_hash", "product_id", "url_hash", "url", "created_at", "persona", "product_category", "price_bucket", "product_slug", "price"]
#: The columns that may leave, in order.
EXTERNAL_FIELDS = ["session_id", "user_id", "store_id", "timestamp", "semantic_action", "product_hash", "url_hash", "created_at", "product_category", "price_bucket"]
CATALOG_FIELDS = ["product_handle", "product_title", "product_type", "price"]
TIMELINE = "link string, timestamp string, timeline array<struct<url:string,referrerUrl:string,duration:int,start:string,timelineEvents:array<struct<eventtype:string,text:string,start:string>>>>"
STEP = "session_id string, timestamp string, synthetic_action string, clicked_url string, url string, llm_call array<string>"
MESSAGES = "session_id string, messages array<struct<role:string,content:string>>"
SHOP_PRODUCT = "id long, title string, handle string, vendor string, product_type string, tags array<string>, variants array<struct<id:long,title:string,sku:string,price:string,available:boolean,option1:string,option2:string>>, images array<struct<id:long,src:string,alt:string>>"


class MissingColumns(ValueError):
    """A source lacks columns that its format requires."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(", ".join(missing))
    return df


def strings(columns: list[str]) -> T.StructType:
    """Text columns: ids must never be guessed to be numbers."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The frame with typed nulls for optional columns that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def flat_events(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Provider events of a CSV with a header; all columns as text, then placed rows with epoch milliseconds and seq in file order.

    Rows whose session or time is missing or unreadable go. seq is the row's
    place in its file and never depends on a later shuffle.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(strings(columns)).csv(path)
    require(raw, ["session_id", "event_name", "event_at"])
    at = F.unix_millis(F.coalesce(F.try_to_timestamp("event_at"), F.try_to_timestamp("event_at", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS z"))))
    return raw.withColumns({"ts_ms": at, "seq": F.monotonically_increasing_id()}).where("session_id IS NOT NULL AND session_id <> '' AND ts_ms IS NOT NULL")


def warehouse(spark: SparkSession, options: dict[str, str], sessions: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Events of a warehouse table by JDBC; the store goes into the scan, a sample of sessions into a semi join."""
    df = spark.read.format("jdbc").options(**options).load()
    if store is not None:
        df = df.where(F.col("shop_id") == store)
    return df if sessions is None else df.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def candidates(events: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """(session_id, outcome, n_real, products): per outcome at most `cap` session summaries, by hash order."""
    from ..operators.features import session_summary

    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("session_id").cast("string")), 256)
    return session_summary(events).withColumn("__k", F.row_number().over(Window.partitionBy("outcome").orderBy(order, "session_id"))).where(F.col("__k") <= cap).drop("__k")


def product_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog CSV: required columns checked, rows without title dropped, numeric prices, first row of a handle."""
    from ..operators.catalog import clean_catalog

    raw = spark.read.option("header", True).csv(path)
    return clean_catalog(require(raw, CATALOG_FIELDS).withColumn("place", F.monotonically_increasing_id()))


def shop_products(spark: SparkSession, path: str) -> DataFrame:
    """Products with price (least, else greatest) and published as true only for the text true."""
    raw = spark.read.option("header", True).csv(path)
    return require(raw, ["product_handle", "min_price", "max_price"]).withColumns({"price": F.coalesce(F.col("min_price").try_cast("double"), F.col("max_price").try_cast("double")), "published": F.when(F.col("published").isNotNull(), F.lower(F.trim("published")) == "true")})


def clickstream(spark: SparkSession, path: str) -> DataFrame:
    """A clickstream CSV with a numeric time; rows without session or time go."""
    raw = spark.read.option("header", True).csv(path)
    return require(raw, ["session_id", "timestamp", "semantic_action"]).withColumns({"timestamp": F.col("timestamp").try_cast("double").cast("long"), "seq": F.monotonically_increasing_id()}).dropna(subset=["session_id", "timestamp"])


def timelines(spark: SparkSession, path: str) -> DataFrame:
    """Nested provider sessions of JSON: one row a page and one a click below it, once per link.

    start (mm:ss) is added to the session's time; an unreadable time is null.
    """
    from ..functions.scalars import clock_ms

    raw = spark.read.schema(TIMELINE).option("multiLine", True).json(path).dropDuplicates(["link"])
    at = F.unix_millis(F.try_to_timestamp("timestamp"))
    pages = raw.select(F.element_at(F.split("link", "/"), -1).alias("session_id"), at.alias("base"), F.posexplode("timeline").alias("page", "p"))
    return pages.select("session_id", "page", (F.col("base") + F.coalesce(clock_ms(F.col("p.start")), F.lit(0))).alias("ts_ms"), F.col("p.url").alias("url"), F.col("p.referrerUrl").alias("referrer"), F.col("p.duration").alias("duration"), F.col("p.timelineEvents").alias("clicks"))


def browser_stream(spark: SparkSession, path: str, since: str, until: str, most: int) -> DataFrame:
    """Flat browser events of a time range and of the three kinds that count, the first `most` in order of time."""
    raw = spark.read.json(path)
    kinds = ["$pageview", "$pageleave", "$autocapture"]
    return require(raw, ["event", "timestamp", "session_id"]).where(F.col("event").isin(*kinds) & F.col("timestamp").between(since, until)).orderBy("timestamp").limit(most)


def run_files(spark: SparkSession, folder: str, name: str = "session_data.json") -> DataFrame:
    """Step records of all run folders below a folder, with the folder that they came from."""
    raw = spark.read.schema(STEP).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
    return raw.withColumns({"run": F.element_at(F.split("_metadata.file_path", "/"), -2), "seq": F.monotonically_increasing_id()})


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; a malformed one fails the scan, or gives nulls if not strict. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Model call traces; missing and broken files are passed over."""
    raw = spark.read.schema("session_id string, model string, input_tokens long, output_tokens long, seconds double, price double, _broken string").option("columnNameOfCorruptRecord", "_broken").option("ignoreMissingFiles", True).json(path)
    return raw.where("session_id IS NOT NULL").drop("_broken")


def split_tables(spark: SparkSession, path: str, splits: str) -> DataFrame:
    """A table partitioned by split; `train+test` names both. Only their folders are read."""
    return spark.read.parquet(path).where(F.col("split").isin(*splits.split("+")))


def named_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome tables whose files are called method_condition_seedN.parquet, with these three as columns."""
    raw = spark.read.option("recursiveFileLookup", True).parquet(folder)
    part = lambda k: F.regexp_extract("_metadata.file_path", r"/([^/_]+)_([^/]+)_seed(\d+)\.parquet", k)
    return raw.withColumns({"method": part(1), "condition": part(2), "seed": part(3).try_cast("int")}).where("seed IS NOT NULL")


def test_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, recall, mrr): the last `Test:` line of each log, else its validation line of highest recall."""
    lines = spark.read.text(path).withColumns({"file": F.col("_metadata.file_path"), "n": F.monotonically_increasing_id()})
    number = lambda k: F.regexp_extract("value", rf"{k}[=: ]+([0-9.]+)", 1).try_cast("double")
    found = lines.where(F.col("value").rlike("^(Test|Valid):")).withColumns({"recall": number("Recall@5"), "mrr": number("MRR@5"), "test": F.col("value").startswith("Test:")})
    rank = F.struct("test", F.when(F.col("test"), F.col("n").cast("double")).otherwise(F.col("recall")), "n")
    return found.groupBy("file").agg(F.max_by("recall", rank).alias("recall"), F.max_by("mrr", rank).alias("mrr"))


def dataset_products(spark: SparkSession, path: str) -> DataFrame:
    """A shop dataset's products: typed variants and images, place by position in the file."""
    raw = spark.read.schema(f"products array<struct<{SHOP_PRODUCT.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode("products").alias("place", "p")).select("place", "p.*")


def store_sessions(rows: DataFrame, cap: int, store: str | None = None) -> DataFrame:
    """Rows of the first `cap` sessions by id (all if cap is not positive), of one store if named."""
    chosen = rows if store is None else rows.where(F.col("store_id") == store)
    if cap <= 0:
        return chosen
    return chosen.join(chosen.select("session_id").distinct().orderBy("session_id").limit(cap), "session_id", "left_semi")


def distinct_runs(paths: DataFrame, path: str, order: str) -> DataFrame:
    """Rows with `resolved` (the path without empty and . segments, and without x/..), the first by `order` of each resolved path."""
    plain = F.filter(F.split(F.col(path), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(plain, F.array().cast("array<string>"), lambda out, x: F.when((x == "..") & (F.size(out) > 0), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.array_append(out, x)))
    rows = paths.withColumn("resolved", F.concat(F.when(F.col(path).startswith("/"), "/").otherwise(""), F.array_join(up, "/")))
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("resolved").orderBy(order))).where("__k = 1").drop("__k")


def action_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The actions of a dataset of three tables (action, session, user) with their session's user and the user's persona; a user without a row has nulls."""
    action, session, user = (spark.read.parquet(f"{folder}/{name}") for name in ("action", "session", "user"))
    return require(action, ["session_id", "timestamp", "action"]).join(require(session, ["session_id", "user_id"]), "session_id").join(require(user, ["user_id"]), "user_id", "left")


#: The text columns of a simulated shop's clickstream.
SIMULATED_FIELDS = ["semantic_action", "raw_action", "url", "product_handle", "landing_url"]


def simulated_clickstream(spark: SparkSession, path: str, store: str | None = None, sessions: int = 0) -> DataFrame:
    """(session_id, ord, timestamp, the text columns) of a simulated shop's clickstream, of the first `sessions` sessions by id (all if not positive).

    A time is whole milliseconds, cut off if it has decimals; what is no number is
    0, and equal times keep the order of the file. Texts lose blanks around them,
    a missing one is ''. Rows without a session are left out.
    """
    raw = require(spark.read.option("header", True).csv(path), ["session_id", "timestamp"])
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in raw.columns else F.lit("")
    at = F.coalesce(F.trim("timestamp").try_cast("long"), F.trim("timestamp").try_cast("double").cast("long"), F.lit(0).cast("long"))
    rows = raw.select(text("session_id").alias("session_id"), text("store_id").alias("store_id"), at.alias("timestamp"), *[(F.lower(text(c)) if c == "semantic_action" else text(c)).alias(c) for c in SIMULATED_FIELDS], F.monotonically_increasing_id().alias("__row"))
    kept = store_sessions(rows.where("session_id <> ''"), sessions, store)
    order = Window.partitionBy("session_id").orderBy("timestamp", "__row")
    return kept.select("session_id", (F.row_number().over(order) - 1).alias("ord"), "timestamp", *SIMULATED_FIELDS)


def shop_records(spark: SparkSession, path: str) -> DataFrame:
    """(place, record: VARIANT) of a shop's JSON files: a row an element of an array, one row for an object. A file is read by one task, so large sets belong in many files."""
    raw = spark.read.option("singleVariantColumn", "r").option("multiLine", True).json(path)
    many = F.schema_of_variant("r").startswith("ARRAY")
    return raw.select(F.explode(F.when(many, F.col("r").cast("array<variant>")).otherwise(F.array("r"))).alias("record")).select(F.monotonically_increasing_id().alias("place"), "record")


IMAGE = "struct<id:long,src:string,alt:string,width:int,height:int,position:int>"


def _image(raw: Column, owner: Column, position: Column) -> Column:
    """An image of a feed; without an id it has its owner's, without a position its place."""
    known = raw.cast(IMAGE)
    return F.when(known.isNotNull(), F.struct(F.coalesce(known["id"], owner).alias("id"), known["src"].alias("src"), known["alt"].alias("alt"), known["width"].alias("width"), known["height"].alias("height"), F.coalesce(known["position"], position).alias("position")))


def typed_products(records: DataFrame) -> DataFrame:
    """Products of a feed with their types: a missing body or time is '', images have an id and a place."""
    raw = "struct<id:long,title:string,handle:string,body_html:string,vendor:string,product_type:string,tags:array<string>,published_at:string,created_at:string,updated_at:string,options:array<struct<name:string,position:int,values:array<string>>>,variants:array<struct<id:long,title:string,sku:string,price:string,available:boolean,option1:string,option2:string,option3:string,position:int>>,images:array<IMAGE>>".replace("IMAGE", IMAGE)
    p = records.select("place", F.col("record").cast(raw).alias("p")).select("place", "p.*")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    images = F.transform("images", lambda x, i: _image(x, F.col("id"), (i + 1).cast("int"))).alias("images")
    return p.select("place", "id", "title", "handle", F.coalesce("body_html", F.lit("")).alias("description_html"), "vendor", "product_type", "tags", blank("published_at"), blank("created_at"), blank("updated_at"), "options", "variants", images)


def typed_collections(records: DataFrame, members: DataFrame) -> DataFrame:
    """Collections of a feed with their types and the products of `members` (collection, product_handles); the feed's description is HTML."""
    raw = f"struct<id:long,title:string,handle:string,description:string,image:{IMAGE},published_at:string,updated_at:string>"
    c = records.select("place", F.col("record").cast(raw).alias("c")).select("place", "c.*")
    m = members.select(F.col("collection").alias("handle"), "product_handles")
    out = c.join(m, "handle", "left")
    return out.select("place", "id", "title", "handle", F.lit(None).cast("string").alias("description"), F.col("description").alias("description_html"), _image(F.col("image"), F.col("id"), F.lit(1)).alias("image"), "published_at", "updated_at", F.lit(None).cast("string").alias("sort_order"), F.coalesce("product_handles", F.array().cast("array<string>")).alias("product_handles"))
