"""The input tables as clickstream shapes, once for Spark and once as SQL.

events become provider events (sessions of a user and week, products from the
payload), part the product catalog, lineitem item sessions and cart lines. The
two spellings of a shape must stay equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, ts_ms, event_name, product_handle, query, collection_handle, price, quantity, client_id, side."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", "product_page_viewed")
        .when(kind == "click", F.when(k % 3 == 0, "collection_page_viewed").otherwise("entity_clicked"))
        .when(kind == "signup", F.when(k % 2 == 0, "product_added_to_cart").otherwise("search_submitted"))
        .when(kind == "purchase", "checkout_started")
        .otherwise("entity_impression")
    )
    return e.select(
        (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).cast("long").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        name.alias("event_name"),
        F.when(kind.isin("view", "purchase") | (kind == "click") & (k % 3 != 0) | (kind == "signup") & (k % 2 == 0), F.concat(F.lit("p"), (k % 4).cast("string"))).otherwise("").alias("product_handle"),
        F.when((kind == "signup") & (k % 2 == 1), F.concat(F.lit("term "), (k % 5).cast("string"))).otherwise("").alias("query"),
        F.when((kind == "click") & (k % 3 == 0), F.concat(F.lit("c"), (k % 2).cast("string"))).otherwise("").alias("collection_handle"),
        F.when(k % 7 != 0, F.col("value")).alias("price"),
        (k % 3 + 1).alias("quantity"),
        F.col("user_id").alias("client_id"),
        (F.col("event_id") % 2).cast("int").alias("side"),
    )


EVENTS_SQL = """
raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), ev AS (
  SELECT CAST(user_id * 10 + floor((day(ts) - 1) / 7) AS BIGINT) AS session_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
    CASE event_type WHEN 'view' THEN 'product_page_viewed' WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'collection_page_viewed' ELSE 'entity_clicked' END
      WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'product_added_to_cart' ELSE 'search_submitted' END WHEN 'purchase' THEN 'checkout_started' ELSE 'entity_impression' END AS event_name,
    CASE WHEN event_type IN ('view', 'purchase') OR (event_type = 'click' AND k % 3 <> 0) OR (event_type = 'signup' AND k % 2 = 0) THEN 'p' || (k % 4) ELSE '' END AS product_handle,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN 'term ' || (k % 5) ELSE '' END AS query,
    CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'c' || (k % 2) ELSE '' END AS collection_handle,
    CASE WHEN k % 7 <> 0 THEN value END AS price, k % 3 + 1 AS quantity, user_id AS client_id, CAST(event_id % 2 AS INTEGER) AS side
  FROM raw
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_handle, product_title, product_type, price, vendor, size of the parts."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product_handle"), F.col("p_name").alias("product_title"), F.col("p_type").alias("product_type"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("vendor"), F.col("p_size").alias("size"), F.col("p_partkey").alias("product_id"))


CATALOG_SQL = """
cat AS (
  SELECT 'p' || p_partkey AS product_handle, p_name AS product_title, p_type AS product_type, p_retailprice AS price, p_brand AS vendor, p_size AS size, p_partkey AS product_id FROM part
)"""


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, item, store, order keys of the line items; the rank of a row in its session is `pos` from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 5).alias("store"), F.row_number().over(w).alias("pos"), F.to_date("l_shipdate").alias("day"))


ITEMS_SQL = """
items AS (
  SELECT l_orderkey AS session, l_partkey AS item, l_suppkey % 5 AS store,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS INTEGER) AS pos, CAST(l_shipdate AS DATE) AS day
  FROM lineitem
)"""
