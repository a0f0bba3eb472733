"""Operator 13: documents drawn by how much likelier a target corpus makes them than the whole.

A position table has one row a word (posexplode); windows over a document's
positions lead() to the words behind, and concatenation gives the features of
each order, hashed to buckets. Documents are dealt once, whole, before they are
exploded, so the window needs no shuffle of words. The buckets of all positions
are kept as numbers; both the counts of the corpus and the sum of gains of each
document read that table, and gains join by bucket (one row each, so their
broadcast is bounded by the number of buckets).

The draw adds Gumbel noise from a hash of the id to the weight and takes the
largest: sampling without replacement in one sort, in ranges that are numbered
after the totals of the ranges before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared
from .words import word_list

ORDERS = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
RANGE_ROWS = 2_000_000


def feature_buckets(df: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, b1 ... b<orders>) of every word position of (row, id, text): the bucket of the feature of each order that begins there.

    An order that the text ends before is null. A text without words has one row
    of nulls.
    """
    dealt = df.repartition("row").sortWithinPartitions("row")
    positions = dealt.select("row", "id", F.posexplode_outer(word_list(F.col("text"))).alias("pos", "word"))
    ahead = Window.partitionBy("row").orderBy("pos")
    leads = {f"w{k}": F.lead("word", k).over(ahead) for k in range(1, orders)}
    table = positions.withColumns(leads) if leads else positions
    words = [F.col("word"), *[F.col(f"w{k}") for k in range(1, orders)]]
    feature = lambda n: words[0] if n == 1 else F.concat(*[x for k in range(n) for x in ([F.lit(" ")] if k else []) + [words[k]]])
    return table.select("row", "id", *[(F.crc32(feature(n)) % buckets).cast("int").alias(f"b{n}") for n in range(1, orders + 1)])


def _counts(table: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, count) over all positions and orders; at most a row a bucket."""
    every = table.select(F.explode(F.array(*[F.col(f"b{n}") for n in range(1, orders + 1)])).alias("bucket")).where("bucket IS NOT NULL")
    return every.groupBy("bucket").agg(F.count("*").alias(name))


def _gain(s: Column, t: Column, all_s: float, all_t: float, buckets: int) -> Column:
    d = lambda c: c.cast("double")
    ratio = (d(t) + 1.0) * F.lit(float(all_s + buckets)) / ((d(s) + 1.0) * F.lit(float(all_t + buckets)))
    return F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")


def importance_sample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text",
    orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs.

    weight is the floored mean over the document's features of
    floor(1000 * ln(share of the bucket in the target / its share in docs)), shares
    smoothed by one; score adds Gumbel noise from the hash of seed and id. Of the
    rows with `least_words` words or more, `percent` per cent (rounded down) are
    drawn by falling score, ties to the smaller id; they have ranks from 1.

    Null and empty texts have no features and weight 0. A null id counts as '' in
    the hash and comes last among ties. Rows that repeat take part each; their
    ranks follow each other. Empty tables are fine on both sides. No other
    column is read.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id().alias("row")
    table = shared(feature_buckets(docs.select(row, F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), orders, buckets))
    aims = feature_buckets(target.select(row, F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), orders, buckets)
    s, t = _counts(table, orders, "s"), _counts(aims, orders, "t")
    both = shared(s.join(t, "bucket", "full").fillna(0, ["s", "t"]))  # a row a bucket
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    gains = both.select("bucket", _gain(F.col("s"), F.col("t"), sums["s"] or 0, sums["t"] or 0, buckets).alias("gain"))

    own = table
    for n in range(1, orders + 1):
        own = own.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"gain{n}"))), f"b{n}", "left")
    columns = range(1, orders + 1)
    count = sum((F.count(f"b{n}") for n in columns), F.lit(0))
    total = sum((F.coalesce(F.sum(f"gain{n}"), F.lit(0)) for n in columns), F.lit(0))
    weighed = own.groupBy("row", "id").agg(F.count("b1").alias("n_words"), count.cast("long").alias("n_features"), total.cast("long").alias("total"))
    weighed = weighed.withColumn("weight", F.expr("CASE WHEN n_features > 0 THEN (total - pmod(total, n_features)) div n_features ELSE 0L END"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)

    order = [F.desc("drawable"), F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")]
    scored = scored.select("row", "id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("drawable"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.count_if("drawable").alias("drawable"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.expr(f"{percent} * sum(drawable) OVER () div 100").alias("drawn"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    placed = ranged.join(F.broadcast(starts), "part").withColumn("place", place.cast("long"))
    return placed.select(F.col("id").alias(id_column), "n_features", "weight", "score", F.when(F.col("place") <= F.col("drawn"), F.col("place")).alias("rank"))
