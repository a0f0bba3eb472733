"""Operator 6: contiguous shards of near equal bytes from global prefix sums. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared

LAW = "bytes"
RANGE_ROWS = 2_000_000


def byte_size(text: str = "text", overhead: int = 16) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead a row."""
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + overhead).cast("long")


def shards_by_bytes(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, shards being contiguous in the order of ids.

    The rows without their texts are range-partitioned by id and kept; each
    partition's total of bytes and rows gives the next one's start, and a running
    sum inside the partition gives every row its place among all bytes. The
    total is cut at `shards` equal targets, a row going where its middle byte
    lies, so shards differ by the size of one row at most. slot counts the rows
    of a shard from 0. Nothing but one row a partition and one a shard is ever
    brought together.

    A null text has the overhead as its size and 0 as its CRC. A null id sorts
    first. Rows of equal id are ordered by CRC and size, equal rows arbitrarily;
    a range border may fall among them, so one id with very many rows is split.
    A row larger than a target leaves shards empty. An empty table gives an empty
    one. grown_shard belongs to the law `key` and is null. No other column stays.
    """
    spark = docs.sparkSession
    # As many ranges as the session shuffles into, and more where they would hold over RANGE_ROWS rows.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / RANGE_ROWS))
    order = [F.col("id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("tie")]
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), byte_size(text, overhead).alias("size"), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    ranged = shared(narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "number": F.row_number().over(inside)})
        .join(F.broadcast(starts), "part")
        .select(
            "id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.expr(f"(2 * (bytes_before + upto) - size) * {shards} div (2 * total)")).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("number") - 1).alias("place"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_column), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
