"""Places in a total order of a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in spark.checkpoint.dir; on one machine without that setting, under its warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()


def apart(df: DataFrame) -> DataFrame:
    """The frame for a join that deals both sides out by key.

    Spark would send a side whole to the driver and every task if its files are
    small, but they tell nothing of the rows that exploding or unpacking makes.
    """
    return df.hint("merge")


def shares(df: DataFrame, rows: int = 200_000) -> int:
    """Into how many parts a table goes for about so many rows each; never fewer than the session shuffles into. Counts the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with `__part`, the number of their range in the order.

    As many ranges as the session shuffles into. Kept, so that a lost executor
    cannot move the borders between two uses.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def before_range(totals: DataFrame, column: str) -> DataFrame:
    """(__part, __before): what the ranges before hold of a total; one row a range."""
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__part", F.coalesce(F.sum(column).over(upto), F.lit(0)).alias("__before"))


def sorted_places(df: DataFrame, *order: str | Column, place: str = "place") -> DataFrame:
    """Rows numbered from 1 in the given order.

    Each range is numbered by itself, after the counts of the ranges before.
    Rows that are equal in the whole order get their places arbitrarily and lie in
    one range, so the order should end in a key. Nulls go where the order says.
    """
    rows = ranged(df, *order)
    before = before_range(rows.groupBy("__part").agg(F.count("*").alias("__n")), "__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(F.broadcast(before), "__part").withColumn(place, inside + F.col("__before")).drop("__part", "__before")
