"""Writers of datasets. Spark's committer makes a job's files visible together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .readers import EXTERNAL_FIELDS, RAW_FIELDS, require


def external(rows: DataFrame) -> DataFrame:
    """The columns that may leave, and no others."""
    return require(rows, EXTERNAL_FIELDS).select(EXTERNAL_FIELDS)


def clickstream_csv(rows: DataFrame, raw_path: str, external_path: str) -> None:
    """Both projections; nulls as blanks. The rows are read twice, so that nothing depends on what an executor holds."""
    kept = require(rows, RAW_FIELDS).select(RAW_FIELDS)
    kept.na.fill("").write.mode("overwrite").option("header", True).csv(raw_path)
    external(kept).na.fill("").write.mode("overwrite").option("header", True).csv(external_path)


def anonymous_csv(rows: DataFrame, path: str) -> None:
    """The compact columns without ids of users and stores."""
    external(rows).drop("user_id", "store_id").write.mode("overwrite").option("header", True).csv(path)


def sessions_json(rows: DataFrame) -> DataFrame:
    """(session_id, trajectory, product_categories, price_bucket, intent): one record a session, in order of time."""
    ordered = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "seq", "semantic_action", "product_category", "price_bucket"))).alias("r"))
    seen = lambda c: F.array_distinct(F.filter(F.transform("r", lambda x: x[c]), lambda v: F.coalesce(v, F.lit("")) != ""))
    return ordered.select("session_id", F.transform("r", lambda x: x["semantic_action"]).alias("trajectory"), seen("product_category").alias("product_categories"), F.transform(seen("price_bucket"), lambda b: b.try_cast("int")).alias("price_bucket"), F.concat(F.lit("I'm looking for "), F.array_join(seen("product_category"), ", ")).alias("intent"))


def json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def dataset(train: DataFrame, test: DataFrame, vocab: DataFrame, path: str) -> dict[str, int]:
    """Examples of both parts and the vocabulary as Parquet, after checks; the counts.

    Raises if a label is outside the vocabulary or a session is in both parts.
    """
    n = vocab.count()
    bad = train.unionByName(test).where((F.col("label") < 1) | (F.col("label") > n)).count()
    both = train.select("session").intersect(test.select("session")).count()
    if bad or both:
        raise ValueError(f"{bad} labels outside the vocabulary, {both} sessions in both parts")
    for name, df in (("train", train), ("test", test), ("vocab", vocab)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {"train": train.count(), "test": test.count(), "vocab": n}


def manifest(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """(part, n, columns) of the tables of a written dataset; the sorted column names, with commas. It is written beside them."""
    out = None
    for part in parts:
        df = spark.read.parquet(f"{path}/{part}")
        one = df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.lit(",".join(sorted(df.columns))).alias("columns"))
        out = one if out is None else out.unionAll(one)
    out.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(out.schema).json(f"{path}/manifest")


def append_run(record: dict[str, str], df: DataFrame, path: str) -> None:
    """One more line in a registry of runs."""
    df.sparkSession.createDataFrame([record]).coalesce(1).write.mode("append").json(path)


def append_batch(lines: DataFrame, batch: int, path: str) -> None:
    """The lines of a numbered batch in a registry; a batch that is written again replaces its own lines and no other's."""
    lines.write.mode("overwrite").json(f"{path}/batch={batch}")


def registry_stream(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a registry, each line once: a batch that is replayed after a failure has its old number."""
    return lines.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines of a registry, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").json(path)


def first_outcomes(dump: DataFrame) -> DataFrame:
    """Outcome rows once per example: of repeated ones the first to arrive. Metrics outside 0 to 1 raise."""
    metrics = ["hit10", "rr10", "hit5", "rr5"]
    out = dump.groupBy("method", "condition", "seed", "example").agg(*[F.min_by(m, "arrival").alias(m) for m in metrics])
    if out.where(" OR ".join(f"NOT ({m} BETWEEN 0 AND 1)" for m in metrics)).limit(1).count():
        raise ValueError("a metric is outside 0 to 1")
    return out
