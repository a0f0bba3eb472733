"""What several operators of this folder share: reading, cutting lineage, sizing."""

from __future__ import annotations

import math
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of an Arrow batch that a Python worker gets; Spark's own setting counts where it is not the default.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def importable(df: DataFrame) -> DataFrame:
    """The frame; from now on its session's Python workers find this package where the driver has it, and get batches of 8 MB at most."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    known = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir or has set as its checkpoint folder; one machine alone may use its warehouse."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isEmpty():
            return known.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder


def shared(df: DataFrame) -> DataFrame:
    """The frame computed once, written to the shared folder as Parquet and read again.

    A lost executor costs the tasks that it ran, never what was already written;
    lineage ends at the written table. `release` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trailmill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trailmill_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the written tables of frames that came from `shared`; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_trailmill_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over the whole table; it sizes the buckets of a job."""
    return df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def bucket_count(total: int, each: int, least: int = 4) -> int:
    """Buckets so that each holds about `each` units whatever the total; odd, so that a multiplication by it is one to one."""
    return max(least, math.ceil(total / each)) | 1
