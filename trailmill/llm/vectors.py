"""What both vector searches share: valid vectors, and a stated query set streaming past blocks of all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable

BLOCK_ROWS, LEAST_ROWS = 16384, 2048
FOUND = "query_id long, vec_id long, score {}"


def valid_vectors(table: DataFrame, id_column: str, vector: str, zero: bool) -> DataFrame:
    """(id, v) of the rows that take part: an id and a vector of finite numbers, with `zero` also one of zeros only. Every such row, repeated ids too."""
    fine = f"size(`{vector}`) > 0 AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    if not zero:
        fine += f" AND exists(`{vector}`, x -> x <> 0)"
    rows = table.where(F.col(f"`{id_column}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).where(F.expr(fine))
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def search_blocks(rows: DataFrame, queries: DataFrame, k: int, score_type: str, build: Callable) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each query by score, ties to the smaller id.

    Rows (id, v) are dealt into blocks of bounded size, each shuffled once; a
    task builds a block's index once, `build(ids, vectors)`, and the queries
    stream past it in Arrow batches: `index.search(query_ids, queries, k)` gives
    arrays of (query id, id, score), at least the k best of the block. Only k
    rows a query and block go on. Vectors of another length than a query's are
    no candidates of it.
    """
    importable(rows)
    n = rows.count()
    n_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(math.ceil(n / LEAST_ROWS), rows.sparkSession.sparkContext.defaultParallelism))
    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("b"), F.size("v").alias("d"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.size("v").alias("d"), F.lit(1).alias("kind"), "id", "v")
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            b, d, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(d) != 0) | (np.diff(asks) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if i == j:
                    continue
                if at != (b[i], d[i]):
                    at, held, index = (b[i], d[i]), [], None
                ids, vectors = batch.column(3)[i:j].to_numpy(), matrix(batch.column(4)[i:j], int(d[i]))
                if asks[i] == 0:
                    held.append((ids, vectors))
                elif held:
                    if index is None:
                        index = build(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    out = index.search(ids, vectors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["query_id", "vec_id", "score"])

    found = own.unionAll(asked).repartition("b", "d").sortWithinPartitions("b", "d", "kind", "id").mapInArrow(run, FOUND.format(score_type))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]
