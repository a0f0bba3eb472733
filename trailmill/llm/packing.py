"""Operator 8: packing of documents into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths decides how to pack. All patterns of up to
three lengths that fill a sequence exactly are enumerated; repeat counts for
them are fitted to the histogram by non-negative least squares (projected
gradient with momentum), rounded down so that no length is used more often than
it occurs, and what is left is packed best fit first, again by lengths. The
plan is a table of intervals: the documents of one length, numbered from 0, go
interval by interval to the places that the patterns have for that length.

The histogram has one entry a length, the plan at most three a pattern; both are
bounded by the capacity (1,024: under 90,000 patterns, 9 MB), whatever the number
of documents, and are all that the driver sees. The documents of a length are
numbered in salts of bounded size, so a length that a third of all documents
share is no one task's; the salts' first numbers are a running sum in Spark.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import loaded
from .common import importable, shared

SALT_ROWS = 100_000
ROUNDS = 400


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths that fill the capacity exactly, as rows of three lengths (0: none)."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    two = lengths[(2 * lengths <= capacity)]
    two = two[has[capacity - two]]
    two = two[two > 0]
    out.append(np.stack([capacity - two, two, np.zeros_like(two)], 1))
    for c in lengths[3 * lengths <= capacity].tolist():
        b = lengths[(lengths >= c) & (c + 2 * lengths <= capacity)]
        b = b[has[capacity - c - b]]
        out.append(np.stack([capacity - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths comes nearest to the histogram."""
    if len(rows) == 0:
        return np.zeros(0)
    size = len(histogram)
    real = rows > 0

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), np.repeat(x, 3) * real.ravel(), size)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[rows] * real).sum(1)

    v = np.ones(len(rows))
    for _ in range(12):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.1 * float(v @ back(used(v))))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - step * back(used(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that hold every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    rows = patterns(np.flatnonzero(left), capacity)
    repeat = fit(rows, left.astype(float))
    for i in np.argsort(-repeat, kind="stable").tolist():
        n = int(repeat[i] + 0.5)
        if n == 0:
            break
        own = tuple(x for x in rows[i].tolist() if x)
        for length in set(own):
            n = min(n, int(left[length]) // own.count(length))
        if n > 0:
            for length in own:
                left[length] -= n
            out.append((own, n))
    # Best fit, longest first, on numbers of equal sequences instead of sequences.
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n > 0:
            space = min((s for s, bins in open_bins.items() if s >= length and bins), default=None)
            if space is None:
                each = capacity // length
                whole, part = divmod(n, each)
                if whole:
                    open_bins[capacity - each * length][(length,) * each] += whole
                if part:
                    open_bins[capacity - part * length][(length,) * part] += 1
                n = 0
            else:
                bins = open_bins[space]
                own, have = next(iter(bins.items()))
                take = min(n, have)
                bins[own] -= take
                if bins[own] == 0:
                    del bins[own]
                open_bins[space - length][(*own, length)] += take
                n -= take
    for bins in open_bins.values():
        out += bins.items()
    return out


def places(packed: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan as intervals sorted by (length, first number): key, first number, first sequence, offset."""
    number: dict[int, int] = defaultdict(int)
    rows = []
    sequence = 0
    for own, n in packed:
        offset = 0
        for length in own:
            rows.append((length, number[length], sequence, offset))
            number[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return _key(table[:, 0], table[:, 1]), table[:, 1], table[:, 2], table[:, 3]


def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (length << 44) + number


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only a longer one is cut, and only its first piece is not full."""
    if total <= capacity:
        return [total]
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's token pieces; a null text has the end id only."""
    proven = loaded(path).proven

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, proven)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            rows: list[list[int]] = [[], [], [], []]
            source: list[int] = []
            for at in range(0, len(column), 512):
                for i, ids in enumerate(bpe.ids(column.slice(at, 512).to_pylist()), at):
                    data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    start = 0
                    for k, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                        for values, v in zip(rows, (k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])), strict=True):
                            values.append(v)
                        source.append(i)
                        start += n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), pa.array(rows[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[1:])], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_column].dataType.simpleString()
    return importable(docs).select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces (columns id, piece, length and more) with `sequence_id` and `offset`.

    Every piece gets a place; sequences hold `capacity` at most, without gaps
    from 0. Equal pieces (one id, one piece number) are placed one by one. The
    table is read twice, so it should be a kept one. An empty table stays empty;
    a piece without a length or over the capacity raises.
    """
    salts = max(1, math.ceil(importable(pieces).count() / SALT_ROWS))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counted = shared(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    keys, numbers, sequences, offsets = places(plan(histogram, capacity), capacity)
    upto = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a salt
    starts = counted.select("length", "__salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__salt").orderBy("id", "piece")
    numbered = salted.withColumn("__number", F.row_number().over(inside) - 1).join(starts, ["length", "__salt"]).withColumn("__number", F.col("__number") + F.col("__before"))
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(keys, _key(length, number), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequences[at] + number - numbers[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return numbered.select(*[F.col(f"`{n}`") for n in names], F.col("length").cast("long").alias("__length"), F.col("__number").cast("long")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents."""
    pieces = shared(token_pieces(docs, path, capacity, end_id, id_column, text))
    return pack(pieces, capacity).withColumnRenamed("id", id_column)
