"""Operator 9: removal of passages that stand in an earlier document already.

Every window of `width` words of every text gets a Rabin-Karp hash. A window is
repeated if the same words start in a document with a smaller doc_id as well;
every word that a repeated window covers goes, so overlapping windows merge into
maximal removal intervals.

The windows are counted in two steps, like any aggregation. A map task sorts the
hashes of a block of documents, so of each distinct window only its smallest
document goes on (all others of the block are repeated, whatever the rest of the
corpus says: a passage in a third of all documents sends one window a block).
What goes on is packed by hash range, some 8 bytes a window. One reducer a range
finds the smallest document of each window and names the places of all others,
packed by groups of documents. There all places of a document merge into runs,
which meet its text again in one join on the document.

All this is a filter. What it names, the windows whose value stands in several
documents, goes through the same two steps once more with a second value of
another word hash and another base beside the first, so windows count as the same
only if more than 110 bits of independent hashes agree (two given ones that differ
do so with a chance of about 2**-115; 10**13 windows make 10**26 pairs, so a
false match anywhere has a chance of some 10**-9). A collision of the first
value alone costs time, never text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_count, importable, release, shared, text_bytes
from .hashing import mix, text_windows

BLOCK_BYTES = 4 << 20
RANGE_BYTES = 12 << 20
PART_BYTES = 96 << 20
BROADCAST_BYTES = 32 << 20  # runs of repeated windows that are sent to the texts; more of them meet the texts in a shuffle
KEY, TAG, FOUND = "__passage_doc", "__passage_tag", "__passage_found"
_SENT = "bucket int, part int, data binary"
_NAMED = "part int, data binary"
_FOUND = f"{KEY} long, {TAG} long, {FOUND} binary"


def _runs(places: np.ndarray) -> np.ndarray:
    """Ascending places as flat (start, length) pairs of consecutive ones."""
    if len(places) == 0:
        return np.zeros(0, np.int32)
    first = np.flatnonzero(np.diff(places, prepend=places[0] - 2) != 1)
    return np.stack([places[first], np.diff(np.append(first, len(places)))], 1).astype(np.int32).ravel()


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each value, byte plane by byte plane."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def _from_planes(data: bytes, n: int, width: int, kind: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view(kind).ravel()


def _pack(rest: np.ndarray, place: np.ndarray, ids: np.ndarray, tags: np.ndarray, ends: np.ndarray, second: np.ndarray | None) -> bytes:
    """Windows of one block and range: 7 bytes of hash each and 8 of the second, if there is one; places as steps, and the documents that they are from."""
    step = np.diff(place, prepend=0).astype(np.uint64)
    wide = 1 if len(step) == 0 else max(1, (int(step.max()).bit_length() + 7) // 8)
    small = zstandard.ZstdCompressor(level=1).compress(
        _planes(step, wide) + np.diff(ids, prepend=0).tobytes() + np.diff(ends, prepend=0).astype(np.int32).tobytes()
    )
    head = np.array([len(rest), len(ids), wide, len(small)], np.int64).tobytes()
    return head + small + tags.astype(np.uint32).tobytes() + _planes(rest, 7) + (b"" if second is None else second.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    n, docs, wide, size = np.frombuffer(data, np.int64, 4).tolist()
    small = zstandard.ZstdDecompressor().decompress(data[32 : 32 + size])
    place = np.cumsum(_from_planes(small, n, wide, np.uint64)).astype(np.int64)
    ids = np.cumsum(np.frombuffer(small, np.int64, docs, n * wide))
    ends = np.cumsum(np.frombuffer(small, np.int32, docs, n * wide + 8 * docs).astype(np.int64))
    at = 32 + size
    tags = np.frombuffer(data, np.uint32, docs, at).astype(np.int64)
    at += 4 * docs
    second = np.frombuffer(data, np.uint64, n, at + 7 * n) if len(data) > at + 7 * n else None
    return _from_planes(data[at : at + 7 * n], n, 7, np.uint64), place, ids, tags, ends, second


@dataclass(frozen=True)
class _Round:
    """What a round of counting needs; `exact` is the second one, which looks only at named places, with both hashes."""

    width: int
    buckets: int
    parts: int
    bits: int = 64
    exact: bool = False


def _in_runs(runs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether each window is in the (start, length) runs of its text; windows lie text after text."""
    edges = np.zeros(int(sizes.sum()) + 1, np.int32)
    for at, raw in zip((np.cumsum(sizes) - sizes).tolist(), runs, strict=True):
        run = np.frombuffer(raw, np.int32).reshape(-1, 2)
        np.add.at(edges, at + run[:, 0], 1)
        np.add.at(edges, at + run[:, 0] + run[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def _send_block(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], runs: list[bytes], how: _Round) -> pa.RecordBatch | None:
    order = np.argsort(ids, kind="stable")
    ids, tags, texts = ids[order], tags[order], [texts[i] for i in order]
    value, text, place = text_windows(texts, how.width)
    second = None
    if how.exact:
        use = _in_runs([runs[i] for i in order], np.bincount(text, minlength=len(texts)))
        second = text_windows(texts, how.width, second=True)[0][use]
        value, text, place = value[use], text[use], place[use]
    elif how.bits < 64:
        value = value & np.uint64((1 << how.bits) - 1)
    if len(value) == 0:
        return None
    # Texts ascend by doc_id and sorts are stable, so the first of equal windows is of the smallest.
    sort = np.argsort(value, kind="stable") if second is None else np.lexsort((second, value))
    fresh = np.ones(len(sort), bool)
    here = value[sort]
    fresh[1:] = here[1:] != here[:-1]
    if second is not None:
        here = second[sort]
        fresh[1:] |= here[1:] != here[:-1]
    del here
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(sort)))
    owner = np.repeat(ids[text[sort]][start], count)
    other = ids[text[sort]] != owner
    repeated = np.zeros(len(sort), bool)
    repeated[sort] = other
    named = repeated.copy()
    if not how.exact:  # the first of them is to be looked at again as well
        named[sort] = np.repeat(np.logical_or.reduceat(other, start), count)
    again = np.flatnonzero(named)
    out: list[tuple[int, int | None, bytes]] = [(p % how.buckets, p, data) for p, data in _pack_places(ids[text[again]], tags[text[again]], place[again], how.parts)]
    value, text, place, second = value[~repeated], text[~repeated], place[~repeated], second if second is None else second[~repeated]
    bucket = ((value >> np.uint64(32)) * np.uint64(how.buckets) >> np.uint64(32)).astype(np.uint32)
    rest = (value * np.uint64(how.buckets)) >> np.uint64(8)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(how.buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[b] : cuts[b + 1]]
        used, first = np.unique(text[own], return_index=True)
        local = place[own]
        # Places restart in each document; steps are taken over documents laid end to end.
        sizes = np.maximum.reduceat(local, first) + 1
        begin = np.cumsum(sizes) - sizes
        laid = local + np.repeat(begin, np.diff(np.append(first, len(own))))
        out.append((b, None, _pack(rest[own], laid, ids[used], tags[used], begin + sizes, second if second is None else second[own])))
    return pa.RecordBatch.from_pydict(dict(zip(("bucket", "part", "data"), map(list, zip(*out, strict=True)), strict=True)), pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())]))


def _send(batches: Iterator[pa.RecordBatch], how: _Round) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK_BYTES of text; in: document, tag, text and, in the second round, its runs."""
    ids: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    texts: list[bytes] = []
    runs: list[bytes] = []
    held = 0
    for batch in batches:
        column = batch.column(2).cast(pa.binary())
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(column):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES - held, side="right")))
            ids.append(batch.column(0)[at:to].to_numpy(zero_copy_only=False))
            tags.append(batch.column(1)[at:to].to_numpy(zero_copy_only=False))
            texts += column[at:to].to_pylist()
            runs += batch.column(3)[at:to].to_pylist() if how.exact else [b""] * (to - at)
            held += int(sizes[at:to].sum())
            at = to
            if held >= BLOCK_BYTES * 0.9:
                if (out := _send_block(np.concatenate(ids), np.concatenate(tags), texts, runs, how)) is not None:
                    yield out
                ids, tags, texts, runs, held = [], [], [], [], 0
    if texts and (out := _send_block(np.concatenate(ids), np.concatenate(tags), texts, runs, how)) is not None:
        yield out


def _pack_places(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Places by group of documents: 20 bytes each."""
    part = (mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        data = doc[own].astype(np.int64).tobytes() + tag[own].astype(np.int64).tobytes() + place[own].astype(np.int32).tobytes()
        out.append((p, zstandard.ZstdCompressor(level=1).compress(data)))
    return out


def _reduce(group: pa.Table, how: _Round) -> pa.Table:
    """Of the windows of one hash range that several documents have: the places of all, in the exact round of all but those of the smallest document."""
    out: list[tuple[int, bytes]] = []
    rests, docs, places, ids, tags, seconds = [], [], [], [], [], []
    seen = 0
    for part, data in zip(group.column("part").to_pylist(), group.column("data"), strict=True):
        data = data.as_buffer().to_pybytes()
        if part is not None:
            out.append((part, data))
            continue
        rest, laid, own_ids, own_tags, ends, second = _unpack(data)
        slot = np.searchsorted(ends, laid, side="right")
        rests.append(rest)
        docs.append((slot + seen).astype(np.int32))
        places.append((laid - np.concatenate([[0], ends])[slot]).astype(np.int32))
        ids.append(own_ids)
        tags.append(own_tags)
        seconds.append(second)
        seen += len(own_ids)
    rest, doc, place = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (rests, docs, places))
    rests.clear(), docs.clear(), places.clear()
    if how.exact and len(rest):
        second = np.concatenate(seconds)
        order = np.lexsort((second, rest))
        new = (np.diff(rest[order]) != 0) | (np.diff(second[order]) != 0)
    else:
        order = np.argsort(rest)
        new = np.diff(rest[order]) != 0
    first = np.flatnonzero(new) + 1
    count = np.diff(np.concatenate([[0], first, [len(rest)]]))
    order = order[np.repeat(count > 1, count)]  # the rest stand in one place only
    count = count[count > 1]
    if len(order):
        id_of, tag_of = np.concatenate(ids), np.concatenate(tags)
        own = id_of[doc[order]]
        start = np.cumsum(count) - count
        other = own != np.repeat(np.minimum.reduceat(own, start), count)
        if not how.exact:
            other = np.repeat(np.logical_or.reduceat(other, start), count)
        again = np.sort(order[other])
        out += _pack_places(id_of[doc[again]], tag_of[doc[again]], place[again], how.parts)
    return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "data": pa.array([x[1] for x in out], pa.binary())})


def _merge(group: pa.Table) -> pa.Table:
    """All repeated places of a group of documents as runs, one row a document and text."""
    doc, tag, place = [], [], []
    for data in group.column("data").to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = len(raw) // 20
        doc.append(np.frombuffer(raw, np.int64, n))
        tag.append(np.frombuffer(raw, np.int64, n, 8 * n))
        place.append(np.frombuffer(raw, np.int32, n, 16 * n))
    doc, tag, place = np.concatenate(doc), np.concatenate(tag), np.concatenate(place)
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    fresh = np.flatnonzero((np.diff(doc, prepend=doc[0] - 1) != 0) | (np.diff(tag, prepend=tag[0] - 1) != 0))
    runs = [_runs(np.unique(p)).tobytes() for p in np.split(place, fresh[1:])]
    return pa.table({KEY: pa.array(doc[fresh]), TAG: pa.array(tag[fresh]), FOUND: pa.array(runs, pa.binary())})


def repeated_windows(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(document, tag of its text, places): the windows of each text that start in a document with a smaller id as well, kept in the shared folder.

    One text of a repeated id can differ from the next; the tag (32 bits of the
    text's hash) tells them apart. `bits` of the first hash are used: fewer let
    more windows through to the second round and change no result.
    """
    total = text_bytes(docs, text)
    how = _Round(width, bucket_count(total, RANGE_BYTES), bucket_count(total, PART_BYTES), bits)
    keyed = importable(docs).where(F.col(f"`{id_column}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{id_column}`").cast("long").alias(KEY), _tag(text).alias(TAG), F.col(f"`{text}`").alias("text"))

    def counted(rows: DataFrame, how: _Round) -> DataFrame:
        sent = rows.mapInArrow(lambda batches: _send(batches, how), _SENT)
        named = sent.groupBy("bucket").applyInArrow(lambda group: _reduce(group, how), _NAMED)
        return shared(named.groupBy("part").applyInArrow(lambda group: _merge(group.select(["data"])), _FOUND))

    likely = counted(keyed, how)
    again = keyed.join(_small(likely), [KEY, TAG]).select(KEY, TAG, "text", FOUND)
    out = counted(again, replace(how, buckets=2 * how.buckets + 1, exact=True))
    release(likely)
    return out


def _small(found: DataFrame) -> DataFrame:
    """The runs, broadcast if they are small; else they meet the texts in a shuffle."""
    size = found.agg(F.sum(F.octet_length(FOUND) + 64)).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def _tag(text: str):
    return F.xxhash64(f"`{text}`").bitwiseAND(F.lit(0xFFFFFFFF))


def remove_repeated_passages(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """The frame with `kept_text`, `n_words`, `n_removed` and `removed_spans` (array of first word and number of words).

    Each word goes that is covered by a window of `width` words whose sequence
    also starts in a document with a smaller id, judged on the input. Kept words
    are joined by one blank. Words are runs of bytes outside [\\x20\\x09-\\x0D].
    Null and empty texts have no words. Rows without an id lose nothing and make
    others lose nothing; rows of equal id are equal in rank, so they do not make
    each other lose words. Texts under `width` words stay whole. An empty table
    gives an empty table. The four columns replace any of their names.
    """
    new = [
        T.StructField("kept_text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType())]))),
    ]
    names = [f.name for f in new]
    keep = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*keep, *new])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed, removed = [], [], [], []
            for raw, found in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = raw.as_buffer().to_pybytes().split() if raw.is_valid else []
                gone: list[dict[str, int]] = []
                lost = 0
                if found.is_valid:
                    edges = np.zeros(len(words) + 1, np.int32)
                    run = np.frombuffer(found.as_py(), np.int32).reshape(-1, 2)
                    np.add.at(edges, run[:, 0], 1)
                    np.add.at(edges, run[:, 0] + run[:, 1] + (width - 1), -1)
                    off = np.cumsum(edges[:-1]) > 0
                    lost = int(off.sum())
                    pairs = _runs(np.flatnonzero(off)).reshape(-1, 2).tolist()
                    gone = [{"start": a, "words": b} for a, b in pairs]
                    n_words.append(len(words))
                    words = list(compress(words, (~off).tolist()))
                else:
                    n_words.append(len(words))
                kept.append(b" ".join(words))
                n_removed.append(lost)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans)], names=[f.name for f in schema.fields])

    found = repeated_windows(docs, width, id_column, text, bits)
    left = docs.withColumns({KEY: F.col(f"`{id_column}`").cast("long"), TAG: F.when(F.col(f"`{text}`").isNotNull(), _tag(text))})
    joined = left.join(_small(found), [KEY, TAG], "left")
    return joined.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("binary").alias("__passage_text"), FOUND).mapInArrow(cut_out, schema)
