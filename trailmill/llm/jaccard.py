"""Operator 5: exact join of texts on the Jaccard similarity of their word n-grams, by PartEnum signatures.

Sets whose similarity reaches the threshold have sizes in the same or in
neighbouring bands. In one band instance two such sets differ in at most k
elements. The feature domain (64-bit hashes) is cut into parts of three cells
each; of (k+1)/2 parts at least one has one difference at most, so at least two
of its three cells are equal. A signature is a part with one cell left out: the
hash of all elements in the other two. Linked sets share one.

No signature is over nothing, or all sets with an empty place there would meet.
A set is thin in a partition if more than `spare` parts (cut beyond those needed)
have two empty cells; it signs what is not empty and then again in a next
partition of the domain, until it is not thin. Of two linked sets one stops first;
in that partition both sign, and in one of the parts where they agree the one
that is not thin has no empty signature, so neither has the other.

Copies (equal sets) are one node. Links are decided on whole sets in three steps:

1. every node with the one node that it shares most signatures with;
2. the other pairs of small groups and of the stars of large ones, as far as
   their nodes are not in one component by then;
3. large groups that are still in several components: the groups of one pivot,
   and of one largest component, are taken together, and the nodes outside it
   meet all their nodes.

Pairs do not carry sets. A text (compressed) goes once to the group of its pivot,
or to a block of a component, where a task holds one pivot or block and lets the
others stream past. In steps 2 and 3 a sketch (a checksum of each of n/2 to n
cells of the domain; those that differ are at most the elements that differ) is
asked first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, importable, release, shared
from .components import components
from .hashing import mix, prefix_sums, text_windows

BLOCK_BYTES = 4 << 20
BUCKET_SIGNATURES = 3 << 20
SPARE_SHARE = 8  # one spare part for so many
BLOCK_ELEMENTS = 1 << 20
BROADCAST_ROWS = 1_000_000  # 16 MB at most
HUB_SHARE = 1024  # a pivot with more than this share of all pairs is split; there are fewer than so many
_DESCRIBED = "doc long, text_hash long, n long, fp long, signs long"
_SIGNED = "bucket int, data binary"
_PAIRS = "a long, b long, w int, pivot long, members binary"
_KEPT = "fp long, n long, sketch binary, size int, z binary"
_LINKS = "a long, b long"


@dataclass(frozen=True)
class Likeness:
    """n-gram width in words, and the threshold as a fraction."""

    words: int = 5
    part: int = 80
    whole: int = 100

    def bands(self, most: int) -> np.ndarray:
        """Least size of each band; a set of a band can't link beyond the next."""
        out = [1]
        while out[-1] <= most * self.whole // self.part + 1:
            out.append(out[-1] * self.whole // self.part + 1)
        return np.array([*out, out[-1] * self.whole // self.part + 1], np.int64)

    def differences(self, most: np.ndarray) -> np.ndarray:
        """The most elements in which two linked sets of up to `most` elements differ."""
        return 2 * most * (self.whole - self.part) // (self.whole + self.part)

    def enough(self, common, na, nb):
        return self.whole * common >= self.part * (na + nb - common)

    def sizes_fit(self, a, b):
        return (a * self.whole >= b * self.part) & (b * self.whole >= a * self.part)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct n-gram hashes of each text (A-Z as a-z), one after the other, and their numbers."""
    value, text, _ = text_windows(texts, words, lower=True, short=True)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[fresh], np.bincount(text[fresh], minlength=len(texts)).astype(np.int64)


def set_hashes(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sums = prefix_sums(mix(value))
    ends = np.cumsum(n)
    return mix((sums[ends] - sums[ends - n]) ^ mix(n.astype(np.uint64)))


def _parts(n: np.ndarray, like: Likeness) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(instance, parts, spare parts, prefix) of each set in both of its band instances; none where no other set can link.

    Where the smallest sets of an instance have fewer than three elements a part
    (thresholds far below 0.8), a prefix of single elements stands for the parts.
    """
    bands = like.bands(int(n.max(initial=1)))
    own = np.searchsorted(bands, n, side="right") - 1
    out = []
    for instance in (own, own + 1):
        k = like.differences(bands[instance + 1] - 1)
        needed = (k + 2) // 2
        spare = needed // SPARE_SHARE
        any_links = (k > 0) & (n > 0) & (n * like.whole >= bands[instance] * like.part)
        smallest = np.maximum(bands[np.maximum(instance - 1, 0)], -(-bands[instance] * like.part // like.whole))
        whole = smallest >= 3 * (needed + spare)
        out.append((instance, np.where(any_links & whole, needed + spare, 0), spare, np.where(any_links & ~whole, np.minimum(k + 1, n), 0)))
    return out


def _sign_in(value: np.ndarray, n: np.ndarray, instance: np.ndarray, parts: np.ndarray, spare: np.ndarray, partition: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, thin) in one partition of the domain; every set has parts, its values ascend."""
    owner = np.repeat(np.arange(len(n)), n)
    cells = 3 * parts
    base = np.cumsum(cells) - cells
    cell = base[owner] + (((value >> np.uint64(32)) * cells.astype(np.uint64)[owner]) >> np.uint64(32)).astype(np.int64)
    counts = np.bincount(cell, minlength=int(cells.sum()))
    edge = np.concatenate([[0], np.cumsum(counts)])
    sums = prefix_sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)))
    cell_sums = (sums[edge[1:]] - sums[edge[:-1]]).reshape(-1, 3)
    counts = counts.reshape(-1, 3)
    of = np.repeat(np.arange(len(n)), parts)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    salt = mix((instance[of].astype(np.uint64) << np.uint64(40)) + (rank.astype(np.uint64) << np.uint64(2)) + (np.uint64(partition) << np.uint64(56)))
    left = counts.sum(1, keepdims=True) - counts
    thin = np.bincount(of, weights=(left == 0).any(1), minlength=len(n)) > spare
    sig = mix((cell_sums.sum(1, keepdims=True, dtype=np.uint64) - cell_sums) ^ (salt[:, None] + np.arange(3, dtype=np.uint64)))
    use = left > 0
    return sig[use], np.broadcast_to(of[:, None], use.shape)[use], thin


def signatures(value: np.ndarray, n: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of all signatures of the sets, whose values ascend."""
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for instance, parts, spare, prefix in _parts(n, like):
        if prefix.any():
            of = np.repeat(np.arange(len(n)), prefix)
            place = np.arange(len(of)) - np.repeat(np.cumsum(prefix) - prefix, prefix) + (np.cumsum(n) - n)[of]
            found.append(mix(value[place] ^ mix(instance[of].astype(np.uint64))))
            owners.append(of)
        which = np.flatnonzero(parts > 0)
        partition = 0
        while len(which):
            at, size = value[np.repeat(parts > 0, n)] if partition == 0 else at, n[which]
            sig, of, thin = _sign_in(at, size, instance[which], parts[which], spare[which], partition)
            found.append(sig)
            owners.append(which[of])
            # The thin ones once more, with their elements elsewhere in the domain.
            at = mix(at[np.repeat(thin, size)] + np.uint64(0xA0761D6478BD642F))
            which = which[thin]
            at = at[np.lexsort((at, np.repeat(np.arange(len(which)), n[which])))]
            partition += 1
    return np.concatenate(found), np.concatenate(owners)


def level(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the cells of a sketch: half as many cells as elements, or up to twice that."""
    return np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64)


def sketches(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """One checksum byte for each cell of the domain, of each set."""
    cells = np.left_shift(1, level(n))
    base = np.cumsum(cells) - cells
    owner = np.repeat(np.arange(len(n)), n)
    cell = base[owner] + (value >> (np.uint64(64) - level(n).astype(np.uint64)[owner])).astype(np.int64) if len(value) else owner
    cell = np.where(cells[owner] == 1, base[owner], cell)
    sums = np.bincount(cell, weights=(mix(value) & np.uint64(255)).astype(float), minlength=int(cells.sum())).astype(np.int64).astype(np.uint8)
    return np.split(sums, base[1:])


def least_differences(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """For each row (sketches of one level) the cells in which it differs from `one`, at the coarser level of both."""
    while rows.shape[1] > len(one):
        rows = rows[:, 0::2] + rows[:, 1::2]
    while len(one) > rows.shape[1]:
        one = one[0::2] + one[1::2]
    return (rows != one).sum(1)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `most` bytes of text (the last column), and the texts."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.binary()), b"")
        upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at), column.slice(at, to - at).to_pylist()
            at = to


def _describe(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Id, size, hash of each text's set (null if empty) and about how many signatures it has."""
    for block, texts in _blocks(batches, BLOCK_BYTES):
        value, n = shingle_sets(texts, like.words)
        fp = set_hashes(value, n).view(np.int64)
        signs = sum(3 * parts + prefix for _, parts, _, prefix in _parts(n, like))
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(n), pa.array(fp, mask=n == 0), pa.array(signs)], names=["doc", "text_hash", "n", "fp", "signs"])


def _sign(batches: Iterator[pa.RecordBatch], like: Likeness, buckets: int) -> Iterator[pa.RecordBatch]:
    """The signatures of each block's sets by range, 4 bytes each behind their sets' hashes; sizes and counts by byte plane, compressed."""
    pack = zstandard.ZstdCompressor(level=1)
    for _, texts in _blocks(batches, BLOCK_BYTES):
        value, n = shingle_sets(texts, like.words)
        fp = set_hashes(value, n).view(np.int64)
        # Copies inside a block sign once.
        _, first = np.unique(fp, return_index=True)
        single = np.zeros(len(texts), bool)
        single[first] = True
        single &= n > 0
        sig, of = signatures(value[np.repeat(single, n)], n[single], like)
        fp, n = fp[single], n[single]
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
        rest = ((sig * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((of, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            take = order[cuts[b] : cuts[b + 1]]
            used, many = np.unique(of[take], return_counts=True)
            small = pack.compress(n[used].astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() + many.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())
            head = np.array([len(used), len(take), len(small)], np.int64).tobytes()
            out.append((b, head + small + fp[used].tobytes() + rest[take].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "data"])


def _propose(group: pa.Table, like: Likeness) -> pa.Table:
    """Pairs (a, b, shared signatures) of one range of signatures that may link, and the members of its larger groups, by pivot."""
    fps, sizes, nodes, sigs = [], [], [], []
    seen = 0
    for data in group.column("data"):
        data = data.as_buffer()
        d, m, packed = np.frombuffer(data, np.int64, 3).tolist()
        small = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[24 : 24 + packed]), np.uint8).reshape(2, 4, d)
        size, many = (np.ascontiguousarray(x.T).view(np.int32).ravel() for x in small)
        fps.append(np.frombuffer(data, np.int64, d, 24 + packed))
        sizes.append(size)
        nodes.append(np.repeat(np.arange(d, dtype=np.int32), many) + np.int32(seen))
        sigs.append(np.frombuffer(data, np.uint32, m, 24 + packed + 8 * d))
        seen += d
    fp, first, inverse = np.unique(np.concatenate(fps), return_index=True, return_inverse=True)  # copies of other blocks fall together
    size = np.concatenate(sizes)[first].astype(np.int64)
    key = np.concatenate(sigs).astype(np.uint64)
    key <<= np.uint64(32)
    key |= inverse[np.concatenate(nodes)].astype(np.uint64)
    sigs.clear(), nodes.clear()
    key.sort()
    key = key[np.diff(key, prepend=key[0] ^ np.uint64(1)) != 0]
    sig, node = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
    del key
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(start, len(sig)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in (2, 3, 4):
        rows = node[start[count == m][:, None] + np.arange(m)]
        for i in range(m):
            for j in range(i + 1, m):
                left.append(rows[:, i])
                right.append(rows[:, j])
    large = count > 4
    members: dict[int, np.ndarray] = {}
    if large.any():
        node = node[np.repeat(large, count)]
        count = count[large]
        start = np.cumsum(count) - count
        # The text that copies were made from shares a signature with each of them, so it is in most groups.
        groups = np.bincount(node, minlength=len(fp))
        rank = groups * len(fp) + np.argsort(np.argsort(mix(fp.view(np.uint64))))
        pivot = np.repeat(node[np.flatnonzero(rank[node] == np.repeat(np.maximum.reduceat(rank[node], start), count))], count)
        left.append(np.minimum(pivot, node))
        right.append(np.maximum(pivot, node))
        # All groups of a pivot are one list: it names a node once, however many signatures the node shares with the pivot.
        both = np.unique((pivot.astype(np.uint64) << np.uint64(32)) | node.astype(np.uint64))
        head, own = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(head)) + 1
        members = {int(head[i]): part for i, part in zip([0, *cuts.tolist()], np.split(own, cuts), strict=True)}
    a, b = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
    use = (a != b) & like.sizes_fit(size[a], size[b])
    pair, w = np.unique((a[use].astype(np.uint64) << np.uint64(32)) | b[use].astype(np.uint64), return_counts=True)
    a, b = fp[(pair >> np.uint64(32)).astype(np.int64)], fp[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    heads, lists = pa.array(fp[list(members)], pa.int64()), pa.array([fp[x].tobytes() for x in members.values()], pa.binary())
    columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(w.astype(np.int32))]
    of_list = {n: pa.concat_arrays([pa.nulls(len(a), c.type), c]) for n, c in (("pivot", heads), ("members", lists))}
    return pa.table({n: pa.concat_arrays([c, pa.nulls(len(lists), c.type)]) for n, c in zip("abw", columns, strict=True)} | of_list)


def _keep(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """What deciding needs of each text: its set's hash, size and sketch, and the text compressed."""
    pack = zstandard.ZstdCompressor(level=3)
    for _, texts in _blocks(batches, BLOCK_BYTES):
        value, n = shingle_sets(texts, like.words)
        fp = set_hashes(value, n).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(n), pa.array([x.tobytes() for x in sketches(value, n)], pa.binary()), pa.array([len(t) for t in texts], pa.int32()), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["fp", "n", "sketch", "size", "z"])


def _sets(z: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return shingle_sets([unpack.decompress(x) for x in z.to_pylist()], words)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes of text; the column before the last has the sizes."""
    for batch in batches:
        upto = np.cumsum(batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def common_of(pivot: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Elements that each of the sets (none empty) has in common with the pivot; all ascend."""
    hit = pivot[np.minimum(np.searchsorted(pivot, value), len(pivot) - 1)] == value
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)


def _by_texts(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Pairs that link; in: pivot, salt, kind (0: the pivot itself, first), node, n, size, text, by pivot and salt."""
    at, pivot = None, np.zeros(0, np.uint64)
    for batch in _slices(batches):
        value, n = _sets(batch.column(6), like.words)
        ends = np.cumsum(n)
        b, salt, kind, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(salt) != 0)) + 1
        out = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
            while i < j and kind[i] == 0:
                at, pivot = (b[i], salt[i]), value[ends[i] - n[i] : ends[i]]
                i += 1
            if i < j and at == (b[i], salt[i]):
                common = common_of(pivot, value[ends[i] - n[i] : ends[j - 1]], n[i:j])
                out.append(np.flatnonzero(like.enough(common, n[i:j], len(pivot))) + i)
        keep = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(b[keep])], names=["a", "b"])


def _by_sketches(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link; in: as for texts, with sketches."""
    at, pivot, size = None, np.zeros(1, np.uint8), 0
    for batch in _slices(batches):
        b, salt, kind, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(salt) != 0)) + 1
        out = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
            while i < j and kind[i] == 0:
                at, pivot, size = (b[i], salt[i]), np.frombuffer(batch.column(6)[i].as_buffer(), np.uint8), int(n[i])
                i += 1
            if i < j and at == (b[i], salt[i]):
                kinds = level(n[i:j])
                for k in np.unique(kinds).tolist():
                    own = np.flatnonzero(kinds == k) + i
                    rows = np.frombuffer(b"".join(batch.column(6).take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                    common = (n[own] + size - least_differences(rows, pivot)) // 2
                    out.append(own[like.enough(common, n[own], size)])
        keep = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(b[keep])], names=["a", "b"])


def _small(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows, broadcast if `kept`, a kept table that they are not much longer than, is small; beyond that the join shuffles."""
    return F.broadcast(rows) if kept.count() <= BROADCAST_ROWS else rows


def _stream(pairs: DataFrame, kept: DataFrame, column: str, judge) -> DataFrame:
    """The pairs (a node, b its pivot) that the judge lets pass: each pivot once, its nodes streaming past it.

    `pairs` is a kept table. A pivot of very many pairs is split into salts; its
    row is then sent once for each. Texts of one id and set may give a pair twice.
    """
    total = pairs.count()
    per = pairs.groupBy("b").agg(F.count("*").alias("k"))
    salts = F.ceil(F.col("k") * HUB_SHARE / max(total, 1)).cast("int")
    many = F.col("k") * HUB_SHARE > total
    split = F.broadcast(per.where(many).select("b", salts.alias("salts")))  # fewer than HUB_SHARE rows
    size = F.octet_length("sketch") if column == "sketch" else F.col("size")
    payload = kept.select("fp", "n", size.cast("int").alias("size"), F.col(column).alias("data"))
    asked = pairs.join(split, "b", "left").select("b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.col("a").alias("fp"))
    nodes = payload.join(_small(asked, pairs), "fp").select("b", "salt", F.lit(1).alias("kind"), "fp", "n", "size", "data")
    pivots = per.select(F.col("b").alias("fp"), F.explode(F.sequence(F.lit(0), F.when(many, salts).otherwise(1) - 1)).alias("salt"))
    pivots = payload.join(_small(pivots, pairs), "fp").select(F.col("fp").alias("b"), "salt", F.lit(0).alias("kind"), "fp", "n", "size", "data")
    rows = pivots.unionAll(nodes).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    return rows.mapInArrow(judge, _LINKS)


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: the stars so far and these, not all links anew; the table before is deleted."""
    out = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links.select("a", "b")))
    release(known)
    return out


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).select("a", "b")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, node) of lists of members; all groups of one pivot are one group, named by it."""
    for batch in batches:
        lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if lists:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists])), pa.array(np.concatenate(lists))], names=["g", "fp"])


def _across(members: DataFrame, known: DataFrame, kept: DataFrame, like: Likeness) -> DataFrame:
    """Links between nodes of one group that are in different components so far.

    The groups with one largest component are merged. Their nodes are dealt into
    blocks of bounded size, each sent once; the nodes outside the component
    stream past every block.
    """
    rows = members.mapInArrow(_groups, "g long, fp long").distinct()
    placed = shared(rows.join(known.select(F.col("node").alias("fp"), "root"), "fp", "left").select("g", "fp", F.coalesce("root", "fp").alias("c")))
    parts = placed.groupBy("g", "c").agg(F.count("*").alias("k"))
    open_groups = parts.groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("g", "top")
    nodes = shared(placed.join(_small(open_groups, placed), "g").select("top", "fp", "c").distinct().join(kept.select("fp", "n"), "fp"))
    blocks = nodes.groupBy("top").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    dealt = nodes.select("top", "fp", "c").join(_small(blocks, nodes), "top")
    own = dealt.select("top", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "c", "fp")
    outside = dealt.where("c <> top").select("top", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "c", "fp")
    dealt = shared(own.unionAll(outside))
    sent = kept.join(_small(dealt, dealt), "fp").select("top", "block", "kind", "c", "fp", "n", "sketch", "size", "z")
    met = sent.repartition("top", "block").sortWithinPartitions("top", "block", "kind")
    out = shared(met.mapInArrow(lambda batches: _outsiders(batches, like), _LINKS).distinct())
    release(placed, nodes, dealt)
    return out


class _Block:
    """Nodes of one block: their sketches by level, and their sets."""

    def __init__(self, like: Likeness):
        self.like = like
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.ready = False

    def add(self, c, fp, n, sketch, value) -> None:
        self.rows.append((c, fp, n, sketch, value))
        self.ready = False

    def _prepare(self) -> None:
        self.c, self.fp, self.n = (np.concatenate([r[k] for r in self.rows]) for k in range(3))
        self.value = np.concatenate([r[4] for r in self.rows])
        self.ends = np.cumsum(self.n)
        raw = [x for r in self.rows for x in r[3]]
        kinds = level(self.n)
        self.levels = [(own, np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint8).reshape(len(own), -1)) for k in np.unique(kinds).tolist() if len(own := np.flatnonzero(kinds == k))]
        self.ready = True

    def links(self, c: int, n: int, sketch: np.ndarray, value: np.ndarray) -> list[int]:
        """Nodes that link with the one given, one for each component but its own."""
        if not self.ready:
            self._prepare()
        like, may = self.like, []
        for own, rows in self.levels:
            use = (self.c[own] != c) & like.sizes_fit(self.n[own], n)
            if use.any():
                own, apart = own[use], least_differences(rows[use], sketch)
                keep = like.enough((self.n[own] + n - apart) // 2, self.n[own], n)
                may.append(np.stack([apart[keep] / self.n[own][keep], own[keep]], 1))
        out, done = [], set()
        for i in np.concatenate(may)[np.argsort(np.concatenate(may)[:, 0], kind="stable"), 1].astype(np.int64).tolist() if may else []:
            if self.c[i] not in done:
                common = int(common_of(self.value[self.ends[i] - self.n[i] : self.ends[i]], value, np.array([n]))[0])
                if like.enough(common, int(self.n[i]), n):
                    done.add(self.c[i])
                    out.append(int(self.fp[i]))
        return out


def _outsiders(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Links of the outsiders (kind 1) with the nodes of their block (kind 0, first)."""
    at, block = None, _Block(like)
    for batch in _slices(batches):
        value, n = _sets(batch.column(8), like.words)
        ends = np.cumsum(n)
        top, number, kind, c, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        sketch = batch.column(6).to_pylist()
        cuts = np.flatnonzero((np.diff(top) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
        left, right = [], []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(top)], strict=True):
            if at != (top[i], number[i]):
                at, block = (top[i], number[i]), _Block(like)
            if kind[i] == 0:
                block.add(c[i:j], fp[i:j], n[i:j], sketch[i:j], value[ends[i] - n[i] : ends[j - 1]])
            elif block.rows:
                for k in range(i, j):
                    for other in block.links(c[k], int(n[k]), np.frombuffer(sketch[k], np.uint8), value[ends[k] - n[k] : ends[k]]):
                        left.append(int(fp[k]))
                        right.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def near_copies(docs: DataFrame, like: Likeness = Likeness(), id_column: str = "doc_id", text: str = "text", details: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links reach.

    A text's set is its distinct word n-grams, A-Z as a-z; with fewer words its
    whole sequence is the one element; without words (or null) it is empty and
    linked with nothing. Two texts link when their Jaccard similarity is at least
    part/whole. Equal sets are linked. Ids should be unique; rows with one id and
    different texts are told apart by their sets. A row without an id takes the
    smallest id of its component, if it has any. Other columns are dropped. With
    `details`, text_hash (xxhash64 of the text) and component (a name that no
    other component has, null for empty sets) come along. Sets are told apart by 64-bit hashes; all decisions on pairs are taken on whole
    sets of such hashes. An empty table gives an empty one.
    """
    keyed = importable(docs).select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    rows = shared(keyed.mapInArrow(lambda x: _describe(x, like), _DESCRIBED))
    buckets = bucket_count(rows.agg(F.sum("signs")).first()[0] or 0, BUCKET_SIGNATURES)
    classes = shared(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("rep")))
    signed = keyed.select("text").mapInArrow(lambda x: _sign(x, like, buckets), _SIGNED)
    proposed = shared(signed.groupBy("bucket").applyInArrow(lambda x: _propose(x.select(["data"]), like), _PAIRS))
    pairs = shared(proposed.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w")))
    members = proposed.where("members IS NOT NULL").select("pivot", "members")

    wanted = shared(pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct().join(classes, "fp").select("rep"))
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    kept = shared(keyed.join(chosen, keyed["doc"].eqNullSafe(chosen["rep"]), "left_semi").select("text").mapInArrow(lambda x: _keep(x, like), _KEPT).where("n > 0"))
    release(wanted)

    toward = pairs.select("a", "b", "w").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    best = shared(toward.groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("b")))
    links = shared(_stream(best, kept, "z", lambda x: _by_texts(x, like)))
    known = components(links)

    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = shared(_apart(pairs.select("a", "b"), known).join(tried, ["a", "b"], "left_anti"))
    likely = shared(_stream(others, kept, "sketch", lambda x: _by_sketches(x, like)).distinct())
    more = shared(_stream(likely, kept, "z", lambda x: _by_texts(x, like)))
    release(best, others, likely)
    if more.limit(1).count():
        known = _joined(known, more)
    if members.limit(1).count():
        across = _across(members, known, kept, like)
        if across.limit(1).count():
            known = _joined(known, across)
        release(across)
    release(links, more, kept, pairs, proposed)

    more = ["text_hash"] if details else []
    placed = rows.select("doc", "n", "fp", *more).join(known.select(F.col("node").alias("fp"), "root"), "fp", "left").select("doc", "n", *more, F.coalesce("root", "fp").alias("root"))
    least = classes.join(known.select(F.col("node").alias("fp"), "root"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rep").alias("least"))
    return placed.join(least, "root", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"), *more, *([F.col("root").alias("component")] if details else []))
