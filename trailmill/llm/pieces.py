"""Operator 2: exact SentencePiece (merge type) encoding by backtracking, and decoding.

A sequence of pieces is the result of the merges exactly when every two
neighbours are compatible, that is, when re-merging the text of both gives the
same two again: the first merge across a border would also happen in the pair
alone, because the order of merges (best score, then leftmost) is total. So the
encoder walks the text once: a trie of the pieces gives the longest path from
each place that it comes to, the sizes of the pieces on a path are known, a
piece is taken if it is compatible with the one before, and a place from which
the end can't be reached is struck out of a bitfield so that none is tried
twice.

Characters outside the vocabulary never merge; they become byte pieces. No merge
crosses two neighbouring characters that no piece has side by side, so texts are
cut there and encoded by segments, each distinct one once per cache. One such
place is before a blank: no piece has a visible character before one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import CHUNK_CHARS, SpanTable, cut_chars
from .common import importable

BLANK = "▁"
PAIRS = 2_000_000
NEIGHBOUR_BITS = 20


def neighbour_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A key of NEIGHBOUR_BITS bits of each pair of code points; other pairs may share it, which only leaves a text uncut there."""
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - NEIGHBOUR_BITS)


class PieceCodec:
    """Encoder and decoder of one SentencePiece model of the merge (BPE) type with identity normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece has a blank after a visible character; segments would not be independent")
        if lib.decode(lib.encode("  a  b ")) != "  a  b ":
            raise ValueError("only models with identity normalisation and one added blank are supported")
        self.trie = ahocorasick.Automaton()
        self.longest = max(map(len, self.ids), default=1)
        self.sizes: dict[str, tuple[int, ...]] = {"": (1,)}  # of the pieces on each path of the trie, longest first; a character alone always is one
        for p in sorted(self.ids, key=len):
            self.trie.add_word(p, len(p))
            for to in range(1, len(p) + 1):
                if (path := p[:to]) not in self.sizes:
                    self.sizes[path] = self.sizes[path[:-1]] if to > 1 else (1,)
            if len(p) > 1:
                self.sizes[p] = (len(p), *self.sizes[p])
        self.neighbours = np.zeros(1 << NEIGHBOUR_BITS, bool)
        self.neighbours[neighbour_keys(*(np.array([ord(c) for p in self.ids for c in p[k : len(p) - 1 + k]], np.uint32) for k in (0, 1)))] = True
        self.compatible: dict[tuple[str, str], bool] = {}
        self.table = SpanTable()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by carrying out the merges one by one; the definition, used on pairs."""
        symbols: list[str | None] = list(text)
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (score := self.scores.get(both := symbols[i] + symbols[j])) is not None:
                heapq.heappush(queue, (-score, i, j, both))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a segment (characters outside the vocabulary alone), by backtracking."""
        n = len(text)
        reach, sizes, longest = self.trie.longest_prefix, self.sizes, self.longest
        at = 0
        failed = bytearray((n + 8) // 8)
        known, fits = self.compatible.get, self.fits
        taken: list[str] = []
        before = None
        left = [iter(sizes[text[: reach(text[:longest])]])]
        while at < n:
            for size in left[-1]:
                to = at + size
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                piece = text[at:to]
                if before is not None:
                    fit = known((before, piece))
                    if not (fits(before, piece) if fit is None else fit):
                        continue
                taken.append(piece)
                before = piece
                at = to
                if at < n:
                    left.append(iter(sizes[text[at : at + reach(text[at : at + longest])]]))
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                left.pop()
                at -= len(taken.pop())
                before = taken[-1] if taken else None
        return taken

    def encode_segment(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8")]
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, ids) of consecutive pieces of the texts, without begin and end."""
        pieces: list[str] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            for piece in cut_chars(BLANK + text.replace(" ", BLANK), CHUNK_CHARS) if len(text) < CHUNK_CHARS else (p.replace(" ", BLANK) for p in cut_chars(" " + text, CHUNK_CHARS)):
                pieces.append(piece)
                owners.append(i)
                held += len(piece)
                if held >= CHUNK_CHARS:
                    yield from self._chunk(pieces, owners)
                    pieces, owners, held = [], [], 0
        if pieces:
            yield from self._chunk(pieces, owners)

    def _chunk(self, pieces: list[str], owners: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        text = "".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, pieces)])
        blank = points == ord(BLANK)
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[1:] |= ~self.neighbours[neighbour_keys(points[:-1], points[1:])]
        start[bounds[:-1]] = True
        begins = np.flatnonzero(start)
        rows, sizes = self.table.look_up(text, points, begins, np.append(begins[1:], len(points)), self.encode_segment)
        ids = self.table.flat(rows, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, bounds)]
        for owner, a, b in zip(owners, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            yield owner, ids[a:b]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end."""
        out = [[np.array([self.bos], np.uint32)] for _ in texts]
        for i, ids in self.encode(texts):
            out[i].append(ids)
        return [np.concatenate([*x, np.array([self.eos], np.uint32)]) for x in out]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids as the library's decode gives it: control ids are silent, one leading blank goes, runs of byte pieces are UTF-8."""
        ids = np.asarray(ids, np.int64)
        if len(ids) == 0:
            return ""
        self._surfaces()
        if self.is_plain[ids].all():
            text = "".join(map(self.surface.__getitem__, ids.tolist()))
            return text[1:] if text.startswith(" ") and self.leads[ids[self.visible[ids]][0]] else text
        return self.library.decode(ids.tolist())

    def _surfaces(self) -> None:
        if hasattr(self, "surface"):
            return
        n = len(self.pieces)
        self.surface = ["" if i in self.control else self.pieces[i].replace(BLANK, " ") for i in range(n)]
        self.is_plain = np.ones(n, bool)
        self.visible = np.array([i not in self.control for i in range(n)])
        self.leads = np.array([self.pieces[i].startswith(BLANK) for i in range(n)])
        for b, i in enumerate(self.bytes):
            self.surface[i] = chr(b)
            self.is_plain[i] = b < 0x80
        self.is_plain[self.library.unk_id()] = False


_LOADED: dict[str, PieceCodec] = {}


def loaded(path: str) -> PieceCodec:
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> DataFrame:
    """The frame without its text and with the ids of each whole text (null: empty), begin and end included, as array<int>.

    path: a SentencePiece model file that all machines have. Repeated rows are
    encoded each; a very long text is read in pieces cut at blanks. A column
    named like `column` is replaced, an empty table stays empty. One narrow stage
    without a shuffle.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text, column)]
    schema = T.StructType([*keep, T.StructField(column, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "").to_pylist()
            yield _with_ids([*batch.columns[:-1]], codec.ids_of(texts), [f.name for f in schema.fields])

    return importable(docs).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`")).mapInArrow(run, schema)


def _with_ids(columns: list, ids: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))
    return pa.RecordBatch.from_arrays([*columns, values], names=names)


def decode(frame: DataFrame, path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """The frame without its ids and with the text that they decode to; null ids give an empty text, ids outside the vocabulary raise as in the library."""
    keep = [f for f in frame.schema.fields if f.name not in (ids, column)]
    schema = T.StructType([*keep, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [codec.decode([] if not x.is_valid else x.values.to_numpy()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return importable(frame).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{ids}`")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: `n_tokens`, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text.

    The same codec as in `encode` and `decode`; the ids never leave the task.
    Null texts are empty; repeated rows are done each; clashing column names are
    replaced; an empty table stays empty.
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    keep = [f for f in docs.schema.fields if f.name not in (text, *(f.name for f in new))]
    schema = T.StructType([*keep, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts, encoded, decoded = [], [], []
            for at in range(0, len(column), 128):
                for ids in codec.ids_of(pc.fill_null(column.slice(at, 128), "").to_pylist()):
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=[f.name for f in schema.fields])

    return importable(docs).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`")).mapInArrow(run, schema)
