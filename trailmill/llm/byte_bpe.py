"""Operator 1: token counts of a byte-level BPE, with a whole-token shortcut.

Most pre-tokens of a text are themselves vocabulary strings. Which of those
strings encode alone as exactly one token is proved beforehand by running the
model on every one of them; a pre-token in that proven set counts as one token
with no merging. Only the rest is merged, once per distinct pre-token and cache.

Splitting into pre-tokens is done on arrays of code points: the class of each
code point (letter, number, white space, other) is asked from the library's own
pre-tokenizer the first time it is met, so both agree on every Unicode version.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable
from .hashing import mix, prefix_sums

CHUNK_CHARS = 1 << 19
CACHE_SPANS, CACHE_CHARS = 400_000, 16 << 20
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


def span_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A value of each span of code points that spans of equal content share; others may, so it only proposes equal ones."""
    place = np.arange(len(points), dtype=np.uint64)
    sums = prefix_sums(mix(points.astype(np.uint64)) * (np.uint64(2) * place + np.uint64(1)))
    plain = prefix_sums(mix(points.astype(np.uint64)))
    moved = (sums[ends] - sums[starts]) - (plain[ends] - plain[starts]) * (np.uint64(2) * starts.astype(np.uint64))
    return mix(moved ^ ((ends - starts).astype(np.uint64) << np.uint64(44)))


def cut_chars(text: str, most: int) -> Iterator[str]:
    """The text in pieces of about `most` characters, cut only between a visible character and a space, where no pre-token or segment crosses."""
    at = 0
    while len(text) - at > most:
        to = text.find(" ", at + most)
        while to > 0 and (text[to - 1].isspace() or text[to - 1] == "▁"):
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


class SpanTable:
    """Encodings of distinct spans by their text, kept in flat arrays; refilled from `encode` when a span is new.

    `fixed` spans stay; the others are held up to bounds of number and characters, then they are dropped and met anew.
    """

    def __init__(self, most: int = CACHE_SPANS, chars: int = CACHE_CHARS):
        self.most, self.chars = most, chars
        self.known: dict[str, int] = {}
        self.new: dict[str, int] = {}
        self.held = 0
        self.begins = array("q", [0])
        self.ids = array("I")
        self.fixed = self.fixed_ids = 0

    def fix(self, spans: list[str], ids: list[list[int]]) -> None:
        for span, own in zip(spans, ids, strict=True):
            self.known[span] = self._append(own)
        self.fixed, self.fixed_ids = len(self.begins) - 1, len(self.ids)

    def _append(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.begins.append(len(self.ids))
        return len(self.begins) - 2

    def row(self, span: str, encode) -> int:
        out = self.known.get(span)
        if out is None and (out := self.new.get(span)) is None:
            out = self.new[span] = self._append(encode(span))
            self.held += len(span)
        return out

    def look_up(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """The row and the number of ids of each span; the spans follow each other without gaps.

        Spans of equal key are compared character by character with the first
        of them; those that differ are looked up by themselves.
        """
        if len(self.new) > self.most or self.held > self.chars:
            self.new, self.held = {}, 0
            del self.begins[self.fixed + 1 :], self.ids[self.fixed_ids :]
        _, first, inverse = np.unique(span_keys(points, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        other = size != size[first][inverse]
        shift = np.where(other, 0, starts[first][inverse] - starts)
        place = np.arange(starts[0], ends[-1]) + np.repeat(shift, size)
        other |= np.logical_or.reduceat(points[place] != points[starts[0] : ends[-1]], starts - starts[0])
        rows = np.array([self.row(text[a:b], encode) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)[inverse]
        for i in np.flatnonzero(other).tolist():
            rows[i] = self.row(text[starts[i] : ends[i]], encode)
        begins = np.frombuffer(self.begins, np.int64)
        return rows, begins[rows + 1] - begins[rows]

    def flat(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after the other."""
        shift = np.frombuffer(self.begins, np.int64)[rows] - (np.cumsum(sizes) - sizes)
        return np.frombuffer(self.ids, np.uint32)[np.arange(sizes.sum()) + np.repeat(shift, sizes)]


class ByteBpe:
    """Exact ids and counts of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, proven: np.ndarray | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.letters = dict(enumerate(self.alphabet))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.table = SpanTable()
        strings = self.text_strings()
        self.proven = self.prove(strings) if proven is None else proven
        self.table.fix([strings[i] for i in self.proven.tolist()], [[i] for i in self.proven.tolist()])

    def text_strings(self) -> dict[int, str]:
        """The vocabulary strings that are text by themselves, by id."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        out = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                out[i] = bytes(back[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
        return out

    def prove(self, strings: dict[int, str]) -> np.ndarray:
        """The ids of those strings that the merges alone turn into their own one token."""
        return np.array([i for i, s in strings.items() if self.merge(s) == [i]], np.int32)

    def merge(self, pretoken: str) -> list[int]:
        """The ids of one pre-token by the model's merges."""
        return [t.id for t in self.model.tokenize(pretoken.encode("utf-8").decode("latin-1").translate(self.letters))]

    def class_of(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == UNKNOWN).any():
            for p in np.unique(points[out == UNKNOWN]).tolist():
                c = chr(p)
                joins = lambda head: len(self.split(head + c)) == 1  # noqa: E731, B023
                self.classes[p] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins("!") else SPACE
            out = self.classes[points]
        return out

    def starts(self, points: np.ndarray, sections: np.ndarray) -> np.ndarray:
        """True where a pre-token starts; `sections` are the places where a text (or a piece of one) starts."""
        n = len(points)
        kind = self.class_of(points)
        fresh = np.zeros(n + 1, bool)
        fresh[sections] = True
        fresh[n] = True
        start = fresh[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # White space before something visible leaves its last character: a blank joins what follows, any other stands alone.
        after = np.flatnonzero(start[1:] & ~fresh[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 0x20]] = False
        quote = np.flatnonzero(start & (points == 0x27))
        for tail in CONTRACTIONS:
            at = quote[quote + len(tail) < n]
            for k, c in enumerate(tail, 1):
                at = at[(points[at + k] == ord(c)) & ~fresh[at + k]]
            start[at + 1] = False
            if len(tail) == 2:
                start[at + 2] = False
            to = at + len(tail) + 1
            start[to[to < n]] = True
        return start

    def encode(self, texts: list[str], with_ids: bool = False) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(text number, tokens, ids) of consecutive pieces of the texts, as the library encodes them without added tokens."""
        pieces: list[str] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for section in self.sections(text):
                if section in self.special:
                    if pieces:
                        yield from self._chunk(pieces, owners, with_ids)
                    pieces, owners, held = [], [], 0
                    yield i, 1, np.array([self.special[section]], np.uint32) if with_ids else None
                    continue
                for piece in cut_chars(section, CHUNK_CHARS):
                    pieces.append(piece)
                    owners.append(i)
                    held += len(piece)
                    if held >= CHUNK_CHARS:
                        yield from self._chunk(pieces, owners, with_ids)
                        pieces, owners, held = [], [], 0
        if pieces:
            yield from self._chunk(pieces, owners, with_ids)

    def sections(self, text: str) -> Iterator[str]:
        """The text split at the strings of special tokens, which the library takes as such tokens inside texts."""
        marks = [s for s in self.special if s in text]
        if not marks:
            yield text
            return
        at = 0
        while True:
            found = min(((p, -len(s), s) for s in marks if (p := text.find(s, at)) >= 0), default=None)
            if found is None:
                break
            if found[0] > at:
                yield text[at : found[0]]
            yield found[2]
            at = found[0] + len(found[2])
        if at < len(text):
            yield text[at:]

    def _chunk(self, pieces: list[str], owners: list[int], with_ids: bool) -> Iterator[tuple[int, int, np.ndarray | None]]:
        text = "".join(pieces)
        if not text:
            return
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, pieces)])
        begins = np.flatnonzero(self.starts(points, bounds[:-1][bounds[:-1] < len(points)]))
        rows, sizes = self.table.look_up(text, points, begins, np.append(begins[1:], len(points)), self.merge)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, bounds)]
        ids = self.table.flat(rows, sizes) if with_ids else None
        for owner, a, b in zip(owners, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            yield owner, b - a, ids[a:b] if with_ids else None

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, n, _ in self.encode(texts):
            out[i] += n
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, _, ids in self.encode(texts, with_ids=True):
            out[i].append(ids)
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str, proven: np.ndarray | None = None) -> ByteBpe:
    """The tokenizer of this process; what another one has proven of the same file is not proved again."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path, proven)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """The frame with the number of tokens of each whole text in `column`.

    path: a byte-level BPE .json of the tokenizers library, the same path on all
    machines. The driver proves the whole tokens once; tasks get the proven ids.
    Null and empty texts count 0; repeated rows and ids are counted row by row. A
    text of any length is read in pieces cut at blanks, one without blanks as
    one pre-token. A column of the frame that is named like `column` is replaced;
    all others stay. An empty table gives an empty one. One narrow stage, no
    shuffle: each task holds one Arrow batch and a bounded cache.
    """
    proven = loaded(path).proven
    fields = [f for f in docs.schema.fields if f.name not in (text, column)]
    keep = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(column, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, proven)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bpe.counts(texts))], names=[*keep, column])

    return importable(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(count, schema)
