"""Hashes of words and word windows over raw UTF-8, without a Python object per word.

A word is read in lanes of eight bytes, each mixed into the hash of those before
it, so words of up to eight bytes never collide and longer ones have no structure
that would make them (a polynomial modulo a power of two has: it is blind to some
pairs of texts of two letters). A window is Rabin's and Karp's polynomial over
its words' hashes modulo the prime 2**61 - 1: two different windows agree for
at most `width` of all 2**61 bases. Its value comes from two prefix sums and one
power, whatever the width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

PRIME = (1 << 61) - 1
WINDOW_BASE = 0x16E8FEB86659FD93
SPACES = bytes([0x20, *range(0x09, 0x0E)])  # [\x20\x09-\x0D]
CHUNK_BYTES = 1 << 20
LANES = 64  # longer words are rare and hashed one by one
_P, _M30, _M31, _M32 = (np.uint64(x) for x in (PRIME, (1 << 30) - 1, (1 << 31) - 1, (1 << 32) - 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit values in which every input bit moves every output bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo 2**61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it, in halves of 31 bits."""
    a1, a0 = a >> np.uint64(31), a & _M31
    b1, b0 = b >> np.uint64(31), b & _M31
    middle = a1 * b0 + a0 * b1
    return folded(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & _M30) << np.uint64(31)) + a0 * b0)


class Powers:
    """Powers of a base and of its inverse modulo 2**61 - 1, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, times(self.up, np.uint64(pow(self.base, m, PRIME)))])
            self.down = np.concatenate([self.down, times(self.down, np.uint64(pow(self.inverse, m, PRIME)))])
        return self.up[:n], self.down[:n]


WORD_POWERS = Powers(WINDOW_BASE)
SECOND_POWERS = Powers(0x0B4E0EF37BC32127)
SECOND_SEED = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def prefix_sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of about `most` bytes, cut before a white-space byte only."""
    at = 0
    while len(text) - at > most:
        to = at + most
        while to < len(text) and text[to] not in SPACES:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _chunk_words(parts: list[bytes], lower: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *parts, b" " * 8]), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    lanes = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    hashes = mix(mix(size.astype(np.uint64) ^ np.uint64(seed)) ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    left = np.flatnonzero(size > 8)
    for at in range(8, 8 * LANES, 8):
        if len(left) == 0:
            break
        hashes[left] = mix(hashes[left] ^ (lanes[starts[left] + at] & _MASK[np.minimum(size[left] - at, 8)]))
        left = left[size[left] > at + 8]
    for i in left.tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    bounds = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def word_hashes(texts: list[bytes], lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, one after the other, and the words of each text.

    Words are runs of bytes outside [\\x20\\x09-\\x0D]; with `lower`, A-Z count as a-z.
    Hashes of different seeds are independent of each other.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            h, c = _chunk_words(parts, lower, seed)
            hashes.append(h)
            np.add.at(counts, owners, c)
            parts.clear()
            owners.clear()
            held = 0

    for i, text in enumerate(texts):
        for piece in cut(text, CHUNK_BYTES):
            parts.append(piece)
            owners.append(i)
            held += len(piece) + 1
            if held >= CHUNK_BYTES:
                flush()
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def windows(hashes: np.ndarray, counts: np.ndarray, width: int, short: bool = False, powers: Powers = WORD_POWERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start word of each window of `width` words inside one text.

    With `short`, a text of 1 to width-1 words has its whole sequence as its one window.
    """
    n = len(hashes)
    up, down = powers.to(max(n, width + 1))
    terms = times(folded(hashes), up[:n])
    low, high = prefix_sums(terms & _M32), prefix_sums(terms >> np.uint64(32))
    ends = np.cumsum(counts)
    begins = ends - counts
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n)
    whole = at + width <= np.repeat(ends, counts)
    length = np.full(n, width)
    if short:
        few = begins[(counts > 0) & (counts < width)]
        whole[few] = True
        length[few] = counts[(counts > 0) & (counts < width)]
    at, text, length = at[whole], text[whole], length[whole]
    high = high[at + length] - high[at]
    total = folded((low[at + length] - low[at]) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    # One more term of 1 in front tells sequences of different lengths apart.
    value = mix(folded(times(total, down[at]) + up[length]))
    return value, text, at - begins[text]


def text_windows(texts: list[bytes], width: int, lower: bool = False, short: bool = False, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`windows` of whole texts, hashed about 1 MB of text at a time, so the working arrays do not grow with the block of texts.

    With `second`, hashes of words and windows are others, independent of the first.
    """
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= CHUNK_BYTES:
            held += len(texts[to])
            to += 1
        value, text, place = windows(*word_hashes(texts[at:to], lower, SECOND_SEED if second else 0), width, short, SECOND_POWERS if second else WORD_POWERS)
        out.append((value, (text + at).astype(np.int32), place.astype(np.int32)))
        at = to
    value, text, place = (np.concatenate(x) for x in zip(*out, strict=True))
    return value, text, place
