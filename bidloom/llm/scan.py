"""Words of Arrow text columns as NumPy arrays: where each starts and ends, whose it is, and a 64-bit hash of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Longer spans are hashed by XXH64: sums of powers repeat for certain long words.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C55)
_POWERS: dict[str, np.ndarray] = {}

#: Bytes of words: digits, letters and all of UTF-8 beyond ASCII.
WORDS = np.zeros(256, bool)
WORDS[0x30:0x3A] = WORDS[0x41:0x5B] = WORDS[0x61:0x7B] = WORDS[0x80:] = True
#: Bytes of words that white space parts: all but space and 0x09 to 0x0D.
SPACED = np.ones(256, bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


@dataclass
class Words:
    """Byte offsets are those in data; doc numbers the texts of the block from 0; bounds are the texts' byte offsets."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.bounds) - 1)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def char(self, doc: int, byte: np.ndarray) -> np.ndarray:
        """Code points of the text before each byte offset."""
        lo, hi = int(self.bounds[doc]), int(self.bounds[doc + 1])
        lead = np.cumsum((self.data[lo:hi] & 0xC0) != 0x80)
        return np.concatenate([[0], lead])[np.asarray(byte) - lo]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes; a longer text is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def find_words(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, bounds = raw[lo:hi], offsets - lo
    word = letters[data]
    n = len(data)
    first, last = word.copy(), word.copy()
    if n:
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, bounds, start, end, np.searchsorted(bounds, start, "right") - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, by in (("up", _BASE), ("down", inverse)):
            x = np.full(size, by, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans ascend. Works on pieces of about `step` bytes, so memory is bounded by that and the longest span."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        base = int(start[a])
        b = max(a + 1, int(np.searchsorted(start, base + step, "left")))
        top = int(end[a:b].max())
        up, down = _powers(top - base + 1)
        part = fold[data[base:top]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = start[a:b] - base, end[a:b] - base
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    for k in np.flatnonzero(end - start > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(fold[data[start[k] : end[k]]].tobytes())
    return mix(out)


def equal_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at : at + size] and b[bt : bt + size] hold the same bytes, eight at a time."""

    def eights(x: np.ndarray) -> np.ndarray:
        padded = np.concatenate([x, np.zeros(8, np.uint8)])
        return np.ndarray((len(x) + 1,), "<u8", padded, strides=(1,))

    x, y = eights(a), eights(b)
    same = np.ones(len(at), bool)
    left = np.flatnonzero(size > 0)
    step = 0
    while len(left):
        rest = size[left] - step
        differ = x[at[left] + step] ^ y[bt[left] + step]
        short = rest < 8
        differ[short] &= (np.uint64(1) << (np.uint64(8) * rest[short].astype(np.uint64))) - np.uint64(1)
        same[left[differ != 0]] = False
        left = left[(differ == 0) & (rest > 8)]
        step += 8
    return same


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of spans of data (case already folded), equal for equal bytes only, and the place of one span of each number."""
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    other = first[code]
    same = size == size[other]
    at = np.flatnonzero(same)
    same[at] = equal_spans(data, start[at], data, start[other[at]], size[at])
    more: dict[bytes, int] = {}
    extra = []
    for k in np.flatnonzero(~same).tolist():  # spans that share a hash with other bytes
        word = data[start[k] : end[k]].tobytes()
        if word not in more:
            more[word] = len(first) + len(extra)
            extra.append(k)
        code[k] = more[word]
    return code, np.concatenate([first, np.array(extra, np.int64)])
