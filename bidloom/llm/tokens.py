"""Token ids of whole texts by a tokenizer file, with what repeats encoded once.

A tokenizer file first splits a text by a rule, then encodes each unit by itself. Texts of Latin-1 characters are taken together, up to
`BLOCK` bytes at a time: their units are cut here by the file's own rule, in array operations over the classes of characters; equal
units become one by a dictionary encoding, which compares bytes; each different unit goes to the library's own model unless a cache of
bounded size holds it (two generations, of which the older is dropped when the younger is full, so that frequent units stay); and the
ids are laid out again in the order of the texts. In texts with other characters, only pieces between cuts at a space between visible
characters, where no rule joins anything, are handled so; a piece with other characters, or with what might be a special token, goes
through the whole tokenizer. The ids equal those of the whole text; tests compare them.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLOCK = 1 << 20

# The classes of Latin-1 characters in the splitting rules of the two tokenizer files (letter, digit, white space, other),
# and what follows an apostrophe in the units that begin with one.
_LETTER, _DIGIT, _WHITE, _OTHER = range(4)
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(256):
        c = chr(b)
        if c.isalpha():
            out[b] = _LETTER
        elif c.isnumeric():
            out[b] = _DIGIT
        elif c.isspace() and b not in range(0x1C, 0x20):
            out[b] = _WHITE
    return out


_CLASS = _classes()
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    spare = iter(range(256, 512))
    return {b: b if b in _PLAIN else next(spare) for b in range(256)}


_LETTERS = _byte_letters()


def _lettered(text: str) -> str:
    """Each byte of a text as its letter."""
    return text.encode().decode("latin-1").translate(_LETTERS)


def _is_plain(text: str) -> bool:
    """Latin-1 characters only, and nothing that might be a special token."""
    return _is_latin(text) and "<|" not in text


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Cache:
    """At most 2 * most entries; those looked up since the last turn survive it."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key: bytes, value: bytes) -> None:
        if len(key) <= 64:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        self.units = Cache(most)
        self.size = self.tokenizer.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, units: list[bytes]) -> list[bytes]:
        """The ids of each of some different units, given in Latin-1."""
        out = list(map(self.units.young.get, units))
        tokenize, old, put = self.model.tokenize, self.units.old.get, self.units.put
        for k, ids in enumerate(out):
            if ids is None:
                unit = units[k]
                ids = old(unit)
                if ids is None:
                    bare = unit.lstrip(b" ") if self.words else unit
                    text = bare.decode("latin-1")
                    ids = array("I", [t.id for t in tokenize(text if bare.isalnum() else _lettered(text))]).tobytes() if text else b""
                put(unit, ids)
                old = self.units.old.get
                out[k] = ids
        return out

    def _starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where units start. first: which bytes begin a text. Where white space is dropped, it leads the unit after it."""
        kind = _CLASS[data]
        n = len(data)
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        if self.words:
            new |= kind == _DIGIT
        # An apostrophe alone takes certain letters after it.
        at = np.flatnonzero((data[:-1] == 39) & new[:-1] & (kind[1:] == _LETTER) & ~first[1:])
        if not self.words:
            at = at[first[at] | (data[at - 1] != 32)]
        if len(at):
            a, b = data[at + 1], np.where(at + 2 < n, data[np.minimum(at + 2, n - 1)], 0)
            inside = (at + 2 < n) & ~first[np.minimum(at + 2, n - 1)]
            size = np.isin(a, np.frombuffer(_ONE, np.uint8)).astype(np.int64)
            for x, y in _TWO:
                size[(a == x) & (b == y) & inside] = 2
            at, size = at[size > 0], size[size > 0]
            new[at + 1] = False
            after = at + 1 + size
            new[after[after < n]] = True
        white = kind == _WHITE
        follows = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:]) + 1  # what comes after white space in its text
        if self.words:
            new[follows] = False
        else:
            new[follows - 1] = True
            new[follows[data[follows - 1] == 32]] = False
        return np.flatnonzero(new)

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of Latin-1 characters (lower case, if the file asks for that) without special tokens."""
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not bounds[-1]:
            return [b""] * len(texts)
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        if self.words:
            data = np.where(_CLASS[data] == _WHITE, np.uint8(32), data)
        first = np.zeros(len(data), bool)
        first[bounds[:-1][bounds[:-1] < len(data)]] = True
        start = self._starts(data, first)
        offsets = np.append(start, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._units(units.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        which = np.asarray(units.indices)
        many = size[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat((begin[which] - ends[:-1]).astype(np.int32), many)
        at += np.arange(len(at), dtype=np.int32)
        out = flat[at].tobytes()
        cuts = (4 * ends[np.searchsorted(start, bounds)]).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        mixed: dict[int, list[bytes]] = {}
        held: list[bytes] = []
        places: list[tuple[int, int]] = []  # text, and its part if the text is mixed
        size = 0

        def flush() -> None:
            nonlocal size
            for (k, part), ids in zip(places, self._block(held), strict=True):
                if k in mixed:
                    mixed[k][part] = ids
                else:
                    out[k] = ids
            held.clear()
            places.clear()
            size = 0

        for k, text in enumerate(texts):
            parts = [text] if _is_plain(text) else _parts(text)
            if len(parts) > 1 or not _is_plain(parts[0]):
                mixed[k] = [b""] * len(parts)
            for i, part in enumerate(parts):
                if k in mixed and not _is_plain(part):
                    mixed[k][i] = self._whole(part)
                    continue
                held.append((part.lower() if self.words else part).encode("latin-1"))
                places.append((k, i))
                size += len(part)
            if size >= BLOCK:
                flush()
        flush()
        for k, ids in mixed.items():
            out[k] = b"".join(ids)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _parts(text: str) -> list[str]:
    cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = 150_000) -> Encoder:
    """One encoder for each file and process, so that tasks share its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    return _ENCODERS[path]
