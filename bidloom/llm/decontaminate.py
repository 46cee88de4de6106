"""Benchmark decontamination with an FM-index for each shard of the training texts.

Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. A window is `width` consecutive words of a
benchmark item; an item with fewer words, but at least one, is one window. The alphabet of an index is the words that the windows
hold; any other word, and the end of a document, ends a stretch, and no window reaches across the end of a stretch. Windows are
searched backwards through the ranks of a wavelet matrix, occurrences are located from sampled suffix positions, and overlapping
occurrences merge into removal spans.

A shard is a run of whole documents of about `shard_bytes`; a longer document is a shard of its own. The benchmark goes to the
executors in blocks of at most `block_bytes` of text, so its size doesn't bound the operator: each block is one pass, whose spans merge
with those of the passes before, and whose result is kept in the shared folder before the next block is read and the last one released.
The windows of a block, about 8 times its text, are made in the executors' processes; the driver holds one block of texts.

Words are told apart by their bytes, hashes only find them. Null or empty texts have no words and are not contaminated. Very long texts
are searched whole. Repeated rows are searched each for itself. Items with equal texts all count, in the order of their ids. An empty
table gives an empty one, an empty benchmark contaminates nothing. Null item ids count as the empty string. Extra columns pass, and
those that have the name of a result are replaced.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import scan
from bidloom.llm.common import keep, map_documents

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("word_spans", SPAN), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])


class Windows:
    """The windows of one block of items. Their words are numbered from 1 in the order of the words' hashes; a word is known by its bytes."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        words = scan.find_words(*scan.strings(pa.array([t for _, t in items], pa.large_string())), scan.WORDS)
        hashes = scan.hash_spans(words.data, words.start, words.end)
        data = scan.LOWER[words.data]
        code, place = scan.codes(data, words.start, words.end, hashes)
        order = np.argsort(hashes[place], kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        code, place = number[code], place[order]
        self.alphabet, self.size = hashes[place], words.end[place] - words.start[place]
        spans = [data[a:b] for a, b in zip(words.start[place].tolist(), words.end[place].tolist(), strict=True)]
        self.data = np.concatenate(spans) if spans else np.zeros(0, np.uint8)
        self.start = np.cumsum(self.size) - self.size
        shared = np.concatenate([np.zeros(min(1, len(place)), bool), self.alphabet[1:] == self.alphabet[:-1]])
        clash = np.flatnonzero(np.isin(self.alphabet, self.alphabet[shared]))
        self.clash = {spans[k].tobytes(): k + 1 for k in clash.tolist()}
        self.clashing = self.alphabet[clash]

        self.ids = [i for i, _ in items]
        counts = words.counts()
        first = np.concatenate([[0], np.cumsum(counts)])
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, width + 1):
            own = np.flatnonzero((counts >= n) if n == width else counts == n)
            if not len(own):
                continue
            many = counts[own] - n + 1
            item = np.repeat(own, many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[item]
            windows, which = np.unique(np.lib.stride_tricks.sliding_window_view(code, n)[at], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
            self.by_length.append((windows, np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(windows)))]), pairs[:, 1]))

    def code(self, data: np.ndarray, words: scan.Words) -> np.ndarray:
        """The numbers of a shard's words, 0 for those that no window holds. data: the shard's bytes in lower case."""
        if not len(self.alphabet) or not len(words.start):
            return np.zeros(len(words.start), np.int64)
        hashes = scan.hash_spans(words.data, words.start, words.end)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        maybe = np.flatnonzero((self.alphabet[at] == hashes) & (self.size[at] == words.end - words.start))
        same = scan.equal_spans(data, words.start[maybe], self.data, self.start[at[maybe]], self.size[at[maybe]])
        out = np.zeros(len(hashes), np.int64)
        out[maybe[same]] = at[maybe[same]] + 1
        if self.clash:
            for k in np.flatnonzero(np.isin(hashes, self.clashing)).tolist():
                out[k] = self.clash.get(data[words.start[k] : words.end[k]].tobytes(), 0)
        return out


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of a symbol, highest first, the symbols parted stably by that bit after each."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.shifts = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        now = symbols
        for s in self.shifts:
            bit = (now >> s) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - int(np.count_nonzero(bit)))
            now = np.concatenate([now[~bit], now[bit]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix length i ends up below the last level for each symbol; less its value at 0 it is the symbol's rank."""
        for s, bits, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> s) & 1 == 1, zeros + ones, i - ones)
        return i

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and where they end up."""
        symbol = np.zeros(len(i), np.int64)
        for s, bits, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            bit, ones = bits.get(i), bits.rank(i)
            symbol |= bit.astype(np.int64) << s
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Start positions of the suffixes of text in order, by prefix doubling on what is still tied. Zeros differ from each other: they are smaller the earlier they stand."""
    n = len(text)
    stops = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(stops)
    rank[stops] = np.arange(len(stops))
    bits = int(len(stops) + top + 1).bit_length()
    span = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(span):
        key <<= bits
        key[: max(0, n - j)] |= rank[j:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    at = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        s = order[tied]
        after = np.where(s + span < n, rank[np.minimum(s + span, n - 1)], -1)
        both = rank[s] * (n + 1) + after + 1
        by = np.argsort(both, kind="stable")
        s, both = s[by], both[by]
        order[tied] = s
        new[tied[1:]] = both[1:] != both[:-1]
        rank[s] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        span *= 2


class ShardIndex:
    """An FM-index over stretches of coded words, each ended by a zero."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        order = suffix_order(text, top)
        self.n = len(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), top)
        self.base = self.wavelet.follow(np.arange(top + 1), np.zeros(top + 1, np.int64))
        # the walk back from an occurrence never has to pass the start of its stretch
        chosen = (order % sample == 0) | (text[order - 1] == 0)
        self.sampled, self.positions = Bits(chosen), order[chosen]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix order that start with each pattern (a row of patterns): from lo, before hi."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            lo = self.below[c] + self.wavelet.follow(c, lo) - self.base[c]
            hi = np.maximum(lo, self.below[c] + self.wavelet.follow(c, hi) - self.base[c])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), 0
        left, now = np.arange(len(rows)), rows
        while len(left):
            there = self.sampled.get(now)
            out[left[there]] = self.positions[self.sampled.rank(now[there])] + steps
            left, now = left[~there], now[~there]
            c, i = self.wavelet.read(now)
            now = self.below[c] + i - self.base[c]
            steps += 1
        return out


def _stretches(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of an index, and the word that stands at each place of it (-1 at the zeros)."""
    known = np.flatnonzero(code)
    cut = np.ones(len(known), bool)
    cut[1:] = (np.diff(known) > 1) | (np.diff(doc[known]) > 0)
    at = np.arange(len(known)) + np.cumsum(cut) - 1
    size = len(known) + int(cut.sum())
    text, word = np.zeros(size, np.int32), np.full(size, -1, np.int64)
    text[at], word[at] = code[known], known
    return text, word


def search_shard(words: scan.Words, windows: Windows) -> tuple[np.ndarray, list[set[int]]]:
    """Which words of a shard lie in occurrences, and for each document the numbers of the items that occur."""
    n_docs = len(words.bounds) - 1
    cover, items = np.zeros(len(words.start) + 1, np.int64), [set() for _ in range(n_docs)]
    code = windows.code(scan.LOWER[words.data], words)
    if code.any():
        text, word = _stretches(code, words.doc)
        if len(text):
            index = ShardIndex(text, len(windows.alphabet))
            for patterns, begin, owners in windows.by_length:
                lo, hi = index.search(patterns)
                found = np.flatnonzero(hi > lo)
                many = (hi - lo)[found]
                which = np.repeat(found, many)
                rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
                first = word[index.locate(rows)]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + patterns.shape[1], -1)
                for d, w in np.unique(np.stack([words.doc[first], which], 1), axis=0).tolist():
                    items[d].update(owners[begin[w] : begin[w + 1]].tolist())
    return np.cumsum(cover[:-1]) > 0, items


_BLOCK: tuple[str, Windows | None] = ("", None)


def _windows(name: str, items: list[tuple[str, str]], width: int) -> Windows:
    """The windows of the block that this process works on, made once; those of the block before go."""
    global _BLOCK
    if _BLOCK[0] != name:
        _BLOCK = ("", None)
        _BLOCK = (name, Windows(items, width))
    return _BLOCK[1]


def _work(windows: Windows, text: str, shard_bytes: int, again: bool):
    """again: the batch holds the spans and items of earlier passes, which are merged with those of this one."""

    def shard(raw: np.ndarray, offsets: np.ndarray, past: list[tuple]) -> list[tuple]:
        words = scan.find_words(raw, offsets, scan.WORDS)
        hit, items = search_shard(words, windows)
        counts = words.counts()
        first = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for d in range(len(counts)):
            mine, found = hit[first[d] : first[d + 1]], {windows.ids[k] for k in items[d]}
            if again:
                for s in past[d][0]:
                    mine[s["start"] : s["end"]] = True
                found.update(past[d][1])
            if not mine.any():
                out.append((int(counts[d]), 0, [], [], []))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            a, b = edge[::2], edge[1::2]
            chars = words.char(d, np.stack([words.start[first[d] + a], words.end[first[d] + b - 1]]))
            pairs = [[{"start": x, "end": y} for x, y in zip(p.tolist(), q.tolist(), strict=True)] for p, q in ((a, b), chars)]
            out.append((int(counts[d]), int(mine.sum()), *pairs, sorted(found)))
        return out

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        raw, offsets = scan.strings(batch.column(text))
        past = list(zip(batch.column("word_spans").to_pylist(), batch.column("items").to_pylist(), strict=True)) if again else []
        rows = [r for a, b in scan.blocks(offsets, shard_bytes) for r in shard(raw, offsets[a : b + 1], past[a:b])]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span, span, pa.list_(pa.string()))
        return {f.name: pa.array(x, k) for f, x, k in zip(ADDED, zip(*rows, strict=True), kinds, strict=True)}

    return work


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Lists of (item id, text) of at most block_bytes of text each, or of one item. Items come to the driver one partition at a time."""
    block, size = [], 0
    for i, t in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if block and size + len(t.encode()) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t.encode())
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    carry: list[str] | None = None,
    shard_bytes: int = 2 << 20,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """docs with n_words, n_hit, word_spans (in words), spans (in code points) and items (sorted ids of the items with occurring windows)."""
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED.names]
    out, sent = docs, None
    blocks = _item_blocks(benchmark, item_id, item_text, block_bytes)
    for k, block in enumerate(chain([next(blocks, [])], blocks)):
        if sent is not None:
            out = keep(out, "searched")
            sent.unpersist()
        sent, name = spark.sparkContext.broadcast(block), f"{uuid.uuid4()}"
        out = map_documents(out, lambda sent=sent, name=name, k=k: _work(_windows(name, sent.value, width), text, shard_bytes, k > 0), ADDED, list(dict.fromkeys([*carry, text])))
    return out.select(*carry, *ADDED.names)


def clean(scanned: DataFrame) -> DataFrame:
    """The documents of decontaminate()'s result without any benchmark window, in the columns they came with."""
    return scanned.where("n_hit = 0").drop(*ADDED.names)


def cut_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """decontaminate()'s documents with the removal spans cut out of the text."""
    kept = F.transform(
        F.arrays_zip(
            F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end")).alias("a"),
            F.concat(F.col("spans.start"), F.array(F.length(text).cast("long"))).alias("b"),
        ),
        lambda x: F.substring(F.col(text), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")),
    )
    return scanned.withColumn(text, F.when(F.col("n_hit") > 0, F.array_join(kept, "")).otherwise(F.col(text))).drop(*ADDED.names)
