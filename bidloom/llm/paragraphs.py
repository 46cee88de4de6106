"""Substring dedup: near-equal paragraphs found by MinHash banding.

Paragraphs. A line is a paragraph; consecutive lines of fewer than `MIN_WORDS` words are one together. A paragraph of more than
`MAX_WORDS` words is cut where its content says: before each word whose bigram hash is the smallest among `RADIUS` words to either side
within it, so a passage is cut alike wherever it stands, also in the middle of a line. A piece of fewer than `MIN_WORDS` words is joined
to the piece before it (the first one to the piece after it), so none is lost. Words are runs of other characters than space and 0x09
to 0x0D, A-Z lower-cased. Only texts and lines between longer ones that have fewer than `MIN_WORDS` words in all are left alone.

Search. Equal paragraphs become one row. Of each, the minima of hashed 5-word shingles fall into bands; rows and bands are tuned so
that a pair of the threshold's Jaccard similarity collides with at least the wanted recall. Paragraphs that collide are compared by
exact Jaccard similarity of their shingle sets. A bucket, with its paragraphs' shingles, is solved as a spanning forest: a paragraph that
has been reached is not compared again, and others are only compared if they share one of the shingles, rarest first, of which similar
sets must share one. Buckets with equal members are solved once; a bucket of more than `BUCKET` paragraphs is dealt out in blocks, each
pair of which is solved by itself, so no task holds more than two. Components of the links are classes; the earliest occurrence of a
class (by document id, then place) stays.

Result. Found paragraphs that touch are one passage; passages of fewer than `PASSAGE` words, which are phrases rather than copies, are
left alone.

Null and empty texts have no paragraphs. Very long texts are cut as any other. Repeated rows are occurrences of their own; of those with
equal id and place either counts as the earliest. Occurrences with null ids come first. An empty table gives an empty one. The result has
columns of its own, so names of extra columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import scan
from bidloom.llm.common import components, join_skewed, keep, new_path, remove
from bidloom.session import ship

SHINGLE, MIN_WORDS, MAX_WORDS, RADIUS, PASSAGE = 5, 6, 48, 5, 16
BLOCK = 1 << 20
BUCKET = 50_000


def tune_bands(threshold: float = 0.8, recall: float = 0.98, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows with which a pair at the threshold collides with the wanted recall."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


class Paragraphs:
    """Paragraphs of a block of texts: first and last word (exclusive), document, and the hashes of words and shingles."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        w = scan.find_words(raw, offsets, scan.SPACED)
        self.words = w
        n = len(w.start)
        self.hash = scan.hash_spans(w.data, w.start, w.end)
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        line = breaks[w.start] + w.doc  # numbers that differ between lines and between texts, and ascend
        new = np.ones(n, bool)
        new[1:] = np.diff(line) > 0
        first = np.flatnonzero(new)
        short = np.diff(np.concatenate([first, [n]])) < MIN_WORDS
        if len(first) > 1:  # a short line after a short line of the same text goes on with it
            new[first[1:][short[1:] & short[:-1] & (w.doc[first[1:]] == w.doc[first[:-1]])]] = False
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [n]]))
        long = np.flatnonzero(size > MAX_WORDS)
        if len(long):
            new[self._joined(first[long], size[long], self._cuts(first[long], size[long]))] = True
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [n]]) if n else first
        wide = last - first >= MIN_WORDS
        self.first, self.last = first[wide], last[wide]
        self.doc = w.doc[self.first]
        shingle = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            shingle = scan.mix(shingle + self.hash[k : k + len(shingle)])
        self.shingle = shingle

    def _cuts(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Content-defined cuts in lines, each padded on both sides so that no window leaves its line."""
        top = np.iinfo(np.uint64).max
        pad = RADIUS + 1
        begin = np.cumsum(size + 2 * pad) - size - pad
        total = int(begin[-1] + size[-1] + pad) + 2 * RADIUS
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(first, size) + inner
        place = np.repeat(begin, size) + inner
        pair = scan.mix(self.hash + np.uint64(3) * np.concatenate([self.hash[1:], [np.uint64(0)]]))
        pair[first + size - 1] = top  # a bigram never leaves its line
        x = np.full(total, top, np.uint64)
        x[place] = pair[word]
        window = _least(x, RADIUS)
        left, right = window[place - RADIUS], window[place + 1]
        return word[(x[place] < left) & (x[place] <= right) & (inner > 0)]

    def _joined(self, first: np.ndarray, size: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The cuts but for those around pieces that are too short. Cuts lie more than RADIUS words apart, so such pieces are rare inside."""
        part = np.searchsorted(first, cuts, "right") - 1
        end = first[part] + size[part]
        after = np.append(cuts[1:], 0)
        after = np.where((after > cuts) & (after < end), after, end)
        return cuts[(cuts - first[part] >= MIN_WORDS) & (after - cuts >= MIN_WORDS)]

    def keys(self) -> list[bytes]:
        """128-bit hashes of the paragraphs' words."""
        out = []
        for salt in (0x51ED270B, 0xC2B2AE35):
            g = scan.mix(self.hash + np.uint64(salt))
            up, down = scan._powers(len(g) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * up[: len(g)], dtype=np.uint64)])
            h = (sums[self.last] - sums[self.first]) * down[self.first]
            out.append(scan.mix(h + (self.last - self.first).astype(np.uint64)))
        both = np.stack(out, axis=1).astype(">u8").tobytes()
        return [both[k : k + 16] for k in range(0, len(both), 16)]

    def minima(self, count: int) -> np.ndarray:
        """For each paragraph and hash function the least hashed shingle."""
        size = self.last - self.first - SHINGLE + 1
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first, size)
        s, edge = self.shingle[at], np.cumsum(size) - size
        out = np.empty((len(size), count), np.uint64)
        for k in range(count):
            seed = scan.mix(np.array([k + 1], np.uint64))[0]
            out[:, k] = np.minimum.reduceat(scan.mix(s ^ seed), edge)
        return out


def _blocks(batch: pa.RecordBatch, text: str):
    raw, offsets = scan.strings(batch.column(text))
    for a, b in scan.blocks(offsets, BLOCK):
        p = Paragraphs(raw, offsets[a : b + 1])
        if len(p.first):
            yield a, p


def _banded(batches: Iterator[pa.RecordBatch], text: str, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, p in _blocks(batch, text):
            low = p.minima(bands * rows)
            key = np.empty((len(p.first), bands), np.uint64)
            for b in range(bands):
                h = np.full(len(p.first), np.uint64(b + 1))
                for r in range(rows):
                    h = scan.mix(h + low[:, b * rows + r])
                key[:, b] = h
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + p.doc)), pa.array(p.first - _document_start(p)), pa.array(p.keys(), pa.binary()), lists], names=["id", "place", "key", "bands"])


def _document_start(p: Paragraphs) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(p.words.counts())])[p.doc]


def _places(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, p in _blocks(batch, text):
            w = p.words
            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte of the block
            begin = chars[w.bounds[p.doc]]
            start, end = chars[w.start[p.first]] - begin, chars[w.end[p.last - 1]] - begin
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(a + p.doc)), pa.array(p.first - _document_start(p)), pa.array(p.keys(), pa.binary()), pa.array(p.last - p.first), pa.array(start), pa.array(end)],
                names=["id", "place", "key", "n_words", "start", "end"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the wanted paragraphs of each text."""
    for batch in batches:
        wanted = batch.column("wanted")
        for a, p in _blocks(batch, "t"):
            sets: tuple[list, list] = ([], [])
            mine, doc = set(), -1
            for key, d, lo, hi in zip(p.keys(), p.doc.tolist(), p.first.tolist(), p.last.tolist(), strict=True):
                if d != doc:
                    mine, doc = set(wanted[a + d].as_py()), d
                if key in mine:
                    mine.remove(key)
                    sets[0].append(key)
                    sets[1].append(np.unique(p.shingle[lo : hi - SHINGLE + 1]).tobytes())
            if sets[0]:
                yield pa.RecordBatch.from_arrays([pa.array(sets[0], pa.binary()), pa.array(sets[1], pa.binary())], names=["key", "shingles"])


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by column, cut so that each holds whole groups."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held.column(column)
        last = keys[-1]
        if keys[0] == last:
            continue
        k = keys.combine_chunks().to_numpy(zero_copy_only=False)
        tail = int(np.flatnonzero(k != k[-1])[-1]) + 1
        yield held.slice(0, tail).combine_chunks().to_batches()[0]
        held = held.slice(tail)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n, k) of bands that n different paragraphs share. A bucket is named by the hash of its members, so equal buckets have one name."""
    for batch in _groups(batches, "band"):
        band = np.asarray(batch.column("band"))
        cut = np.flatnonzero(np.diff(band)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(band)]])
        size = last - first
        name = scan.mix(np.add.reduceat(scan.mix(np.asarray(batch.column("k")).view(np.uint64)), first) + size.astype(np.uint64))
        many = np.flatnonzero(np.repeat(size > 1, size))
        if len(many):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[many].view(np.int64)), pa.array(np.repeat(size, size)[many]), batch.column("k").take(pa.array(many))], names=["bucket", "n", "k"])


def _similar(a: frozenset, b: frozenset, threshold: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < threshold * large:
        return False
    both = len(a & b)
    return both >= threshold * (small + large - both)


def forest(sets: list[frozenset], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets."""
    if len(sets) == 2:
        return [(0, 1)] if _similar(*sets, threshold) else []
    count = Counter(x for s in sets for x in s)
    heads, holders = [], defaultdict(list)
    for k, s in enumerate(sets):
        # Similar sets share one of so many elements in any order that both follow; the rarest first leave the fewest to compare.
        head = heapq.nsmallest(len(s) - math.ceil(threshold * len(s)) + 1, s, key=lambda x: (count[x], x))
        heads.append(head)
        for x in head:
            holders[x].append(k)
    reached = [False] * len(sets)
    edges = []
    for root in range(len(sets)):
        if reached[root]:
            continue
        reached[root] = True
        queue = [root]
        while queue:
            k = queue.pop()
            seen = set()
            for x in heads[k]:
                holders[x] = left = [j for j in holders[x] if not reached[j]]
                for j in left:
                    if j not in seen and not reached[j]:
                        seen.add(j)
                        if _similar(sets[k], sets[j], threshold):
                            reached[j] = True
                            edges.append((k, j))
                            queue.append(j)
    return edges


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in _groups(batches, "part"):
        part = np.asarray(batch.column("part"))
        keys, sets = batch.column("key").to_pylist(), batch.column("shingles").to_pylist()
        cut = np.flatnonzero(np.diff(part)) + 1
        a_, b_ = [], []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
            for a, b in forest([frozenset(np.frombuffer(x, np.uint64).tolist()) for x in sets[lo:hi]], threshold):
                a_.append(keys[lo + a])
                b_.append(keys[lo + b])
        if a_:
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], names=["a", "b"])


def _write(df: DataFrame, path: str) -> None:
    """Write df. What its shuffles left on disk goes once the driver's JVM has collected their handles, which is done here."""
    df.write.parquet(path)
    spark = df.sparkSession
    del df
    spark.sparkContext._jvm.System.gc()


def _last(df: DataFrame, name: str) -> DataFrame:
    """df as a kept table, less what its shuffles left on disk."""
    df = keep(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _blocks_of(buckets: DataFrame, most: int) -> DataFrame:
    """(part, k): each bucket of at most `most` paragraphs is a part; of a larger one each pair of its blocks is."""
    blocks = F.ceil(F.col("n") / most)
    mine = F.pmod(F.xxhash64("k"), blocks)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64("bucket", F.least(mine, j), F.greatest(mine, j)))
    return buckets.select(F.explode(F.when(F.col("n") > most, parts).otherwise(F.array(F.col("bucket")))).alias("part"), "k")


def repeated_paragraphs(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.98) -> DataFrame:
    """One row for each paragraph that has an equal or near-equal one elsewhere: id, place (its first word), n_words, start, end (code
    points), class_id and class_place (the earliest occurrence of its class), n_occurrences, and removed (all but the earliest)."""
    ship(docs.sparkSession)
    bands, rows = tune_bands(threshold, recall)
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    kind = base.schema["id"].dataType

    def schema(*more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("id", kind), T.StructField("place", T.LongType()), T.StructField("key", T.BinaryType()), *(T.StructField(n, t) for n, t in more)])

    units = base.mapInArrow(lambda b: _banded(b, "t", bands, rows), schema(("bands", T.ArrayType(T.LongType()))))
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "banded")
    _write(units.groupBy("key").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), path)
    banded = spark.read.parquet(path)
    short = F.xxhash64("key").alias("k")  # what moves in place of a key where a coincidence only means one comparison more
    collided = banded.select(short, F.explode("bands").alias("band")).repartition("band").sortWithinPartitions("band")
    buckets = _last(collided.mapInArrow(_buckets, "bucket long, n long, k long").distinct(), "buckets")
    distinct = keep(banded.select("key", "first", "n"), "paragraphs")  # the bands have served
    remove(spark, path)
    # Each paragraph's shingles come from the document of its first occurrence, so only texts move, whatever the number of paragraphs.
    wanted = distinct.select("key", "first.id", short).join(buckets.select("k").distinct(), "k", "left_semi").groupBy("id").agg(F.collect_list("key").alias("wanted"))
    texts = base.join(wanted, base["id"].eqNullSafe(wanted["id"])).select("t", "wanted")
    sets = texts.mapInArrow(_sets, "key binary, shingles binary").groupBy("key").agg(F.any_value("shingles").alias("shingles"))
    filled = _blocks_of(buckets, BUCKET).join(sets.select("*", short), "k").drop("k").repartition("part").sortWithinPartitions("part")
    edges = _last(filled.mapInArrow(lambda b: _links(b, threshold), "a binary, b binary"), "links")
    roots = keep(components(edges), "roots")
    classes = _classes(distinct, roots)
    where = base.mapInArrow(lambda b: _places(b, "t"), schema(("n_words", T.LongType()), ("start", T.LongType()), ("end", T.LongType())))
    found = join_skewed(_last(where.join(classes.select("key"), "key", "left_semi"), "found"), classes, ["key"], "copies").select(
        "id", "place", "n_words", "start", "end",
        F.col("least.id").alias("class_id"), F.col("least.place").alias("class_place"), "n_occurrences",
        (~(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("place") == F.col("least.place")))).alias("removed"),
    )
    return _passages(found).withColumnRenamed("id", id)


def _passages(found: DataFrame) -> DataFrame:
    """Rows of found whose paragraphs, with those that touch them, have PASSAGE words or more. Windows hold the rows of one document."""
    inside = Window.partitionBy("id").orderBy("place", "n_words")
    new = F.coalesce((F.col("place") > F.max(F.col("place") + F.col("n_words")).over(inside.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    numbered = found.withColumn("new", new).withColumn("passage", F.sum("new").over(inside))
    whole = Window.partitionBy("id", "passage")
    length = F.max(F.col("place") + F.col("n_words")).over(whole) - F.min("place").over(whole)
    return numbered.withColumn("length", length).where(F.col("length") >= PASSAGE).drop("new", "passage", "length")


def _classes(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, least, n_occurrences of the class, copies of the paragraph) of the paragraphs in classes with two occurrences or more."""
    linked = keep(distinct.select("key", "first", F.col("n").alias("copies")).join(roots.withColumnRenamed("node", "key"), "key"), "linked")
    total = keep(linked.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("n_occurrences"), F.count("*").alias("members")), "totals")
    near = join_skewed(linked.select("key", "root", "copies"), total, ["root"], "members").select("key", "least", "n_occurrences", "copies")
    alone = distinct.where("n > 1").join(roots.select(F.col("node").alias("key")), "key", "left_anti").select("key", F.col("first").alias("least"), F.col("n").alias("n_occurrences"), F.col("n").alias("copies"))
    return keep(near.unionByName(alone), "classes")


def cut_paragraphs(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, whose ids are unique, with the removed paragraphs cut out of the text."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    merged = F.aggregate(  # spans that overlap become one
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    gone = found.where("removed").groupBy(id).agg(merged.alias("~gone"))
    joined = docs.join(gone, id, "left")
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("`~gone`.end"))
    end = F.concat(F.col("`~gone`.start"), F.array(F.length(text).cast("long")))
    kept = F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda x: F.substring(F.col(text), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    return joined.withColumn(text, F.when(F.col("`~gone`").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).drop("~gone")
