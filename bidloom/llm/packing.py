"""Best-fit packing of token sequences, hierarchically.

Each partition packs its own pieces by best fit, longest first. Bins that are nearly full are final; an underfull bin goes on as one
item of the size of its content, so from then on a piece moves only with its bin. Rounds deal the underfull bins to tasks, each round
to a `fan_in`-th of the tasks of the one before, and pack them by best fit again, until one task has packed them all. A task never holds more than `task_items` items: where
more bins stay underfull (all pieces just over half the capacity, say), rounds go on only while they save bins. Every round is kept in
the shared folder.

A piece that fills a sequence by itself is final at once. Pieces of size 0 take no room and are packed like others. Repeated rows are
packed each for itself. An empty table gives no sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.common import give_back, giving_back, keep
from bidloom.llm.tokens import Encoder
from bidloom.session import ship

CAPACITY = 4096


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Items in the order of their bins, and the number of items of each bin. Longest first, each into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    room: dict[int, list[int]] = {}
    open_, bins = 0, []  # bit r of open_: a bin with r tokens of room
    for k, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
            bins[b].append(k)
        else:
            b, r = len(bins), capacity
            bins.append([k])
        left = r - n
        room.setdefault(left, []).append(b)
        open_ |= 1 << left
    return np.array([k for b in bins for k in b], np.int64), np.array([len(b) for b in bins], np.int64)


def _bins(members: pa.StructArray, offsets: np.ndarray) -> pa.RecordBatch:
    """Bins of members, with each member's place in its bin."""
    size = np.asarray(members.field("length"))
    before = np.concatenate([[0], np.cumsum(size)])
    place = before[:-1] - np.repeat(before[offsets[:-1]], np.diff(offsets))
    names = [f.name for f in members.type]
    fields = [pa.array(place, pa.int64()) if n == "offset" else members.field(n) for n in names]
    full = pa.StructArray.from_arrays(fields, names=names)
    return pa.RecordBatch.from_arrays([pa.array(before[offsets[1:]] - before[offsets[:-1]]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), full)], names=["fill", "members"])


def _pack(parts: list[tuple[np.ndarray, pa.Array]], capacity: int) -> pa.RecordBatch:
    fill = np.concatenate([p[0] for p in parts])
    lists = pa.concat_arrays([p[1] for p in parts])
    order, counts = best_fit(fill, capacity)
    lists = lists.take(pa.array(order))
    inner = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    return _bins(lists.flatten(), inner[np.concatenate([[0], np.cumsum(counts)])])


def _like(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """batch in the types that Spark sends, whose nested fields have names of their own."""
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)


def _round(batches: Iterator[pa.RecordBatch], capacity: int, near: int, task_items: int) -> Iterator[pa.RecordBatch]:
    held, n, schema = [], 0, None
    for batch in batches:
        schema = batch.schema
        fill = np.asarray(batch.column("fill"))
        full = fill >= near
        if full.any():
            yield batch.filter(pa.array(full))
        held.append((fill[~full], batch.column("members").filter(pa.array(~full))))
        n += int((~full).sum())
        if n >= task_items:
            yield _like(_pack(held, capacity), schema)
            held, n = [], 0
    if n:
        yield _like(_pack(held, capacity), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, near: float = 0.97, fan_in: int = 8, task_items: int = 100_000) -> DataFrame:
    """pieces (length: 0 to capacity) with sequence_id and offset."""
    ship(pieces.sparkSession)
    full = math.ceil(near * capacity)
    pieces = pieces.drop("offset", "sequence_id")
    members = T.ArrayType(T.StructType([*pieces.schema.fields, T.StructField("offset", T.LongType())]))
    schema = T.StructType([T.StructField("fill", T.LongType()), T.StructField("members", members)])
    now = pieces.select(F.col("length").cast("long").alias("fill"), F.array(F.struct(*pieces.columns, F.lit(0).cast("long").alias("offset"))).alias("members"))
    done, width, left = [], None, 0
    while True:
        packed = keep(now.mapInArrow(giving_back(lambda b: _round(b, capacity, full, task_items)), schema), "bins")
        under = packed.where(F.col("fill") < full)
        n = under.count()
        least = max(1, math.ceil(n / task_items))
        if n <= 1 or width == 1 or (width is not None and width <= least and n > 0.99 * left):
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= full))
        width, left = max(least, width // fan_in if width else math.ceil(n / 1000)), n
        now = under.repartition(width)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    numbered = out.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id")


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", end: int = 1, capacity: int = CAPACITY, carry: list[str] | None = None) -> DataFrame:
    """The documents' ids (with the end id), cut where they pass the capacity: piece, start, length, ids_crc32. A null text is empty."""
    ship(docs.sparkSession)
    added = ["piece", "start", "length", "ids_crc32"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in added[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One cache for each task, which goes with it: a worker that later stages use keeps no memory of this one.
        encode, stop = Encoder(tokenizer, 100_000).encode_all, np.array([end], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            column = batch.column(text).fill_null("")
            texts = (x for a in range(0, len(column), 500) for x in encode(column.slice(a, 500).to_pylist()))
            for k, found in enumerate(texts):
                ids = memoryview(found + stop)
                for a in range(0, len(ids), 4 * capacity):
                    part = ids[a : a + 4 * capacity]
                    row.append(k)
                    piece.append(a // (4 * capacity))
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in carry), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[*carry, *added])
        del encode
        give_back()

    return docs.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", end: int = 1, capacity: int = CAPACITY, carry: list[str] | None = None) -> DataFrame:
    return pack(pieces(docs, tokenizer, text, end, capacity, carry), capacity)
