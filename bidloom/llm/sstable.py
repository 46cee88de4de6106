"""Token ids of documents in sorted-string-table shards.

A shard holds a range of keys in ascending order: data blocks, a Bloom filter, a sparse index and a footer.

- A data block is a Zstandard frame. Inside, each entry is three varints (bytes shared with the key before, bytes of key that follow,
  bytes of value), the key's rest and the value; every 16th entry shares nothing and is a restart. The restarts' offsets and their
  number end the block. The frame is followed by its crc32.
- A value is the document's ids, 2 bytes each if the vocabulary allows, else 4, little-endian.
- The index has for each block its last key, place, size, entries, and the ids of the shard before it.
- The footer has places and sizes of filter and index, entries, ids, bytes an id, and a magic number.

A look-up prunes shards by the manifest's key ranges, asks the Bloom filter, bisects the index, and bisects the block's restarts.
Files are written under another name and then moved, so a task that is repeated replaces its shard by an equal one.

Keys are integers or strings: null comes first, then integers by value or strings by bytes; equal keys (ties, repeated rows) stand
together and a look-up returns them all. A null text is empty; a very long one is one entry of a block of its own size. The shards are cut
by key and, within equal keys, by text and row, so repeated keys never have to share a shard; they hold about `SHARD_BYTES` of text, or less
where that leaves fewer shards than shuffle partitions. An empty table makes no shard. Only key and text are read, so the names of extra
columns cannot clash.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.common import keep
from bidloom.llm.tokens import encoder
from bidloom.session import ship

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQB7x8s")
SHARD_BYTES = 256 << 20
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 16, 10, 7
MANIFEST = "shard int, path string, first binary, last binary, entries long, ids long"


def key_bytes(key: int | str | None) -> bytes:
    """Bytes that sort as keys do."""
    if key is None:
        return b""
    if isinstance(key, str):
        return b"\x02" + key.encode()
    return b"\x01" + struct.pack(">Q", key + (1 << 63))


def key_value(raw: bytes) -> int | str | None:
    if not raw:
        return None
    return raw[1:].decode() if raw[0] == 2 else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path in it. file: and plain paths are folders that all machines mount."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 33 | h << 31) & 0xFFFFFFFFFFFFFFFF | 1
    return [(h + k * step) % (1 << 64) % bits for k in range(BLOOM_HASHES)]


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index, self.keys = [], []
        self.entries = self.ids = 0
        self.first: bytes | None = None
        self.last = b""
        self.press = zstandard.ZstdCompressor(level=1)
        self._begin()
        self._put(MAGIC)

    def _begin(self) -> None:
        self.block, self.restarts, self.count, self.ids_before = bytearray(), [], 0, self.ids

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit. Keys ascend."""
        shared = 0
        if self.count % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        value = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if self.first is None:
            self.first = key
        if not self.keys or key != self.last:
            self.keys.append(xxhash.xxh64_intdigest(key))
        self.last = key
        self.count += 1
        self.entries += 1
        self.ids += len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            frame = self.press.compress(raw)
            self.index.append((self.last, self.at, len(frame), self.count, self.ids_before))
            self._put(frame)
            self._put(struct.pack("<I", zlib.crc32(frame)))
            self._begin()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        h = np.array(self.keys, np.uint64)
        step = (h >> np.uint64(33)) | (h << np.uint64(31)) | np.uint64(1)
        bloom = np.zeros(bits, bool)
        for k in range(BLOOM_HASHES):
            bloom[(h + np.uint64(k) * step) % np.uint64(bits)] = True
        bloom_at, packed = self.at, np.packbits(bloom, bitorder="little").tobytes()
        self._put(struct.pack("<Q", bits) + packed)
        index_at = self.at
        for key, at, size, count, before in self.index:
            self._put(b"".join([_varint(len(key)), key, *(_varint(x) for x in (at, size, count, before))]))
        self._put(FOOTER.pack(bloom_at, index_at - bloom_at, index_at, self.at - index_at, self.entries, self.ids, self.width, MAGIC))


class Reader:
    """A shard opened for look-ups and scans; blocks are read when needed."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        bloom_at, bloom_size, index_at, index_size, self.entries, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self._bloom = (bloom_at, bloom_size)
        raw, k = self._read(index_at, index_size), 0
        self.blocks = []
        while k < len(raw):
            n, k = _read_varint(raw, k)
            key, k = raw[k : k + n], k + n
            row = [key]
            for _ in range(4):
                n, k = _read_varint(raw, k)
                row.append(n)
            self.blocks.append(tuple(row))
        self.last_keys = [b[0] for b in self.blocks]
        self.bloom: bytes | None = None
        self.open = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...]]:
        _, at, size, _, _ = self.blocks[k]
        frame = self._read(at, size + 4)
        if zlib.crc32(frame[:size]) != struct.unpack("<I", frame[size:])[0]:
            raise ValueError("a block's checksum differs")
        raw = self.open.decompress(frame[:size])
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 * n - 4], struct.unpack(f"<{n}I", raw[-4 * n - 4 : -4])

    def _entries(self, raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            value = raw[at + rest : at + rest + size]
            at += rest + size
            yield key, np.frombuffer(value, "<u2").astype("<u4").tobytes() if self.width == 2 else value

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it in the shard, ids) in ascending order, one block in memory at a time."""
        for k, block in enumerate(self.blocks):
            before = block[4]
            for key, ids in self._entries(self._block(k)[0], 0):
                yield key, before, ids
                before += len(ids) // 4

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self._read(*self._bloom)
        bits = struct.unpack("<Q", self.bloom[:8])[0]
        return all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _places(key, bits))

    def get(self, key: bytes) -> list[bytes]:
        """The ids of all entries of a key."""
        out: list[bytes] = []
        if not self.may_hold(key):
            return out
        k = bisect.bisect_left(self.last_keys, key)
        while k < len(self.blocks):
            raw, restarts = self._block(k)
            r = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at))[0])
            past = False
            for own, ids in self._entries(raw, restarts[max(0, r - 1)]):
                if own == key:
                    out.append(ids)
                elif own > key:
                    past = True
                    break
            if past:
                break
            k += 1
        return out


def write(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 2, shards: int | None = None) -> DataFrame:
    """Write docs' ids to shards below path. Returns the manifest: shard, path, first and last key, entries, ids."""
    spark = docs.sparkSession
    ship(spark)
    if shards is None:
        size = docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)
    order = [F.col("k").asc_nulls_first(), F.col("h"), F.col("row")]
    rows = docs.select(F.col(id).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out = None, None
        encode, stop = encoder(tokenizer), np.array([end], "<u4").tobytes()
        fs, folder = file_system(path)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"shard-{shard:06d}.sst"
        for batch in batches:
            for k, ids in zip(batch.column("k").to_pylist(), encode.encode_all(batch.column("t").fill_null("").to_pylist()), strict=True):
                if writer is None:
                    out = fs.open_output_stream(f"{folder}/.{name}.{attempt}")
                    writer = Writer(out, 2 if max(encode.size, end + 1) <= 1 << 16 else 4)
                writer.add(key_bytes(k), ids + stop)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            row = [[shard], [f"{path}/{name}"], [writer.first], [writer.last], [writer.entries], [writer.ids]]
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "path", "first", "last", "entries", "ids"])

    return keep(dealt.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, id: str = "doc_id", kind: T.DataType | None = None, ids: bool = True) -> DataFrame:
    """All entries in the shards: id, start (ids of all entries before it), n_tokens, ids_crc32 and, if asked for, ids."""
    spark = manifest.sparkSession
    based = manifest.select("shard", "path", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    fields = [T.StructField(id, kind or T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    shards = max(1, manifest.count())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:4])]
        if ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cols[4]], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for path, base in zip(given.column("path").to_pylist(), given.column("base").to_pylist(), strict=True):
                rows, size = [], 0
                for key, before, raw in Reader(path).scan():
                    rows.append((key_value(key), base + before, len(raw) // 4, zlib.crc32(raw), raw if ids else None))
                    size += len(raw) if ids else 64
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return based.repartition(shards, "shard").mapInArrow(run, T.StructType(fields))


def lookup(manifest: DataFrame, keys: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, ids) of the entries of each given key, one row for each entry. Keys go to the shards whose range holds them; the manifest, one row a shard, is sent to the tasks."""
    spark = keys.sparkSession
    ship(spark)
    rows = manifest.orderBy("shard").collect()
    sent = spark.sparkContext.broadcast([(r["path"], bytes(r["first"]), bytes(r["last"])) for r in rows])
    schema = T.StructType([keys.schema[id], T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, readers = sent.value, {}
        lasts = [s[2] for s in shards]
        for given in batches:
            found: tuple[list, list] = ([], [])
            for k in sorted(given.column(0).to_pylist(), key=key_bytes):
                raw = key_bytes(k)
                s = bisect.bisect_left(lasts, raw)
                while s < len(shards) and shards[s][1] <= raw:
                    if s not in readers:
                        readers = {s: Reader(shards[s][0])}  # keys of a batch ascend, so one open shard is enough
                    for x in readers[s].get(raw):
                        found[0].append(k)
                        found[1].append(np.frombuffer(x, "<u4").astype(np.int64))
                    s += 1
            yield pa.RecordBatch.from_arrays([pa.array(found[0], given.schema.field(0).type), pa.array(found[1], pa.list_(pa.int64()))], names=[id, "ids"])

    return keys.select(id).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), id).mapInArrow(run, schema)


def roundtrip(docs: DataFrame, tokenizer: str, spark: SparkSession, path: str, id: str = "doc_id", text: str = "text", end: int = 2) -> DataFrame:
    """Write the shards and read them back."""
    return read(write(docs, path, tokenizer, id, text, end), id, docs.schema[id].dataType, ids=False)
