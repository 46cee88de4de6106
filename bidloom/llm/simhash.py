"""SimHash near-duplicates through segment popcounts.

Texts are lower-cased (A-Z), words are runs of other characters than space and 0x09 to 0x0D, shingles are `width` consecutive words,
repeats included, joined by spaces (fewer words: the whole sequence). A fingerprint bit is 1 if it is set in over half of the XXH64
(seed 42) of the shingles. Two fingerprints link at `most` differing bits or fewer.

Search. A fingerprint is embedded as the bit counts of `segments` equal segments. Each differing bit moves one count by one at most, so
the Manhattan distance of two embeddings is a lower bound of the fingerprints' distance. The embedding is cut in halves; one half of a
linked pair has a Manhattan distance of most // 2 at most. So each half is a grid with unit cells, and a range join meets all pairs
whose cells lie in that range: every fingerprint stands in its own cell and, for a range of 1, in the cells one step up. In each cell
the bound over the whole embedding and then the exact distance decide; a dense cell is first parted by equal blocks of bits. Equal
fingerprints are one node, so a group of copies of any size is one row here. A cell returns a spanning forest of its links, not all of
them, which keeps what is connected connected.

Null or empty texts have fingerprint zero and link like any other. Very long texts are hashed whole, their shingles one at a time.
Repeated rows and ties share a fingerprint. Null ids are never the smallest of a component unless all its ids are null. An empty table
gives an empty one. Of extra columns those in `carry` are returned; those that have the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import scan
from bidloom.llm.common import components, giving_back, join_skewed, keep, map_documents, without
from bidloom.session import ship

SEED = 42
DENSE = 2_000
RESULTS = ("fingerprint", "component_id", "n_copies", "class_fingerprint")
FINGERPRINT = T.StructType([T.StructField("fingerprint", T.LongType())])


def fingerprint(data: bytes, width: int = 3) -> int:
    """The fingerprint of lower-cased UTF-8."""
    words = data.split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, carry: list[str] | None = None) -> DataFrame:
    """docs with `fingerprint`, the 64 bits as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            raw, offsets = scan.strings(batch.column(text))
            low = scan.LOWER
            out = [fingerprint(low[raw[a:b]].tobytes(), width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return {"fingerprint": pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())}

        return work

    return map_documents(docs, make, FINGERPRINT, carry)


def _cell_rows(batches: Iterator[pa.RecordBatch], segments: int, reach: int) -> Iterator[pa.RecordBatch]:
    """(cell, node) rows: each fingerprint in its own cell of either half and in those that lie up to `reach` steps up."""
    bits = 64 // segments
    half = segments // 2
    place = np.uint64(bits + 1)
    for batch in batches:
        f = np.asarray(batch.column(0)).view(np.uint64)
        parts = np.stack([np.bitwise_count((f >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)) for k in range(segments)]).astype(np.uint64)
        cells, nodes = [], []
        for h in (0, 1):
            mine = parts[h * half : (h + 1) * half]
            weight = place ** np.arange(half, dtype=np.uint64)
            own = (mine * weight[:, None]).sum(axis=0, dtype=np.uint64)
            ring = [(own, f, mine, 0)]
            for step in range(reach + 1):
                nxt = []
                for cell, node, at, low in ring:
                    cells.append(cell * np.uint64(2) + np.uint64(h))
                    nodes.append(node)
                    if step < reach:
                        for k in range(low, half):  # steps in ascending places, so each cell comes once
                            up = at[k] < bits
                            if up.any():
                                moved = at[:, up].copy()
                                moved[k] += np.uint64(1)
                                nxt.append((cell[up] + weight[k], node[up], moved, k))
                ring = nxt
        cell, node = np.concatenate(cells), np.concatenate(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(scan.mix(cell).view(np.int64)), pa.array(node.view(np.int64))], names=["cell", "node"])


def embedding(f: np.ndarray, segments: int) -> np.ndarray:
    bits = 64 // segments
    return np.stack([np.bitwise_count((f >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)) for k in range(segments)], axis=1).astype(np.int8)


def _forest(nodes: np.ndarray, segments: int, most: int, parted: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links among a cell's nodes. A node that has been reached is never compared again, so a cell of near copies costs little more than one comparison a node.

    A cell of many nodes that don't link is parted further: of most + 3 blocks of bits three at least are equal in a linked pair, so
    all choices of three are tried, and only nodes equal in these are compared.
    """
    edges = []
    if len(nodes) == 2:
        return [(int(nodes[0]), int(nodes[1]))] if int(np.bitwise_count(nodes[0] ^ nodes[1])) <= most else []
    if len(nodes) > DENSE and not parted:
        cuts = np.linspace(0, 64, most + 4).astype(int)
        masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for some in combinations(masks, 3):
            key = nodes & np.uint64(sum(some))
            order = np.argsort(key, kind="stable")
            key = key[order]
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                edges += _forest(nodes[order[a:b]], segments, most, True)
        return list(set(edges))
    left, vectors = nodes, embedding(nodes, segments)
    while len(left):
        queue = [(left[0], vectors[0])]
        left, vectors = left[1:], vectors[1:]
        while queue and len(left):
            node, vector = queue.pop()
            near = np.abs(vectors - vector).sum(axis=1, dtype=np.int32) <= most
            near[near] = np.bitwise_count(left[near] ^ node) <= most
            if near.any():
                edges += [(int(node), int(x)) for x in left[near]]
                queue += list(zip(left[near], vectors[near], strict=True))
                left, vectors = left[~near], vectors[~near]
    return edges


def _link_cells(batches: Iterator[pa.RecordBatch], segments: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell. What is kept back between batches is one cell."""

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    def solve(cell: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
        cut = np.flatnonzero(np.diff(cell)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(cell)]])
        edges = []
        for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
            edges += _forest(np.unique(node[a:b]), segments, most)
        return edges

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, node = np.asarray(batch.column("cell")), np.asarray(batch.column("node")).view(np.uint64)
        tail = int(np.searchsorted(cell, cell[-1], "left"))
        if tail == 0 and held and held[-1][0][-1] == cell[0]:
            held.append((cell, node))
            continue
        if tail:
            whole = [np.concatenate(x) for x in zip(*held, (cell[:tail], node[:tail]), strict=True)]
            held = []
            if edges := solve(*whole):
                yield out(edges)
        elif held:
            if edges := solve(*[np.concatenate(x) for x in zip(*held, strict=True)]):
                yield out(edges)
            held = []
        held.append((cell[tail:], node[tail:]))
    if held and (edges := solve(*[np.concatenate(x) for x in zip(*held, strict=True)])):
        yield out(edges)


def link(prints: DataFrame, column: str = "fingerprint", segments: int = 32, most: int = 3) -> DataFrame:
    """(a, b) links among distinct fingerprints that connect what the links of `most` bits connect."""
    ship(prints.sparkSession)
    reach = most // 2
    cells = prints.select(column).distinct().mapInArrow(giving_back(lambda b: _cell_rows(b, segments, reach)), "cell long, node long")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(giving_back(lambda b: _link_cells(b, segments, most)), "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, segments: int = 32, most: int = 3, carry: list[str] | None = None) -> DataFrame:
    """docs (id and the columns in carry) with fingerprint (16 hex digits), component_id (the smallest id that can be reached), n_copies (rows with this fingerprint) and class_fingerprint (the smallest of the component, as a signed long)."""
    named = without(docs, *[c for c in RESULTS if c != id])
    found = keep(fingerprints(named, text, width, list(dict.fromkeys([id, *(carry or [])]))), "fingerprints")
    nodes = found.groupBy("fingerprint").agg(F.min(id).alias("component_id"), F.count("*").alias("n_copies"))
    roots = components(link(found, "fingerprint", segments, most))
    joined = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    joined = keep(joined.withColumn("class_fingerprint", F.coalesce("root", "fingerprint")).drop("root"), "nodes")
    least = keep(joined.groupBy("class_fingerprint").agg(F.min("component_id").alias("component_id"), F.count("*").alias("members")), "classes")
    classes = keep(join_skewed(joined.drop("component_id"), least, ["class_fingerprint"], "members"), "members")
    return join_skewed(found, classes, ["fingerprint"], "n_copies").select(*found.drop("fingerprint").columns, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "n_copies", "class_fingerprint")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs less all but one document of each component: the one with the smallest id; of several rows with that id the one whose columns have the smallest hash."""
    # whole rows are read once more and shuffled once; all that is decided is decided on ids and hashes
    hashed = docs.withColumn("~row", F.xxhash64(*docs.columns))
    found = near_duplicates(hashed, id, text, carry=["~row"], **how)
    first = found.where(F.col(id).eqNullSafe(F.col("component_id"))).select("class_fingerprint", F.col("~row").alias("~first"), F.col(id).alias("~id"))
    least = first.groupBy("class_fingerprint").agg(F.min(F.struct("~first", "~id")).alias("x")).select("x.*")
    same = (F.col("~row") == F.col("~first")) & ((F.col(id) == F.col("~id")) | (F.col(id).isNull() & F.col("~id").isNull()))
    return hashed.join(least, same, "left_semi").dropDuplicates(["~row", id]).select(*docs.columns)
