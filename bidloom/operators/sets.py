"""Pairs of sets that share enough: by their rarest items, or in blocks where these leave nearly all pairs.

Sets are rows (by, side, id, name, items). Items are numbered, the rarest first (ties by the item). With the Jaccard index s that a pair must
reach, both sets hold one of the first n - ceil(s n) + 1 items of the other. In a group where few pairs meet so, sets are joined by equality of
these items, each pair at the first that both have. In a group where many do (names of few words, whose items are all frequent), the join would
make each pair several times over; there blocks of `SIZE` sets meet, each pair of blocks once, by products of matrices. Both ways are exact. Pairs
still grow with the square of a dense group; memory doesn't, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.operators import scan
from bidloom.session import bounded, ship
from bidloom.stages import keep

SIZE = 2048
#: A group is dense if joining by rare items makes so many pairs, and more than one in so many of all.
MANY, ONE_IN = 20_000, 64
#: Columns of a matrix, and rows of a batch of results.
WIDTH, ROWS = 2048, 200_000


def numbered(sets: DataFrame) -> DataFrame:
    """sets (id, items, ...) with the items' numbers, ascending, as `codes`."""
    each = sets.select("id", F.explode("items").alias("item"))
    counts = keep(each.groupBy("item").agg(F.count("*").alias("n")), "frequencies")
    codes = keep(scan.number(counts, [], ["n", "item"], name="code").select("item", F.col("code").cast("int").alias("code")), "codes")
    order = each.join(bounded(codes, 200_000), "item").groupBy("id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return sets.drop("items").join(order, "id")


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, items that both have) of the pairs that come near a Jaccard index. a, b: sizes of sets, and their codes in a row."""
    rows = [np.repeat(np.arange(len(x[0])), x[0]) for x in (a, b)]
    common = np.intersect1d(a[1], b[1])
    least = [(share / (1 + share) * x[0]).astype(np.float32) for x in (a, b)]
    product = -(least[0][:, None] + least[1][None, :])
    for k in range(0, len(common), WIDTH):
        part = common[k : k + WIDTH]
        both = []
        for (size, codes), row in zip((a, b), rows, strict=True):
            at = np.minimum(np.searchsorted(part, codes), len(part) - 1)
            held = part[at] == codes
            m = np.zeros((len(size), len(part)), np.float32)
            m[row[held], at[held]] = 1
            both.append(m)
        product += both[0] @ both[1].T
    for k in range(0, len(a[0]), 256):
        i, j = np.nonzero(product[k : k + 256] > -0.05)  # rounding is far below that; the caller compares exactly
        i += k
        yield i, j, np.rint(product[i, j] + least[0][i] + least[1][j]).astype(np.int64)


class _Forest:
    """Components of the nodes of two blocks, each with its weakest link."""

    def __init__(self, n: int):
        self.root, self.weak = np.arange(n), np.full(n, np.inf)

    def add(self, i: np.ndarray, j: np.ndarray, similarity: np.ndarray) -> None:
        np.minimum.at(self.weak, i, similarity)
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A link of each node to its component's first, with the component's weakest similarity."""
        weak = np.full(len(self.root), np.inf)
        np.minimum.at(weak, self.root, self.weak)
        nodes = np.flatnonzero(self.root != np.arange(len(self.root)))
        return nodes, self.root[nodes], weak[self.root[nodes]]


def _blocks_meet(batches: Iterator[pa.RecordBatch], keys: list[str], share: float, least: float, measure: Callable, two: bool, forest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1)

            def values(name: str, one: pa.RecordBatch = one) -> pa.Array:
                return one.column(name).flatten()

            a, b = ((np.asarray(values(f"{s}_sizes")), np.asarray(values(f"{s}_flat"))) for s in "ab")
            ids = np.concatenate([np.asarray(values("a_ids")), np.asarray(values("b_ids"))])
            texts = pa.concat_arrays([values("a_names"), values("b_names")])
            same = not two and one.column("i")[0].as_py() == one.column("j")[0].as_py()
            n = len(a[0])
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=texts.to_pylist().__getitem__)] = np.arange(len(ids))
            tree = _Forest(len(ids))

            def out(x: np.ndarray, y: np.ndarray, similarity: np.ndarray, one: pa.RecordBatch = one, ids: np.ndarray = ids, texts: pa.Array = texts) -> Iterator[pa.RecordBatch]:
                for k in range(0, len(x), ROWS):
                    u, v = x[k : k + ROWS], y[k : k + ROWS]
                    ends = [pa.array(ids[u]), pa.array(ids[v])] if forest else [texts.take(pa.array(u)), texts.take(pa.array(v))]
                    group = pa.array(np.zeros(len(u), np.int64))
                    yield pa.RecordBatch.from_arrays([*(one.column(c).take(group) for c in keys), *ends, pa.array(similarity[k : k + ROWS])], names=[*keys, "a", "b", "similarity"])

            for i, j, shared in _near(a, b, share):
                similarity = measure(shared, a[0][i].astype(np.int64), b[0][j].astype(np.int64))
                good = similarity >= least - 1e-9
                if same:
                    good &= i < j
                i, j, similarity = i[good], j[good] + (0 if same else n), similarity[good]
                if forest:
                    tree.add(i, j, similarity)
                    continue
                if not two:
                    turned = order[i] > order[j]
                    i, j = np.where(turned, j, i), np.where(turned, i, j)
                yield from out(i, j, similarity)
            if forest:
                yield from out(*tree.links())


def meet(sets: DataFrame, by: list[str], share: float, measure: Callable, least: float, two: bool, forest: bool = False) -> DataFrame:
    """Pairs (by, a, b, similarity) within a group whose measure reaches `least`: a set of side 0 and one of side 1, or, unless two, of side 0 both, each pair once.

    sets: by, side, id (long, unique), name (unique in group and side), items (not empty). share: the Jaccard index that such pairs reach.
    measure(items of both, items of a, items of b): for columns and for arrays. a, b: names, a < b unless two. With forest: ids, and links that
    join the same sets into components as all pairs would, the least similarity of a component's links being that of its pairs.
    """
    spark = sets.sparkSession
    ship(spark)
    keys = by or ["_all"]
    sets = keep(numbered(keep(sets if by else sets.withColumn("_all", F.lit(0)), "sets")), "numbered-sets")
    n = F.size("codes")
    ready = sets.withColumn("prefix", F.slice("codes", F.lit(1), n - F.ceil(F.lit(share) * n - 1e-9).cast("int") + 1))
    left, right = F.count_if(F.col("side") == 0), F.count_if(F.col("side") == int(two))
    met = ready.select(*keys, "side", F.explode("prefix").alias("code")).groupBy(*keys, "code").agg((left * right).alias("m")).groupBy(*keys).agg(F.sum("m").alias("m"))
    sizes = sets.groupBy(*keys).agg(left.alias("nl"), right.alias("nr"))
    dense = keep(sizes.join(met, keys).where((F.col("m") >= MANY) & (F.col("m") * ONE_IN >= F.col("nl") * F.col("nr"))).select(*keys, "nl", "nr"), "dense")
    none = dense.isEmpty()
    rare = ready if none else ready.join(bounded(dense.select(*keys)), keys, "left_anti")
    end = "id" if forest else "name"
    rare = rare.withColumn("code", F.explode("prefix"))
    x = rare.where("side = 0").select(*keys, "code", F.col(end).alias("a"), F.col("name").alias("na"), F.col("codes").alias("ca"), F.col("prefix").alias("pa"))
    y = rare.where(F.col("side") == int(two)).select(*keys, "code", F.col(end).alias("b"), F.col("name").alias("nb"), F.col("codes").alias("cb"), F.col("prefix").alias("pb"))
    pairs = x.join(y, [*keys, "code"]).where(F.size("ca") >= F.lit(share) * F.size("cb") - 1e-9).where(F.size("cb") >= F.lit(share) * F.size("ca") - 1e-9)
    pairs = pairs.where(F.get(F.array_intersect("pa", "pb"), 0) == F.col("code"))
    if not two:
        pairs = pairs.where("na < nb")
    similarity = measure(F.size(F.array_intersect("ca", "cb")), F.size("ca"), F.size("cb"))
    pairs = pairs.select(*by, "a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    if none:
        return pairs
    count = {s: F.ceil(F.col(c) / SIZE) for s, c in ((0, "nl"), (1, "nr"))}
    member = sets.join(bounded(dense), keys).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, count[0]).otherwise(count[1])))
    lists = member.groupBy(*keys, "side", "nl", "nr", "block").agg(F.collect_list(F.struct("id", "name", "codes")).alias("r"))
    blocks = keep(lists.select(*keys, "side", "nl", "nr", "block", F.col("r")["id"].alias("ids"), F.col("r")["name"].alias("names"), F.transform(F.col("r")["codes"], F.size).alias("sizes"), F.flatten(F.col("r")["codes"]).alias("flat")), "blocks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def side(of: str, own: str, other: str, which: int, first, last) -> DataFrame:
        named = [F.col(c).alias(f"{of}_{c}") for c in ("ids", "names", "sizes", "flat")]
        return blocks.where(F.col("side") == which).select(*keys, F.col("block").alias(own), F.explode(F.sequence(first, last)).alias(other), *named).repartition(parts, *keys, "i", "j")

    zero = F.lit(0).cast("long")
    a = side("a", "i", "j", 0, zero if two else F.col("block"), (count[1] if two else count[0]) - 1)
    b = side("b", "j", "i", int(two), zero, count[0] - 1 if two else F.col("block"))
    kind = T.LongType() if forest else T.StringType()
    schema = T.StructType([*(sets.schema[c] for c in keys), T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])
    close = a.join(b, [*keys, "i", "j"]).mapInArrow(lambda batches: _blocks_meet(batches, keys, share, least, measure, two, forest), schema)
    return pairs.unionByName(close.select(*by, "a", "b", "similarity"))
