"""Components of a graph, and joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.stages import keep


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df, a kept table, has so few rows that it may be broadcast. At most rows + 1 of them are counted."""
    return df.limit(rows + 1).count() <= rows


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int | None = None) -> DataFrame:
    """left joined to right, a kept table with one row for each key and in `count` the number of rows that left has of it. left is read
    twice, and once more to count its rows if they are not given.

    Keys with more than a 100,000th of left's rows (100 at least), of which there are 100,000 at most, are broadcast; the others, none of
    which fills a task, are shuffled. Left's rows with other keys are dropped.
    """
    most = max(100, (left.count() if rows is None else rows) // 100_000)
    hot = F.broadcast(right.where(F.col(count) > most))
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(right.where(F.col(count) <= most), on))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an undirected graph, root being the smallest node that can be reached.

    Alternates large-star and small-star steps, which halve distances without ever gathering a node's whole neighbourhood: each is
    one aggregate of minima and one join, in which the centres of large stars are broadcast. Every step is kept in the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = keep(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
        large = join_skewed(both.where("v > u"), low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "large-star")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_skewed(large, low, ["u"], "n").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = keep(small, "small-star")
        same = small.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        before = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        now = small
        if same == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
