"""Vectors of texts, and the nearest of them by an index of cells.

Vectors. Each different text goes to a provider once; its vector is kept in a table by the hash of model and text, so what was asked before
isn't asked again. What a provider fails to answer has no vector and is asked again next time.

Index. Vectors are scaled to length one. A bounded sample of them gives centres (k-means by cosine); every vector lies in the cell of its
nearest centre. A query visits the cells of its nearest centres first. With `exact`, it then visits each other cell that could hold a
better one: by the triangle inequality of angles a cell's vectors are no nearer than the angle to its centre less the widest angle in it.

Null and zero vectors, and those with an infinite or undefined part, are in no cell and like nothing. Vectors have one length. Of
rows with equal ids the greatest vector counts. Equal vectors are one row of the index with their least ids, and are asked for once, so copies
cost no comparisons. Cells of any size are cut into blocks, which the queries visit one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.similarity import dot
from bidloom.session import bounded, ship
from bidloom.stages import keep

CELLS = 4096  # most cells of an index; their centres go to the driver and to every task
BLOCK = 20_000  # vectors of a cell that are compared in one task
STEP = 1024  # vectors that are held against all centres at once


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def embed(rows: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], cache: str, model: str = "default", size: int = 64, retries: int = 2) -> DataFrame:
    """rows with `vector`, the provider's answer to their text, null where there is none. cache: path of the table of vectors, which grows.

    The provider gets up to `size` texts a call, in the tasks; a call that fails, or gives another number of vectors, is repeated.
    """
    spark = rows.sparkSession
    ship(spark)
    key = F.sha2(F.concat(F.lit(model + "\0"), F.col(text)), 256)
    keyed = rows.drop("vector").withColumn("~key", key)
    asked = keyed.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(F.col("~key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    known = spark.read.schema("key string, vector array<double>").parquet(cache) if _exists(spark, cache) else None

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                for _ in range(retries + 1):
                    try:
                        found = [[float(x) for x in v] for v in provider(part["text"].tolist())]
                    except Exception:  # whatever a provider raises means that it has no answer
                        continue
                    if len(found) == len(part):
                        yield pd.DataFrame({"key": part["key"].tolist(), "vector": found})
                        break

    new = asked if known is None else asked.join(known.select("key"), "key", "left_anti")
    new.mapInPandas(answers, "key string, vector array<double>").write.mode("append").parquet(cache)
    stored = spark.read.schema("key string, vector array<double>").parquet(cache).dropDuplicates(["key"])
    return keyed.join(stored.withColumnRenamed("key", "~key"), "~key", "left").drop("~key")


def _unit(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(vector, lambda x: x.cast("double") / norm))


@dataclass
class CellIndex:
    rows: DataFrame  # ids, unit, cell, block: a kept table
    blocks: DataFrame  # cell, n_blocks: CELLS rows at most
    centres: Broadcast  # (centres, widest angle of each cell)
    most: int  # ids that are kept of equal vectors


def _angles(units: pd.Series, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(units), STEP):
        part = slice(at, at + STEP)
        yield part, np.arccos(np.clip(np.stack(units.iloc[part].to_numpy()) @ centres.T, -1, 1))


def cell_index(vectors: DataFrame, id: str, vector: str, cells: int | None = None, fit_rows: int = 100_000, most: int = 16) -> CellIndex:
    """The index of vectors, for up to most - 1 neighbours. cells: the square root of their number by default, CELLS at most. The centres are fitted on about fit_rows vectors."""
    spark = vectors.sparkSession
    one = vectors.select(F.col(id).alias("id"), _unit(F.col(vector)).alias("unit")).where("unit IS NOT NULL").groupBy("id").agg(F.max("unit").alias("unit"))
    least = one.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy("id"))).where(F.col("rank") <= most)
    rows = keep(least.groupBy("unit").agg(F.array_sort(F.collect_list("id")).alias("ids")), "units")
    n = rows.count()
    if n == 0:
        empty = rows.withColumns({"cell": F.lit(0), "block": F.lit(0)})
        return CellIndex(empty, empty.select("cell", F.lit(1).alias("n_blocks")), spark.sparkContext.broadcast((np.zeros((0, 0)), np.zeros(0))), most)
    wanted = min(CELLS, cells or max(2, int(n**0.5)))
    sample = rows.sample(min(1.0, fit_rows / n), seed=7).select(array_to_vector("unit").alias("features"))
    fitted = KMeans(k=max(2, wanted), distanceMeasure="cosine", maxIter=10, seed=7).fit(sample if n > fit_rows else rows.select(array_to_vector("unit").alias("features")))
    centres = np.array([c / (np.linalg.norm(c) or 1.0) for c in fitted.clusterCenters()])
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, angle double")
    def place(units: pd.Series) -> pd.DataFrame:
        best = [(a.argmin(1), a.min(1)) for _, a in _angles(units, sent.value)]
        return pd.DataFrame({"cell": np.concatenate([b for b, _ in best]), "angle": np.concatenate([a for _, a in best])}) if best else pd.DataFrame({"cell": [], "angle": []})

    placed = keep(rows.withColumn("p", place("unit")).select("ids", "unit", "p.cell", "p.angle"), "cells")
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("widest"), F.count("*").alias("n")).collect()  # a row for each cell
    widest = np.full(len(centres), -np.inf)  # no angle is wide enough to reach an empty cell
    for r in sizes:
        widest[r.cell] = r.widest
    blocks = spark.createDataFrame([(r.cell, -(-r.n // BLOCK)) for r in sizes], "cell int, n_blocks int")
    ready = placed.join(F.broadcast(blocks), "cell").select("ids", "unit", "cell", F.pmod(F.xxhash64("unit"), F.col("n_blocks")).cast("int").alias("block"))
    return CellIndex(ready, blocks, spark.sparkContext.broadcast((centres, widest)), most)


def search(index: CellIndex, anchors: DataFrame, id: str, vector: str, k: int = 3, least: float = 0.55, probes: int = 8, exact: bool = True) -> DataFrame:
    """(anchor_id, place, other, similarity): the k vectors of the index most like each anchor's, at or above `least`, ties by the least id.
    Anchors visit the cells of their `probes` nearest centres; with exact also all others that could change the result."""
    if k >= index.most:
        raise ValueError(f"the index is made for {index.most - 1} neighbours at most")
    sent, n = index.centres, k + 1  # one may be the anchor itself
    each = anchors.select(F.col(id).alias("anchor_id"), _unit(F.col(vector)).alias("anchor")).where("anchor IS NOT NULL").groupBy("anchor_id").agg(F.max("anchor").alias("anchor"))
    each = keep(each, "anchors")
    asked = keep(each.groupBy("anchor").agg(F.min("anchor_id").alias("head")), "asked")

    @F.pandas_udf("array<int>")
    def cells(units: pd.Series, floor: pd.Series, later: pd.Series) -> pd.Series:
        centres, widest = sent.value
        out = []
        for part, angle in _angles(units, centres) if len(centres) else ():
            order = np.argsort(angle, axis=1, kind="stable")
            reach = np.cos(np.clip(angle - widest - 1e-9, 0, np.pi))
            for own, near, f, rest in zip(order, reach, floor.iloc[part], later.iloc[part], strict=True):
                out.append([c for c in own[probes:] if near[c] >= f] if rest else list(own[:probes]))
        return pd.Series(out if len(centres) else [[] for _ in units], dtype=object)

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("similarity"), "other"))).where(F.col("place") <= n)

    def visit(rows: DataFrame, floor: Column, later: bool) -> DataFrame:
        visits = rows.select("head", "anchor", F.explode(cells("anchor", floor, F.lit(later))).alias("cell")).join(F.broadcast(index.blocks), "cell")
        visits = keep(visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks"), "visits")
        pairs = index.rows.join(bounded(visits), ["cell", "block"])
        scored = pairs.select("head", "ids", F.round(dot(F.col("anchor"), F.col("unit")), 4).alias("similarity")).where(F.col("similarity") >= least)
        return keep(best(scored.select("head", F.explode(F.slice("ids", 1, n)).alias("other"), "similarity")), "nearest")

    found = visit(asked, F.lit(least), False)
    if exact:
        reached = found.where(F.col("place") == n).select("head", F.col("similarity").alias("kth"))
        floor = F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least)) - 1e-4  # similarities are rounded to four places
        found = best(found.unionByName(visit(asked.join(reached, "head", "left"), floor, True)).drop("place"))
    rows = each.join(asked, "anchor").select("anchor_id", "head").join(found.select("head", "other", "similarity"), "head").where(F.col("other") != F.col("anchor_id"))
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("similarity"), "other"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("anchor_id", "place", "other", "similarity")
