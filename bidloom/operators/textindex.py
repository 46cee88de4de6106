"""Substring search by an index of three-character runs, kept as tables.

Each different text is a row of `texts`; `postings` holds the runs of its folded form with its hash, `frequencies` how many texts have a run.
All three are cut into buckets, which a search reads only as far as it needs: those of the pattern's rarest runs, then those of the texts that
have them all. What is found so is compared with the pattern itself, so hashes and folding only narrow the search. Wildcards of the pattern
cut it into literal parts; where none of them has three characters, all texts are compared.

Null texts are not indexed and not found. The empty pattern finds every other text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators.listing import contains
from bidloom.session import bounded

BUCKETS = 64
RAREST = 4  # runs of a pattern whose postings are met


def _runs(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class TextIndex:
    """An index below a folder that driver and executors share."""

    def __init__(self, folder: str, buckets: int = BUCKETS):
        self.folder, self.buckets = folder, buckets

    def _bucket(self, c: Column) -> Column:
        return F.pmod(c, F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str, order: list[str]) -> None:
        """Cut by range, so that a run that most texts have is written by many tasks."""
        rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def build(self, rows: DataFrame, column: str) -> TextIndex:
        texts = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct().withColumn("key", F.xxhash64("text"))
        self._write(texts.withColumn("bucket", self._bucket(F.col("key"))), "texts", ["key"])
        stored = self._read(rows.sparkSession, "texts").select("key", F.explode(_runs(F.col("text"))).alias("run"))
        self._write(stored.distinct().withColumn("bucket", self._bucket(F.xxhash64("run"))), "postings", ["run", "key"])
        counts = self._read(rows.sparkSession, "postings").groupBy("run").agg(F.count("*").alias("n"))
        self._write(counts.withColumn("bucket", self._bucket(F.xxhash64("run"))), "frequencies", ["run"])
        return self

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        kinds = {"texts": "text string, key long, bucket int", "postings": "key long, run string, bucket int", "frequencies": "run string, n long, bucket int"}
        return spark.read.schema(kinds[name]).parquet(f"{self.folder}/{name}")

    def rarest(self, spark: SparkSession, pattern: str) -> list[tuple[str, int]] | None:
        """The pattern's rarest runs with their buckets; none if it has no runs, null if no text has all of them."""
        low = spark.sql("SELECT lower(?)", args=[pattern]).first()[0]
        runs = sorted({part[i : i + 3] for part in re.split("[%_]", low) for i in range(len(part) - 2)})
        if not runs:
            return []
        placed = spark.createDataFrame([(r,) for r in runs], "run string").select("run", self._bucket(F.xxhash64("run")).alias("bucket")).collect()
        where = F.col("bucket").isin([r.bucket for r in placed]) & F.col("run").isin(runs)
        found = sorted((r.n, r.run, r.bucket) for r in self._read(spark, "frequencies").where(where).collect())  # at most the pattern's runs
        return [(run, bucket) for _, run, bucket in found[:RAREST]] if len(found) == len(runs) else None

    def candidates(self, spark: SparkSession, pattern: str) -> DataFrame:
        """Texts that may hold the pattern."""
        texts = self._read(spark, "texts")
        runs = self.rarest(spark, pattern)
        if runs is None:
            return texts.limit(0)
        if not runs:
            return texts
        met = self._read(spark, "postings").where(F.col("bucket").isin([b for _, b in runs]) & F.col("run").isin([r for r, _ in runs]))
        keys = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(runs)).select("key", self._bucket(F.col("key")).alias("bucket"))
        return texts.join(bounded(keys), ["bucket", "key"], "left_semi")

    def search(self, spark: SparkSession, pattern: str) -> DataFrame:
        """The texts that hold the pattern, regardless of case; % and _ in it are wildcards."""
        return self.candidates(spark, pattern).where(contains("text", pattern)).select("text")


def search(rows: DataFrame, patterns: dict[str, tuple[TextIndex, str]]) -> DataFrame:
    """rows of which one of the columns holds the pattern that is given for it. A column's index has at least the column's texts."""
    hit = F.lit(False)
    for i, (column, (index, pattern)) in enumerate(patterns.items()):
        found = bounded(index.search(rows.sparkSession, pattern).select(F.col("text").alias(f"~text{i}")))
        rows = rows.join(found, F.col(column) == F.col(f"~text{i}"), "left")
        hit = hit | F.col(f"~text{i}").isNotNull()
    return rows.where(hit).drop(*[f"~text{i}" for i in range(len(patterns))])
