"""Sums, counts and extremes that are maintained while rows come, change and go.

A change is a row with a sign: +1 for one that came, -1 for one that went; a row that changed went and came. A batch of changes is summed by
its group and written beside the earlier batches, in buckets by the group's first key. A group's totals are the sum over all batches, so a
batch costs what it changes, and reading some groups reads their buckets alone. Sums can't give back an extreme, so lowest and highest prices
come from counts of each price: one whose count is 0 is gone.

A batch is written under its number and replaces what an earlier attempt under this number wrote, so a batch that is repeated counts once.
Null keys are a group. Null values count as 0. Where rows are taken away that never came, counts fall below 0: such groups are kept and shown
by `overdrawn`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def signed(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The changes that lead from the current rows to those after `changes` (one row for each key; is_deleted_row where it is to go), with `sign`."""
    touched = current.join(changes.select(key), key, "left_semi").withColumn("sign", F.lit(-1))
    new = changes.where("NOT coalesce(is_deleted_row, false)").drop("is_deleted_row").withColumn("sign", F.lit(1))
    return touched.unionByName(new)


class Totals:
    """Totals of groups, kept below a folder that driver and executors share."""

    def __init__(self, folder: str, keys: list[str], sums: list[str], buckets: int = BUCKETS):
        self.folder, self.keys, self.sums, self.buckets = folder, keys, sums, buckets

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Record a batch of changes (keys, sums, sign). Usable with foreachBatch."""
        parts = [F.sum(F.col("sign") * F.coalesce(c, F.lit(0))).alias(c) for c in self.sums]
        net = changes.groupBy(*self.keys).agg(*parts, F.sum("sign").cast("long").alias("n"))
        net = net.where(" OR ".join(f"`{c}` <> 0" for c in [*self.sums, "n"])).withColumn("bucket", _bucket(F.col(self.keys[0]), self.buckets))
        net.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch}")

    def _stored(self, spark) -> DataFrame:
        return spark.read.option("basePath", self.folder).parquet(f"{self.folder}/batch=*")

    def read(self, spark, only: DataFrame | None = None) -> DataFrame:
        """Keys, sums and n of the groups that are not empty; with only (the first key), of these. At most as many numbers as there are buckets are collected."""
        rows = self._stored(spark)
        if only is not None:
            asked = only.select(self.keys[0]).distinct()
            found = [r[0] for r in asked.select(_bucket(F.col(self.keys[0]), self.buckets)).distinct().collect()]
            same = rows[self.keys[0]].eqNullSafe(asked[self.keys[0]])
            rows = rows.where(F.col("bucket").isin(found)).join(asked, same, "left_semi")
        return self._summed(rows).where("n <> 0")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in [*self.sums, "n"]])

    def overdrawn(self, spark) -> DataFrame:
        return self._summed(self._stored(spark)).where("n < 0")

    def compact(self, spark, folder: str) -> Totals:
        """The same totals in another folder, as one batch under the number of the last; later batches go there."""
        last = self._stored(spark).agg(F.max("batch")).first()[0]
        new = Totals(folder, self.keys, self.sums, self.buckets)
        net = self._summed(self._stored(spark)).where(" OR ".join(f"`{c}` <> 0" for c in [*self.sums, "n"])).withColumn("bucket", _bucket(F.col(self.keys[0]), self.buckets))
        net.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/batch={last or 0}")
        return new


def subtotals(folder: str) -> Totals:
    """Amounts and numbers of a submission's items: changes have submission_id, amount."""
    return Totals(folder, ["submission_id"], ["amount"])


def prices(folder: str) -> Totals:
    """How often each price was recorded: changes are rows of price history."""
    return Totals(folder, ["catalog_item_id", "project_id", "bid_id", "unit_price"], ["amount"])


def price_sums(counts: DataFrame) -> DataFrame:
    """What benchmarks start from, from counts of prices (catalog_item_id, project_id, bid_id, unit_price, amount, n)."""
    real = counts.where("unit_price > 0 AND n > 0")
    return real.groupBy("catalog_item_id", F.col("project_id").alias("source")).agg(
        F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"), F.sum(F.col("unit_price") * F.col("n")).alias("s"), F.sum("amount").alias("a"), F.sum("n").alias("n"), F.count_distinct("bid_id").alias("b")
    )
