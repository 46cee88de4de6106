"""Comparison reports as frames, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_rows(pivot: DataFrame) -> DataFrame:
    """One row for each row of a comparison: lowest and highest price, the lowest vendor, and the ratio of highest to lowest in hundredths."""
    priced = pivot.where("unit_price > 0")
    return priced.groupBy("bid_id", "category", "row_key").agg(
        F.count("*").alias("n_vendors"), F.min("unit_price").alias("low"), F.max("unit_price").alias("high"),
        F.min_by("vendor_id", F.struct("unit_price", "vendor_id")).alias("low_vendor"),
        F.floor(F.max("unit_price") * 100 / F.min("unit_price")).cast("long").alias("ratio"),
    )


def report_summary(totals: DataFrame) -> DataFrame:
    """Totals of each vendor (bid_id, vendor_id, category, total), and which vendor of a bid is lowest; a total of 0 never is."""
    sums = totals.groupBy("bid_id", "vendor_id").agg(F.sum("total").alias("total"))
    best = sums.where("total > 0").groupBy("bid_id").agg(F.min_by("vendor_id", F.struct("total", "vendor_id")).alias("low_vendor"))
    return sums.join(best, "bid_id", "left").withColumn("is_lowest", F.coalesce(F.col("vendor_id") == F.col("low_vendor"), F.lit(False))).drop("low_vendor")


def wide(totals: DataFrame, vendors: list[str]) -> DataFrame:
    """A column for each of the named vendors."""
    return totals.groupBy("bid_id", "category").pivot("vendor_id", vendors).sum("total")


def write_report(path: str, **frames: DataFrame) -> None:
    """Each frame as CSV with a header, in a folder of its own below path, written by all tasks."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
