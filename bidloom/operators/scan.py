"""Row numbers, values filled down and runs over groups of any size: a prefix scan instead of a window that holds a group in one task.

Rows are range-partitioned by group and order, so a large group lies in many partitions, in order. Each partition leaves one row of totals
for each group that it has a part of (how many rows, its last value, its number of starts); windows over these few rows, one for each
partition of a group, give what comes before each part, and a second pass adds it.

Columns of the group may be null (nulls are a group). Rows that tie in all of `order` keep any one order among themselves, the same in
all results. An empty table gives an empty result. Columns named as those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.session import bounded
from bidloom.stages import keep

_OWN = ["_part", "_at", "_tie"]


def _columns(names: list[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in names]


def spread(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """df in range partitions by group and order, kept in the shared folder: `_part` numbers the partition, `_at` ascends within it."""
    keys = [*_columns(group), *_columns(order), F.col("_tie")]
    rows = df.drop(*_OWN).withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    return keep(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "spread")


def _meet(rows: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """rows with the totals of their part of a group."""
    named = totals.select(F.col("_part").alias("_p"), *[F.col(f"`{g}`").alias(f"_g{k}") for k, g in enumerate(group)], *[c for c in totals.columns if c not in [*group, "_part"]])
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"_g{k}"))
    return rows.join(bounded(named, 100_000), same).drop("_p", *[f"_g{k}" for k in range(len(group))])


def _before(group: list[str]):
    return Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def number(df: DataFrame, group: list[str], order: list[str | Column], name: str = "position", size: str | None = None) -> DataFrame:
    """df with each row's place in its group, from 0; and with the group's number of rows as `size`, if wanted."""
    rows = spread(df.drop(name, *([size] if size else [])), group, order)
    totals = rows.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)))
    if size:
        totals = totals.withColumn(size, F.sum("_n").over(Window.partitionBy(*group)))
    done = _meet(rows, totals.drop("_n"), group).withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first"))
    return done.drop("_part", "_at", "_offset", "_first")


def fill_forward(df: DataFrame, group: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """df with each null in `columns` replaced by the last value before it in its group that is none."""
    rows = spread(df, group, order)
    last = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_at"))).alias(f"_l{k}") for k, c in enumerate(columns)]
    totals = rows.groupBy("_part", *group).agg(*last)
    totals = totals.select("_part", *group, *[F.last(f"_l{k}", ignorenulls=True).over(_before(group)).alias(f"_b{k}") for k in range(len(columns))])
    here = Window.partitionBy("_part", *group).orderBy("_at")
    done = _meet(rows, totals, group)
    done = done.withColumns({c: F.coalesce(F.last(f"`{c}`", ignorenulls=True).over(here), F.col(f"_b{k}")) for k, c in enumerate(columns)})
    return done.drop("_part", "_at", *[f"_b{k}" for k in range(len(columns))])


def runs(df: DataFrame, group: list[str], order: list[str | Column], label: str | Column, name: str = "run") -> DataFrame:
    """df with the number, from 1, of the run of equal labels (nulls are equal) that each row is in, and its place in the run, from 0, as `name`_place."""
    place = f"{name}_place"
    rows = spread(df.drop(name, place).withColumn("_label", F.struct((F.col(label) if isinstance(label, str) else label).alias("x"))), group, order)
    here = Window.partitionBy("_part", *group).orderBy("_at")
    marked = rows.withColumn("_prev", F.lag("_label").over(here))
    totals = marked.groupBy("_part", *group).agg(
        F.min("_at").alias("_first"), F.min_by("_label", "_at").alias("_open"), F.max_by("_label", "_at").alias("_close"), F.count("*").alias("_n"),
        F.count_if(F.col("_prev").isNotNull() & ~F.col("_label").eqNullSafe(F.col("_prev"))).alias("_inner"),
        F.max(F.when(F.col("_prev").isNotNull() & ~F.col("_label").eqNullSafe(F.col("_prev")), F.col("_at"))).alias("_cut"),
    )
    parts = Window.partitionBy(*group).orderBy("_part")
    totals = totals.withColumn("_new", (~F.lag("_close").over(parts).eqNullSafe(F.col("_open"))).cast("long"))
    totals = totals.withColumn("_base", F.sum("_new").over(parts) + F.coalesce(F.sum("_inner").over(_before(group)), F.lit(0)))
    # where the run that is open at the part's first row began, counted in rows of the group
    totals = totals.withColumn("_rows", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)))
    own = F.when(F.col("_cut").isNotNull(), F.col("_rows") + F.col("_cut") - F.col("_first")).when(F.col("_new") == 1, F.col("_rows"))
    totals = totals.withColumn("_last_start", own).withColumn("_start", F.when(F.col("_new") == 1, F.col("_rows")).otherwise(F.last("_last_start", ignorenulls=True).over(_before(group))))
    done = _meet(rows, totals.select("_part", *group, "_first", "_base", "_rows", "_start"), group)
    begins = F.lag("_label").over(here).isNotNull() & ~F.col("_label").eqNullSafe(F.lag("_label").over(here))
    done = done.withColumn("_begins", begins).withColumn("_pos", F.col("_rows") + F.col("_at") - F.col("_first"))
    done = done.withColumn(name, F.col("_base") + F.sum(F.col("_begins").cast("long")).over(here))
    done = done.withColumn(place, F.col("_pos") - F.coalesce(F.last(F.when(F.col("_begins"), F.col("_pos")), ignorenulls=True).over(here), F.col("_start")))
    return done.drop("_part", "_at", "_label", "_first", "_base", "_rows", "_start", "_begins", "_pos")
