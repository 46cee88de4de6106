"""Vendors compared: item by item, by category, against the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import scalars as S
from bidloom.session import bounded


def live_items(items: DataFrame) -> DataFrame:
    """Leaves of submissions that are done and not deleted."""
    return items.where("NOT is_header AND extraction_status = 'done' AND NOT is_deleted")


def vendors(submissions: DataFrame) -> DataFrame:
    """Vendors of each bid, lowest subtotal first, those without one last."""
    live = submissions.where("extraction_status = 'done' AND NOT is_deleted")
    rank = F.struct(F.col("subtotal").isNull(), "subtotal", "vendor_name")
    ranked = live.groupBy("bid_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "submission_id"))).alias("all"))
    place = ranked.select("bid_id", F.posexplode("all").alias("place", "v")).select(F.col("v.submission_id").alias("submission_id"), (F.col("place") + 1).alias("vendor_rank"))
    return live.join(place, "submission_id")


def name_conflicts(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, name) that stand under more than one path, with the number of paths."""
    return items.groupBy(*by, "name").agg(F.count_distinct("path").alias("n_paths")).where("n_paths > 1")


def compare_pivot(items: DataFrame) -> DataFrame:
    """One row for each row of the comparison and vendor. A row is a name within a category, or a path where the name stands under several.

    Specification and path come from the first item of the row, price, quantity, amount and item from the vendor's last one. Items are read
    once: they are summed by path and vendor in the map tasks, and what a name or a row has in common is a window over those sums.
    """
    key = ["bid_id", "category", "name"]
    item = F.col("item_id") if "item_id" in items.columns else F.lit(None).cast("string").alias("item_id")
    per_path = items.where("name <> ''").groupBy(*key, "path", "vendor_id").agg(
        F.max(F.struct("seq", "unit_price", "quantity", "amount", item)).alias("last"), F.min(F.struct("seq", F.col("brand").alias("spec"), F.col("path").alias("p"))).alias("first")
    )
    name = Window.partitionBy(*key)
    keyed = per_path.withColumn("row_key", F.when(F.min("path").over(name) != F.max("path").over(name), F.col("path")).otherwise(F.col("name")))
    row = ["bid_id", "category", "row_key"]
    vendor = keyed.repartition(*row).groupBy(*row, "vendor_id").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    whole = vendor.withColumn("head", F.min("first").over(Window.partitionBy(*row)))
    return whole.select(*row, "vendor_id", "last.unit_price", "last.quantity", "last.amount", "last.item_id", F.col("head.spec").alias("spec"), F.col("head.p").alias("path"))


def row_extremes(pivot: DataFrame, by: tuple[str, ...] = ("bid_id", "category", "row_key")) -> DataFrame:
    """Cheapest and dearest vendor of each row over prices that are neither null nor 0; no dearest with one price. Ties: the vendor first in order."""
    priced = pivot.where("unit_price <> 0")
    return priced.groupBy(*by).agg(
        F.min("unit_price").alias("min_price"),
        F.min_by("vendor_id", F.struct("unit_price", "vendor_id")).alias("min_vendor"),
        F.when(F.count("*") > 1, F.max("unit_price")).alias("max_price"),
        F.when(F.count("*") > 1, F.max_by("vendor_id", F.struct("unit_price", -F.col("vendor_id")))).alias("max_vendor"),
        F.count("*").alias("n_prices"),
    )


def category_totals(items: DataFrame, canonical: list[str]) -> DataFrame:
    """Each vendor's total of each canonical category, 0 where it offers nothing. Others don't count."""
    one = items.groupBy("bid_id", "vendor_id").agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("amount"))), F.lit(0)).alias(c) for c in canonical])
    return one.select("bid_id", "vendor_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, canonical)), F.array(*canonical))).alias("category", "total"))


def category_order(items: DataFrame, canonical: list[str]) -> DataFrame:
    """Categories of each bid in order: canonical ones first, the others as first seen."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, canonical)), F.col("category")), F.lit(0))
    rank = F.when(rank == 0, len(canonical) + 1).otherwise(rank)
    seen = items.groupBy("bid_id", "category").agg(F.min(F.struct("seq")).alias("seen"))
    ordered = seen.groupBy("bid_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "seen", "category"))).alias("all"))
    return ordered.select("bid_id", F.posexplode("all").alias("place", "c")).select("bid_id", F.col("c.category").alias("category"), (F.col("place") + 1).cast("int").alias("place"))


def majority(rows: DataFrame, by: list[str], column: str, order: str) -> DataFrame:
    """The most frequent value of a group; of equally frequent ones the one seen first."""
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("n"), "seen")).alias(column))


def _asked(totals: DataFrame, projects: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """totals of items beside the projects that ask for them: those of wanted (project_id, catalog_item_id), else every project for every item."""
    if wanted is None:
        return totals.crossJoin(bounded(projects.select("project_id").distinct()))
    return wanted.select("project_id", "catalog_item_id").distinct().join(totals, "catalog_item_id")


def benchmark(history: DataFrame, projects: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """For each project the prices that other projects paid for an item; with wanted (project_id, catalog_item_id) for these pairs only.

    History is summed by item and project once.
    """
    priced = history.where("unit_price > 0 AND NOT is_deleted")
    sums = priced.groupBy("catalog_item_id", F.col("project_id").alias("source")).agg(
        F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"), F.sum("unit_price").alias("s"), F.sum("amount").alias("a"), F.count("*").alias("n"), F.count_distinct("bid_id").alias("b")
    )
    return benchmark_of_sums(sums, projects, wanted)


def benchmark_of_sums(sums: DataFrame, projects: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Benchmarks from an item's prices in each project (catalog_item_id, source, lo, hi, s, a, n, b: lowest, highest, sum of prices, sum of amounts, records, bids).

    What others paid is an item's totals less the project's own, and for the lowest and
    highest price the best of another project: of each item the two lowest and two highest, each from a project of its own, are kept.
    """
    item = Window.partitionBy("catalog_item_id")
    kinds = ("s", "a", "n", "b")
    rows = sums.withColumns({f"all_{c}": F.sum(c).over(item) for c in kinds} | {"first_lo": F.min(F.struct("lo", "source")).over(item), "first_hi": F.max(F.struct("hi", "source")).over(item)})
    rows = rows.withColumns({f"next_{c}": f(F.when(F.col("source") != F.col(f"first_{c}.source"), F.col(c))).over(item) for c, f in (("lo", F.min), ("hi", F.max))})
    totals = rows.drop("source", "lo", "hi", *kinds).dropDuplicates(["catalog_item_id"])
    own = sums.select("catalog_item_id", F.col("source").alias("project_id"), *kinds)
    joined = _asked(totals, projects, wanted).join(own, ["project_id", "catalog_item_id"], "left")
    left = joined.withColumns({c: F.col(f"all_{c}") - F.coalesce(c, F.lit(0)) for c in kinds}).where("n > 0")

    def other(c: str) -> Column:
        return F.when(F.col(f"first_{c}.source") == F.col("project_id"), F.col(f"next_{c}")).otherwise(F.col(f"first_{c}.{c}"))

    return left.select("project_id", "catalog_item_id", other("lo").alias("min_price"), other("hi").alias("max_price"), (F.col("s") / F.col("n")).alias("avg_price"), (F.col("a") / F.col("n")).alias("avg_amount"), F.col("n").alias("n_prices"), F.col("b").alias("n_bids"))


def cheapest(history: DataFrame, projects: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """For each project (with wanted: for these pairs) the cheapest recorded price of an item in other projects, with where it was paid. Of
    each item the cheapest price and the cheapest of another project are kept."""
    priced = history.where("unit_price > 0 AND NOT is_deleted")
    detail = F.struct("unit_price", "bid_date", "item_id", "bid_id", "l_suppkey")
    best = priced.groupBy("catalog_item_id", F.col("project_id").alias("source")).agg(F.min(detail).alias("d"))
    item = Window.partitionBy("catalog_item_id")
    rows = best.withColumn("first", F.min(F.struct("d", "source")).over(item)).withColumn("next", F.min(F.when(F.col("source") != F.col("first.source"), F.col("d"))).over(item))
    joined = _asked(rows.select("catalog_item_id", "first", "next").dropDuplicates(["catalog_item_id"]), projects, wanted)
    chosen = joined.select("project_id", "catalog_item_id", F.when(F.col("first.source") == F.col("project_id"), F.col("next")).otherwise(F.col("first.d")).alias("d")).where("d IS NOT NULL")
    return chosen.select("project_id", "catalog_item_id", "d.unit_price", "d.bid_date", "d.item_id", F.col("d.bid_id").alias("source_bid"), F.col("d.l_suppkey").alias("vendor_id"))


def deviation(price: Column, base: Column) -> Column:
    """How far a price lies above a base, in hundredths of a percent, rounded down; null without a base."""
    return F.when(base != 0, F.floor((price - base) * 10000 / base)).cast("long")


def catalog_lookup(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog item of each name: one with that canonical name, else one with that alias, regardless of case; the first in order of the catalog."""
    known = catalog.select("catalog_item_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("tier"), F.lower("name").alias("key"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("tier"), F.lower(a).alias("key"))))).alias("k")).select("catalog_item_id", "k.*")
    best = known.groupBy("key").agg(F.min(F.struct("tier", "catalog_item_id")).alias("m"))
    return names.withColumn("key", F.lower("name")).join(best, "key", "left").select("name", F.col("m.catalog_item_id").alias("catalog_item_id"), F.col("m.tier").alias("tier"))


def fx_rates(submissions: DataFrame) -> DataFrame:
    """Submissions with a rate that is neither null nor 0."""
    return submissions.where("fx_rate <> 0").select("submission_id", "vendor_name", "fx_rate")


def cluster_groups(member_rows: DataFrame) -> DataFrame:
    """One row for each row of a cluster and vendor. A row is a name, or a path where the name stands under several in the cluster, shown
    with its parent; a vendor's last item counts."""
    name = F.coalesce(F.nullif(S.strip(F.col("name")), F.lit("")), F.lit("미명명"))
    per = member_rows.withColumn("name", name).withColumn("path", F.coalesce("path", F.lit(""))).groupBy("cluster_id", "name", "path", "vendor_id").agg(F.max(F.struct("seq", "item_id", "unit_price", "quantity", "amount")).alias("last"))
    whole = Window.partitionBy("cluster_id", "name")
    apart = (F.min("path").over(whole) != F.max("path").over(whole)) & (F.col("path") != "")
    parts = S.split_path(F.col("path"))
    parent = S.join_path(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    keyed = per.withColumn("row_key", F.when(apart, F.col("path")).otherwise(F.col("name"))).withColumn("shown", F.when(apart & (parent != ""), F.concat("name", F.lit("  ("), parent, F.lit(")"))).otherwise(F.col("name")))
    rows = keyed.groupBy("cluster_id", "row_key", "vendor_id").agg(F.max("last").alias("last"), F.min("shown").alias("shown"))
    return rows.select("cluster_id", "row_key", "vendor_id", "shown", "last.item_id", "last.unit_price", "last.quantity", "last.amount")


def compared_totals(items: DataFrame, member_rows: DataFrame, canonical: list[str]) -> DataFrame:
    """Category totals of a comparison with clusters: items outside of them, and members once for each cluster that holds them."""
    columns = ["bid_id", "vendor_id", "category", "amount"]
    outside = items.join(member_rows.select("item_id").distinct(), "item_id", "left_anti")
    return category_totals(outside.select(*columns).unionByName(member_rows.select(*columns)), canonical)


def row_benchmarks(pivot: DataFrame, links: DataFrame, bids: DataFrame, history: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of a comparison with the benchmark of the catalog item that one of their items is confirmed as (of several, the smallest id that has
    one). links: item_id, catalog_item_id, match_status. Only the pairs of project and item that occur are benchmarked."""
    sure = links.where("match_status = 'confirmed' AND catalog_item_id IS NOT NULL").select("item_id", "catalog_item_id")
    found = pivot.select("bid_id", "category", "row_key", "item_id").join(sure, "item_id").join(bids.select("bid_id", "project_id"), "bid_id")
    found = found.groupBy("bid_id", "category", "row_key", "project_id", "catalog_item_id").agg(F.lit(1).alias("one"))
    priced = found.join(benchmark(history, projects, found).select("project_id", "catalog_item_id", F.col("min_price").alias("benchmark")), ["project_id", "catalog_item_id"])
    return priced.groupBy("bid_id", "category", "row_key").agg(F.min(F.struct("catalog_item_id", "benchmark")).alias("b")).select("bid_id", "category", "row_key", "b.*")


def cluster_benchmarks(clusters: DataFrame, history: DataFrame, projects: DataFrame, catalog: DataFrame) -> DataFrame:
    """Clusters (cluster_id, project_id, status, representative_item_id, name) with the catalog item whose benchmark they show: an accepted one's
    representative if it has one, else the item of that canonical name, else of that alias, among those that have one."""
    known = catalog.select("catalog_item_id", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("tier"), F.lower("name").alias("key"))), F.transform("aliases", lambda a: F.struct(F.lit(2).alias("tier"), F.lower(a).alias("key"))))).alias("k")).select("catalog_item_id", "k.*")
    named = clusters.select("cluster_id", "project_id", F.lower("name").alias("key")).join(known, "key").select("cluster_id", "project_id", "tier", "catalog_item_id")
    rep = clusters.where("status = 'accepted'").select("cluster_id", "project_id", F.lit(0).alias("tier"), F.col("representative_item_id").alias("catalog_item_id"))
    asked = named.unionByName(rep)
    priced = benchmark(history, projects, asked).select("project_id", "catalog_item_id", "min_price")
    best = asked.join(priced, ["project_id", "catalog_item_id"]).groupBy("cluster_id").agg(F.min(F.struct("tier", "catalog_item_id", "min_price")).alias("b"))
    return clusters.join(best, "cluster_id", "left").select("cluster_id", "b.tier", "b.catalog_item_id", F.col("b.min_price").alias("benchmark"))
