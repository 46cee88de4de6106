"""Listings, searches and counts over the project, bid, submission and item hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_overview(projects: DataFrame, bids: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every project with its numbers of bids and submissions. Each side is counted before it is joined, so nothing fans out."""
    per_bid = submissions.groupBy("bid_id").agg(F.count_distinct("submission_id").alias("n"))
    counts = bids.join(per_bid, "bid_id", "left").groupBy("project_id").agg(F.count_distinct("bid_id").alias("n_bids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_submissions"))
    return projects.join(counts, "project_id", "left").fillna(0, ["n_bids", "n_submissions"])


def bid_summary(bids: DataFrame, projects: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every bid with its done submissions: how many, lowest and highest subtotal. Deleted ones count."""
    done = submissions.where("extraction_status = 'done'").groupBy("bid_id").agg(F.count_distinct("submission_id").alias("n_done"), F.min("subtotal").alias("min_subtotal"), F.max("subtotal").alias("max_subtotal"))
    return bids.join(projects, "project_id").join(done, "bid_id", "left").fillna(0, ["n_done"])


def submission_listing(submissions: DataFrame, items: DataFrame, deleted: bool = False) -> DataFrame:
    """Active (or deleted) submissions with the number of their items that are no headers."""
    counts = items.groupBy("submission_id").agg(F.count_if(~F.col("is_header")).alias("n_items"))
    return submissions.where(F.col("is_deleted") == deleted).drop("n_items").join(counts, "submission_id", "left").fillna(0, ["n_items"])


def submission_subtotal(items: DataFrame) -> DataFrame:
    """Sum of the amounts of a submission's leaves; null amounts count as 0."""
    return items.groupBy("submission_id").agg(F.coalesce(F.sum(F.when(~F.col("is_header"), F.coalesce("amount", F.lit(0)))), F.lit(0)).alias("subtotal"), F.count_if("is_nego").alias("n_nego"))


def bids_ready(bids: DataFrame, projects: DataFrame, submissions: DataFrame, least: int = 2) -> DataFrame:
    """Bids with so many done submissions or more."""
    done = submissions.where("extraction_status = 'done'").groupBy("bid_id").agg(F.count("*").alias("n_done")).where(F.col("n_done") >= least)
    return bids.join(done, "bid_id").join(projects, "project_id")


def contains(column: str | Column, query: str) -> Column:
    """LIKE '%query%' regardless of case; % and _ in the query are wildcards, a backslash is not."""
    return (F.col(column) if isinstance(column, str) else column).ilike("%" + query.replace("\\", "\\\\") + "%")


def price_search(items: DataFrame, bids: DataFrame, projects: DataFrame, query: str, columns: tuple[str, ...] = ("name",), project_id: int | None = None) -> DataFrame:
    """Items that are no headers and whose columns hold the query, with bid and project; in one project if asked."""
    match = contains(columns[0], query)
    for c in columns[1:]:
        match = match | contains(c, query)
    found = items.where(~F.col("is_header") & match).join(bids, "bid_id").join(projects, "project_id")
    return found if project_id is None else found.where(F.col("project_id") == project_id)


def category_listing(categories: DataFrame, catalog: DataFrame) -> DataFrame:
    """Categories with their parent's name and the number of active catalog items."""
    parents = categories.select(F.col("category_id").alias("parent_id"), F.col("category_name").alias("parent_name"))
    active = catalog.where("is_active").groupBy("category_id").agg(F.count("*").alias("n_items"))
    return categories.join(parents, "parent_id", "left").join(active, "category_id", "left").fillna(0, ["n_items"])


def catalog_stats(catalog: DataFrame, categories: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: active catalog items, categories, and distinct items that are matched."""
    return catalog.agg(F.count_if("is_active").alias("n_items")).crossJoin(categories.agg(F.count("*").alias("n_categories"))).crossJoin(matched.agg(F.count_distinct("catalog_item_id").alias("n_matched")))


def domain_impact(bids: DataFrame, submissions: DataFrame, history: DataFrame) -> DataFrame:
    """What a domain's removal would touch: its bids, projects, submissions and recorded prices."""
    per_bid = submissions.groupBy("bid_id").agg(F.count("*").alias("s"))
    prices = history.groupBy("bid_id").agg(F.count("*").alias("h"))
    joined = bids.join(per_bid, "bid_id", "left").join(prices, "bid_id", "left")
    return joined.groupBy("domain").agg(F.count("*").alias("n_bids"), F.count_distinct("project_id").alias("n_projects"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_submissions"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_prices"))


def domain_removal(domains: DataFrame, bids: DataFrame, submissions: DataFrame, categories: DataFrame, catalog: DataFrame) -> DataFrame:
    """What a domain's change would touch: its bids, their submissions, its active categories and their active catalog items. Domains without any show zeros."""
    per_bid = submissions.groupBy("bid_id").agg(F.count("*").alias("n"))
    of_bids = bids.join(per_bid, "bid_id", "left").groupBy("domain").agg(F.count("*").alias("n_bids"), F.sum("n").alias("n_submissions"))
    active = categories.where("is_active").groupBy("domain").agg(F.count("*").alias("n_categories"))
    per_category = catalog.where("is_active").groupBy("category_id").agg(F.count("*").alias("n"))
    of_items = categories.join(per_category, "category_id").groupBy("domain").agg(F.sum("n").alias("n_items"))
    rows = domains.select("domain").join(of_bids, "domain", "left").join(active, "domain", "left").join(of_items, "domain", "left")
    return rows.fillna(0, ["n_bids", "n_submissions", "n_categories", "n_items"])


def chosen(rows: DataFrame, shared: dict[str, str] | None = None, **wanted: object) -> DataFrame:
    """rows whose columns have the wanted values; None wants nothing of a column. shared: values that a column may have besides, as ALL for every domain."""
    for column, value in wanted.items():
        if value is not None:
            also = (shared or {}).get(column)
            rows = rows.where(F.col(column) == value if also is None else F.col(column).isin(value, also))
    return rows


def catalog_search(catalog: DataFrame, categories: DataFrame, search: str | None = None, active: bool = True, **wanted: object) -> DataFrame:
    """Catalog items with their category's name and parent, whose name or an alias holds the search; active ones alone unless asked otherwise."""
    rows = chosen(catalog, is_active=True if active else None, **wanted)
    if search:
        rows = rows.where(contains("name", search) | contains(F.to_json("aliases"), search))
    return rows.join(categories.select("category_id", "category_name", "parent_id"), "category_id", "left")


def cluster_listing(clusters: DataFrame, member_rows: DataFrame, status: str | None = None, bid_id: object = None) -> DataFrame:
    """Clusters that have members, with how many; of a status and a bid if asked."""
    counts = member_rows.groupBy("cluster_id").agg(F.count("*").alias("member_count"))
    return chosen(clusters, status=status, bid_id=bid_id).join(counts, "cluster_id")


def status_histogram(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Rows of each status, zero where there are none, and their total."""
    counts = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    return rows.groupBy(*by).agg(*counts, F.count("*").alias("n_total"))


def items_with_match(items: DataFrame, catalog: DataFrame, categories: DataFrame) -> DataFrame:
    """All items, with catalog item and category where they are matched."""
    return items.join(catalog, "catalog_item_id", "left").join(categories, "category_id", "left")


def is_status(column: str, allowed: list[str]) -> Column:
    return F.coalesce(F.col(column).isin(allowed), F.lit(False))


def summary_view(items: DataFrame, role: str) -> DataFrame:
    """What a role may see: viewers of summaries get totals by submission and category, everyone else the items."""
    if role != "viewer-summary":
        return items
    return items.groupBy("submission_id", "category").agg(F.sum("amount").alias("amount"), F.count("*").alias("n_items"))
