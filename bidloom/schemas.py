"""Schemas of the bid model's thirteen tables. Money columns hold cents (long): sums are exact and don't depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


USERS = "user_id string, email string, name string, role string, dept string, is_active boolean, llm_verify_ssl boolean, created_at timestamp"
DOMAINS = "domain_id string, name string, description string, sort_order int, is_active boolean"
PROJECTS = "project_id string, name string, description string, owner_id string, status string, created_at timestamp"
BIDS = "bid_id string, project_id string, name string, domain string, due_date date, status string, created_at timestamp"
SUBMISSIONS = (
    "submission_id string, bid_id string, vendor_name string, file_name string, file_format string, extraction_status string, subtotal long, fx_rate double, "
    "has_usd_items boolean, compare_level int, compare_units array<string>, extracted_sheets array<string>, map_config string, uploaded_by string, deleted_at timestamp, created_at timestamp"
)
ITEMS = (
    "item_id string, submission_id string, sort_order int, depth int, is_header boolean, is_nego boolean, category string, path string, line_no string, name_raw string, "
    "name_normalized string, spec string, quantity double, unit string, unit_price long, amount long, catalog_item_id string, match_status string, match_confidence double"
)
WATCHLIST = "watchlist_id string, user_id string, bid_id string, created_at timestamp"
CATEGORIES = "category_id string, parent_id string, name string, domain string, sort_order int, is_active boolean"
CATALOG_ITEMS = "catalog_item_id string, category_id string, name_canonical string, aliases array<string>, spec_template string, unit_std string, is_active boolean, created_at timestamp"
PRICE_HISTORY = "record_id string, catalog_item_id string, submission_id string, item_id string, unit_price long, quantity double, amount long, bid_date date, vendor_name string"
SUGGESTIONS = "suggestion_id string, item_id string, catalog_item_id string, confidence double, reason string, status string"
CLUSTERS = "cluster_id string, bid_id string, representative_name string, rep_item_id string, catalog_item_id string, category string, status string, created_at timestamp, reviewed_by string"
MEMBERS = "cluster_id string, item_id string, is_representative boolean, similarity_score double"

TABLES: dict[str, str] = {
    "users": USERS, "domains": DOMAINS, "projects": PROJECTS, "bids": BIDS, "submissions": SUBMISSIONS, "submission_items": ITEMS, "bid_watchlist": WATCHLIST,
    "catalog_categories": CATEGORIES, "catalog_items": CATALOG_ITEMS, "price_history": PRICE_HISTORY, "catalog_suggestions": SUGGESTIONS,
    "catalog_clusters": CLUSTERS, "catalog_cluster_members": MEMBERS,
}


def schema(table: str) -> T.StructType:
    """A table's columns and types. Needs a running session, which parses the text."""
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df in a table's columns and types: what is missing is null, what the table lacks is dropped, what can't be cast is null."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(table)])
