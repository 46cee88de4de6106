"""Items of submissions matched to the catalog: what a provider is shown, suggestions, and their confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.operators.compare import catalog_lookup


def match_input(items: DataFrame, catalog: DataFrame, candidates: DataFrame, by: str = "submission_id", aliases: int = 3) -> DataFrame:
    """What a provider is shown of each submission: its leaves in order of `seq`, a line each, and the catalog items that are candidates of one
    of them (candidates: name, catalog_item_id), by id, with their first aliases. Without candidates the catalog's list is empty."""

    # Headings and field names of the text.
    def field(name: str, *columns: str):
        return F.concat(F.lit(f" | {name}="), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))

    leaves = items.where("NOT is_header")
    item = F.concat(F.lit("  - item_id="), "item_id", field("category", "category"), field("name", "name"), field("spec", "brand"), field("qty", "quantity", "unit"))
    item_lines = leaves.groupBy(by).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.struct("seq", "item_id", item.alias("line"))))["line"], "\n").alias("items"))
    known = F.concat(F.lit("  - catalog_item_id="), F.col("catalog_item_id").cast("string"), field("name", "name"), field("category", "category"), field("unit", "unit_std"), F.lit(" | aliases="), F.array_join(F.slice("aliases", 1, aliases), ", "))
    wanted = leaves.select(by, "name").distinct().join(candidates.select("name", "catalog_item_id"), "name").select(by, "catalog_item_id").distinct()
    listed = wanted.join(catalog.select("catalog_item_id", known.alias("line")), "catalog_item_id")
    catalog_lines = listed.groupBy(by).agg(F.count("*").alias("n_catalog"), F.array_join(F.array_sort(F.collect_list(F.struct("catalog_item_id", "line")))["line"], "\n").alias("known"))
    texts = item_lines.join(catalog_lines, by, "left").withColumns({"n_catalog": F.coalesce("n_catalog", F.lit(0)), "known": F.coalesce("known", F.lit(""))})
    text = F.concat(F.lit("## 라인 아이템 목록 ("), "n_items", F.lit("개)\n"), "items", F.lit("\n\n## 카탈로그 품목 목록 ("), "n_catalog", F.lit("개)\n"), "known")
    return texts.select(by, text.alias("text"), "n_items", "n_catalog")


def suggest(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """The deterministic provider's matches (item_id, catalog_item_id, confidence, reason): by canonical name, else alias; without one, null and 0."""
    names = items.where("NOT is_header").select("name").distinct()
    found = catalog_lookup(names, catalog)
    reason = F.when(F.col("tier") == 0, "name").when(F.col("tier") == 1, "alias").otherwise("")
    confidence = F.when(F.col("tier") == 0, 1.0).when(F.col("tier") == 1, 0.9).otherwise(0.0)
    return items.where("NOT is_header").select("item_id", "name").join(found, "name").select("item_id", "catalog_item_id", confidence.alias("confidence"), reason.alias("reason"))


def save_suggestions(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Items with their matches: suggested if a match names a catalog item, else unmatched. Items without a match keep what they had; of several the surest counts."""
    best = matches.groupBy("item_id").agg(F.max(F.struct("confidence", "catalog_item_id", "reason")).alias("m"))
    rows = items
    for c, t in (("catalog_item_id", "bigint"), ("match_status", "string"), ("match_confidence", "double")):
        if c not in items.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    joined = rows.join(best, "item_id", "left")
    has = F.col("m").isNotNull()
    return (
        joined.withColumn("catalog_item_id", F.when(has, F.col("m.catalog_item_id")).otherwise(F.col("catalog_item_id")))
        .withColumn("match_status", F.when(has, F.when(F.col("m.catalog_item_id").isNotNull(), "suggested").otherwise("unmatched")).otherwise(F.col("match_status")))
        .withColumn("match_confidence", F.when(has, F.coalesce("m.confidence", F.lit(0.0))).otherwise(F.col("match_confidence")))
        .drop("m")
    )


def suggestions(items: DataFrame, catalog: DataFrame, status: str | None = None) -> DataFrame:
    """Items with a match and the catalog item's name, of one status if given, in the order of their submission."""
    rows = items.where("match_status IS NOT NULL" if status is None else F.col("match_status") == status)
    return rows.join(catalog.select("catalog_item_id", F.col("name").alias("catalog_name")), "catalog_item_id", "left")


def confirm(items: DataFrame, decisions: DataFrame, history: DataFrame, by: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Items after decisions (item_id, catalog_item_id or null): confirmed or unmatched; and the price records to append, one for each
    confirmed item, without those that the history (catalog_item_id, item_id) has already. A record is a snapshot: it also has the item's
    vendor, project, unit and spec, as far as items have these columns. Of several decisions for an item the last by `decided_at` counts if
    there is such a column, else the one with the greatest catalog item (null is the least)."""
    last = F.struct(*[c for c in ("decided_at",) if c in decisions.columns], "catalog_item_id")
    decided = decisions.groupBy(by).agg(F.max(last).alias("_d")).select(by, F.col("_d.catalog_item_id").alias("chosen"), F.lit(True).alias("decided"))
    joined = items.join(decided, by, "left")
    now = (
        joined.withColumn("catalog_item_id", F.when(F.col("decided"), F.col("chosen")).otherwise(F.col("catalog_item_id")))
        .withColumn("match_status", F.when(F.col("decided"), F.when(F.col("chosen").isNotNull(), "confirmed").otherwise("unmatched")).otherwise(F.col("match_status")))
    )
    priced = now.where("decided AND chosen IS NOT NULL").select("catalog_item_id", by, "submission_id", *[c for c in ("vendor_id", "vendor_name", "project_id", "project_name", "unit", "spec") if c in items.columns], "quantity", "unit_price", "amount", "bid_date")
    return now.drop("chosen", "decided"), priced.join(history.select("catalog_item_id", by), ["catalog_item_id", by], "left_anti")
