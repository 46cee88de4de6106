"""Changes to stored rows, as an append-only log of changes and a view of the latest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import scalars as S


def latest(log: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last row of each key; keys whose last row is a deletion (is_deleted_row) are absent."""
    rest = [c for c in log.columns if c not in key]
    rows = log.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("x")).select(*key, "x.*")
    return rows.where("NOT coalesce(is_deleted_row, false)").drop("is_deleted_row") if "is_deleted_row" in rest else rows


def upsert(rows: DataFrame, new: DataFrame, key: list[str], replace: bool) -> DataFrame:
    """rows and new, one for each key: the new one if replace, else the old one."""
    if replace:
        return rows.join(new.select(*key), key, "left_anti").unionByName(new.dropDuplicates(key))
    return rows.unionByName(new.dropDuplicates(key).join(rows.select(*key), key, "left_anti"))


def reset_submission(items: DataFrame, submissions: DataFrame, keep_nego: bool = False) -> DataFrame:
    """Items less those of the given submissions; negotiated ones may stay."""
    gone = items.join(submissions.select("submission_id"), "submission_id", "left_semi")
    gone = gone.where("NOT coalesce(is_nego, false)") if keep_nego else gone
    return items.join(gone.select("item_id"), "item_id", "left_anti")


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key).distinct(), key, "left_anti")


def guard_empty(parent: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Rows of parent that nothing refers to, which alone may be deleted."""
    return parent.join(children.select(key).distinct(), key, "left_anti")


def rename_domain(bids: DataFrame, categories: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bids and categories with a domain renamed, and how many rows of each changed."""

    def renamed(df: DataFrame) -> DataFrame:
        return df.withColumn("domain", F.when(F.col("domain") == old, new).otherwise(F.col("domain")))

    counts = bids.agg(F.count_if(F.col("domain") == old).alias("n_bids")).crossJoin(categories.agg(F.count_if(F.col("domain") == old).alias("n_categories")))
    return renamed(bids), renamed(categories), counts


def nego_items(requests: DataFrame) -> DataFrame:
    """Negotiated reductions (submission_id, item_id, label, amount) as items: always negative, last in order."""
    amount = -F.abs("amount")
    return requests.select("item_id", "submission_id", F.col("label").alias("name"), F.lit("조정").alias("category"), amount.alias("amount"), amount.alias("unit_price"), F.lit(1.0).alias("quantity"), F.lit(99999).alias("sort_order"), F.lit(True).alias("is_nego"), F.lit(False).alias("is_header"))


NUMBERS = ("quantity", "unit_price", "unit_price_orig", "amount")


def insert_items(extracted: DataFrame) -> DataFrame:
    """Items of extraction results (submission_id, items array) with their place as sort_order. The path falls back to parent_path, texts in
    numeric columns become numbers (null where they hold none), marks of indentation leave the names, a category header is a header, the
    depth is 0 and the currency KRW where none is given. Columns that the results lack stay absent."""
    rows = extracted.select("submission_id", F.posexplode("items").alias("sort_order", "i")).select("submission_id", "sort_order", "i.*")
    kinds = dict(rows.dtypes)
    new = {c: S.clean_number(F.col(c)) for c in NUMBERS if kinds.get(c) == "string"}
    new |= {"name_raw": S.strip_indent(F.coalesce("name_raw", F.lit("")))} if "name_raw" in kinds else {}
    new |= {"path": F.coalesce(F.nullif("path", F.lit("")), "parent_path", F.lit(""))} if {"path", "parent_path"} <= kinds.keys() else {}
    new |= {"is_header": F.coalesce("is_category_header", F.lit(False))} if "is_category_header" in kinds else {}
    new |= {"is_nego": F.coalesce("is_nego", F.lit(False))} if "is_nego" in kinds else {}
    new |= {"depth": F.coalesce("depth", F.lit(0))} if "depth" in kinds else {}
    new |= {"unit_price_currency": F.coalesce("unit_price_currency_in_source", F.lit("KRW"))} if "unit_price_currency_in_source" in kinds else {}
    return rows.withColumns(new) if new else rows


def set_flag(rows: DataFrame, which: DataFrame, key: str, column: str, value: bool | None = None) -> DataFrame:
    """Rows with a flag set for the keys in which: soft deletion and restoring, activity of categories and domains. Without a value the flag is turned."""
    marked = rows.join(which.select(key).distinct().withColumn("~hit", F.lit(True)), key, "left")
    new = ~F.coalesce(F.col(column), F.lit(False)) if value is None else F.lit(value)
    return marked.withColumn(column, F.when(F.col("~hit"), new).otherwise(F.col(column))).drop("~hit")


def landing_name(name: Column, at: Column, allowed: tuple[str, ...] = ("xlsx", "xls", "pdf", "docx")) -> Column:
    """The name under which a file lands: a time stamp before its extension; null if the extension is not allowed."""
    stem, ending = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ending.isin(*allowed) & (stem != ""), F.concat(stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("."), ending))
