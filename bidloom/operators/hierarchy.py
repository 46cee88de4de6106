"""Roll-ups along category paths, and grouping by comparison units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import scalars as S

UNCLASSIFIED = "(미분류)"


def clamp_level(level: int) -> int:
    return max(1, min(6, level))


def level_rollup(items: DataFrame, level: int, by: str = "submission_id") -> DataFrame:
    """Leaves summed over the first `level` levels of their path; without a path, over category and name. First seen first."""
    parts = S.split_path(F.coalesce("path", F.lit("")))
    plain = F.when(F.coalesce("category", F.lit("")) != "", F.array("category", "name")).otherwise(F.array("name"))
    levels = F.when(F.size(parts) > 0, F.slice(parts, 1, clamp_level(level))).otherwise(plain)
    rows = items.where("NOT is_header").withColumn("levels", levels).withColumn("depth", F.greatest(F.size(parts), F.lit(1)))
    return rows.groupBy(by, S.join_path(F.col("levels")).alias("group_path")).agg(
        F.max(F.element_at("levels", -1)).alias("label"),
        F.sum("amount").alias("amount"),
        F.count("*").alias("n_items"),
        F.max("depth").alias("max_depth"),
        F.min("seq").alias("first_seq"),
    )


def node_paths(items: DataFrame) -> Column:
    """Levels of an item's node: its path, or else its category, and its name unless that ends it already."""
    parts = S.split_path(F.coalesce("path", F.lit("")))
    parts = F.when(F.size(parts) > 0, parts).when(F.coalesce("category", F.lit("")) != "", F.array("category")).otherwise(F.array().cast("array<string>"))
    name = S.truthy(F.col("name"))
    return F.when((name == "") | (F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")) == name), parts).otherwise(F.array_append(parts, name))


def tree_rollup(items: DataFrame, by: str = "submission_id") -> DataFrame:
    """Amount and number of items below every node of the tree. Leaves with one path are summed first, so a path is exploded once."""
    leaves = items.where("NOT is_header").groupBy(by, node_paths(items).alias("parts")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    nodes = leaves.select(by, F.posexplode(S.prefixes(F.col("parts"))).alias("level", "node"), F.size("parts").alias("deep"), "amount", "n")
    return nodes.groupBy(by, "node", (F.col("level") + 1).alias("depth")).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n_items"), F.bool_or(F.col("deep") == F.col("level") + 1).alias("is_leaf"))


def deepest(items: DataFrame) -> int:
    """The most levels of an item's node; 0 without items."""
    return items.agg(F.max(F.greatest(F.size(node_paths(items)), F.lit(1)))).first()[0] or 0


def nested_tree(items: DataFrame, by: str = "submission_id", leaf: tuple[str, ...] = ("item_id", "name", "brand", "quantity", "unit_price"), levels: int | None = None, dealt: bool = False) -> DataFrame:
    """One JSON text for each group: {"tree": nodes, "total", "max_depth"}. A node has name, path, amount, n_items, depth, is_leaf, leaf_data
    (the last item that ends there, of which the columns in `leaf` and the amount; null elsewhere) and children, in the order of their first items.

    Items are dealt by group once; they are summed by node, and nodes put together as texts level by level from the deepest, where they lie:
    parents get their sums with their children's texts. A group's text lies in one row, so it is as large as the group's tree. Null amounts count
    as 0, items without names and paths as unclassified, items of no group are left out. levels: as many as the deepest node has, or more; if
    they aren't given, items are read once more. dealt: items of one group lie in one partition already, and Spark knows it.
    """
    rows = items.where(f"NOT is_header AND `{by}` IS NOT NULL").withColumn("amount", F.coalesce("amount", F.lit(0)))
    if levels is None:
        levels = deepest(rows)
    parts = node_paths(rows)
    # the aggregates below find their rows in place, and no text is shuffled
    now = (rows if dealt else rows.repartition(by)).groupBy(by, F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(UNCLASSIFIED))).alias("node")).agg(
        F.sum("amount").alias("amount"), F.count("*").alias("n_items"), F.min("seq").alias("first"), F.max_by(F.struct(*leaf, "amount"), "seq").alias("leaf_data"), F.lit(None).cast("string").alias("children")
    )
    now = now.withColumn("deep", F.size("node"))
    for depth in range(levels, 0, -1):
        # nodes of this depth become texts of their parents, which meet them in one aggregate; the others have no children yet
        here = F.size("node") == depth
        name = F.element_at("node", -1)
        head = F.to_json(F.struct(name.alias("name"), S.join_path(F.col("node")).alias("path"), "amount", "n_items", F.lit(depth).alias("depth"), F.isnull("children").alias("is_leaf"), "leaf_data"), {"ignoreNullFields": "false"})
        text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        moved = now.select(by, F.when(here, F.slice("node", 1, depth - 1)).otherwise(F.col("node")).alias("node"), "amount", "n_items", "first", F.when(~here, F.col("leaf_data")).alias("leaf_data"), "deep", F.when(here, F.struct("first", name.alias("name"), text.alias("text"))).alias("child"))
        listed = F.array_join(F.array_sort(F.collect_list("child"))["text"], ",")
        now = moved.groupBy(by, "node").agg(F.sum("amount").alias("amount"), F.sum("n_items").alias("n_items"), F.min("first").alias("first"), F.first("leaf_data", True).alias("leaf_data"), F.max("deep").alias("deep"), F.when(F.count("child") > 0, listed).alias("children"))
    return now.select(by, F.concat(F.lit('{"tree":['), "children", F.lit('],"total":'), F.col("amount").cast("string"), F.lit(',"max_depth":'), F.col("deep").cast("string"), F.lit("}")).alias("tree"))


def _raw_prefixes(path: Column) -> Column:
    """The path, and what stands in it before each `>` and each ` > `."""
    cuts = F.split(path, ">")
    before = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.struct(F.array_join(F.slice(cuts, 1, k), ">").alias("head"), F.element_at(cuts, k + 1).startswith(" ").alias("spaced")))
    spaced = F.transform(F.filter(before, lambda x: x["spaced"] & x["head"].endswith(" ")), lambda x: F.substring(x["head"], F.lit(1), F.length(x["head"]) - 1))
    return F.array_distinct(F.when(F.size(cuts) > 1, F.concat(F.array(path), F.transform(before, lambda x: x["head"]), spaced)).otherwise(F.array(path)))


def units_at_level(items: DataFrame, level: int) -> DataFrame:
    """Each submission's distinct path prefixes of so many levels, as units; shorter paths give none."""
    parts = S.split_path(F.coalesce("path", F.lit("")))
    return items.where(F.size(parts) >= level).select("submission_id", S.join_path(F.slice(parts, 1, level)).alias("unit")).distinct()


def match_unit(items: DataFrame, units: DataFrame, normalize: bool) -> DataFrame:
    """items with `unit`, the longest of their submission's units that their path equals or starts with; null if none does.

    Normalised units meet the prefixes of normalised paths by equality. Raw ones meet what stands before a `>` or ` > ` in the path as it is.
    units: submission_id, unit. A submission's units are one row, which meets its items where they are dealt by submission: items are
    shuffled once, and what follows within a submission needs no shuffle.
    """
    node = S.join_path(S.split_path(F.col("unit"))) if normalize else F.col("unit")
    known = units.where("unit IS NOT NULL").groupBy("submission_id").agg(F.collect_set(F.struct(node.alias("node"), F.col("unit").alias("given"))).alias("_known"))
    prefixes = S.prefixes(S.split_path(F.col("path"))) if normalize else _raw_prefixes(F.col("path"))
    # of the prefixes that are a unit the longest; of units with one node the least
    given = lambda p: F.array_min(F.transform(F.filter("_known", lambda k: k["node"] == p), lambda k: k["given"]))
    met = F.filter(F.transform(prefixes, lambda p: F.struct((-F.length(p)).alias("n"), given(p).alias("given"))), lambda x: x["given"].isNotNull())
    best = F.when(F.col("path").isNotNull() & F.col("_known").isNotNull(), F.array_min(met)["given"])
    # a generator's column: filters and groups that use it don't match again
    return items.join(known.hint("merge"), ["submission_id"], "left").withColumn("unit", F.explode(F.array(best))).drop("_known")


def group_by_unit(items: DataFrame, units: DataFrame, normalize: bool = False, key: str = "label", unmatched: str = "self", sample: int = 5) -> DataFrame:
    """Leaves grouped by comparison unit.

    key: label (units that end alike meet) or path. unmatched: self (items are grouped by their own path, else category, else
    unclassified) or passthrough (items without a unit stay as they are). sample: how many names of a group are listed.
    """
    leaves = match_unit(items.where("NOT is_header"), units, normalize)
    own = F.coalesce(F.nullif("path", F.lit("")), F.nullif("category", F.lit("")), F.lit(UNCLASSIFIED))
    place = F.coalesce("unit", own)
    if unmatched == "passthrough":
        place = F.coalesce("unit", F.concat(F.lit("#"), F.col("item_id")))
    if key == "label":
        place = F.element_at(S.split_path(place), -1)
    rows = leaves.withColumn("group_key", place)
    if sample:  # only so many names of a group are gathered
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("submission_id", "group_key").orderBy("seq", "name")))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= sample, F.struct("seq", "name"))))["name"] if sample else None
    grouped = rows.groupBy("submission_id", "group_key").agg(
        F.sum("amount").alias("amount"),
        F.count("*").alias("n_items"),
        F.min_by("path", "seq").alias("first_path"),
        F.min_by("item_id", "seq").alias("first_item"),
        F.min_by("category", "seq").alias("category"),
        F.bool_or(F.col("unit").isNotNull()).alias("is_unit"),
        *([F.array_join(listed, ", ").alias("names")] if sample else []),
    )
    return grouped


def collapse_units(items: DataFrame, units: DataFrame, listed: int = 5) -> DataFrame:
    """Leaves whose path lies below a comparison unit of their submission become one item for each unit; the others stay as they are.

    Such an item has the unit's last level as name, the unit as path, the sum of amounts as amount and unit price, quantity 1, number and
    first names of its leaves as brand, and item_id, category and seq of its first leaf. Leaves are in order of category, name and seq.
    Only the names that are listed are gathered.
    """
    found = match_unit(items, units, True).withColumn("leaf", F.when(F.col("unit").isNull(), F.monotonically_increasing_id()))
    order = F.struct("category", "name", "seq")
    key = ["submission_id", "bid_id", "vendor_id", "unit"]
    named = F.coalesce("name", F.lit("")) != ""
    place = Window.partitionBy(*key, "leaf").orderBy((~named).cast("int"), "category", "name", "seq")
    first = F.array_sort(F.collect_list(F.when(named & (F.col("place") <= listed), F.struct("place", "name"))))["name"]
    columns = [*key[:3], "item_id", "category", "seq", "name", "path", "brand", "quantity", "amount", "unit_price"]
    # items without a unit are groups of one, so that all are read once
    one = found.withColumn("place", F.row_number().over(place)).groupBy(*key, "leaf").agg(F.min_by(F.struct(*columns[3:]), order).alias("head"), F.sum("amount").alias("total"), F.count_if(named).alias("n"), first.alias("names"))
    more = F.when(F.col("n") > listed, " ...").otherwise("")
    types = dict(items.dtypes)
    total = F.coalesce("total", F.lit(0))
    made = {
        "name": F.element_at(S.split_path(F.col("unit")), -1), "path": F.col("unit"), "quantity": F.lit(1), "amount": total, "unit_price": total,
        "brand": F.when(F.col("n") > 0, F.concat(F.lit("("), F.col("n").cast("string"), F.lit("개: "), F.array_join("names", ", "), more, F.lit(")"))),
    }
    is_unit = F.col("leaf").isNull()
    return one.select(*key[:3], *[F.when(is_unit, made[c].cast(types[c])).otherwise(F.col(f"head.{c}")).alias(c) if c in made else F.col(f"head.{c}").alias(c) for c in columns[3:]], is_unit.alias("is_unit"))


def unit_totals_pivot(grouped: DataFrame, submissions: DataFrame) -> DataFrame:
    """Groups of all vendors by label, with the vendor of the lowest amount (ties: the vendor listed first)."""
    rows = grouped.join(submissions.select("submission_id", "bid_id", "vendor_name"), "submission_id")
    return rows.groupBy("bid_id", "group_key").agg(F.count("*").alias("n_vendors"), F.min("amount").alias("min_amount"), F.min_by("vendor_name", F.struct("amount", "vendor_name")).alias("min_vendor"), F.max("amount").alias("max_amount"))


def chunk_ids(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with chunk, numbered from 0, of so many rows each."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
