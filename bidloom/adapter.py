"""The driver's star schema seen as the bid model.

A region is a project, a nation of ordering customers a bid, a supplier a vendor; a submission is a (nation, supplier) pair and a line
item an item of it. Parts are catalog items. Amounts are cents. The same views exist as SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.session import table

CANONICAL = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


class BidModel:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def projects(self) -> DataFrame:
        return self._t("region").select(F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("project_name"))

    @cached_property
    def bids(self) -> DataFrame:
        return self._t("nation").select(F.col("n_nationkey").alias("bid_id"), F.col("n_regionkey").alias("project_id"), F.col("n_name").alias("bid_name"), F.when(F.col("n_nationkey") % 2 == 0, "IT").otherwise("FACILITY").alias("domain"))

    @property
    def _path(self) -> Column:
        return F.concat_ws(" > ", "category", "brand", "name")

    @cached_property
    def parts(self) -> DataFrame:
        return self._t("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).withColumn("path", self._path)

    @cached_property
    def _lines(self) -> DataFrame:
        """Items without ids that are texts. Orders meet their customers before they meet lines, so that lines are shuffled once, and narrow."""
        customers = self._t("customer").select("c_custkey", F.col("c_nationkey").alias("bid_id"))
        orders = self._t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("bid_date"))
        owners = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "bid_date", "bid_id")
        nego = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
        amount = F.round(F.col("l_extendedprice") * 100).cast("long")
        price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
        lines = self._t("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus",
            F.col("l_quantity").alias("quantity"),
            F.when(nego, -F.abs(amount)).otherwise(amount).alias("amount"),
            F.when(nego, -F.abs(price)).otherwise(price).alias("unit_price"),
            nego.alias("is_nego"),
        )
        return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    @staticmethod
    def _identified(rows: DataFrame) -> DataFrame:
        """rows of _lines with what their keys give: made after the joins, so that no shuffle carries it."""
        item = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        rest = [c for c in rows.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "quantity", "amount", "unit_price", "is_nego", "bid_date", "bid_id")]
        return rows.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", item.alias("item_id"), "quantity", "amount", "unit_price", (F.col("l_linenumber") == 7).alias("is_header"),
            "is_nego", "bid_date", "bid_id", F.concat_ws("-", "bid_id", "l_suppkey").alias("submission_id"), *rest,
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Items without their rank and without part attributes: what listings and totals need."""
        return self._identified(self._lines)

    @cached_property
    def _parted(self) -> DataFrame:
        return self._lines.join(self.parts.drop("path"), F.col("l_partkey") == F.col("part_id"))

    def _named(self, rows: DataFrame) -> DataFrame:
        return self._identified(rows).withColumns({"path": self._path, "seq": F.struct("submission_id", "l_orderkey", "l_partkey", "l_linenumber", "amount", "quantity")})

    @cached_property
    def named(self) -> DataFrame:
        """Items with part attributes."""
        return self._named(self._parted)

    @cached_property
    def named_by_submission(self) -> DataFrame:
        """`named`, dealt by submission before ids, paths and places are made, which are several times as large: so in more parts than are usual."""
        parts = 4 * max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return self._named(self._parted.repartition(parts, F.concat_ws("-", "bid_id", "l_suppkey")))

    @cached_property
    def items(self) -> DataFrame:
        """Items with part attributes and sort_order, their rank in the submission."""
        w = Window.partitionBy("submission_id").orderBy("l_orderkey", "l_partkey", "l_linenumber")
        return self.named.withColumn("sort_order", F.row_number().over(w) - 1)

    @cached_property
    def submissions(self) -> DataFrame:
        heads = self.lines.groupBy("submission_id", "bid_id", "l_suppkey").agg(F.sum(F.when(~F.col("is_header"), F.col("amount"))).alias("subtotal"), F.count_if(~F.col("is_header")).alias("n_items"))
        vendors = self._t("supplier").select("s_suppkey", F.col("s_name").alias("vendor_name"))
        return self._status(heads.join(vendors, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey"))

    def _status(self, df: DataFrame) -> DataFrame:
        return df.withColumn("extraction_status", F.when(F.pmod("l_suppkey", F.lit(10)) == 9, "pending").otherwise("done")).withColumn("is_deleted", F.pmod(F.col("l_suppkey") + F.col("bid_id"), F.lit(13)) == 0)

    def with_status(self, items: DataFrame) -> DataFrame:
        """Items with their submission's status, which the keys give without a join."""
        return self._status(items)

    @cached_property
    def history(self) -> DataFrame:
        """Recorded prices: items of done submissions with a final status."""
        rows = self.lines.join(self.bids.select("bid_id", "project_id"), "bid_id").where("l_linestatus = 'F'")
        return self._status(rows).where("extraction_status = 'done'").select("item_id", "bid_id", "project_id", "submission_id", "l_suppkey", F.col("l_partkey").alias("catalog_item_id"), "unit_price", "amount", "bid_date", "is_deleted")

    @cached_property
    def clusters(self) -> DataFrame:
        return self.clusters_of(self.members_all)

    @staticmethod
    def clusters_of(members: DataFrame) -> DataFrame:
        """Clusters: (bid, name) with two vendors or more. Vendors are counted only where their number is asked for."""
        status = F.element_at(F.array(*map(F.lit, ("accepted", "pending", "held", "rejected"))), (F.pmod(F.length("name") + F.col("bid_id"), F.lit(4)) + 1).cast("int"))
        return members.groupBy("bid_id", "name").agg(F.count_distinct("l_suppkey").alias("n_vendors"), F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"), F.count("*").alias("n_members")).where("low <> high").select("bid_id", "name", F.concat_ws(":", "bid_id", "name").alias("cluster_id"), status.alias("status"), "n_vendors", "n_members")

    @cached_property
    def members_all(self) -> DataFrame:
        return self.named.where("NOT is_header")


VIEWS = {
    "bids": "SELECT n_nationkey AS bid_id, n_regionkey AS project_id, n_name AS bid_name, CASE WHEN n_nationkey % 2 = 0 THEN 'IT' ELSE 'FACILITY' END AS domain FROM nation",
    "lines": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_quantity AS quantity, CAST(o_orderdate AS DATE) AS bid_date, c_nationkey AS bid_id,
      concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item_id, concat_ws('-', c_nationkey, l_suppkey) AS submission_id,
      l_linenumber = 7 AS is_header, (l_returnflag = 'R' AND l_discount >= 0.09) AS is_nego,
      CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount,
      CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN -1 ELSE 1 END * CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_price,
      CASE WHEN l_suppkey % 10 = 9 THEN 'pending' ELSE 'done' END AS extraction_status, (l_suppkey + c_nationkey) % 13 = 0 AS is_deleted
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "named": "SELECT l.*, p_partkey AS part_id, p_name AS name, p_brand AS brand, p_type AS category, concat_ws(' > ', p_type, p_brand, p_name) AS path FROM lines l JOIN part ON l_partkey = p_partkey",
    "items": "SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY l_orderkey, l_partkey, l_linenumber) - 1 AS sort_order FROM named",
    "submissions": """SELECT submission_id, bid_id, l_suppkey, s_name AS vendor_name, extraction_status, is_deleted,
      sum(amount) FILTER (NOT is_header) AS subtotal, count(*) FILTER (NOT is_header) AS n_items
      FROM lines JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "history": "SELECT l.*, b.project_id, l_partkey AS catalog_item_id FROM lines l JOIN bids b ON l.bid_id = b.bid_id WHERE l_linestatus = 'F' AND extraction_status = 'done'",
    "clusters": """SELECT bid_id, name, concat_ws(':', bid_id, name) AS cluster_id, ['accepted', 'pending', 'held', 'rejected'][(length(name) + bid_id) % 4 + 1] AS status,
      count(DISTINCT l_suppkey) AS n_vendors, count(*) AS n_members FROM named WHERE NOT is_header GROUP BY bid_id, name HAVING count(DISTINCT l_suppkey) >= 2""",
}
NEEDS = {"named": ["lines"], "items": ["lines", "named"], "submissions": ["lines"], "history": ["bids", "lines"], "clusters": ["lines", "named"]}


def views(names: str, body: str) -> str:
    """body with the views it names, and those they need, before it."""
    wanted = {v for n in names.split() for v in [*NEEDS.get(n, []), n]}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted) + (", " if body.lstrip().startswith("--with") else " ") + body.lstrip().removeprefix("--with")
