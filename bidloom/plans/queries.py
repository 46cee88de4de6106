"""The engine's operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.adapter import CANONICAL, BidModel, views
from bidloom.functions import scalars as S
from bidloom.operators import clusters as C
from bidloom.operators import compare as P
from bidloom.operators import extract as X
from bidloom.operators import hierarchy as H
from bidloom.operators import lifecycle as L
from bidloom.operators import listing as G
from bidloom.operators import similarity as V
from bidloom.session import table
from bidloom.sources import report as R

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PROJECTS = "SELECT r_regionkey AS project_id, r_name AS project_name FROM region"


def query(needs: str, sql: str | None):
    """Register a query; its SQL may use the views named in needs."""

    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = views(needs, sql) if needs else sql
        return f

    return put


# Listings


@query("bids lines submissions", """SELECT r_regionkey AS project_id, r_name AS project_name, count(DISTINCT b.bid_id) AS n_bids, count(DISTINCT submission_id) AS n_submissions
  FROM region LEFT JOIN bids b ON b.project_id = r_regionkey LEFT JOIN submissions s ON s.bid_id = b.bid_id GROUP BY ALL""")  # fmt: skip
def project_overview(spark, d):
    m = BidModel(spark, d)
    return G.project_overview(m.projects, m.bids, m.submissions)


@query("bids submissions", """SELECT b.bid_id, b.project_id, bid_name, domain, r_name AS project_name, count(DISTINCT submission_id) AS n_done, min(subtotal) AS min_subtotal, max(subtotal) AS max_subtotal
  FROM bids b JOIN region ON r_regionkey = b.project_id LEFT JOIN submissions s ON s.bid_id = b.bid_id AND extraction_status = 'done' GROUP BY ALL""")  # fmt: skip
def bid_summary(spark, d):
    m = BidModel(spark, d)
    return G.bid_summary(m.bids, m.projects, m.submissions)


_LISTED = "SELECT submission_id, bid_id, vendor_name, extraction_status, subtotal, n_items FROM submissions WHERE "


def _listing(spark, d, deleted):
    m = BidModel(spark, d)
    return G.submission_listing(m.submissions, m.lines, deleted).select("submission_id", "bid_id", "vendor_name", "extraction_status", "subtotal", "n_items")


@query("submissions", _LISTED + "NOT is_deleted ORDER BY subtotal NULLS LAST")
def submission_listing(spark, d):
    return _listing(spark, d, False).orderBy(F.asc_nulls_last("subtotal"))


@query("submissions", _LISTED + "is_deleted")
def deleted_submissions(spark, d):
    return _listing(spark, d, True)


@query("lines", "SELECT submission_id, coalesce(sum(amount) FILTER (NOT is_header), 0) AS subtotal, count(*) FILTER (is_nego) AS n_nego FROM lines GROUP BY 1")
def submission_subtotal(spark, d):
    return G.submission_subtotal(BidModel(spark, d).lines)


@query("bids submissions", """SELECT b.bid_id, b.project_id, bid_name, domain, r_name AS project_name, count(*) AS n_done FROM bids b JOIN region ON r_regionkey = b.project_id
  JOIN submissions s ON s.bid_id = b.bid_id WHERE extraction_status = 'done' GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def bids_ready_for_clustering(spark, d):
    m = BidModel(spark, d)
    return G.bids_ready(m.bids, m.projects, m.submissions)


_FOUND = ["item_id", "name", "brand", "unit_price", "amount", "bid_name", "project_name", "bid_date"]


@query("bids named", "SELECT item_id, name, brand, unit_price, amount, bid_name, r_name AS project_name, bid_date FROM named n JOIN bids b ON n.bid_id = b.bid_id JOIN region ON r_regionkey = b.project_id WHERE NOT is_header AND (name ILIKE '%RING%' OR brand ILIKE '%#1_%')")
def price_search(spark, d):
    m = BidModel(spark, d)
    return G.price_search(m.named.drop("seq"), m.bids, m.projects, "RING", ("name",)).select(*_FOUND).unionByName(G.price_search(m.named.where(~G.contains("name", "RING")), m.bids, m.projects, "#1_", ("brand",)).select(*_FOUND))


@query("bids named", "SELECT item_id, name, brand, unit_price, amount, bid_name, r_name AS project_name, bid_date FROM named n JOIN bids b ON n.bid_id = b.bid_id JOIN region ON r_regionkey = b.project_id WHERE NOT is_header AND name ILIKE '%widget%' AND b.project_id = 2")
def price_search_project(spark, d):
    m = BidModel(spark, d)
    return G.price_search(m.named, m.bids, m.projects, "widget", project_id=2).select(*_FOUND)


def _categories(spark, d):
    parts = table(spark, d, "part")
    none = F.lit(None).cast("string")
    top = parts.select(F.col("p_type").alias("category_id"), F.col("p_type").alias("category_name"), none.alias("parent_id")).distinct()
    low = parts.select(F.concat_ws("/", "p_type", "p_brand").alias("category_id"), F.col("p_brand").alias("category_name"), F.col("p_type").alias("parent_id")).distinct()
    return top.unionByName(low)


def _catalog(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("catalog_item_id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_type", "p_brand").alias("category_id"), F.array(F.concat_ws(" ", "p_brand", "p_name")).alias("aliases"), (F.col("p_size") % 5 != 0).alias("is_active"))


_CATEGORIES = "SELECT DISTINCT p_type AS category_id, p_type AS category_name, NULL AS parent_id FROM part UNION ALL SELECT DISTINCT concat_ws('/', p_type, p_brand), p_brand, p_type FROM part"


@query("", f"""WITH c AS ({_CATEGORIES}) SELECT c.category_id, c.category_name, c.parent_id, p.category_name AS parent_name, count(p_partkey) AS n_items
  FROM c LEFT JOIN c p ON c.parent_id = p.category_id LEFT JOIN part ON concat_ws('/', p_type, p_brand) = c.category_id AND p_size % 5 <> 0 GROUP BY ALL""")  # fmt: skip
def category_listing(spark, d):
    return G.category_listing(_categories(spark, d), _catalog(spark, d))


@query("history", f"SELECT count(*) FILTER (p_size % 5 <> 0) AS n_items, (SELECT count(*) FROM ({_CATEGORIES})) AS n_categories, (SELECT count(DISTINCT catalog_item_id) FROM history) AS n_matched FROM part")
def catalog_stats(spark, d):
    return G.catalog_stats(_catalog(spark, d), _categories(spark, d), BidModel(spark, d).history)


@query("bids submissions history", """SELECT domain, count(DISTINCT b.bid_id) AS n_bids, count(DISTINCT b.project_id) AS n_projects,
  (SELECT count(*) FROM submissions s JOIN bids x ON s.bid_id = x.bid_id WHERE x.domain = b.domain) AS n_submissions,
  (SELECT count(*) FROM history h JOIN bids x ON h.bid_id = x.bid_id WHERE x.domain = b.domain) AS n_prices FROM bids b GROUP BY domain""")  # fmt: skip
def domain_impact(spark, d):
    m = BidModel(spark, d)
    return G.domain_impact(m.bids, m.submissions, m.history)


@query("submissions", """SELECT bid_id, count(*) FILTER (extraction_status = 'done') AS n_done, count(*) FILTER (extraction_status = 'pending') AS n_pending,
  count(*) FILTER (extraction_status = 'failed') AS n_failed, count(*) AS n_total FROM submissions GROUP BY 1""")  # fmt: skip
def status_histogram(spark, d):
    return G.status_histogram(BidModel(spark, d).submissions, ["bid_id"], "extraction_status", ["done", "pending", "failed"])


@query("lines", "SELECT item_id, submission_id, p_name AS name, p_type AS category_name, p_brand AS brand FROM lines LEFT JOIN part ON p_partkey = l_partkey AND p_size % 5 <> 0")
def items_with_match(spark, d):
    parts = table(spark, d, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("catalog_item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category_id"))
    kinds = table(spark, d, "part").select(F.col("p_type").alias("category_id"), F.col("p_type").alias("category_name")).distinct()
    lines = BidModel(spark, d).lines.select("item_id", "submission_id", F.col("l_partkey").alias("catalog_item_id"))
    return G.items_with_match(lines, parts, kinds).select("item_id", "submission_id", "name", "category_name", "brand")


@query("history", "SELECT catalog_item_id, item_id, unit_price, bid_date, s_name AS vendor_name FROM history JOIN supplier ON l_suppkey = s_suppkey ORDER BY catalog_item_id, bid_date DESC")
def price_history(spark, d):
    vendors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("vendor_name"))
    return BidModel(spark, d).history.join(vendors, "l_suppkey").select("catalog_item_id", "item_id", "unit_price", "bid_date", "vendor_name").orderBy("catalog_item_id", F.desc("bid_date"))


# Hierarchy

_LEVELS = "list_slice(string_split(path, ' > '), 1, {n})"


def _level(n: int):
    def f(spark, d):
        rows = BidModel(spark, d).named
        return H.level_rollup(rows, n).select("submission_id", "group_path", "label", "amount", "n_items", "max_depth")

    f.__name__ = f"level_rollup_{n}"
    levels = _LEVELS.format(n=n)
    query("named", f"SELECT submission_id, array_to_string({levels}, ' > ') AS group_path, max({levels}[-1]) AS label, sum(amount) AS amount, count(*) AS n_items, 3 AS max_depth FROM named WHERE NOT is_header GROUP BY 1, 2")(f)


for _n in (1, 2, 3):
    _level(_n)


@query("named", """--with nodes AS (SELECT submission_id, amount, string_split(path, ' > ') AS parts, unnest(range(1, 4)) AS depth FROM named WHERE NOT is_header)
  SELECT submission_id, array_to_string(list_slice(parts, 1, depth), ' > ') AS node, CAST(depth AS INTEGER) AS depth, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n_items, depth = 3 AS is_leaf FROM nodes GROUP BY submission_id, node, depth""")  # fmt: skip
def tree_rollup(spark, d):
    return H.tree_rollup(BidModel(spark, d).named)


def _units(rows: DataFrame) -> DataFrame:
    """Units for the grouping queries: every category, and the brands whose number is even."""
    keys = rows.select("submission_id", "category", "brand").distinct()
    even = F.when(F.expr("CAST(split(brand, '#')[1] AS INT) % 2 = 0"), F.concat_ws(" > ", "category", "brand"))
    # one pass over the keys, so that units stay where their keys are
    return keys.select("submission_id", F.explode(F.array("category", even)).alias("unit")).distinct().where("unit <> 'SMALL' AND unit <> 'PROMO'")


_UNIT = "CASE WHEN CAST(string_split(brand, '#')[2] AS INTEGER) % 2 = 0 THEN category || ' > ' || brand WHEN category NOT IN ('SMALL', 'PROMO') THEN category END"


def _grouping(name: str, normalize: bool, key: str, unmatched: str, place: str):
    def f(spark, d):
        rows = BidModel(spark, d).named
        return H.group_by_unit(rows, _units(rows), normalize, key, unmatched, sample=0).select("submission_id", "group_key", "amount", "n_items", "is_unit")

    f.__name__ = name
    query("named", f"SELECT submission_id, {place} AS group_key, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n_items, bool_or({_UNIT} IS NOT NULL) AS is_unit FROM named WHERE NOT is_header GROUP BY 1, 2")(f)


_grouping("unit_grouping_label", False, "label", "self", f"string_split(coalesce({_UNIT}, path), ' > ')[-1]")
_grouping("unit_grouping_path", False, "path", "self", f"coalesce({_UNIT}, path)")
_grouping("unit_grouping_passthrough", True, "path", "passthrough", f"coalesce({_UNIT}, '#' || item_id)")


@query("named submissions", f"""--with g AS (SELECT submission_id, string_split(coalesce({_UNIT}, path), ' > ')[-1] AS group_key, CAST(sum(amount) AS BIGINT) AS amount FROM named WHERE NOT is_header GROUP BY 1, 2)
  SELECT s.bid_id, group_key, count(*) AS n_vendors, min(amount) AS min_amount, arg_min(vendor_name, (amount, vendor_name)) AS min_vendor, max(amount) AS max_amount FROM g JOIN submissions s ON g.submission_id = s.submission_id GROUP BY 1, 2""")  # fmt: skip
def compare_units(spark, d):
    m = BidModel(spark, d)
    grouped = H.group_by_unit(m.named, _units(m.named), False, "label", "self", sample=0)
    return H.unit_totals_pivot(grouped, m.submissions)


# Comparison

_LIVE = "live AS (SELECT *, l_suppkey AS vendor_id, (submission_id, l_orderkey, l_partkey, l_linenumber, amount, quantity) AS seq FROM named WHERE NOT is_header AND extraction_status = 'done' AND NOT is_deleted)"
_PIVOT = """split AS (SELECT bid_id, category, name, count(DISTINCT path) > 1 AS conflict FROM live GROUP BY 1, 2, 3),
  keyed AS (SELECT l.*, CASE WHEN conflict THEN path ELSE l.name END AS row_key FROM live l JOIN split s ON l.bid_id = s.bid_id AND l.category = s.category AND l.name = s.name),
  heads AS (SELECT bid_id, category, row_key, arg_min(brand, seq) AS spec, arg_min(path, seq) AS path FROM keyed GROUP BY 1, 2, 3),
  final AS (SELECT bid_id, category, row_key, vendor_id, arg_max(unit_price, seq) AS unit_price, arg_max(quantity, seq) AS quantity, arg_max(amount, seq) AS amount FROM keyed GROUP BY 1, 2, 3, 4),
  rows_ AS (SELECT l.*, spec, path FROM final l JOIN heads h ON l.bid_id = h.bid_id AND l.category = h.category AND l.row_key = h.row_key)"""


def _live(spark, d) -> DataFrame:
    m = BidModel(spark, d)
    return P.live_items(m.with_status(m.named)).withColumn("vendor_id", F.col("l_suppkey"))


@query("named", f"--with {_LIVE}, {_PIVOT} SELECT bid_id, category, row_key, vendor_id, unit_price, quantity, amount, spec, path FROM rows_")
def compare_pivot_long(spark, d):
    return P.compare_pivot(_live(spark, d)).drop("item_id")


@query("named", f"""--with {_LIVE}, {_PIVOT} SELECT bid_id, category, row_key, min(unit_price) AS min_price, arg_min(vendor_id, (unit_price, vendor_id)) AS min_vendor,
  CASE WHEN count(*) > 1 THEN max(unit_price) END AS max_price, CASE WHEN count(*) > 1 THEN arg_max(vendor_id, (unit_price, -vendor_id)) END AS max_vendor, count(*) AS n_prices FROM rows_ WHERE unit_price <> 0 GROUP BY 1, 2, 3""")  # fmt: skip
def row_min_max_vendor(spark, d):
    return P.row_extremes(P.compare_pivot(_live(spark, d)))


@query("named", f"--with {_LIVE} SELECT bid_id, name, count(DISTINCT path) AS n_paths FROM live GROUP BY 1, 2 HAVING count(DISTINCT path) > 1")
def name_conflicts(spark, d):
    return P.name_conflicts(_live(spark, d), ["bid_id"])


@query("named", f"""--with {_LIVE}, v AS (SELECT DISTINCT bid_id, vendor_id FROM live), c AS (SELECT unnest({CANONICAL}) AS category)
  SELECT v.bid_id, v.vendor_id, c.category, CAST(coalesce(sum(amount), 0) AS BIGINT) AS total FROM v CROSS JOIN c LEFT JOIN live l ON l.bid_id = v.bid_id AND l.vendor_id = v.vendor_id AND l.category = c.category GROUP BY 1, 2, 3""")  # fmt: skip
def category_totals(spark, d):
    return P.category_totals(_live(spark, d), CANONICAL)


@query("named", f"""--with {_LIVE}, s AS (SELECT bid_id, category, min(seq) AS seen FROM live GROUP BY 1, 2)
  SELECT bid_id, category, CAST(row_number() OVER (PARTITION BY bid_id ORDER BY coalesce(list_position({CANONICAL}, category), 99), seen) AS INTEGER) AS place FROM s""")  # fmt: skip
def category_order(spark, d):
    return P.category_order(_live(spark, d), CANONICAL)


@query("submissions", """SELECT submission_id, bid_id, vendor_name, subtotal, CAST(row_number() OVER (PARTITION BY bid_id ORDER BY subtotal NULLS LAST, vendor_name) AS INTEGER) AS vendor_rank
  FROM submissions WHERE extraction_status = 'done' AND NOT is_deleted""")  # fmt: skip
def vendor_ranking(spark, d):
    return P.vendors(BidModel(spark, d).submissions).select("submission_id", "bid_id", "vendor_name", "subtotal", "vendor_rank")


_OTHERS = "h AS (SELECT r_regionkey AS pid, x.* FROM region JOIN history x ON x.project_id <> r_regionkey WHERE unit_price > 0 AND NOT is_deleted)"


@query("history", f"""--with {_OTHERS} SELECT pid AS project_id, catalog_item_id, min(unit_price) AS min_price, max(unit_price) AS max_price, CAST(sum(unit_price) AS DOUBLE) / count(*) AS avg_price,
  CAST(sum(amount) AS DOUBLE) / count(*) AS avg_amount, count(*) AS n_prices, count(DISTINCT bid_id) AS n_bids FROM h GROUP BY 1, 2""")  # fmt: skip
def benchmark_by_project(spark, d):
    m = BidModel(spark, d)
    return P.benchmark(m.history, m.projects)


@query("history", f"""--with {_OTHERS} SELECT pid AS project_id, catalog_item_id, min(unit_price) AS unit_price, arg_min(bid_date, k) AS bid_date, arg_min(item_id, k) AS item_id, arg_min(bid_id, k) AS source_bid, arg_min(l_suppkey, k) AS vendor_id
  FROM (SELECT *, (unit_price, bid_date, item_id, bid_id, l_suppkey) AS k FROM h) GROUP BY 1, 2""")  # fmt: skip
def benchmark_cheapest(spark, d):
    m = BidModel(spark, d)
    return P.cheapest(m.history, m.projects)


@query("bids lines history", f"""--with {_OTHERS}, b AS (SELECT pid, catalog_item_id, min(unit_price) AS low FROM h GROUP BY 1, 2),
  own AS (SELECT project_id, l_partkey, min(unit_price) AS price FROM lines JOIN bids ON lines.bid_id = bids.bid_id WHERE NOT is_header AND extraction_status = 'done' AND NOT is_deleted AND unit_price > 0 GROUP BY 1, 2)
  SELECT project_id, l_partkey AS catalog_item_id, price, low AS benchmark, CAST(floor(CAST((price - low) * 10000 AS DOUBLE) / low) AS BIGINT) AS deviation FROM own JOIN b ON pid = project_id AND catalog_item_id = l_partkey""")  # fmt: skip
def benchmark_deviation(spark, d):
    m = BidModel(spark, d)
    live = P.live_items(m.with_status(m.lines)).where("unit_price > 0").join(m.bids.select("bid_id", "project_id"), "bid_id")
    own = live.groupBy("project_id", F.col("l_partkey").alias("catalog_item_id")).agg(F.min("unit_price").alias("price"))
    both = own.join(P.benchmark(m.history, m.projects, own).select("project_id", "catalog_item_id", F.col("min_price").alias("benchmark")), ["project_id", "catalog_item_id"])
    return both.withColumn("deviation", P.deviation(F.col("price"), F.col("benchmark")))


_WANTED = "SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT lower(concat_ws(' ', p_brand, p_name)) FROM part WHERE p_size < 10 UNION SELECT 'no such thing'"


def _wanted(spark, d):
    parts = table(spark, d, "part")
    return parts.select(F.upper("p_name").alias("name")).union(parts.where("p_size < 10").select(F.lower(F.concat_ws(" ", "p_brand", "p_name")))).union(spark.sql("SELECT 'no such thing'")).distinct()


@query("", f"""WITH k AS (SELECT 0 AS tier, lower(p_name) AS key, p_partkey FROM part UNION ALL SELECT 1, lower(concat_ws(' ', p_brand, p_name)), p_partkey FROM part),
  b AS (SELECT key, min((tier, p_partkey)) AS m FROM k GROUP BY key) SELECT name, m[2] AS catalog_item_id, m[1] AS tier FROM ({_WANTED}) LEFT JOIN b ON lower(name) = key""")  # fmt: skip
def catalog_lookup(spark, d):
    return P.catalog_lookup(_wanted(spark, d), _catalog(spark, d))


@query("", f"SELECT name, lower(name) IN (SELECT lower(p_name) FROM part) OR lower(name) IN (SELECT lower(concat_ws(' ', p_brand, p_name)) FROM part) AS is_known FROM ({_WANTED})")
def catalog_match_flag(spark, d):
    return P.catalog_lookup(_wanted(spark, d), _catalog(spark, d)).select("name", F.col("catalog_item_id").isNotNull().alias("is_known"))


@query("", "SELECT item_id, vendor_id, fx_rate FROM (SELECT event_id AS item_id, user_id AS vendor_id, CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'click' THEN NULL ELSE value END AS fx_rate FROM events) WHERE fx_rate <> 0")
def fx_rate_filter(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("submission_id"), F.col("user_id").alias("vendor_name"), F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") != "click", F.col("value")).alias("fx_rate"))
    return P.fx_rates(rows).select(F.col("submission_id").alias("item_id"), F.col("vendor_name").alias("vendor_id"), "fx_rate")


# Clusters

_MEMBERS = "members AS (SELECT c.cluster_id, c.status, n.*, l_suppkey AS vendor_id FROM clusters c JOIN named n ON c.bid_id = n.bid_id AND c.name = n.name WHERE NOT is_header)"


def _members(spark, d) -> DataFrame:
    m = BidModel(spark, d)
    return C.members(m.clusters, m.members_all).withColumn("vendor_id", F.col("l_suppkey"))


@query("clusters", f"--with {_MEMBERS} SELECT cluster_id, item_id, status, vendor_id, amount, unit_price FROM members")
def cluster_members(spark, d):
    return _members(spark, d).select("cluster_id", "item_id", "status", "vendor_id", "amount", "unit_price")


@query("clusters", """SELECT bid_id, count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'held') AS n_held,
  count(*) FILTER (status = 'rejected') AS n_rejected, count(*) AS n_total FROM clusters GROUP BY 1""")  # fmt: skip
def cluster_summary(spark, d):
    return C.summary(BidModel(spark, d).clusters, ["bid_id"])


@query("clusters", f"""--with {_MEMBERS}, v AS (SELECT cluster_id, vendor_id, CAST(sum(amount) AS BIGINT) AS total, min(unit_price) FILTER (unit_price <> 0) AS price FROM members GROUP BY 1, 2)
  SELECT cluster_id, count(*) AS n_vendors, min(total) AS min_total, arg_min(vendor_id, (total, vendor_id)) AS min_vendor, arg_min(price, (total, vendor_id)) AS min_vendor_price,
  CASE WHEN count(*) > 1 THEN max(total) END AS max_total, CASE WHEN count(*) > 1 THEN arg_max(vendor_id, (total, -vendor_id)) END AS max_vendor FROM v GROUP BY 1""")  # fmt: skip
def cluster_vendor_totals(spark, d):
    return C.vendor_totals(_members(spark, d))


@query("clusters", f"""--with {_MEMBERS}, n AS (SELECT cluster_id, category, count(*) AS n, min((submission_id, l_orderkey, l_partkey, l_linenumber, amount, quantity)) AS seen FROM members GROUP BY 1, 2)
  SELECT cluster_id, arg_min(category, (-n, seen)) AS category FROM n GROUP BY 1""")  # fmt: skip
def cluster_category(spark, d):
    return P.majority(_members(spark, d), ["cluster_id"], "category", "seq")


@query("clusters", f"--with {_MEMBERS} SELECT cluster_id, string_agg(DISTINCT brand, ' | ' ORDER BY brand) AS brands, count(*) AS n_members FROM members GROUP BY 1")
def cluster_names(spark, d):
    return C.member_names(_members(spark, d))


@query("clusters", f"--with {_MEMBERS} SELECT item_id, bid_id, name FROM named WHERE NOT is_header AND item_id NOT IN (SELECT item_id FROM members WHERE status <> 'rejected')")
def unclustered_items(spark, d):
    m = BidModel(spark, d)
    return C.unclustered(m.members_all, _members(spark, d).where(F.col("status").isin(C.OPEN))).select("item_id", "bid_id", "name")


_SCORED = "scored AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) = 1 AS is_representative, 1 - (l_linenumber % 3) * 0.0625 AS similarity_score FROM members)"


@query("clusters", f"--with {_MEMBERS}, {_SCORED} SELECT cluster_id, coalesce(bool_and(similarity_score >= 0.9) FILTER (NOT is_representative), false) AS is_confident FROM scored GROUP BY 1")
def cluster_confidence(spark, d):
    rows = _members(spark, d)
    first = rows.groupBy("cluster_id").agg(F.min("item_id").alias("item_id"), F.lit(True).alias("is_representative"))
    scored = rows.join(first, ["cluster_id", "item_id"], "left").fillna(False, ["is_representative"]).withColumn("similarity_score", 1 - (F.col("l_linenumber") % 3) * 0.0625)
    return C.high_confidence(scored)


_MAP = "map AS (SELECT c.cluster_id AS source, concat_ws(':', 0, c.name) AS target FROM clusters c WHERE bid_id <> 0 AND bid_id % 5 = 0 AND concat_ws(':', 0, c.name) IN (SELECT cluster_id FROM clusters))"


def _mapping(clusters: DataFrame) -> DataFrame:
    target = clusters.where("bid_id = 0").select("name", F.col("cluster_id").alias("target"))
    return clusters.where("bid_id <> 0 AND bid_id % 5 = 0").join(target, "name").select(F.col("cluster_id").alias("source"), "target")


@query("clusters", f"""--with {_MEMBERS}, {_MAP}, moved AS (SELECT DISTINCT coalesce(target, cluster_id) AS cluster_id, item_id FROM members LEFT JOIN map ON source = cluster_id)
  SELECT c.cluster_id, CASE WHEN target IS NOT NULL THEN 'rejected' ELSE status END AS status, (SELECT count(*) FROM moved m WHERE m.cluster_id = c.cluster_id) AS n_members FROM clusters c LEFT JOIN map ON source = c.cluster_id""")  # fmt: skip
def merge_clusters(spark, d):
    found = BidModel(spark, d).clusters
    status, moved = C.merge(found, _members(spark, d).select("cluster_id", "item_id"), _mapping(found))
    counts = moved.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    return status.select("cluster_id", "status").join(counts, "cluster_id", "left").fillna(0, ["n_members"])


@query("clusters", f"""--with {_MEMBERS}, acc AS (SELECT DISTINCT cluster_id, bid_id, l_partkey AS catalog_item_id FROM members WHERE status = 'accepted'),
  gone AS (SELECT * FROM acc WHERE bid_id % 2 = 1), orphan AS (SELECT DISTINCT catalog_item_id FROM gone WHERE catalog_item_id NOT IN (SELECT catalog_item_id FROM acc WHERE bid_id % 2 = 0))
  SELECT p_partkey AS catalog_item_id, (SELECT count(*) FROM members m WHERE m.status = 'accepted' AND m.l_partkey = p_partkey AND m.bid_id % 2 = 0) AS n_history FROM part WHERE p_partkey NOT IN (SELECT catalog_item_id FROM orphan)""")  # fmt: skip
def reopen_release(spark, d):
    rows = _members(spark, d).where("status = 'accepted'").withColumn("catalog_item_id", F.col("l_partkey"))
    accepted = rows.select("cluster_id", "bid_id", "catalog_item_id").distinct()
    catalog, history = C.release(accepted, accepted.where("bid_id % 2 = 1").select("cluster_id").distinct(), rows.select("cluster_id", "catalog_item_id", "item_id"), _catalog(spark, d).select("catalog_item_id"))
    return catalog.join(history.groupBy("catalog_item_id").agg(F.count("*").alias("n_history")), "catalog_item_id", "left").fillna(0, ["n_history"])


@query("clusters", f"""--with {_MEMBERS}, rest AS (SELECT cluster_id, item_id FROM members WHERE NOT (l_linenumber = 1 AND vendor_id % 2 = 0)),
  hit AS (SELECT DISTINCT cluster_id FROM members WHERE l_linenumber = 1 AND vendor_id % 2 = 0), gone AS (SELECT h.cluster_id FROM hit h LEFT JOIN rest r ON h.cluster_id = r.cluster_id GROUP BY 1 HAVING count(item_id) < 2)
  SELECT cluster_id, count(*) AS n_left FROM rest WHERE cluster_id NOT IN (SELECT cluster_id FROM gone) GROUP BY 1""")  # fmt: skip
def validation_removals(spark, d):
    rows = _members(spark, d)
    left, _ = C.remove_members(rows, rows.where("l_linenumber = 1 AND vendor_id % 2 = 0").select("cluster_id", "item_id"))
    return left.groupBy("cluster_id").agg(F.count("*").alias("n_left"))


@query("named", """--with p AS (SELECT bid_id, replace(lower(name), ' ', '') AS key, count(*) AS n_items, count(DISTINCT l_suppkey) AS n_vendors, arg_min(item_id, (submission_id, l_orderkey, l_partkey, l_linenumber, amount, quantity)) AS rep_item_id FROM named WHERE NOT is_header GROUP BY 1, 2)
  SELECT concat_ws(':', bid_id, key) AS cluster_id, n_items, n_vendors, rep_item_id FROM p WHERE n_items >= 2 AND n_vendors >= 2""")  # fmt: skip
def cluster_proposals(spark, d):
    rows = BidModel(spark, d).members_all.withColumn("vendor_id", F.col("l_suppkey"))
    return C.valid_clusters(C.block_clusters(rows, ["bid_id"]), rows).select("cluster_id", "n_items", "n_vendors", "rep_item_id")


@query("clusters", f"""--with {_MEMBERS}, a AS (SELECT * FROM clusters WHERE status = 'pending'), h AS (SELECT DISTINCT (SELECT min(p_partkey) FROM part WHERE p_name = m.name) AS catalog_item_id, item_id, unit_price FROM members m WHERE status = 'pending' AND unit_price <> 0)
  SELECT catalog_item_id, count(*) AS n_prices, min(unit_price) AS min_price FROM h GROUP BY 1""")  # fmt: skip
def accept_clusters(spark, d):
    found = BidModel(spark, d).clusters.where("status = 'pending'")
    catalog = _catalog(spark, d).withColumn("catalog_item_id", F.lpad(F.col("catalog_item_id").cast("string"), 12, "0"))
    _, history = C.accept(found, _members(spark, d).where("status = 'pending'"), catalog)
    return history.groupBy(F.col("catalog_item_id").cast("bigint").alias("catalog_item_id")).agg(F.count("*").alias("n_prices"), F.min("unit_price").alias("min_price"))


@query("clusters", f"""--with {_MEMBERS} SELECT cluster_id, concat_ws(' ', min(name), string_agg(DISTINCT concat_ws(' ', name, brand), ' ' ORDER BY concat_ws(' ', name, brand))) AS text FROM members GROUP BY 1""")
def cluster_texts(spark, d):
    return V.cluster_text(_members(spark, d))


# Similarity


@query("", """WITH a AS (SELECT vec_id AS anchor_id, embedding AS anchor FROM embeddings WHERE vec_id % 100 = 0),
  s AS (SELECT anchor_id, vec_id AS other, round(list_cosine_similarity(CAST(anchor AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS similarity FROM embeddings JOIN a ON vec_id <> anchor_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, other) AS INTEGER) AS place FROM s WHERE similarity >= 0.25)
  SELECT anchor_id, place, other, similarity FROM r WHERE place <= 3""")  # fmt: skip
def cosine_top3(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", least=0.25)


@query("", None)
def lexical_similarity(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"))
    return V.lexical(names, names.where("part_id % 100 = 0"), "part_id", "text", 0.55)


# Extraction

_SHEET = """sheet AS (SELECT CONCAT('parts-', p_partkey // 40) AS file, p_partkey % 40 + 1 AS row, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS cat1, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS cat2,
  p_name AS name, p_retailprice AS price FROM part)"""


def _sheet(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("parts-"), F.floor(F.col("p_partkey") / 40)).alias("file"), (F.col("p_partkey") % 40 + 1).alias("row"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("cat1"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("cat2"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


@query("", f"""WITH {_SHEET}, one AS (SELECT file, row, name, cat2 AS own, last_value(cat1 IGNORE NULLS) OVER w AS cat1 FROM sheet WINDOW w AS (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING))
  SELECT file, row, name, cat1, coalesce(last_value(own IGNORE NULLS) OVER w, first_value(cat1 IGNORE NULLS) OVER w) AS cat2 FROM one WINDOW w AS (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def fill_down(spark, d):
    return X.fill_down(_sheet(spark, d), ["file"], "row", ["cat1", "cat2"]).select("file", "row", "name", "cat1", "cat2")


@query("", f"""WITH {_SHEET}, n AS (SELECT file, row, name, CAST(floor(price / 7) AS BIGINT) % 3 AS label FROM sheet), b AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY file ORDER BY row)),
  r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY file ORDER BY row) AS BIGINT) AS run FROM b) SELECT file, row, run, (row_number() OVER (PARTITION BY file, run ORDER BY row) - 1) // 3 AS chunk FROM r""")  # fmt: skip
def run_chunks(spark, d):
    rows = _sheet(spark, d).withColumn("label", F.floor(F.col("price") / 7) % 3)
    return X.runs(rows, ["file"], "row", "label", most=3).select("file", "row", "run", "chunk")


_LINES = "split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query("", f"WITH {_LINES} SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 150 AS chunk, length(line) AS n_chars FROM split")
def line_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return H.chunk_ids(rows, ["doc_id"], ["line_no"], 150).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "chunk", F.length("line").cast("bigint").alias("n_chars"))


@query("", "SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS cleaned, CASE WHEN regexp_matches(v, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$') THEN TRY_CAST(v AS DOUBLE) END AS strict FROM (SELECT *, regexp_replace(CASE event_id % 4 WHEN 0 THEN '₩' || CAST(user_id AS VARCHAR) || ',000' WHEN 1 THEN '$ ' || CAST(user_id AS VARCHAR) || '.5' WHEN 2 THEN event_type ELSE CAST(user_id AS VARCHAR) || ' 원' END, '[,\\s₩원$]', '', 'g') AS v FROM events)")
def number_cleaning(spark, d):
    user = F.col("user_id").cast("string")
    shown = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("₩"), user, F.lit(",000"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("$ "), user, F.lit(".5"))).when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise(F.concat(user, F.lit(" 원")))
    return table(spark, d, "events").select("event_id", S.clean_number(F.col("props")).alias("cleaned"), S.strict_number(shown).alias("strict"))


@query("", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scalars(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_FOREIGN = "f AS (SELECT l_orderkey AS sub, (l_partkey, l_suppkey, l_linenumber) AS seq, l_quantity AS quantity, floor(l_extendedprice / 1000) AS price, floor(l_extendedprice / 1000) * l_quantity * (400 + l_partkey % 1800) AS amount, CASE WHEN l_tax > 0.02 THEN 'USD' ELSE 'KRW' END AS currency FROM lineitem)"


@query("", f"""WITH {_FOREIGN}, r AS (SELECT *, CASE WHEN price * quantity <> 0 THEN amount / (price * quantity) END AS rate FROM f WHERE currency = 'USD')
  SELECT sub, round_even(arg_min(rate, seq), 0) AS fx_rate FROM r WHERE rate BETWEEN 500 AND 2000 GROUP BY 1""")  # fmt: skip
def fx_derivation(spark, d):
    price = F.floor(F.col("l_extendedprice") / 1000).cast("double")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sub"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("seq"), F.col("l_quantity").alias("quantity"), price.alias("price"), (price * F.col("l_quantity") * (400 + F.col("l_partkey") % 1800)).alias("amount"), F.when(F.col("l_tax") > 0.02, "USD").otherwise("KRW").alias("currency"))
    return X.fx_rate(rows, "sub", "seq")


@query("lines", """--with s AS (SELECT l_orderkey AS order_id, CAST(sum(amount) FILTER (NOT is_header) AS BIGINT) AS items_sum FROM lines GROUP BY 1)
  SELECT o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS stated, items_sum, CAST(floor(CAST(abs(items_sum - CAST(round(o_totalprice * 100) AS BIGINT)) * 10000 AS DOUBLE) / abs(CAST(round(o_totalprice * 100) AS BIGINT))) AS BIGINT) AS discrepancy,
  coalesce(floor(CAST(abs(items_sum - CAST(round(o_totalprice * 100) AS BIGINT)) * 10000 AS DOUBLE) / abs(CAST(round(o_totalprice * 100) AS BIGINT))) <= 100, false) AS matches FROM orders LEFT JOIN s ON order_id = o_orderkey""")  # fmt: skip
def extraction_validation(spark, d):
    stated = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("stated"))
    return X.validate_sums(BidModel(spark, d).lines.withColumn("order_id", F.col("l_orderkey")), stated, "order_id")


_PAGES = ["랙 배치도", "Front View 1", "시스템 구성도", "Logical 구성도", "거래조건", "거 래 조 건", "견적서", "견적서 명세", "명세", "drawing"]


@query("", f"""SELECT event_id, ['DRAWING', 'DRAWING', 'UNKNOWN', 'DIAGRAM', 'TERMS', 'TERMS', 'SUMMARY (갑지)', 'DETAIL (명세)', 'DETAIL (명세)', 'UNKNOWN'][event_id % 10 + 1] AS first_lines,
  'UNKNOWN' AS sixth_line FROM events""")  # fmt: skip
def page_type(spark, d):
    head = F.element_at(F.array(*map(F.lit, _PAGES)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.page_type(F.concat(F.lit("x\n"), head)).alias("first_lines"), X.page_type(F.concat(F.lit("\n\n\n\n\n"), head)).alias("sixth_line"))


@query("", f"""WITH {_SHEET}, c AS (SELECT file, row, (cat1 IS NOT NULL)::INT + (cat2 IS NOT NULL)::INT + 1 AS n FROM sheet WHERE row <= 6) SELECT file, arg_min(row, (-n, row)) AS header_row, CAST(max(n) AS BIGINT) AS n_cells FROM c GROUP BY 1""")
def header_guess(spark, d):
    cells = _sheet(spark, d).select("file", F.lit("1").alias("sheet"), "row", F.posexplode(F.array("cat1", "cat2", "name")).alias("col", "value"))
    return X.header_row(cells).select("file", "header_row", "n_cells")


@query("", """WITH m AS (SELECT p_partkey * 4 AS r1, p_partkey * 4 + p_size % 4 AS r2, p_size % 3 AS c1, p_size % 3 + p_size % 2 AS c2, p_type AS value FROM part)
  SELECT CAST(row AS BIGINT) AS row, CAST(col AS INTEGER) AS col, value FROM (SELECT unnest(range(r1, r2 + 1)) AS row, c1, c2, value FROM m), LATERAL (SELECT unnest(range(c1, c2 + 1)) AS col)""")  # fmt: skip
def merged_cells(spark, d):
    parts = table(spark, d, "part").select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), (F.col("p_partkey") * 4).alias("r1"), (F.col("p_partkey") * 4 + F.col("p_size") % 4).alias("r2"), (F.col("p_size") % 3).alias("c1"), (F.col("p_size") % 3 + F.col("p_size") % 2).alias("c2"), F.col("p_type").alias("value"))
    cells = parts.select("file", "sheet", F.col("r1").alias("row"), F.col("c1").alias("col"), "value")
    return X.expand_merges(cells, parts.drop("value")).select("row", "col", "value")


@query("named", """SELECT item_id, concat_ws(' > ', category, brand, name) AS path, 3 AS depth, category, name, unit_price, amount FROM named WHERE l_linenumber <> 7""")
def nego_signs(spark, d):
    rows = BidModel(spark, d).named.where("l_linenumber <> 7")
    return rows.select("item_id", S.join_path(S.split_path(F.col("path"))).alias("path"), F.size(S.split_path(F.col("path"))).alias("depth"), "category", "name", "unit_price", "amount")


# Changes


@query("", """SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max((o_orderdate, o_orderkey))[2] AS order_id FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'P'""")
def latest_rows(spark, d):
    log = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("order_id"), F.struct("o_orderdate", "o_orderkey").alias("version"), (F.col("o_orderstatus") == "P").alias("is_deleted_row"))
    return L.latest(log, ["o_custkey"], "version").select("o_custkey", "status", "order_id")


@query("lines", "SELECT item_id, submission_id, amount FROM lines WHERE NOT (l_suppkey % 3 = 0 AND NOT is_nego)")
def reset_submissions(spark, d):
    lines = BidModel(spark, d).lines
    return L.reset_submission(lines, lines.where("l_suppkey % 3 = 0").select("submission_id").distinct(), keep_nego=True).select("item_id", "submission_id", "amount")


@query("bids", "SELECT bid_id, CASE WHEN domain = 'IT' THEN 'ICT' ELSE domain END AS domain, (SELECT count(*) FROM bids WHERE domain = 'IT') AS n_bids FROM bids")
def rename_domain(spark, d):
    bids = BidModel(spark, d).bids
    renamed, _, counts = L.rename_domain(bids, bids, "IT", "ICT")
    return renamed.select("bid_id", "domain").crossJoin(counts.select("n_bids"))


@query("bids lines", "SELECT project_id, bid_id, n_items, total FROM (SELECT project_id, lines.bid_id, count(*) AS n_items, CAST(sum(amount) AS BIGINT) AS total FROM lines JOIN bids ON lines.bid_id = bids.bid_id WHERE NOT is_header GROUP BY 1, 2) WHERE n_items > 1")
def bid_totals(spark, d):
    m = BidModel(spark, d)
    one = m.lines.where("NOT is_header").groupBy("bid_id").agg(F.count("*").alias("n_items"), F.sum("amount").alias("total"))
    return one.join(m.bids.select("bid_id", "project_id"), "bid_id").where("n_items > 1").select("project_id", "bid_id", "n_items", "total")


@query("items", "SELECT submission_id, sort_order, item_id FROM items WHERE sort_order < 3")
def first_items(spark, d):
    w = Window.partitionBy("submission_id").orderBy("l_orderkey", "l_partkey", "l_linenumber")
    return BidModel(spark, d).lines.withColumn("sort_order", (F.row_number().over(w) - 1).cast("bigint")).where("sort_order < 3").select("submission_id", "sort_order", "item_id")


# Sheets


def _cells(spark, d) -> DataFrame:
    return _sheet(spark, d).select("file", F.lit("s").alias("sheet"), "row", F.posexplode(F.array("cat1", "cat2", "name", F.floor(F.col("price") * 100).cast("long").cast("string"))).alias("col", "value"))


_LABEL = "'R' || CASE WHEN length(CAST(row AS VARCHAR)) < 3 THEN lpad(CAST(row AS VARCHAR), 3, '0') ELSE CAST(row AS VARCHAR) END"
_CENTS = "CAST(CAST(floor(price * 100) AS BIGINT) AS VARCHAR)"


@query("", f"WITH {_SHEET} SELECT file, row, concat_ws(' | ', {_LABEL}, coalesce(cat1, ''), coalesce(cat2, ''), name, {_CENTS}) AS line FROM sheet")
def sheet_text(spark, d):
    return X.sheet_lines(_cells(spark, d)).select("file", "row", "line")


@query("", f"WITH {_SHEET} SELECT file, min(row) AS row, CAST(2 AS INTEGER) AS col FROM sheet WHERE row <= 10 AND contains(name, 'ring') GROUP BY 1")
def keyword_cell(spark, d):
    return X.find_keyword(_cells(spark, d).where("col = 2"), "ring").select("file", "row", "col")


_HEADS = ["대분류", "중분류", "품명", "규격", "Q'ty", "Unit", "Unit Price", "공급가", "비고", "No.", "x"]


@query("", """WITH c AS (SELECT user_id AS file, event_id % 8 + 1 AS row, event_id % 5 AS col, ['cat1', 'cat2', 'name', 'spec', 'qty', 'unit', 'price', 'amount', 'remark', 'seq', NULL][event_id % 11 + 1] AS role FROM events),
  u AS (SELECT file, row, col, min(role) AS role, count(DISTINCT coalesce(role, '')) AS kinds FROM c GROUP BY 1, 2, 3), r AS (SELECT * FROM u WHERE kinds = 1 AND role IS NOT NULL), n AS (SELECT file, row, count(*) AS hits, string_agg(col || role, ',' ORDER BY col) AS mapping FROM r GROUP BY 1, 2),
  b AS (SELECT file, arg_min(row, (-hits, row)) AS row, max(hits) AS hits, arg_min(mapping, (-hits, row)) AS mapping FROM n GROUP BY 1)
  SELECT file, row, hits, mapping, CASE WHEN hits >= 4 THEN 'high' WHEN hits >= 2 THEN 'low' ELSE 'none' END AS confidence FROM b""")  # fmt: skip
def role_suggestion(spark, d):
    heads = F.array(*map(F.lit, _HEADS))
    cells = table(spark, d, "events").select(F.col("user_id").alias("file"), F.lit("s").alias("sheet"), (F.col("event_id") % 8 + 1).alias("row"), (F.col("event_id") % 5).alias("col"), F.element_at(heads, (F.col("event_id") % 11 + 1).cast("int")).alias("value"))
    one = cells.groupBy("file", "sheet", "row", "col").agg(F.min("value").alias("value"), F.count_distinct("value").alias("kinds")).where("kinds = 1").drop("kinds")
    found = X.suggest_roles(one)
    return found.select("file", "row", "hits", F.array_join(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"].cast("string"), e["value"])), ",").alias("mapping"), "confidence")


@query("", f"""WITH {_SHEET}, one AS (SELECT file, row, name, price, cat2 AS own, last_value(cat1 IGNORE NULLS) OVER w AS cat1 FROM sheet WHERE row > 0 WINDOW w AS (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING)),
  two AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER w, first_value(cat1 IGNORE NULLS) OVER w) AS cat2 FROM one WINDOW w AS (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT *, CAST({_CENTS} AS DOUBLE) AS cents FROM two)
  SELECT file, row, coalesce(nullif(concat_ws(' > ', cat1, cat2), ''), name) AS path, coalesce(cat1, cat2, '기타') AS category, 'R' || row AS line_no, name, CASE WHEN row IN (10, 20, 30) THEN -cents ELSE cents END AS amount FROM x""")  # fmt: skip
def extract_items(spark, d):
    items = X.extract_by_mapping(_cells(spark, d), {0: "cat1", 1: "cat2", 2: "name", 3: "amount"}, 0, nego=[10, 20, 30])
    return items.select("file", "row", "path", "category", "line_no", "name", "amount")


@query("", f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, line_no % 10 <> 0 AS is_data FROM split), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 20 AS chunk FROM k WHERE is_data),
  s AS (SELECT doc_id, count(*) AS shared FROM k WHERE NOT is_data GROUP BY 1) SELECT n.doc_id, chunk, count(*) + any_value(shared) AS n_lines FROM n JOIN s ON n.doc_id = s.doc_id GROUP BY 1, 2""")  # fmt: skip
def text_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = rows.select("doc_id", "line_no", F.when(F.col("line_no") % 10 != 0, S.row_label(F.col("line_no"))).otherwise("# head").alias("line"))
    return X.text_chunks(lines, "doc_id", "line_no", 20).select("doc_id", "chunk", "n_lines")


# Review of clusters


@query("clusters", f"""--with {_MEMBERS}, mv AS (SELECT item_id, concat_ws(':', bid_id, 'kept') AS cluster_id FROM members WHERE l_linenumber = 2),
  now AS (SELECT cluster_id, item_id FROM members WHERE l_linenumber <> 2 UNION ALL SELECT cluster_id, item_id FROM mv) SELECT cluster_id, count(*) AS n FROM now GROUP BY 1""")  # fmt: skip
def move_items(spark, d):
    rows = _members(spark, d)
    now, _ = C.move_items(rows.select("cluster_id", "item_id"), rows.where("l_linenumber = 2").select("item_id", F.concat_ws(":", "bid_id", F.lit("kept")).alias("cluster_id")))
    return now.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("clusters", f"""--with {_MEMBERS}, held AS (SELECT * FROM clusters WHERE status = 'held'), d AS (SELECT bid_id, min(cluster_id) AS cluster_id FROM held GROUP BY 1),
  a AS (SELECT n.item_id, c.cluster_id FROM named n JOIN held c ON c.bid_id = n.bid_id AND c.name = n.name WHERE NOT is_header UNION ALL SELECT item_id, cluster_id FROM named n JOIN d ON n.bid_id = d.bid_id WHERE NOT is_header),
  f AS (SELECT * FROM a WHERE item_id NOT IN (SELECT item_id FROM members WHERE status <> 'rejected')) SELECT item_id, min(cluster_id) AS cluster_id FROM f GROUP BY 1""")  # fmt: skip
def unmatched_additions(spark, d):
    m = BidModel(spark, d)
    held = m.clusters.where("status = 'held'").select("bid_id", "name", "cluster_id")
    default = held.groupBy("bid_id").agg(F.min("cluster_id").alias("cluster_id"))
    rows = m.members_all.select("item_id", "bid_id", "name")
    asked = rows.join(held, ["bid_id", "name"]).select("item_id", "cluster_id").unionByName(rows.join(default, "bid_id").select("item_id", "cluster_id"))
    asked = asked.select("item_id", "cluster_id", F.lit(None).cast("double").alias("confidence"), F.col("cluster_id").alias("place"))
    return C.assign_unmatched(asked, m.clusters, m.members_all, _members(spark, d).where(F.col("status").isin(C.OPEN))).select("item_id", "cluster_id")


@query("clusters", f"--with {_MEMBERS} SELECT cluster_id, count(*) AS n FROM members WHERE status IN ('accepted', 'rejected') GROUP BY 1")
def reset_clusters(spark, d):
    _, rows = C.reset(BidModel(spark, d).clusters, _members(spark, d))
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("named", "SELECT bid_id, item_id, (row_number() OVER (PARTITION BY bid_id ORDER BY lower(name), item_id) - 1) // 90 AS \"window\" FROM named WHERE NOT is_header")
def cluster_windows(spark, d):
    rows = BidModel(spark, d).members_all.withColumn("folded", F.lower("name"))
    return C.number_windows(rows, "bid_id", ["folded", "item_id"]).select("bid_id", "item_id", "window")


@query("clusters", "SELECT bid_id, bool_and(bid_id % 2 = 0) AS is_owner FROM clusters GROUP BY 1")
def merge_ownership(spark, d):
    found = BidModel(spark, d).clusters
    wanted = found.select("bid_id", F.when(F.col("bid_id") % 2 == 0, F.col("cluster_id")).otherwise(F.concat(F.lit("x"), "cluster_id")).alias("cluster_id"))
    return C.same_bid(found, wanted)


@query("clusters", "SELECT cluster_id, CASE WHEN status = 'held' THEN 'pending' ELSE status END AS status FROM clusters")
def reopen_held(spark, d):
    return C.set_status(BidModel(spark, d).clusters, F.col("status") == "held", "pending").select("cluster_id", "status")


# Reports and views


@query("named", f"""--with {_LIVE}, {_PIVOT} SELECT bid_id, category, row_key, count(*) AS n_vendors, min(unit_price) AS low, max(unit_price) AS high, arg_min(vendor_id, (unit_price, vendor_id)) AS low_vendor,
  CAST(floor(CAST(max(unit_price) * 100 AS DOUBLE) / min(unit_price)) AS BIGINT) AS ratio FROM rows_ WHERE unit_price > 0 GROUP BY 1, 2, 3""")  # fmt: skip
def report_rows(spark, d):
    return R.report_rows(P.compare_pivot(_live(spark, d)))


@query("named", f"""--with {_LIVE}, t AS (SELECT bid_id, vendor_id, CAST(coalesce(sum(amount) FILTER (list_contains({CANONICAL}, category)), 0) AS BIGINT) AS total FROM live GROUP BY 1, 2),
  b AS (SELECT bid_id, arg_min(vendor_id, (total, vendor_id)) AS v FROM t WHERE total > 0 GROUP BY 1) SELECT t.bid_id, vendor_id, total, coalesce(vendor_id = v, false) AS is_lowest FROM t LEFT JOIN b ON t.bid_id = b.bid_id""")  # fmt: skip
def report_summary(spark, d):
    return R.report_summary(P.category_totals(_live(spark, d), CANONICAL))


@query("named", "SELECT submission_id, category, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n_items FROM named GROUP BY 1, 2")
def summary_view(spark, d):
    return G.summary_view(BidModel(spark, d).named, "viewer-summary")


@query("named", f"""--with u AS (SELECT submission_id, {_UNIT} AS unit, name, amount, (submission_id, l_orderkey, l_partkey, l_linenumber, amount, quantity) AS seq FROM named WHERE NOT is_header)
  SELECT submission_id, unit AS group_key, array_to_string(list_slice(list(name ORDER BY seq, name), 1, 5), ', ') AS names, count(*) AS n_items FROM u WHERE unit IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def unit_names(spark, d):
    rows = BidModel(spark, d).named
    return H.group_by_unit(rows, _units(rows), True, "path", "passthrough", sample=5).where("is_unit").select("submission_id", "group_key", "names", "n_items")


# Further changes


@query("", "SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def guarded_delete(spark, d):
    children = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("customer"))
    return L.guard_empty(table(spark, d, "customer").select(F.col("c_custkey").alias("customer")), children, "customer")


@query("", "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 AND p_retailprice > 1000 THEN p_retailprice * 2 ELSE p_retailprice END AS v FROM part")
def upsert_rows(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), "p_size")
    return L.upsert(rows.drop("p_size"), rows.where("p_size % 2 = 0 AND v > 1000").select("k", (F.col("v") * 2).alias("v")), ["k"], True)


@query("lines", "SELECT item_id, submission_id FROM lines WHERE submission_id NOT IN (SELECT submission_id FROM lines WHERE is_deleted)")
def cascade_delete(spark, d):
    m = BidModel(spark, d)
    return L.cascade(m.lines, m.with_status(m.lines).where("is_deleted"), "submission_id").select("item_id", "submission_id")


@query("", "SELECT 'n' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS item_id, -abs(CAST(round(l_extendedprice * 100) AS BIGINT)) AS amount, '조정' AS category, 99999 AS sort_order FROM lineitem WHERE l_discount > 0.09")
def nego_requests(spark, d):
    asked = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.concat(F.lit("n"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")).alias("item_id"), F.lit("s").alias("submission_id"), F.lit("discount").alias("label"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"))
    return L.nego_items(asked).select("item_id", "amount", "category", "sort_order")
