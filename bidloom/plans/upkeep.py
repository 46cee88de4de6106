"""Queries over changes by hand and listings with filters; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.adapter import BidModel
from bidloom.operators import clusters as C
from bidloom.operators import lifecycle as L
from bidloom.operators import listing as G
from bidloom.plans.queries import _MEMBERS, _catalog, _categories, _members, query
from bidloom.session import table
from bidloom.stages import keep

# Clusters by hand

_REQUESTS = f"""{_MEMBERS}, asked AS (SELECT bid_id || '/' || k AS made, bid_id, k, CASE WHEN bid_id % 3 = 0 THEN 'given' END AS given, item_id, category FROM members, (SELECT unnest([0, 1]) AS k) WHERE l_linenumber = 1 OR (l_linenumber = 2 AND k = 1))"""


def _requests(spark, d):
    """Two requests in each bid, which both name the items of each order's first line."""
    rows = _members(spark, d).where("l_linenumber <= 2").select("bid_id", "item_id", "category", "l_linenumber", F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).where("l_linenumber = 1 OR place = 1")
    return rows.select(F.concat_ws("/", "bid_id", "place").alias("cluster_id"), "bid_id", F.concat(F.lit("made "), "place").alias("name"), F.when(F.col("bid_id") % 3 == 0, "given").alias("category"), "place", F.col("item_id").alias("item_place"), "item_id")


@query("clusters", f"""--with {_REQUESTS}, n AS (SELECT made, category, count(*) AS n, min(item_id) AS seen FROM asked GROUP BY 1, 2), c AS (SELECT made, arg_min(category, {{'n': -n, 's': seen}}) AS own FROM n GROUP BY 1),
  m AS (SELECT item_id, arg_max(made, k) AS made FROM asked GROUP BY 1), h AS (SELECT made, any_value(bid_id) AS bid_id, any_value(given) AS given, min(item_id) AS representative_item_id FROM asked GROUP BY 1)
  SELECT h.made AS cluster_id, bid_id, representative_item_id, coalesce(given, own) AS category, '수동 생성 (' || coalesce(given, own) || ')' AS similarity_summary, coalesce(k.n, 0) AS n_members, coalesce(k.r, 0) AS n_representatives,
  (SELECT count(*) FROM (SELECT cluster_id FROM members GROUP BY 1 HAVING count(*) = count(*) FILTER (item_id IN (SELECT item_id FROM asked)))) AS n_emptied
  FROM h JOIN c ON c.made = h.made LEFT JOIN (SELECT m.made, count(*) AS n, count(*) FILTER (h.representative_item_id = item_id) AS r FROM m JOIN h ON h.made = m.made GROUP BY 1) k ON k.made = h.made""")  # fmt: skip
def created_clusters(spark, d):
    """Clusters made from items by hand: their category, what is theirs after all requests, and how many clusters have nothing left."""
    rows = keep(_members(spark, d).select("cluster_id", "item_id", "category"), "members")
    made, now, emptied = C.create_from_items(rows.drop("category"), rows.select("item_id", "category").dropDuplicates(["item_id"]), _requests(spark, d))
    counts = now.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.count_if(F.col("role") == "representative").alias("n_representatives"))
    return made.join(counts, "cluster_id", "left").fillna(0, ["n_members", "n_representatives"]).crossJoin(emptied.agg(F.count("*").alias("n_emptied"))).select("cluster_id", "bid_id", "representative_item_id", "category", "similarity_summary", "n_members", "n_representatives", "n_emptied")


@query("clusters", f"""--with {_MEMBERS}, i AS (SELECT item_id, bid_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS catalog_item_id, CASE WHEN l_linenumber % 3 = 0 THEN 'unmatched' WHEN l_linenumber = 2 THEN 'unmatched' ELSE 'confirmed' END AS match_status, l_linenumber FROM members)
  SELECT bid_id, count(*) FILTER (l_linenumber <> 2) AS n_members, count(CASE WHEN l_linenumber <> 2 THEN catalog_item_id END) AS n_linked, count(*) FILTER (match_status = 'unmatched') AS n_unmatched FROM i GROUP BY 1""")  # fmt: skip
def excluded_items(spark, d):
    """Items that leave their clusters and lose their match."""
    rows = _members(spark, d).withColumns({"catalog_item_id": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")), "match_status": F.when(F.col("l_linenumber") % 3 != 0, "confirmed").otherwise("unmatched")})
    left, items = C.exclude_items(rows.select("cluster_id", "item_id"), rows.select("item_id", "bid_id", "catalog_item_id", "match_status"), rows.where("l_linenumber = 2"))
    return items.join(left, "item_id", "left").groupBy("bid_id").agg(F.count("cluster_id").alias("n_members"), F.count("catalog_item_id").alias("n_linked"), F.count_if(F.col("match_status") == "unmatched").alias("n_unmatched"))


@query("clusters", f"""--with {_MEMBERS}, c AS (SELECT *, bid_id % 4 = 0 AS gone FROM clusters), a AS (SELECT * FROM c WHERE status = 'accepted'), stay AS (SELECT DISTINCT name FROM a WHERE NOT gone),
  h AS (SELECT a.name, a.gone, count(*) AS n FROM a JOIN members m ON m.cluster_id = a.cluster_id GROUP BY 1, 2)
  SELECT a.name AS catalog_item_id, (SELECT count(*) FROM c WHERE NOT gone) AS n_clusters, (SELECT count(*) FROM members WHERE bid_id % 4 <> 0) AS n_members, CAST(max(h.n) AS BIGINT) AS n_prices
  FROM (SELECT DISTINCT name FROM a) a JOIN stay s ON s.name = a.name JOIN h ON h.name = a.name AND NOT h.gone GROUP BY 1""")  # fmt: skip
def deleted_clusters(spark, d):
    """The clusters of every fourth bid deleted: which catalog items stay, with the prices that are left."""
    clusters = BidModel(spark, d).clusters.withColumn("catalog_item_id", F.when(F.col("status") == "accepted", F.col("name")))
    rows = keep(_members(spark, d).select("cluster_id", "item_id", "status", "name"), "members")
    accepted = rows.where("status = 'accepted'").select("cluster_id", "item_id", F.col("name").alias("catalog_item_id"))
    left, now, prices, catalog = C.delete_clusters(clusters, rows.select("cluster_id", "item_id"), clusters.where("bid_id % 4 = 0"), accepted, accepted.select("catalog_item_id").distinct())
    counts = left.agg(F.count("*").alias("n_clusters")).crossJoin(now.agg(F.count("*").alias("n_members")))
    return catalog.join(prices.groupBy("catalog_item_id").agg(F.count("*").alias("n_prices")), "catalog_item_id", "left").crossJoin(counts).select("catalog_item_id", "n_clusters", "n_members", "n_prices")


# Listings with filters


@query("clusters", f"--with {_MEMBERS} SELECT c.cluster_id, c.bid_id, c.status, count(*) AS member_count FROM clusters c JOIN members m ON m.cluster_id = c.cluster_id WHERE c.status = 'pending' AND c.bid_id = 3 GROUP BY 1, 2, 3 UNION ALL SELECT c.cluster_id, c.bid_id, c.status, count(*) FROM clusters c JOIN members m ON m.cluster_id = c.cluster_id WHERE c.status = 'accepted' GROUP BY 1, 2, 3")
def cluster_listing(spark, d):
    """Pending clusters of one bid, and accepted ones of all."""
    clusters, rows = BidModel(spark, d).clusters, _members(spark, d).select("cluster_id")
    both = G.cluster_listing(clusters, rows, "pending", 3).unionByName(G.cluster_listing(clusters, rows, "accepted"))
    return both.select("cluster_id", "bid_id", "status", "member_count")


@query("", """WITH c AS (SELECT p_partkey AS catalog_item_id, p_name AS name, p_type || '/' || p_brand AS category_id, p_brand AS category_name, p_type AS parent_id, p_brand || ' ' || p_name AS alias, p_size % 5 <> 0 AS is_active FROM part)
  SELECT catalog_item_id, name, category_name, parent_id, 'search' AS filter FROM c WHERE is_active AND (name ILIKE '%ring%' OR alias ILIKE '%#1% red%')
  UNION ALL SELECT catalog_item_id, name, category_name, parent_id, 'category' FROM c WHERE category_id = 'SMALL/Brand#4'""")  # fmt: skip
def catalog_filters(spark, d):
    """Catalog items by a search in names and aliases, and all of one category, inactive ones too."""
    catalog, categories = _catalog(spark, d), _categories(spark, d)
    found = G.catalog_search(catalog, categories, "ring").unionByName(G.catalog_search(catalog, categories, "#1% red")).dropDuplicates(["catalog_item_id"])
    shown = ("catalog_item_id", "name", "category_name", "parent_id")
    return found.select(*shown, F.lit("search").alias("filter")).unionByName(G.catalog_search(catalog, categories, active=False, category_id="SMALL/Brand#4").select(*shown, F.lit("category").alias("filter")))


_DOMAINS = "cats AS (SELECT DISTINCT p_type || '/' || p_brand AS category_id, CASE length(p_type) % 3 WHEN 0 THEN 'FACILITY' WHEN 1 THEN 'ALL' ELSE 'IT' END AS domain, p_brand <> 'Brand#1' AS is_active FROM part)"


def _domain_categories(spark, d):
    n = F.length("p_type") % 3
    return table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("category_id"), F.when(n == 0, "FACILITY").when(n == 1, "ALL").otherwise("IT").alias("domain"), (F.col("p_brand") != "Brand#1").alias("is_active")).distinct()


@query("", f"WITH {_DOMAINS} SELECT category_id, domain FROM cats WHERE domain IN ('IT', 'ALL') AND is_active")
def domain_categories(spark, d):
    """Active categories of a domain and those of every domain."""
    return G.chosen(_domain_categories(spark, d), {"domain": "ALL"}, domain="IT", is_active=True, category_id=None).select("category_id", "domain")


@query("bids lines submissions", f"""--with {_DOMAINS}, d AS (SELECT unnest(['IT', 'FACILITY', 'ALL', 'OFFICE']) AS domain)
  SELECT domain, (SELECT count(*) FROM bids b WHERE b.domain = d.domain) AS n_bids, (SELECT count(*) FROM submissions s JOIN bids b ON b.bid_id = s.bid_id WHERE b.domain = d.domain) AS n_submissions,
  (SELECT count(*) FROM cats c WHERE c.domain = d.domain AND is_active) AS n_categories, (SELECT count(*) FROM part JOIN cats c ON c.category_id = p_type || '/' || p_brand WHERE c.domain = d.domain AND p_size % 5 <> 0) AS n_items FROM d""")  # fmt: skip
def domain_removal(spark, d):
    """What the removal of each domain would touch."""
    m = BidModel(spark, d)
    domains = spark.createDataFrame([("IT",), ("FACILITY",), ("ALL",), ("OFFICE",)], "domain string")
    return G.domain_removal(domains, m.bids, m.submissions, _domain_categories(spark, d), _catalog(spark, d)).select("domain", "n_bids", "n_submissions", "n_categories", "n_items")


# Bulk insert


@query("", """WITH p AS (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS won FROM part), q AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN won ELSE -won END AS price FROM p)
  SELECT CAST(p_partkey // 20 AS VARCHAR) AS submission_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS sort_order, p_name AS name_raw, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS path,
  CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE CAST(price AS DOUBLE) END AS unit_price, p_size = 1 AS is_header FROM q""")  # fmt: skip
def inserted_items(spark, d):
    """Extracted items with numbers as texts, as they are stored."""
    k, won = F.col("p_partkey") % 4, F.floor("p_retailprice").cast("string")
    price = F.when(k == 0, F.concat(F.format_number(won.cast("long"), 0), F.lit("원"))).when(k == 1, F.concat(F.lit("-"), won)).when(k == 2, "-").otherwise(F.concat(F.lit("₩ -"), won))
    one = F.struct(
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "[indent=2] ").otherwise(""), "p_name").alias("name_raw"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, "").alias("path"),
        F.col("p_brand").alias("parent_path"), price.alias("unit_price"), F.when(F.col("p_size") == 1, True).alias("is_category_header"),
    )
    rows = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).cast("string").alias("submission_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("i"))))["i"].alias("items"))
    return L.insert_items(rows).select("submission_id", "sort_order", "name_raw", "path", "unit_price", "is_header")
