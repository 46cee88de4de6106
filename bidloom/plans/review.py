"""Queries of the comparison with clusters, of matching, and of clustering and extraction as jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.adapter import CANONICAL, BidModel
from bidloom.operators import clusters as C
from bidloom.operators import compare as P
from bidloom.operators import extract as X
from bidloom.operators import hierarchy as H
from bidloom.operators import lifecycle as L
from bidloom.operators import matching as M
from bidloom.plans.queries import _LIVE, _MEMBERS, _OTHERS, _PIVOT, _UNIT, _catalog, _live, _members, _units, query
from bidloom.session import table
from bidloom.stages import keep

_OPEN = "open AS (SELECT m.*, l.vendor_id AS live_vendor, l.seq FROM members m JOIN live l ON m.item_id = l.item_id WHERE status IN ('accepted', 'pending', 'held'))"


def _open(spark, d):
    """Live members of clusters that are not rejected."""
    return BidModel(spark, d).with_status(_members(spark, d)).where(F.col("status").isin(C.OPEN)).where("extraction_status = 'done' AND NOT is_deleted")


# Comparison with clusters


@query("clusters", f"""--with {_MEMBERS}, {_LIVE.replace("FROM named WHERE", "FROM named WHERE item_id NOT IN (SELECT item_id FROM members WHERE status <> 'rejected') AND")}, {_PIVOT}
  SELECT bid_id, category, row_key, vendor_id, unit_price, quantity, amount, spec, path FROM rows_""")  # fmt: skip
def unclustered_pivot(spark, d):
    return P.compare_pivot(C.unclustered(_live(spark, d), _members(spark, d).where(F.col("status").isin(C.OPEN)))).drop("item_id")


_COLLAPSED = f"""u AS (SELECT *, {_UNIT} AS unit FROM live),
  g AS (SELECT submission_id, bid_id, vendor_id, unit, arg_min(item_id, (category, name, seq)) AS item_id, arg_min(category, (category, name, seq)) AS category, string_split(unit, ' > ')[-1] AS name,
    '(' || count(*) || '개: ' || array_to_string(list_slice(list(name ORDER BY category, name, seq), 1, 5), ', ') || CASE WHEN count(*) > 5 THEN ' ...' ELSE '' END || ')' AS brand, CAST(sum(amount) AS BIGINT) AS amount
    FROM u WHERE unit IS NOT NULL GROUP BY 1, 2, 3, 4),
  collapsed AS (SELECT submission_id, item_id, category, name, unit AS path, brand, CAST(1 AS DOUBLE) AS quantity, amount, amount AS unit_price, true AS is_unit FROM g
    UNION ALL SELECT submission_id, item_id, category, name, path, brand, quantity, amount, unit_price, false FROM u WHERE unit IS NULL)"""


@query("named", f"--with {_LIVE}, {_COLLAPSED} SELECT * FROM collapsed")
def collapsed_items(spark, d):
    live = _live(spark, d)
    return H.collapse_units(live, _units(live)).drop("bid_id", "vendor_id", "seq")


@query("named", f"""--with {_LIVE}, {_COLLAPSED}, p AS (SELECT split_part(submission_id, '-', 1) AS bid, split_part(submission_id, '-', 2) AS vendor, * FROM collapsed WHERE is_unit)
  SELECT CAST(bid AS BIGINT) AS bid_id, category, name, count(DISTINCT vendor) AS n_vendors FROM p GROUP BY 1, 2, 3""")  # fmt: skip
def collapsed_pivot(spark, d):
    """Vendors that offer each collapsed unit, from the comparison of collapsed items."""
    live = _live(spark, d)
    rows = P.compare_pivot(H.collapse_units(live, _units(live)).where("is_unit"))
    parts = F.split("path", " > ")
    return rows.withColumn("name", F.element_at(parts, -1)).groupBy(F.col("bid_id").cast("long").alias("bid_id"), "category", "name").agg(F.count_distinct("vendor_id").alias("n_vendors"))


_GROUPS = """k AS (SELECT *, min(path) OVER w <> max(path) OVER w AS apart FROM open WINDOW w AS (PARTITION BY cluster_id, name)),
  g AS (SELECT cluster_id, CASE WHEN apart THEN path ELSE name END AS row_key, CASE WHEN apart THEN name || '  (' || category || ' > ' || brand || ')' ELSE name END AS shown, live_vendor AS vendor_id, seq, item_id, unit_price, quantity, amount FROM k),
  f AS (SELECT cluster_id, row_key, vendor_id, min(shown) AS shown, arg_max(item_id, seq) AS item_id, arg_max(unit_price, seq) AS unit_price, arg_max(quantity, seq) AS quantity, arg_max(amount, seq) AS amount FROM g GROUP BY 1, 2, 3)"""


@query("clusters", f"--with {_MEMBERS}, {_LIVE}, {_OPEN}, {_GROUPS} SELECT * FROM f")
def cluster_groups(spark, d):
    return P.cluster_groups(_open(spark, d))


@query("clusters", f"""--with {_MEMBERS}, {_LIVE}, {_OPEN}, {_GROUPS} SELECT cluster_id, row_key, min(unit_price) AS min_price, arg_min(vendor_id, (unit_price, vendor_id)) AS min_vendor,
  CASE WHEN count(*) > 1 THEN max(unit_price) END AS max_price, CASE WHEN count(*) > 1 THEN arg_max(vendor_id, (unit_price, -vendor_id)) END AS max_vendor, count(*) AS n_prices FROM f WHERE unit_price <> 0 GROUP BY 1, 2""")  # fmt: skip
def cluster_group_extremes(spark, d):
    return P.row_extremes(P.cluster_groups(_open(spark, d)), ("cluster_id", "row_key"))


@query("clusters", f"""--with {_MEMBERS}, {_LIVE}, {_OPEN}, twice AS (SELECT bid_id, live_vendor AS vendor_id, category, amount, item_id FROM open UNION ALL SELECT bid_id, live_vendor, category, amount, item_id FROM open WHERE l_linenumber = 1),
  a AS (SELECT bid_id, vendor_id, category, amount FROM live WHERE item_id NOT IN (SELECT item_id FROM twice) UNION ALL SELECT bid_id, vendor_id, category, amount FROM twice),
  v AS (SELECT DISTINCT bid_id, vendor_id FROM a), c AS (SELECT unnest({CANONICAL}) AS category)
  SELECT v.bid_id, v.vendor_id, c.category, CAST(coalesce(sum(amount), 0) AS BIGINT) AS total FROM v CROSS JOIN c LEFT JOIN a ON a.bid_id = v.bid_id AND a.vendor_id = v.vendor_id AND a.category = c.category GROUP BY 1, 2, 3""")  # fmt: skip
def compared_totals(spark, d):
    """Items on line 1 stand in two clusters, so they count twice."""
    rows = _open(spark, d)
    return P.compared_totals(_live(spark, d), rows.unionByName(rows.where("l_linenumber = 1")), CANONICAL)


@query("clusters", f"""--with {_MEMBERS}, n AS (SELECT cluster_id, category, count(*) AS n, min((submission_id, l_orderkey, l_partkey, l_linenumber, amount, quantity)) AS seen FROM members GROUP BY 1, 2),
  c AS (SELECT cluster_id, arg_min(category, (-n, seen)) AS category FROM n GROUP BY 1)
  SELECT bid_id, k.cluster_id, category, CAST(row_number() OVER (PARTITION BY bid_id ORDER BY coalesce(list_position({CANONICAL}, category), 10), lower(name), k.cluster_id) AS INTEGER) AS place FROM clusters k JOIN c ON c.cluster_id = k.cluster_id""")  # fmt: skip
def cluster_order(spark, d):
    category = P.majority(_members(spark, d), ["cluster_id"], "category", "seq")
    return C.cluster_order(BidModel(spark, d).clusters.select("bid_id", "cluster_id", "name").join(category, "cluster_id"), CANONICAL).select("bid_id", "cluster_id", "category", "place")


_STATUS = "CASE WHEN l_linenumber % 3 = 0 THEN 'confirmed' ELSE 'suggested' END"


@query("bids lines named history", f"""--with {_LIVE}, {_OTHERS}, b AS (SELECT pid, catalog_item_id, min(unit_price) AS low FROM h GROUP BY 1, 2), {_PIVOT.replace("arg_max(amount, seq) AS amount FROM", "arg_max(amount, seq) AS amount, arg_max(l_partkey, seq) AS last_part, arg_max(l_linenumber, seq) AS last_line FROM")},
  j AS (SELECT r.bid_id, category, row_key, last_part AS catalog_item_id, low FROM rows_ r JOIN bids ON bids.bid_id = r.bid_id JOIN b ON pid = project_id AND b.catalog_item_id = last_part WHERE last_line % 3 = 0)
  SELECT bid_id, category, row_key, min(catalog_item_id) AS catalog_item_id, arg_min(low, catalog_item_id) AS benchmark FROM j GROUP BY 1, 2, 3""")  # fmt: skip
def row_benchmarks(spark, d):
    m = BidModel(spark, d)
    links = m.lines.select("item_id", F.col("l_partkey").alias("catalog_item_id"), F.when(F.col("l_linenumber") % 3 == 0, "confirmed").otherwise("suggested").alias("match_status"))
    return P.row_benchmarks(P.compare_pivot(_live(spark, d)), links, m.bids, m.history, m.projects)


@query("clusters history bids lines", f"""--with {_OTHERS}, b AS (SELECT pid, catalog_item_id, min(unit_price) AS low FROM h GROUP BY 1, 2),
  k AS (SELECT 1 AS tier, lower(p_name) AS key, p_partkey AS id FROM part UNION ALL SELECT 2, lower(concat_ws(' ', p_brand, p_name)), p_partkey FROM part),
  c AS (SELECT cluster_id, project_id, status, clusters.name, bids.bid_id AS rep FROM clusters JOIN bids ON bids.bid_id = clusters.bid_id),
  a AS (SELECT cluster_id, project_id, tier, id FROM c JOIN k ON lower(name) = key UNION ALL SELECT cluster_id, project_id, 0, rep FROM c WHERE status = 'accepted'),
  m AS (SELECT cluster_id, min((tier, id, low)) AS b FROM a JOIN b ON pid = project_id AND catalog_item_id = id GROUP BY 1)
  SELECT c.cluster_id, b[1] AS tier, b[2] AS catalog_item_id, b[3] AS benchmark FROM c LEFT JOIN m ON m.cluster_id = c.cluster_id""")  # fmt: skip
def cluster_benchmarks(spark, d):
    m = BidModel(spark, d)
    found = m.clusters.join(m.bids.select("bid_id", "project_id"), "bid_id").withColumn("representative_item_id", F.col("bid_id").cast("bigint"))
    return P.cluster_benchmarks(found, m.history, m.projects, _catalog(spark, d))


# Matching


_FOUND = """s AS (SELECT *, CASE WHEN l_linenumber = 2 THEN 'no such' WHEN l_linenumber = 3 THEN upper(brand || ' ' || name) ELSE name END AS wanted FROM named WHERE NOT is_header),
  k AS (SELECT 0 AS tier, lower(p_name) AS key, p_partkey AS id FROM part UNION ALL SELECT 1, lower(concat_ws(' ', p_brand, p_name)), p_partkey FROM part), b AS (SELECT key, min((tier, id)) AS m FROM k GROUP BY 1),
  f AS (SELECT item_id, submission_id, l_linenumber, wanted, m[2] AS catalog_item_id, CASE m[1] WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END AS confidence FROM s LEFT JOIN b ON lower(wanted) = key)"""


def _asked(spark, d):
    n = F.col("l_linenumber")
    name = F.when(n == 2, "no such").when(n == 3, F.upper(F.concat_ws(" ", "brand", "name"))).otherwise(F.col("name"))
    return BidModel(spark, d).named.where("NOT is_header").withColumn("name", name)


def _suggested(spark, d):
    rows = _asked(spark, d)
    return M.save_suggestions(rows, M.suggest(rows, _catalog(spark, d)))


@query("named", f"--with {_FOUND} SELECT item_id, catalog_item_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN catalog_item_id IS NULL THEN 'unmatched' ELSE 'suggested' END AS match_status FROM f")
def match_suggestions(spark, d):
    return _suggested(spark, d).select("item_id", "catalog_item_id", F.col("match_confidence").alias("confidence"), "match_status")


@query("named", f"--with {_FOUND} SELECT submission_id, count(*) FILTER (catalog_item_id IS NOT NULL) AS n_suggested, count(*) FILTER (catalog_item_id IS NULL) AS n_unmatched FROM f GROUP BY 1")
def suggestion_histogram(spark, d):
    return _suggested(spark, d).groupBy("submission_id").agg(F.count_if(F.col("match_status") == "suggested").alias("n_suggested"), F.count_if(F.col("match_status") == "unmatched").alias("n_unmatched"))


@query("named", f"--with {_FOUND} SELECT item_id, f.catalog_item_id, p_name AS catalog_name FROM f JOIN part ON p_partkey = catalog_item_id")
def suggestion_listing(spark, d):
    return M.suggestions(_suggested(spark, d), _catalog(spark, d), "suggested").select("item_id", "catalog_item_id", "catalog_name")


@query("named", f"""--with {_FOUND}, dec AS (SELECT item_id, CASE WHEN l_linenumber = 4 THEN NULL ELSE catalog_item_id END AS chosen FROM f WHERE l_linenumber >= 3),
  now AS (SELECT f.item_id, CASE WHEN dec.item_id IS NULL THEN CASE WHEN catalog_item_id IS NULL THEN 'unmatched' ELSE 'suggested' END WHEN chosen IS NULL THEN 'unmatched' ELSE 'confirmed' END AS match_status, chosen, l_linenumber FROM f LEFT JOIN dec ON f.item_id = dec.item_id)
  SELECT match_status, count(*) AS n_items, count(*) FILTER (match_status = 'confirmed' AND l_linenumber <> 5) AS n_recorded FROM now GROUP BY 1""")  # fmt: skip
def match_confirm(spark, d):
    """Items of line 5 are in the history already; the others' prices are recorded once, though each is confirmed twice."""
    items = _suggested(spark, d)
    decided = items.where("l_linenumber >= 3").select("item_id", F.when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("catalog_item_id")).alias("catalog_item_id"))
    now, new = M.confirm(items, decided, items.where("l_linenumber = 5").select("catalog_item_id", "item_id"))
    again, more = M.confirm(now, decided, items.where("l_linenumber = 5").select("catalog_item_id", "item_id").unionByName(new.select("catalog_item_id", "item_id")))
    recorded = new.unionByName(more).select("item_id", F.lit(1).alias("one"))
    return again.join(recorded, "item_id", "left").groupBy("match_status").agg(F.count("*").alias("n_items"), F.count("one").alias("n_recorded"))


# Clustering as a job


def _clustered(spark, d):
    """(items, their clusters) with what a run asks for: lines meet their orders and parts once."""
    rows = keep(BidModel(spark, d).members_all.select("item_id", "bid_id", "name", "l_suppkey", "l_linenumber", F.col("l_suppkey").alias("vendor_id"), "seq"), "items")
    return rows, keep(BidModel.clusters_of(rows).select("cluster_id", "bid_id", "name", "status"), "clusters")


@query("clusters", f"""--with {_MEMBERS}, kept AS (SELECT * FROM clusters WHERE status IN ('accepted', 'rejected')), taken AS (SELECT item_id FROM members WHERE status = 'accepted'),
  free AS (SELECT * FROM named WHERE NOT is_header AND item_id NOT IN (SELECT item_id FROM taken)),
  p AS (SELECT bid_id, replace(lower(name), ' ', '') AS key, count(*) AS n, count(DISTINCT l_suppkey) AS v FROM free GROUP BY 1, 2)
  SELECT concat_ws(':', bid_id, key) AS cluster_id, n AS n_members, n - 1 AS n_duplicates FROM p WHERE n >= 2 AND v >= 2""")  # fmt: skip
def clustering_run(spark, d):
    """The clusters that a full run forms anew: pending and held ones go, accepted ones keep their items."""
    rows, clusters = _clustered(spark, d)
    found, now, _ = C.run_clustering(rows, clusters, C.members(clusters, rows).select("cluster_id", "item_id"), ["bid_id"])
    made = found.where("status = 'pending'").select("cluster_id")
    return now.where("role IS NOT NULL").join(made, "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.count_if(F.col("role") == "duplicate").alias("n_duplicates"))


@query("clusters", f"""--with {_MEMBERS}, half AS (SELECT * FROM members WHERE l_linenumber <> 1 AND status <> 'rejected'), known AS (SELECT bid_id, replace(lower(name), ' ', '') AS key, min(cluster_id) AS cluster_id FROM clusters WHERE status <> 'rejected' GROUP BY 1, 2)
  SELECT item_id, k.cluster_id FROM named n JOIN known k ON k.bid_id = n.bid_id AND k.key = replace(lower(n.name), ' ', '') WHERE NOT is_header AND item_id NOT IN (SELECT item_id FROM half)""")  # fmt: skip
def refine_unmatched(spark, d):
    """Items of line 1 are taken out of their clusters; a run that keeps the clusters puts them back."""
    rows, found = _clustered(spark, d)
    half = C.members(found, rows).where("l_linenumber <> 1").select("cluster_id", "item_id")
    _, now, _ = C.run_clustering(rows, found, half, ["bid_id"], keep_open=True)
    return now.where("role IS NOT NULL").join(found.select("cluster_id"), "cluster_id", "left_semi").select("item_id", "cluster_id")


@query("named", """--with w AS (SELECT bid_id, item_id, lower(name) AS folded, concat('- item_id=', item_id, ' | vendor=', l_suppkey, ' | name=', name, ' | spec=', brand) AS line,
  (row_number() OVER (PARTITION BY bid_id ORDER BY lower(name), item_id) - 1) // 90 AS "window" FROM named WHERE NOT is_header)
  SELECT bid_id, "window", sha256(string_agg(line, chr(10) ORDER BY folded, item_id)) AS text_sha256, count(*) AS n_items FROM w GROUP BY 1, 2""")  # fmt: skip
def cluster_input(spark, d):
    rows = BidModel(spark, d).members_all.withColumn("vendor_id", F.col("l_suppkey"))
    return C.cluster_input(rows, "bid_id").select("bid_id", "window", F.sha2("text", 256).alias("text_sha256"), "n_items")


# Extraction as a job


@query("", """WITH c AS (SELECT user_id AS doc, event_id AS chunk, event_id % 7 = 3 AS bad, CASE WHEN event_id % 5 < 2 THEN ['USD', 'EUR'][event_id % 2 + 1] ELSE '' END AS currency, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'unit' || (event_id % 4) END AS unit, floor(value) AS v FROM events)
  SELECT doc, arg_max(currency, chunk) FILTER (NOT bad AND currency <> '') AS currency, arg_max(unit, chunk) FILTER (NOT bad AND unit <> '') AS currency_unit, 'v' || min(chunk) FILTER (NOT bad) AS vendor_name, count(*) FILTER (bad) AS n_failed,
  CASE WHEN bool_and(bad) THEN 'failed' ELSE 'done' END AS status, 3 * count(*) FILTER (NOT bad) AS n_items, 2 * count(*) FILTER (NOT bad) AS n_leaves, CAST(coalesce(sum(v + 2) FILTER (NOT bad), 0) AS DOUBLE) AS items_sum FROM c GROUP BY 1""")  # fmt: skip
def merged_chunks(spark, d):
    """Answers of chunks, every seventh of which is no document: heads, currencies, sums and items merged in order."""
    n = F.col("event_id")
    currency = F.when(n % 5 < 2, F.element_at(F.array(F.lit("USD"), F.lit("EUR")), (n % 2 + 1).cast("int"))).otherwise("")
    unit = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("unit"), (n % 4).cast("string")))
    item = F.concat(F.lit('{"name_raw": "a", "amount": '), F.floor("value").cast("string"), F.lit('}, {"name_raw": "h", "is_category_header": true, "amount": 99}, {"name_raw": "b", "amount": 2}'))
    answer = F.when(n % 7 == 3, "sorry").otherwise(F.concat(F.lit('```json\n{"vendor_name": "v'), n.cast("string"), F.lit('", "currency": "'), currency, F.lit('", "currency_unit": "'), unit, F.lit('", "items": ['), item, F.lit("]}\n```")))
    chunks = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), n.alias("chunk"), answer.alias("answer"), F.lit(None).cast("string").alias("error"))
    heads, items = X.merge_chunks(X.parse_answers(chunks), "doc_id")
    counts = items.groupBy("doc_id").agg(F.count("*").alias("n_items"))
    return heads.join(counts, "doc_id", "left").select(F.col("doc_id").alias("doc"), "currency", "currency_unit", "vendor_name", "n_failed", "status", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "n_leaves", "items_sum")


@query("", """WITH e AS (SELECT *, event_id // 4 AS row FROM events WHERE event_id % 4 = 0)
  SELECT e.event_id, CASE e.row % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Head > 1.2 > Part' WHEN 2 THEN '3 > Orphan' WHEN 3 THEN 'loose' WHEN 4 THEN NULL WHEN 5 THEN 'Head > Total station rental' WHEN 6 THEN '2' WHEN 7 THEN NULL END AS path,
  CASE e.row % 8 WHEN 1 THEN 'Head' WHEN 2 THEN '3' WHEN 3 THEN 'loose' WHEN 5 THEN 'Head' WHEN 6 THEN '2' END AS category FROM e""")  # fmt: skip
def sequence_items(spark, d):
    """Each file is a sheet of eight numbered rows: a heading, parts of it, a number whose heading is absent, a loose row, a total, a number with an amount alone, an amount alone."""
    rows = table(spark, d, "events").where("event_id % 4 = 0").select("event_id", F.floor(F.col("event_id") / 4).cast("long").alias("n"))
    k = (F.col("n") % 8 + 1).cast("int")

    def pick(*values):
        return F.element_at(F.array(*map(F.lit, values)), k)

    cells = rows.select(
        "event_id", F.concat(F.lit("f"), F.floor(F.col("n") / 8).cast("string")).alias("file"), F.lit("s").alias("sheet"), (F.col("n") % 8 + 2).cast("int").alias("row"),
        F.posexplode(F.array(pick("1", "1.2.1", "3.1", "", "", "1.1", "2", ""), pick("Head", "Part", "Orphan", "loose", "합계", "Total station rental", "", ""), pick("", "5", "6", "7", "99", "8", "9", "3"))).alias("col", "value"),
    )
    items = X.extract_by_mapping(cells.drop("event_id"), {0: "seq", 1: "name", 2: "amount"}, 1)
    ids = cells.where("col = 0").select("file", "row", "event_id")
    heads = ids.join(items, ["file", "row"], "left")
    return heads.select("event_id", "path", "category")


# Paths, files, flags and listings


@query("named", "SELECT DISTINCT submission_id, category || ' > ' || brand AS unit FROM named")
def units_at_level(spark, d):
    return H.units_at_level(BidModel(spark, d).named, 2)


@query("", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE s_name || '_20240229_010203.' || ['xlsx', 'pdf', 'docx', 'xls'][s_suppkey % 5 + 1] END AS landed FROM supplier""")
def landing_names(spark, d):
    ending = F.element_at(F.array(*map(F.lit, ("XLSX", "pdf", "docx", "xls", "exe"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", L.landing_name(F.concat("s_name", F.lit("."), ending), F.lit("2024-02-29 01:02:03").cast("timestamp_ntz")).alias("landed"))


@query("lines submissions", "SELECT submission_id, CASE WHEN l_suppkey % 3 = 0 THEN true WHEN l_suppkey % 3 = 1 THEN false ELSE is_deleted END AS is_deleted FROM submissions")
def soft_delete(spark, d):
    rows = BidModel(spark, d).submissions.select("submission_id", "l_suppkey", "is_deleted")
    gone = L.set_flag(rows, rows.where("l_suppkey % 3 = 0"), "submission_id", "is_deleted", True)
    return L.set_flag(gone, rows.where("l_suppkey % 3 = 1"), "submission_id", "is_deleted", False).select("submission_id", "is_deleted")


@query("bids", "SELECT bid_id, bid_id % 2 = 0 AS is_active FROM bids")
def toggle_active(spark, d):
    rows = BidModel(spark, d).bids.select("bid_id", F.lit(True).alias("is_active"))
    return L.set_flag(rows, rows.where("bid_id % 2 = 1"), "bid_id", "is_active")


@query("clusters", "SELECT cluster_id, CASE WHEN bid_id % 3 = 0 THEN upper(name) ELSE name END AS name FROM clusters")
def rename_clusters(spark, d):
    found = BidModel(spark, d).clusters
    names = found.where("bid_id % 3 < 2").select("cluster_id", F.when(F.col("bid_id") % 3 == 0, F.upper("name")).otherwise("  ").alias("new_name"))
    return C.rename(found.select("cluster_id", "name"), names)


@query("", """WITH s AS (SELECT CONCAT('size-', p_size) AS file, p_partkey AS row, p_type AS v, p_size % 2 = 0 AS grouped FROM part) SELECT file, grouped, CAST(CASE WHEN grouped THEN sum(1) ELSE 0 END AS BIGINT) AS n_lines FROM s GROUP BY 1, 2""")
def sheet_chunks(spark, d):
    """Sheets with a grouping column in chunks, and those without one."""
    parts = table(spark, d, "part").select(F.concat(F.lit("size-"), F.col("p_size").cast("string")).alias("file"), F.lit("s").alias("sheet"), (F.col("p_partkey") + 2).alias("row"), "p_size", "p_type", "p_name")  # keys begin with 0, the heading is row 1
    heads = parts.select("file", "sheet", "p_size").distinct().select("file", "sheet", F.lit(1).cast("bigint").alias("row"), "p_size", F.when(F.col("p_size") % 2 == 0, "중분류").otherwise("type").alias("p_type"), F.lit("품명").alias("p_name"))
    cells = parts.unionByName(heads).select("file", "sheet", "row", F.posexplode(F.array("p_type", "p_name")).alias("col", "value"))
    chunks, asked = X.sheet_chunks(cells)
    found = chunks.groupBy("file").agg(F.sum("n_lines").alias("n_lines")).select("file", F.lit(True).alias("grouped"), "n_lines")
    return found.unionByName(asked.select("file", F.lit(False).alias("grouped"), F.lit(0).cast("bigint").alias("n_lines")))
