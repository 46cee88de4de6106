"""Queries over jobs that link names: clustering window by window, similar names, candidates, scans; each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from bidloom.adapter import BidModel
from bidloom.operators import clusters as C
from bidloom.operators import matching as M
from bidloom.operators import names, rounds, scan
from bidloom.plans.queries import _sheet, query
from bidloom.session import table
from bidloom.sources.sheets import header_preview
from bidloom.stages import keep, new_path
from bidloom.streaming.extraction import EVENTS, follow_extraction, latest

# Windows of a provider


def by_last_word(task: str, text: str) -> str:
    """A provider that knows things by the last word of their names, and only what the text shows."""
    if task == "form":
        groups: dict[str, list[tuple[str, str]]] = {}
        for name, item in re.findall(r"^  - (.*)  \[.*?\] \(id=(.*?)\)$", text.split("## 전체 품목")[1], re.M):
            groups.setdefault(name.split(" ")[-1], []).append((item, name))
        return json.dumps({"clusters": [{"representative_name": x[0][1], "all_item_ids": [i for i, _ in x], "similarity_score": 0.9} for x in groups.values() if len(x) > 1]})
    known = {name.split(" ")[-1]: c for c, name in re.findall(r"^  - cluster_id=(.*?) \| 대표명=(.*?) \| 멤버", text, re.M)}
    items = re.findall(r"^  - id=(.*?) \| 품목명=(.*?) \| 카테고리", text, re.M)
    return "```json\n" + json.dumps({"additions": [{"item_id": i, "cluster_id": known[n.split(" ")[-1]], "confidence": 0.8} for i, n in items if n.split(" ")[-1] in known]}) + "\n```"


_NAMED_PARTS = """SELECT split_part(p_type, ' ', 1) || '-' || (p_size % 2) AS grp, CAST(p_partkey AS VARCHAR) AS item, p_brand AS vendor, 'k' || (p_partkey * 7919 % 230) AS key, lower(p_name || ' k' || (p_partkey * 7919 % 230)) AS folded FROM part"""


@query("", f"""WITH RECURSIVE named AS ({_NAMED_PARTS}),
  st AS (SELECT 0 AS r, *, (row_number() OVER w - 1) // 90 AS c, 1 AS f, row_number() OVER w AS o, CAST(NULL AS VARCHAR) AS rep, (count(*) OVER (PARTITION BY grp) + 89) // 90 AS k FROM named WINDOW w AS (PARTITION BY grp ORDER BY folded, item)
   UNION ALL
   SELECT r + 1, grp, item, vendor, key, folded, CASE WHEN pool AND now IS NULL THEN c + 1 ELSE c END, CASE WHEN pool AND now IS NULL THEN 0 ELSE f END, CASE WHEN pool AND now IS NULL THEN r * 1000 + rk ELSE o END, now, k FROM (
    SELECT *, coalesce(rep, known, CASE WHEN rest AND n >= 2 AND lo <> hi THEN head.i END) AS now FROM (
     SELECT *, count(*) FILTER (rest) OVER g AS n, min(vendor) FILTER (rest) OVER g AS lo, max(vendor) FILTER (rest) OVER g AS hi, min({{'f': folded, 'i': item}}) FILTER (rest) OVER g AS head FROM (
      SELECT *, pool AND known IS NULL AS rest FROM (
       SELECT *, CASE WHEN pool THEN max(rep) OVER (PARTITION BY grp, key) END AS known FROM (
        SELECT *, active AND c = m AND rk < 90 AS pool FROM (
         SELECT *, row_number() OVER (PARTITION BY grp, active, c ORDER BY f, o) - 1 AS rk FROM (
          SELECT *, rep IS NULL AND c < k AS active, min(CASE WHEN rep IS NULL AND c < k THEN c END) OVER (PARTITION BY grp) AS m FROM st))))) WINDOW g AS (PARTITION BY grp, key)) WHERE m IS NOT NULL))
  SELECT grp, item AS item_id, arg_max(rep, r) AS representative, arg_max(rep IS NOT NULL, r) AS is_clustered FROM st GROUP BY 1, 2""")  # fmt: skip
def windowed_clusters(spark, d):
    """Catalog items of each kind, clustered by a provider that sees 90 of them at a time; equal things lie in distant windows."""
    code = F.concat(F.lit("k"), (F.col("p_partkey") * 7919 % 230).cast("string"))
    items = table(spark, d, "part").select(F.concat_ws("-", F.split_part("p_type", F.lit(" "), F.lit(1)), (F.col("p_size") % 2).cast("string")).alias("grp"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("vendor_id"), F.concat_ws(" ", "p_name", code).alias("name"))
    clusters, members, left, _ = rounds.cluster_in_rounds(items, ["grp"], by_last_word)
    held = members.join(clusters.select("grp", "cluster_id", F.col("representative_item_id").alias("representative")), "cluster_id").select("grp", "item_id", "representative")
    return held.withColumn("is_clustered", F.lit(True)).unionByName(left.withColumn("is_clustered", F.lit(False)), allowMissingColumns=True)


# Groups of any size


@query("", """WITH e AS (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN value END AS v, CAST(floor(value / 25) AS BIGINT) % 3 AS label FROM events),
  b AS (SELECT *, row_number() OVER w - 1 AS position, last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS filled, CASE WHEN row_number() OVER w > 1 AND label IS NOT DISTINCT FROM lag(label) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (ORDER BY ts, event_id)),
  r AS (SELECT *, CAST(sum(new) OVER (ORDER BY position) AS BIGINT) AS run FROM b) SELECT event_id, position, filled, run, row_number() OVER (PARTITION BY run ORDER BY position) - 1 AS run_place, count(*) OVER () AS n FROM r""")  # fmt: skip
def one_long_sheet(spark, d):
    """All events as one sheet: numbered, filled down and cut into runs without a task that holds it."""
    rows = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("filled"), (F.floor(F.col("value") / 25) % 3).alias("label"), F.lit("all").alias("sheet"))
    order = ["ts", "event_id"]
    done = scan.fill_forward(scan.number(rows, ["sheet"], order, size="n"), ["sheet"], order, ["filled"])
    return scan.runs(done, ["sheet"], order, "label").select("event_id", "position", "filled", "run", "run_place", "n")


# Names that are alike

_GRAMS = "list_sort(list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))))"
_VARIED = """varied AS (SELECT p_size AS grp, CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS vendor, p_partkey AS seq,
  CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_brand || ' ' || p_type WHEN 1 THEN p_type || ' ' || p_name || ' ' || p_brand ELSE replace(p_name, 'i', '') || ' ' || upper(p_brand) || ' ' || p_type END AS name FROM part)"""
_PAIRS = f"""{_VARIED}, sets AS (SELECT grp, {_GRAMS.format('name')} AS g, min(name) AS name FROM varied GROUP BY 1, 2),
  pairs AS (SELECT x.grp, x.name AS a, y.name AS b, x.g AS ga, y.g AS gb, length(list_intersect(x.g, y.g)) AS n FROM sets x JOIN sets y ON x.grp = y.grp AND x.name < y.name),
  near AS (SELECT grp, a, b, ga, gb, n / (length(ga) + length(gb) - n) AS similarity FROM pairs WHERE n / (length(ga) + length(gb) - n) >= 0.6)"""


def _varied(spark, d):
    """Parts whose names are written in three ways: as they are, with their words in another order, with letters left out and in capitals."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat_ws(" ", "p_name", "p_brand", "p_type")).when(k == 1, F.concat_ws(" ", "p_type", "p_name", "p_brand")).otherwise(F.concat_ws(" ", F.replace("p_name", F.lit("i"), F.lit("")), F.upper("p_brand"), "p_type"))
    return table(spark, d, "part").select(F.col("p_size").alias("grp"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("vendor_id"), F.col("p_partkey").alias("seq"), name.alias("name"))


@query("", f"WITH {_PAIRS} SELECT grp, a, b, round(similarity, 6) AS similarity FROM near")
def similar_names(spark, d):
    return names.similar(_varied(spark, d), None, ["grp"], "name", 0.6).withColumn("similarity", F.round("similarity", 6))


@query("", f"""WITH RECURSIVE {_PAIRS}, sides AS (SELECT grp, ga, gb FROM near UNION ALL SELECT grp, gb, ga FROM near),
  reach AS (SELECT grp, g, g AS root FROM sets UNION SELECT r.grp, b.gb, r.root FROM reach r JOIN sides b ON b.grp = r.grp AND b.ga = r.g),
  roots AS (SELECT grp, g, min(root) AS root FROM reach GROUP BY 1, 2),
  held AS (SELECT v.*, r.root FROM varied v JOIN roots r ON r.grp = v.grp AND r.g = {_GRAMS.format('v.name')}),
  weak AS (SELECT r.grp, r.root, min(similarity) AS score FROM near n JOIN roots r ON r.grp = n.grp AND r.g = n.ga GROUP BY 1, 2),
  made AS (SELECT h.grp, h.root, count(*) AS n_items, count(DISTINCT vendor) AS n_vendors, arg_min(item_id, seq) AS rep_item_id FROM held h GROUP BY 1, 2)
  SELECT m.grp, m.rep_item_id, m.n_items, m.n_vendors, round(coalesce(w.score, 1), 6) AS score FROM made m LEFT JOIN weak w ON w.grp = m.grp AND w.root = m.root WHERE m.n_items >= 2 AND m.n_vendors >= 2""")  # fmt: skip
def similar_clusters(spark, d):
    """Clusters of the parts of a size whose names are linked by similarity."""
    rows = _varied(spark, d)
    found = C.valid_clusters(names.similar_clusters(rows, "grp", 0.6), rows)
    return found.join(rows.select(F.col("item_id").alias("rep_item_id"), "grp"), "rep_item_id").select("grp", "rep_item_id", "n_items", "n_vendors", F.round("score", 6).alias("score"))


_CATALOG = "known AS (SELECT p_partkey AS catalog_item_id, p_name || ' ' || p_brand || ' ' || p_type AS name FROM part)"


@query("", f"""WITH {_VARIED}, {_CATALOG}, k AS (SELECT catalog_item_id, {_GRAMS.format('name')} AS g FROM known), own AS (SELECT DISTINCT {_GRAMS.format('name')} AS g FROM varied),
  p AS (SELECT own.g, k.catalog_item_id, length(list_intersect(own.g, k.g)) AS n, length(own.g) + length(k.g) AS s FROM own, k), best AS (SELECT g, min({{'s': -n / (s - n), 'i': catalog_item_id}}) AS m FROM p WHERE n / (s - n) >= 0.6 GROUP BY 1)
  SELECT item_id, m.i AS catalog_item_id, round(coalesce(-m.s, 0), 6) AS confidence, CASE WHEN m IS NULL THEN '' ELSE 'name' END AS reason FROM varied v LEFT JOIN best b ON b.g = {_GRAMS.format('v.name')}""")  # fmt: skip
def similar_matches(spark, d):
    """Parts matched to the catalog by the most similar name."""
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("catalog_item_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return names.match_similar(_varied(spark, d), catalog, 0.6).withColumn("confidence", F.round("confidence", 6))


@query("", f"""WITH {_VARIED}, {_CATALOG}, c AS (SELECT catalog_item_id, unnest({_GRAMS.format('name')}) AS gram FROM known), df AS (SELECT gram, 1000000 // count(*) AS w FROM c GROUP BY 1),
  n AS (SELECT name, unnest({_GRAMS.format('name')}) AS gram FROM (SELECT DISTINCT name FROM varied)), s AS (SELECT name, catalog_item_id, CAST(sum(w) AS BIGINT) AS score FROM n JOIN c USING (gram) JOIN df USING (gram) GROUP BY 1, 2)
  SELECT * FROM (SELECT name, catalog_item_id, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, catalog_item_id) AS place FROM s) WHERE place <= 3""")  # fmt: skip
def catalog_candidates(spark, d):
    """The three likeliest catalog items of each name."""
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("catalog_item_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    return names.candidates(_varied(spark, d), catalog, 3)


_ITEM_LINES = """lines2 AS (SELECT *, '  - item_id=' || item_id || ' | category=' || category || ' | name=' || name || ' | spec=' || brand || ' | qty=' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' EA' AS line FROM named WHERE NOT is_header)"""


@query("named", f"""--with cat AS (SELECT p_partkey AS catalog_item_id, p_name AS name, p_type AS category, p_brand AS brand FROM part), c AS (SELECT catalog_item_id, unnest({_GRAMS.format('name')}) AS gram FROM cat), df AS (SELECT gram, 1000000 // count(*) AS w FROM c GROUP BY 1),
  n AS (SELECT name, unnest({_GRAMS.format('name')}) AS gram FROM (SELECT DISTINCT name FROM named WHERE NOT is_header)), s AS (SELECT name, catalog_item_id, CAST(sum(w) AS BIGINT) AS score FROM n JOIN c USING (gram) JOIN df USING (gram) GROUP BY 1, 2),
  best AS (SELECT * FROM (SELECT name, catalog_item_id, row_number() OVER (PARTITION BY name ORDER BY score DESC, catalog_item_id) AS place FROM s) WHERE place <= 3),
  {_ITEM_LINES}, left_part AS (SELECT submission_id, count(*) AS n_items, string_agg(line, chr(10) ORDER BY l_orderkey, l_partkey, l_linenumber, amount, quantity) AS t FROM lines2 GROUP BY 1),
  wanted AS (SELECT DISTINCT submission_id, b.catalog_item_id FROM lines2 l JOIN best b ON b.name = l.name),
  right_part AS (SELECT submission_id, count(*) AS n_catalog, string_agg('  - catalog_item_id=' || k.catalog_item_id || ' | name=' || k.name || ' | category=' || k.category || ' | unit=EA | aliases=' || k.name || ' ' || k.brand || ', ' || k.brand, chr(10) ORDER BY k.catalog_item_id) AS t FROM wanted w JOIN cat k ON k.catalog_item_id = w.catalog_item_id GROUP BY 1)
  SELECT submission_id, n_items, n_catalog, sha256('## 라인 아이템 목록 (' || n_items || '개)' || chr(10) || l.t || chr(10) || chr(10) || '## 카탈로그 품목 목록 (' || n_catalog || '개)' || chr(10) || r.t) AS text_sha256 FROM left_part l JOIN right_part r USING (submission_id)""")  # fmt: skip
def match_input(spark, d):
    """Each submission's items beside the three likeliest catalog items of each, as a provider is shown them."""
    rows = BidModel(spark, d).named.withColumns({"unit": F.lit("EA"), "shown": F.col("quantity").cast("long")})
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("catalog_item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.lit("EA").alias("unit_std"), F.array(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_brand")).alias("aliases"))
    found = names.candidates(rows.where("NOT is_header").select("name"), catalog.select("catalog_item_id", "name"), 3)
    texts = M.match_input(rows.drop("quantity").withColumnRenamed("shown", "quantity"), catalog, found)
    return texts.select("submission_id", "n_items", "n_catalog", F.sha2("text", 256).alias("text_sha256"))


@query("named", """--with p AS (SELECT bid_id, concat_ws(':', bid_id, replace(lower(name), ' ', '')) AS id, count(*) AS n FROM named WHERE NOT is_header GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2)
  SELECT id AS cluster_id, CASE WHEN bid_id % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status, n AS n_members FROM p UNION ALL SELECT id || ' #2', 'rejected', n FROM p WHERE bid_id % 3 = 0 AND bid_id % 2 = 0
  UNION ALL SELECT id || CASE WHEN bid_id % 2 = 0 THEN ' #3' ELSE ' #2' END, 'pending', n FROM p WHERE bid_id % 3 = 0""")  # fmt: skip
def clustering_reruns(spark, d):
    """Three runs over a bid: a third of the bids reject what the first finds, half of those also what the second finds."""
    m = BidModel(spark, d)
    rows = keep(m.members_all.select("item_id", "bid_id", "name", F.col("l_suppkey").alias("vendor_id"), "seq"), "items")
    found, members = rows.select("bid_id", F.lit("").alias("cluster_id"), "name", F.lit("").alias("status")).limit(0), rows.select(F.lit("").alias("cluster_id"), "item_id").limit(0)
    for reject in ("bid_id % 3 = 0", "bid_id % 6 = 0", "false"):
        found, members, _ = C.run_clustering(rows, found, members, ["bid_id"])
        found = keep(C.set_status(found, F.expr(f"status = 'pending' AND {reject}"), "rejected"), "clusters")
    return members.groupBy("cluster_id").agg(F.count("*").alias("n_members")).join(found.select("cluster_id", "status"), "cluster_id")


# Extraction as a stream


@query("", """WITH a AS (SELECT event_id // 4 AS s, event_id % 4 AS chunk, ts, event_id % 7 = 3 AS bad FROM events WHERE event_type <> 'click'),
  g AS (SELECT s, count(*) FILTER (NOT bad) AS n_done, count(*) FILTER (bad) AS n_failed, max(ts) AS last FROM a GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 1 MINUTE AS mark FROM a)
  SELECT CAST(s AS VARCHAR) AS submission_id, n_done, n_failed, CASE WHEN n_done + n_failed = 4 THEN CASE WHEN n_done > 0 THEN 'done' ELSE 'failed' END WHEN date_trunc('millisecond', last) + INTERVAL 2 DAY <= date_trunc('millisecond', mark) THEN 'failed' ELSE 'processing' END AS status FROM g, w""")  # fmt: skip
def extraction_progress(spark, d):
    """All events as answers of a provider, four to a submission, some of which never come and some of which are no document, followed as a stream."""
    n = F.col("event_id")
    rows = table(spark, d, "events").where("event_type <> 'click'").select(F.floor(n / 4).cast("string").alias("submission_id"), F.lit(4).alias("n_chunks"), (n % 4).cast("int").alias("chunk"), F.col("ts").cast("timestamp").alias("at"), F.when(n % 7 == 3, "sorry").otherwise('{"items": [{"name_raw": "a", "amount": 1}]}').alias("answer"), F.lit(None).cast("string").alias("error"))
    folder = new_path(spark, "extraction")
    rows.write.parquet(f"{folder}/answers")
    follow_extraction(spark, f"{folder}/answers", f"{folder}/events", f"{folder}/checkpoint", retries=0, patience="2 days").awaitTermination()
    return latest(spark.read.schema(EVENTS).parquet(f"{folder}/events")).select("submission_id", F.col("n_done").cast("long").alias("n_done"), F.col("n_failed").cast("long").alias("n_failed"), "status")


# Sheets


@query("", """WITH s AS (SELECT CONCAT('parts-', p_partkey // 40) AS file, p_partkey % 40 + 1 AS row, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, '') AS a, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, '') AS b, p_name AS c FROM part),
  h AS (SELECT file, arg_min(row, (-((a <> '')::INT + (b <> '')::INT + 1), row)) AS header_row FROM s WHERE row <= 6 GROUP BY 1),
  x AS (SELECT s.file, h.header_row, s.row, list_filter([CASE WHEN k.a <> '' THEN s.a END, CASE WHEN k.b <> '' THEN s.b END, s.c], lambda v: v IS NOT NULL) AS line FROM s JOIN h ON h.file = s.file JOIN s k ON k.file = h.file AND k.row = h.header_row WHERE s.row BETWEEN h.header_row AND h.header_row + 4)
  SELECT file, header_row, array_to_string(arg_min(line, row), '|') AS heads, string_agg(CASE WHEN row > header_row THEN array_to_string(line, '|') END, '/' ORDER BY row) AS preview FROM x GROUP BY 1, 2""")  # fmt: skip
def sheet_preview(spark, d):
    """The likely header of each sheet of parts and the four rows below it."""
    cells = _sheet(spark, d).select("file", F.lit("s").alias("sheet"), "row", F.posexplode(F.array("cat1", "cat2", "name")).alias("col", "value"))
    shown = header_preview(cells)
    return shown.select("file", "header_row", F.array_join(F.col("columns")["value"], "|").alias("heads"), F.array_join(F.transform("preview", lambda r: F.array_join(r, "|")), "/").alias("preview"))
