"""Queries over what is built once and kept: vectors and their cells, totals under changes, nested trees, texts by their runs; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.adapter import BidModel
from bidloom.operators import compare as P
from bidloom.operators import hierarchy as H
from bidloom.operators import increments as I
from bidloom.operators import similarity as V
from bidloom.operators import vectors
from bidloom.operators.textindex import TextIndex
from bidloom.operators.textindex import search as text_search
from bidloom.plans.queries import _MEMBERS, SQL, _members, query
from bidloom.session import table
from bidloom.stages import keep, new_path

# Vectors


@query("", SQL["cosine_top3"])
def indexed_top3(spark, d):
    """The same rows as by all pairs, from an index of cells."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.search(vectors.cell_index(rows, "vec_id", "embedding"), rows.where("vec_id % 100 = 0"), "vec_id", "embedding", least=0.25)


def letters(texts: list[str]) -> list[list[float]]:
    """A provider of vectors that counts each letter."""
    return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]


@query("", """WITH t AS (SELECT p_partkey AS part_id, list_transform(range(26), lambda i: CAST(length(s) - length(replace(s, chr(CAST(97 + i AS INTEGER)), '')) AS DOUBLE)) AS v FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS s FROM part)),
  p AS (SELECT a.part_id AS anchor_id, b.part_id AS other, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM t a JOIN t b ON a.part_id % 100 = 0 AND a.part_id <> b.part_id)
  SELECT * FROM (SELECT anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, other) AS place, other, similarity FROM p WHERE similarity >= 0.55) WHERE place <= 3""")  # fmt: skip
def embedded_top3(spark, d):
    """Parts most like every hundredth part, by vectors that a provider gives for their texts."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    rows = vectors.embed(rows, "text", letters, new_path(spark, "embedded"))
    return vectors.search(vectors.cell_index(rows, "part_id", "vector"), rows.where("part_id % 100 = 0"), "part_id", "vector")


# Totals under changes


@query("lines", """SELECT submission_id, CAST(sum(CASE WHEN l_linenumber = 2 THEN 2 * amount ELSE amount END) AS BIGINT) AS subtotal, count(*) AS n_items
  FROM lines WHERE NOT is_header AND l_linenumber <> 3 GROUP BY 1""")  # fmt: skip
def subtotals_after_changes(spark, d):
    """Subtotals of submissions after some items went and some changed; only the changes are read for that."""
    rows = BidModel(spark, d).lines.where("NOT is_header").select("item_id", "submission_id", "l_linenumber", "amount")
    kept = I.subtotals(new_path(spark, "subtotals"))
    kept.apply(rows.withColumn("sign", F.lit(1)), 1)
    changes = rows.where("l_linenumber IN (2, 3)").withColumns({"amount": F.col("amount") * 2, "is_deleted_row": F.col("l_linenumber") == 3})
    for _ in range(2):  # a batch that is repeated counts once
        kept.apply(I.signed(rows, changes, "item_id"), 2)
    return kept.read(spark).select("submission_id", F.col("amount").alias("subtotal"), F.col("n").alias("n_items"))


@query("history", """--with c AS (SELECT project_id AS source, catalog_item_id, bid_id, amount, CASE WHEN l_suppkey % 5 = 1 THEN unit_price + 100 ELSE unit_price END AS unit_price FROM history WHERE NOT is_deleted AND l_suppkey % 5 <> 0)
  SELECT r_regionkey AS project_id, catalog_item_id, min(unit_price) AS min_price, max(unit_price) AS max_price, CAST(sum(unit_price) AS DOUBLE) / count(*) AS avg_price, CAST(sum(amount) AS DOUBLE) / count(*) AS avg_amount,
  count(*) AS n_prices, count(DISTINCT bid_id) AS n_bids FROM region JOIN c ON source <> r_regionkey WHERE unit_price > 0 GROUP BY 1, 2""")  # fmt: skip
def benchmark_after_changes(spark, d):
    """Benchmarks after some recorded prices went and some changed, extremes included."""
    m = BidModel(spark, d)
    rows = m.history.where("NOT is_deleted")
    kept = I.prices(new_path(spark, "prices"))
    kept.apply(rows.withColumn("sign", F.lit(1)), 1)
    kind = F.pmod("l_suppkey", F.lit(5))
    changes = rows.where(kind < 2).withColumns({"unit_price": F.col("unit_price") + 100, "is_deleted_row": kind == 0})
    kept.apply(I.signed(rows, changes, "item_id"), 2)
    return P.benchmark_of_sums(I.price_sums(kept.compact(spark, new_path(spark, "prices")).read(spark)), m.projects)


# Nested trees

_NODE = """'{{"name":"' || {name} || '","path":"' || {path} || '","amount":' || {a} || ',"n_items":' || {n} || ',"depth":{depth},"is_leaf":{is_leaf},"leaf_data":' || {leaf} || ',"children":[' || {children} || ']}}'"""
_LEAF = """'{"item_id":"' || item_id || '","name":"' || name || '","brand":"' || brand || '","quantity":' || CAST(quantity AS BIGINT) || ',"unit_price":' || unit_price || ',"amount":' || amount || '}'"""


@query("named", f"""--with r AS (SELECT *, {{'a': l_orderkey, 'b': l_partkey, 'c': l_linenumber, 'd': amount, 'e': quantity}} AS seq FROM named WHERE NOT is_header),
  l3 AS (SELECT submission_id, category, brand, name, sum(amount) AS a, count(*) AS n, min(seq) AS f, arg_max({_LEAF}, seq) AS leaf FROM r GROUP BY 1, 2, 3, 4),
  l2 AS (SELECT submission_id, category, brand, sum(a) AS a, sum(n) AS n, min(f) AS f, string_agg({_NODE.format(name='name', path="category || ' > ' || brand || ' > ' || name", a='a', n='n', depth=3, is_leaf='true', leaf='leaf', children="''")}, ',' ORDER BY f, name) AS t FROM l3 GROUP BY 1, 2, 3),
  l1 AS (SELECT submission_id, category, sum(a) AS a, sum(n) AS n, min(f) AS f, string_agg({_NODE.format(name='brand', path="category || ' > ' || brand", a='a', n='n', depth=2, is_leaf='false', leaf="'null'", children='t')}, ',' ORDER BY f, brand) AS t FROM l2 GROUP BY 1, 2)
  SELECT submission_id, '{{"tree":[' || string_agg({_NODE.format(name='category', path='category', a='a', n='n', depth=1, is_leaf='false', leaf="'null'", children='t')}, ',' ORDER BY f, category) || '],"total":' || sum(a) || ',"max_depth":3}}' AS tree FROM l1 GROUP BY 1""")  # fmt: skip
def submission_trees(spark, d):
    """Each submission's tree of items as one JSON text."""
    m = BidModel(spark, d)
    return H.nested_tree(m.named_by_submission.withColumn("quantity", F.col("quantity").cast("long")), levels=H.deepest(m.parts), dealt=True)


# Substring search


@query("named", "SELECT item_id, name, brand, amount FROM named WHERE NOT is_header AND (name ILIKE '%WIDGET%1_%' OR brand ILIKE '%and#1_%')")
def indexed_search(spark, d):
    """Items whose name or brand holds a pattern, found by an index of their texts."""
    m = BidModel(spark, d)
    names = TextIndex(new_path(spark, "names")).build(m.parts, "name")
    brands = TextIndex(new_path(spark, "brands")).build(m.parts, "brand")
    rows = m.named.where("NOT is_header").select("item_id", "name", "brand", "amount")
    return text_search(rows, {"name": (names, "WIDGET%1_"), "brand": (brands, "and#1_")})


# Texts that are alike

_BOUND = """n AS (SELECT text, c, row_number() OVER (PARTITION BY text, c) AS i FROM (SELECT text, unnest(string_split(text, '')) AS c FROM (SELECT DISTINCT text FROM t))),
  p AS (SELECT a.text AS anchor, b.text AS text, 2 * count(*) / (length(a.text) + length(b.text)) AS bound FROM n a JOIN n b ON a.c = b.c AND a.i = b.i GROUP BY 1, 2)"""


@query("", f"""WITH t AS (SELECT p_partkey AS part_id, p_brand || ' ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_type) || ' ' || p_size ELSE '' END AS text FROM part), {_BOUND} SELECT anchor, text FROM p WHERE bound >= 0.8""")
def reachable_texts(spark, d):
    """Pairs of parts' different texts, each in both orders and with itself, whose ratio could reach 0.8 by their characters."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.concat(F.concat_ws(" ", "p_brand", "p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "), F.col("p_size").cast("string"))).otherwise("")).alias("text"))
    return V.reachable(rows, rows, "text", 0.8)


@query("clusters", f"""--with {_MEMBERS}, x AS (SELECT cluster_id, lower(concat_ws(' ', min(name), string_agg(DISTINCT concat_ws(' ', name, brand), ' ' ORDER BY concat_ws(' ', name, brand)))) AS s FROM members GROUP BY 1),
  t AS (SELECT c.bid_id, c.cluster_id, c.name, c.status, list_transform(range(26), lambda i: CAST(length(s) - length(replace(s, chr(CAST(97 + i AS INTEGER)), '')) AS DOUBLE)) AS v FROM clusters c JOIN x ON x.cluster_id = c.cluster_id),
  f AS (SELECT bid_id, min(cluster_id) AS anchor_id FROM t GROUP BY 1), p AS (SELECT f.anchor_id, b.cluster_id, b.name, b.status, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM f JOIN t a ON a.cluster_id = f.anchor_id JOIN t b ON b.bid_id = f.bid_id AND b.cluster_id <> f.anchor_id),
  r AS (SELECT *, status <> 'rejected' AND similarity >= 0.55 AS live FROM p), g AS (SELECT *, live AND row_number() OVER (PARTITION BY anchor_id, live ORDER BY similarity DESC, cluster_id) <= 3 AS is_suggested FROM r)
  SELECT anchor_id, cluster_id, status, similarity, is_suggested, row_number() OVER (PARTITION BY anchor_id ORDER BY is_suggested DESC, similarity DESC, name, cluster_id) AS place FROM g""")  # fmt: skip
def cluster_suggestions(spark, d):
    """The first cluster of each bid beside the bid's others, the three most similar suggested for a merge."""
    clusters = BidModel(spark, d).clusters.select("bid_id", "cluster_id", F.col("name").alias("representative_name"), "status")
    texts = V.cluster_text(_members(spark, d)).select("cluster_id", F.lower("text").alias("text"))
    found = keep(vectors.embed(texts, "text", letters, new_path(spark, "embedded")).join(clusters.select("bid_id", "cluster_id"), "cluster_id"), "vectors")
    asked = found.groupBy("bid_id").agg(F.min("cluster_id").alias("anchor_id"))
    base = found.select("bid_id", F.col("cluster_id").alias("anchor_id"), F.col("vector").alias("anchor")).join(asked.select("anchor_id"), "anchor_id")
    similar = found.join(base, "bid_id").select("anchor_id", "cluster_id", F.round(V.cosine(F.col("anchor"), F.col("vector")), 4).alias("similarity"))
    return V.suggestions(clusters, asked, similar, ["bid_id"]).select("anchor_id", "cluster_id", "status", "similarity", "is_suggested", "place")
