"""Clusters made and changed by hand, listings with filters, and items as they are stored."""

from pyspark.sql import functions as F

from bidloom.operators import clusters, lifecycle, listing

REQUEST = "cluster_id string, bid_id int, name string, category string, place int, item_place int, item_id string"


def test_created_clusters(spark):
    members = spark.createDataFrame([("old", "a"), ("old", "b"), ("rest", "c"), ("rest", "d")], "cluster_id string, item_id string")
    items = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", ""), ("d", None), ("e", "y")], "item_id string, category string")
    asked = [("n1", 1, "one", None, 1, i, x) for i, x in enumerate("bae")] + [("n2", 1, "two", "", 2, i, x) for i, x in enumerate("cd")] + [("n3", 2, "three", "mine", 3, 0, "a")]
    made, now, emptied = clusters.create_from_items(members, items, spark.createDataFrame(asked, REQUEST))
    assert {(r.cluster_id, r.category, r.representative_item_id, r.similarity_summary) for r in made.collect()} == {("n1", "y", "b", "수동 생성 (y)"), ("n2", "기타", "c", "수동 생성 (기타)"), ("n3", "mine", "a", "수동 생성 (mine)")}
    assert {(r.cluster_id, r.item_id, r.role) for r in now.collect()} == {("n1", "b", "representative"), ("n1", "e", "duplicate"), ("n2", "c", "representative"), ("n2", "d", "duplicate"), ("n3", "a", "representative")}
    assert {r.cluster_id for r in emptied.collect()} == {"old", "rest"}
    tie = spark.createDataFrame([("n", 1, "t", None, 1, 1, "a"), ("n", 1, "t", None, 1, 0, "b")], REQUEST)
    assert clusters.create_from_items(members, items, tie)[0].first().category == "y"  # seen first
    none = clusters.create_from_items(members, items, tie.limit(0))
    assert none[0].isEmpty() and none[1].count() == 4 and none[2].isEmpty()


def test_excluded_and_deleted(spark):
    members = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c")], "cluster_id string, item_id string")
    items = spark.createDataFrame([("a", "p", "confirmed"), ("b", "p", None), ("c", None, "unmatched")], "item_id string, catalog_item_id string, match_status string")
    left, now = clusters.exclude_items(members, items, spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "item_id string"))
    assert {r.item_id for r in left.collect()} == {"b", "c"}
    assert {tuple(r) for r in now.select("item_id", "catalog_item_id", "match_status").collect()} == {("a", None, "unmatched"), ("b", "p", None), ("c", None, "unmatched")}
    stored = spark.createDataFrame([("k", "accepted", "p"), ("l", "accepted", "p"), ("m", "pending", None), ("n", "accepted", "q")], "cluster_id string, status string, catalog_item_id string")
    history = spark.createDataFrame([("k", "p", 1), ("l", "p", 2), ("n", "q", 3)], "cluster_id string, catalog_item_id string, unit_price int")
    catalog = spark.createDataFrame([("p",), ("q",)], "catalog_item_id string")
    gone = spark.createDataFrame([("k",), ("m",), ("n",), ("unknown",)], "cluster_id string")
    kept, rows, prices, known = clusters.delete_clusters(stored, members, gone, history, catalog)
    assert [r.cluster_id for r in kept.collect()] == ["l"] and [r.item_id for r in rows.collect()] == ["c"]
    assert [r.unit_price for r in prices.collect()] == [2] and [r.catalog_item_id for r in known.collect()] == ["p"]


def test_filters(spark):
    rows = spark.createDataFrame([(1, "IT", True), (2, "ALL", True), (3, "FACILITY", True), (4, "IT", False), (5, None, None)], "id int, domain string, is_active boolean")
    assert {r.id for r in listing.chosen(rows, {"domain": "ALL"}, domain="IT", is_active=True).collect()} == {1, 2}
    assert {r.id for r in listing.chosen(rows, domain="IT", is_active=None).collect()} == {1, 4}
    assert listing.chosen(rows).count() == 5
    catalog = spark.createDataFrame([(1, "Pump", ["x 20%"], "c", True), (2, "pipe", None, None, True), (3, "pump", [], "c", False)], "catalog_item_id int, name string, aliases array<string>, category_id string, is_active boolean")
    categories = spark.createDataFrame([("c", "C", "top")], "category_id string, category_name string, parent_id string")
    assert {r.catalog_item_id for r in listing.catalog_search(catalog, categories, "PUMP").collect()} == {1}
    assert {(r.catalog_item_id, r.category_name) for r in listing.catalog_search(catalog, categories, "x 20").collect()} == {(1, "C")}
    assert {(r.catalog_item_id, r.category_name) for r in listing.catalog_search(catalog, categories, active=False).collect()} == {(1, "C"), (2, None), (3, "C")}
    assert {r.catalog_item_id for r in listing.catalog_search(catalog, categories, active=False, category_id="c").collect()} == {1, 3}


def test_inserted_items(spark):
    kinds = "submission_id string, items array<struct<name_raw: string, path: string, parent_path: string, quantity: string, unit_price: string, amount: double, is_category_header: boolean, is_nego: boolean, unit_price_currency_in_source: string>>"
    rows = spark.createDataFrame([("s", [("[indent=3] a", "", "P", "1,000", "3.5원", 2.0, None, None, None), (None, None, None, "-", "1.2.3", None, True, True, "USD")]), ("t", []), ("u", None)], kinds)
    got = {r.sort_order: r for r in lifecycle.insert_items(rows).collect()}
    assert len(got) == 2
    a, b = got[0], got[1]
    assert (a.name_raw, a.path, a.quantity, a.unit_price, a.amount, a.is_header, a.is_nego, a.unit_price_currency) == ("a", "P", 1000.0, 3.5, 2.0, False, False, "KRW")
    assert (b.name_raw, b.path, b.quantity, b.unit_price, b.amount, b.is_header, b.is_nego, b.unit_price_currency) == ("", "", None, None, None, True, True, "USD")
    plain = spark.createDataFrame([("s", [("x",)])], "submission_id string, items array<struct<name_raw: string>>").transform(lifecycle.insert_items)
    assert plain.select(F.col("name_raw")).first()[0] == "x"
