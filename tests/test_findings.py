"""What a review found: results on odd keys, and what is shuffled, broadcast and compared."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from bidloom.adapter import BidModel
from bidloom.operators import clusters as C
from bidloom.operators import hierarchy as H
from bidloom.operators import names
from bidloom.operators import similarity as V
from bidloom.sources import sheets

D = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """No broadcasts by size, as with large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_part_with_the_first_key_is_a_line(spark, tmp_path):
    rows = [(0, "a", "b", "t", 2, 1.0), (1, "c", "b", "u", 2, 1.0), (2, "c", "b", "u", 3, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert {(r.file, r.grouped, r.n_lines) for r in queries()["sheet_chunks"](spark, str(tmp_path)).collect()} == {("size-2", True, 2), ("size-3", False, 0)}


def test_shuffles_carry_no_ids_that_are_texts(shuffled):
    lines = plan(BidModel(shuffled, D).named.select("item_id", "submission_id", "path", "amount")).splitlines()
    first = next(i for i, x in enumerate(lines) if "Exchange" in x)
    assert not any("concat_ws" in x for x in lines[first:])
    assert any("concat_ws" in x for x in lines[:first])


def test_units_meet_items_in_one_shuffle(shuffled):
    items = shuffled.range(50).selectExpr("concat('s', id % 3) AS submission_id", "concat('i', id) AS item_id", "'A > B > ' || id AS path", "'A' AS category", "'n' AS name", "id AS seq", "1 AS amount", "false AS is_header")
    units = shuffled.createDataFrame([("s0", "A"), ("s0", "A > B"), ("s1", "A>B"), ("s1", "A > B"), ("s2", None), ("s2", "A > ")], "submission_id string, unit string")
    found = H.match_unit(items, units, True)
    assert {(r.submission_id, r.unit) for r in found.collect()} == {("s0", "A > B"), ("s1", "A > B"), ("s2", "A > ")}
    assert plan(H.match_unit(items, units, True)).count("Exchange hashpartitioning") == 2
    assert H.group_by_unit(items, units, True, "path").count() == 3


def test_a_trees_texts_are_not_shuffled(shuffled):
    items = shuffled.range(40).selectExpr("concat('s', id % 3) AS submission_id", "'A > B' AS path", "'A' AS category", "concat('n', id % 5) AS name", "id AS seq", "1 AS amount", "concat('i', id) AS item_id", "false AS is_header")
    tree = H.nested_tree(items, leaf=("item_id",))
    assert plan(tree).count("Exchange hashpartitioning") == 1 and tree.count() == 3


def test_two_vendors_are_known_without_counting_them(shuffled):
    text = plan(BidModel(shuffled, D).clusters.select("cluster_id", "status"))
    assert "count(distinct" not in text and "hashpartitioning(bid_id" in text and ", l_suppkey" not in text.split("Exchange hashpartitioning(bid_id", 1)[1].splitlines()[0]


def test_runs_read_their_proposals_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(C, "keep", lambda df, name: kept.append(name) or df)
    items = spark.createDataFrame([("1", 1, 1, "Pump", 1), ("2", 1, 2, "pump", 2), ("3", 1, 1, "pipe", 3)], "item_id string, bid_id int, vendor_id int, name string, seq int")
    none = items.select(F.lit("").alias("cluster_id"), "bid_id", "name", F.lit("").alias("status")).limit(0)
    found, members, carried = C.run_clustering(items, none, items.select(F.lit("").alias("cluster_id"), "item_id").limit(0), ["bid_id"])
    assert [(r.cluster_id, r.bid_id, r.name, r.status) for r in found.collect()] == [("1:pump", 1, "Pump", "pending")]
    assert {(r.item_id, r.role) for r in members.collect()} == {("1", "representative"), ("2", "duplicate")} and [r.item_id for r in carried.collect()] == ["3"]
    assert kept.count("valid-members") == 1 and kept.count("valid-clusters") == 1


def test_copies_in_a_catalog_are_one_set(spark, monkeypatch):
    rows = {}
    own = names.keep

    def keep(df, name):
        out = own(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(names, "keep", keep)
    catalog = spark.range(300).select(F.col("id").alias("catalog_item_id"), F.concat(F.lit("pump "), (F.col("id") % 3).cast("string")).alias("name"))
    asked = spark.createDataFrame([("pump 1",), ("1 PUMP",), ("valve",)], "name string")
    got = names.candidates(asked, catalog, 3).orderBy("name", "place").collect()
    assert [(r.name, r.place, r.catalog_item_id) for r in got] == [(n, p, 3 * p - 2) for n in ("1 PUMP", "pump 1") for p in (1, 2, 3)]
    assert rows["catalog-sets"] == 3 and rows["early"] == 3


def test_copies_of_texts_are_compared_once(spark, monkeypatch):
    rows = {}
    own = V.keep

    def keep(df, name):
        out = own(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(V, "keep", keep)
    texts = spark.range(60).select("id", F.concat(F.lit("abcd"), (F.col("id") % 2).cast("string")).alias("t"))
    got = V.lexical(texts, texts.where("id < 4"), "id", "t", 0.5)
    assert got.count() == 4 * 59 and {r.similarity for r in got.collect()} == {1.0, 0.8} and rows["ratios"] == 4


def test_nearest_in_blocks(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)] + [(20, [0.0, 0.0]), (21, None), (22, [1.0, None]), (23, [1.0])]
    v = spark.createDataFrame(rows, "id int, v array<float>")
    got = V.nearest(v, v.where("id IN (0, 20, 21)"), "id", "v", 3, 0.0).orderBy("anchor_id", "place")
    assert "MapInPandas" in plan(got)
    assert [(r.anchor_id, r.other, r.similarity) for r in got.collect()] == [(0, 2, 1.0), (0, 4, 1.0), (0, 6, 1.0), *[(a, i, 0.0) for a in (20, 21) for i in (0, 1, 2)]]


def test_header_preview_joins_nothing(spark):
    cells = spark.createDataFrame([("f", "s", 1, 0, "x"), ("f", "s", 2, 0, "h"), ("f", "s", 2, 1, "k"), ("f", "s", 3, 1, "v"), ("f", "s", 9, 0, "z"), ("g", "s", 9, 0, "z")], "file string, sheet string, row int, col int, value string")
    got = sheets.header_preview(cells)
    assert "Join" not in plan(got)
    assert [(r.file, r.header_row, [c.value for c in r.columns], r.preview) for r in got.collect()] == [("f", 2, ["h", "k"], [["", "v"]])]


def test_near_duplicates_are_chosen_without_their_texts(spark, monkeypatch):
    from bidloom.llm import simhash

    columns = []
    own = simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda df, name: columns.extend(df.columns) or own(df, name))
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (None, "eight nine ten"), (None, "eight nine ten"), (4, "a b c d e f g h")], "doc_id long, text string")
    assert sorted(simhash.one_of_each(docs).collect(), key=str) == [(1, text), (4, "a b c d e f g h"), (None, "eight nine ten")] and "text" not in columns


def test_rounds_are_no_jobs_of_their_own(spark, monkeypatch):
    """As many jobs for a bid of many windows as for one of few."""
    from bidloom.operators import rounds
    from bidloom.plans.linkage import by_last_word

    jobs = []
    for n in (20, 400):
        spark.sparkContext.setJobGroup(f"rounds-{n}", "")
        items = spark.range(n).select(F.lit("b").alias("bid"), F.col("id").cast("string").alias("item_id"), F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("vendor_id"), F.format_string("n%03d k%d", F.col("id"), F.col("id") % 9).alias("name"))
        clusters, members, left, failed = rounds.cluster_in_rounds(items, ["bid"], by_last_word, size=10)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 12
    assert members.count() + left.count() == 400 and failed.isEmpty() and {r.bid for r in clusters.collect()} == {"b"}


def test_odd_answers_of_a_provider():
    from bidloom.operators import rounds

    said = {"fence": '```json\n{"clusters": []}\n```', "list": "[1]", "text": "sorry", "more": ' {"clusters": [null, 3]} thanks', "none": None}
    assert {k: rounds._objects(rounds._ask(lambda task, text, v=v: v, "form", ""), "clusters") for k, v in said.items()} == {"fence": [], "list": None, "text": None, "more": [], "none": None}
    assert [rounds._text(x) for x in (5, "5", None, [1, "a"])] == ["5", "5", None, '[1,"a"]']


def test_a_run_without_live_clusters_shuffles_no_items(shuffled):
    """F3 clustering_reruns: each run shuffled all items three times, to tell them apart, to save them and to find their bid."""
    items = shuffled.createDataFrame([("1", 1, 1, "Pump", 1), ("2", 1, 2, "pump", 2), ("3", 1, 1, "pipe", 3)], "item_id string, bid_id int, vendor_id int, name string, seq int")
    none = items.select(F.lit("").alias("cluster_id"), "bid_id", "name", F.lit("").alias("status")).limit(0)
    found, members, _ = C.run_clustering(items, none, items.select(F.lit("").alias("cluster_id"), "item_id").limit(0), ["bid_id"])
    assert "Exchange hashpartitioning" not in plan(members) + plan(found)
    assert {(r.cluster_id, r.item_id, r.role) for r in members.collect()} == {("1:pump", "1", "representative"), ("1:pump", "2", "duplicate")}


def test_a_runs_items_are_joined_once(shuffled):
    """F5 refine_unmatched: each use of items, clusters and members joined lines with orders and parts again."""
    for name in ("refine_unmatched", "clustering_run"):
        assert "o_orderkey" not in plan(queries()[name](shuffled, D)), name


def test_every_text_is_an_anchor(spark):
    """F6 reachable_texts: of all parts only those with an id divisible by 100 were anchors."""
    rows = spark.read.parquet(f"{D}/part.parquet").collect()
    texts = {f"{r.p_brand} {r.p_name}" + (f" {r.p_type.upper()} {r.p_size}" if r.p_partkey % 2 == 0 else "") for r in rows}
    letters = {t: Counter(t) for t in texts}
    want = {(a, b) for a in texts for b in texts if 2 * (letters[a] & letters[b]).total() >= 0.8 * (len(a) + len(b))}
    got = queries()["reachable_texts"](spark, D).collect()
    assert {(r.anchor, r.text) for r in got} == want and len(got) == len(want)


def test_trees_are_dealt_once_as_narrow_rows(shuffled):
    """F4 submission_trees: items were shuffled with ids, paths and places as texts, kept, and shuffled again; each was copied for each level."""
    text = plan(queries()["submission_trees"](shuffled, D))
    assert "o_orderkey" in text  # nothing is kept between
    assert text.count("Exchange hashpartitioning(concat_ws(") == 1 and "Exchange hashpartitioning(submission_id" not in text and "Generate" not in text
    assert " AS item_id" not in text.split("Exchange hashpartitioning(concat_ws(")[1]
    items = shuffled.createDataFrame([("s", "A > B", 1, 2), ("s", "A", 2, 3), ("t", "A", 3, None)], "submission_id string, path string, seq long, amount long").selectExpr("*", "'A' AS category", "'' AS name", "concat('i', seq) AS item_id", "false AS is_header")
    trees = {levels: sorted(H.nested_tree(items, leaf=("item_id",), levels=levels).collect()) for levels in (None, 2, 5)}
    assert H.deepest(items) == 2 and H.deepest(items.limit(0)) == 0 and trees[None] == trees[2] == trees[5] and len(trees[2]) == 2
