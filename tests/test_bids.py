"""Small frames with known answers, and traps of the bid model."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bidloom.functions import scalars as S
from bidloom.operators import clusters as C
from bidloom.operators import compare as P
from bidloom.operators import extract as X
from bidloom.operators import hierarchy as H
from bidloom.operators import lifecycle as L
from bidloom.operators import matching as M
from bidloom.operators import listing as G
from bidloom.operators import similarity as V


def column(spark, values, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", f(F.col("v"))).orderBy("k").collect()]


def test_numbers(spark):
    assert column(spark, ["1,000", "1,000원", "3.5", "", "-", "1-2", None], S.clean_number) == [1000, 1000, 3.5, None, None, None, None]
    assert column(spark, ["₩ 1,000", "$3.5", "USD 7", "1e5", "abc", "", None], S.strict_number) == [1000, 3.5, 7, None, None, None, None]


def test_paths(spark):
    assert column(spark, ["a > b|c\\d", "전장/제어부 > x", " > ", "　a　>b"], S.split_path) == [["a", "b", "c", "d"], ["전장/제어부", "x"], [], ["a", "b"]]
    assert column(spark, ["[indent=2] x", "x"], S.strip_indent) == ["x", "x"]
    assert column(spark, ["1", "12", "1234"], S.row_label) == ["R001", "R012", "R1234"]
    assert column(spark, ['["a", "b"]', "[", None], S.from_json_list) == [["a", "b"], [], []]


def test_deleted_vendor_is_absent_and_unpriced_vendor_is_last(spark):
    subs = spark.createDataFrame([("a", 1, "A", "done", False, 10), ("b", 1, "B", "done", True, 1), ("c", 1, "C", "done", False, None), ("d", 1, "D", "pending", False, 2)], "submission_id string, bid_id int, vendor_name string, extraction_status string, is_deleted boolean, subtotal long")
    assert [(r.submission_id, r.vendor_rank) for r in P.vendors(subs).orderBy("vendor_rank").collect()] == [("a", 1), ("c", 2)]


def test_cluster_minimum_is_by_vendor_sum(spark):
    rows = spark.createDataFrame([("k", 3, 17_800_000, 17_800_000), ("k", 6, 9_500_000, 9_500_000), ("k", 6, 12_000_000, 12_000_000)], "cluster_id string, vendor_id int, amount long, unit_price long")
    r = C.vendor_totals(rows).first()
    assert (r.min_vendor, r.min_total, r.max_vendor, r.max_total) == (3, 17_800_000, 6, 21_500_000)


def test_prices_of_zero_and_null_do_not_count(spark):
    pivot = spark.createDataFrame([(1, "c", "r", 1, 0), (1, "c", "r", 2, None), (1, "c", "r", 3, 5)], "bid_id int, category string, row_key string, vendor_id int, unit_price long")
    r = P.row_extremes(pivot).first()
    assert (r.min_vendor, r.max_vendor, r.n_prices) == (3, None, 1)


def test_name_with_two_paths_gives_two_rows_and_last_price_wins(spark):
    rows = spark.createDataFrame(
        [(1, "c", "n", "p > 1", 7, 10, 1.0, 10, "b", 1), (1, "c", "n", "p > 2", 7, 20, 1.0, 20, "b", 2), (1, "c", "m", "p > 3", 7, 1, 1.0, 1, "first", 3), (1, "c", "m", "p > 3", 7, 2, 1.0, 2, "later", 4)],
        "bid_id int, category string, name string, path string, vendor_id int, unit_price long, quantity double, amount long, brand string, seq int",
    )
    got = {r.row_key: (r.unit_price, r.spec) for r in P.compare_pivot(rows).collect()}
    assert got == {"p > 1": (10, "b"), "p > 2": (20, "b"), "m": (2, "first")}


def test_majority_tie_goes_to_the_first_seen(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "g int, v string, seq int")
    assert P.majority(rows, ["g"], "v", "seq").first().v == "b"


def test_longest_unit_wins_and_labels_may_meet(spark):
    items = spark.createDataFrame([("s", "i1", "재료비 > 기구부 > 차폐", "재료비", "x", False, 5, 1), ("s", "i2", "다른 > 차폐", "다른", "y", False, 7, 2), ("s", "i3", None, None, "z", False, 1, 3)], "submission_id string, item_id string, path string, category string, name string, is_header boolean, amount long, seq int")
    units = spark.createDataFrame([("s", "재료비 > 기구부"), ("s", "재료비 > 기구부 > 차폐"), ("s", "다른 > 차폐")], "submission_id string, unit string")
    for normalize in (True, False):
        assert {r.item_id: r.unit for r in H.match_unit(items, units, normalize).collect()} == {"i1": "재료비 > 기구부 > 차폐", "i2": "다른 > 차폐", "i3": None}
    assert {r.group_key: r.amount for r in H.group_by_unit(items, units).collect()} == {"차폐": 12, "(미분류)": 1}
    assert len(H.group_by_unit(items, units, key="path").collect()) == 3


def test_tree_has_every_prefix(spark):
    items = spark.createDataFrame([("s", "a > b", "a", "n", False, 5), ("s", "a > b > n", "a", "n", False, 7), ("s", "", "a", "q", False, 1)], "submission_id string, path string, category string, name string, is_header boolean, amount long")
    got = {r.node: (r.amount, r.n_items) for r in H.tree_rollup(items).collect()}
    assert got == {"a": (13, 3), "a > b": (12, 2), "a > b > n": (12, 2), "a > q": (1, 1)}
    assert H.clamp_level(0) == 1 and H.clamp_level(9) == 6


def test_fill_down_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [(f"f{rnd.randint(0, 3)}", k, *(rnd.choice([None, "", "a", "b", "c"]) for _ in range(3))) for k in range(300)]
    got = {(r.file, r.row): (r.x, r.y, r.z) for r in X.fill_down(spark.createDataFrame(rows, "file string, row int, x string, y string, z string"), ["file"], "row", ["x", "y", "z"]).collect()}
    last: dict = {}
    for f, k, *own in rows:
        now, out = last.setdefault(f, [None] * 3), []
        for i, v in enumerate(own):
            if v:
                now[i] = v
            elif now[i] is None and i and out[i - 1] is not None:
                now[i] = out[i - 1]
            out.append(now[i])
        assert got[(f, k)] == tuple(out)


def cells(spark, rows):
    return spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row)], "file string, sheet string, row int, col int, value string")


def test_extraction_by_mapping(spark):
    sheet = cells(spark, [["대", "중", "소", "품명", "규격", "수량", "단가", "금액"], ["재료비", "기구부", "차폐", "납 BLOCK", "순납", "150", "64,000", "9600000"], ["", "", "", "", "", "", "", "100"], ["", "", "", "할인", "", "1", "500", "500"], [""] * 8])
    mapping = {0: "cat1", 1: "cat2", 2: "cat3", 3: "name", 4: "spec", 5: "qty", 6: "price", 7: "amount"}
    a, b, c = X.extract_by_mapping(sheet, mapping, 1, nego=[4]).orderBy("row").collect()
    assert (a.path, a.depth, a.category, a.line_no, a.name, a.quantity, a.unit_price, a.amount) == ("재료비 > 기구부 > 차폐", 3, "재료비", "R2", "납 BLOCK", 150, 64000, 9600000)
    assert b.is_category_header and b.name == "차폐"
    assert c.is_nego and c.amount == -500 and c.unit_price == -500


def test_sequence_numbers(spark):
    sheet = cells(spark, [["no", "name", "amount"], ["1", "Top", ""], ["1.1", "Low", "5"], ["1.1.2", "Deep", "6"], ["", "Total", "11"], ["2", "Paid", "3"]])
    got = {r.name: r.path for r in X.extract_by_mapping(sheet, {0: "seq", 1: "name", 2: "amount"}, 1).collect()}
    assert got == {"Low": "Top > Low", "Deep": "Top > 1.1 > Deep", "Paid": "Paid"}


def test_sequence_numbers_that_stand_alone(spark):
    rows = [["no", "name", "amount"], ["1", "Top", ""], ["1.1", "Total station rental", "5"], ["3.1", "Orphan", "6"], ["", "loose", "7"], ["2", "", "9"], ["", "", "4"], ["", "합계", "31"], ["", "Total", ""], ["sum", "", "3"]]
    got = [(r.name, r.path, r.category, r.is_category_header) for r in X.extract_by_mapping(cells(spark, rows), {0: "seq", 1: "name", 2: "amount"}, 1).orderBy("row").collect()]
    assert got == [
        ("Total station rental", "Top > Total station rental", "Top", False), ("Orphan", "3 > Orphan", "3", False), ("loose", "loose", "loose", False),
        ("2", "2", "2", True), ("Total", "Total", "Total", False), ("(소계)", "(소계)", "기타", True),
    ]


def test_header_words(spark):
    r = X.suggest_roles(cells(spark, [["대분류", "중분류", "품명", "Q'ty", "Unit Price", "공급가", "Name 2"]])).first()
    assert (r.hits, r.confidence, r.mapping) == (7, "high", {0: "cat1", 1: "cat2", 2: "name", 3: "qty", 4: "price", 5: "amount", 6: "name"})
    pages = {"랙 배치도": "DRAWING", "FRONT VIEW": "DRAWING", "시스템 구성도": "UNKNOWN", "구성도 Logical": "DIAGRAM", "거 래 조 건": "TERMS", "견적서": "SUMMARY (갑지)", "견적서 명세": "DETAIL (명세)", "\n\n\n\n\n명세": "UNKNOWN"}
    rows = spark.createDataFrame([(k,) for k in pages], "t string").select("t", X.page_type(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == pages


def test_raw_units_stand_before_a_separator(spark):
    items = spark.createDataFrame([("s", "a", "x>y > z"), ("s", "b", "x > y"), ("s", "c", "xy > z"), ("s", "d", None), ("s", "e", "x>y")], "submission_id string, item_id string, path string")
    units = spark.createDataFrame([("s", "x"), ("s", "x>y"), ("s", "x > y")], "submission_id string, unit string")
    assert {r.item_id: r.unit for r in H.match_unit(items, units, False).collect()} == {"a": "x>y", "b": "x > y", "c": None, "d": None, "e": "x>y"}
    assert {r.unit for r in H.units_at_level(items, 2).collect()} == {"x > y", "xy > z"}


def test_extraction_job(spark):
    lines = spark.createDataFrame([("a", 0, "# head"), ("a", 1, "R001 | x"), ("a", 2, "R002 | y"), ("a", 3, "R003 | z"), ("b", 1, "R001 | q")], "submission_id string, line_no int, line string")
    submissions = spark.createDataFrame([("a", "processing"), ("b", "processing"), ("c", "processing")], "submission_id string, extraction_status string")

    def provider(text):
        import json

        if "| q" in text:
            raise ValueError("no")
        names = [x.split(" | ")[1] for x in text.split("\n") if x.startswith("R")]
        return "```json\n" + json.dumps({"vendor_name": "V", "currency": "USD" if "x" in names else "", "items": [{"name_raw": n, "amount": 1} for n in names]}) + "\n```"

    done, items = X.run_extraction(submissions, lines, provider, size=1)
    assert {(r.submission_id, r.extraction_status, r.currency, r.n_failed) for r in done.collect()} == {("a", "done", "USD", 0), ("b", "failed", None, 1), ("c", "failed", None, None)}
    assert [r.name_raw for r in items.orderBy("chunk", "place").collect()] == ["x", "y", "z"]


def test_match_input_and_confirmation(spark):
    items = spark.createDataFrame([(2, "i1", "s", "c", "Pump", "b", 2.0, False, 5.0, 10.0, "d", "EA", "v", "P"), (1, "i2", "s", "c", "odd", None, None, False, 1.0, 1.0, "d", None, "v", "P"), (3, "i3", "s", "c", "head", None, None, True, 1.0, 1.0, "d", None, "v", "P"), (1, "i4", "t", "c", "odd", None, None, False, 1.0, 1.0, "d", None, "v", "P")], "seq int, item_id string, submission_id string, category string, name string, brand string, quantity double, is_header boolean, unit_price double, amount double, bid_date string, unit string, vendor_name string, project_name string")
    catalog = spark.createDataFrame([(7, "pump", "c", "set", ["p1", "p2", "p3", "p4"]), (8, "other", "c", None, [])], "catalog_item_id bigint, name string, category string, unit_std string, aliases array<string>")
    found = spark.createDataFrame([("Pump", 7), ("head", 8)], "name string, catalog_item_id bigint")
    texts = {r.submission_id: r.text for r in M.match_input(items, catalog, found).collect()}
    assert texts["s"] == "## 라인 아이템 목록 (2개)\n  - item_id=i2 | category=c | name=odd | spec= | qty= \n  - item_id=i1 | category=c | name=Pump | spec=b | qty=2.0 EA\n\n## 카탈로그 품목 목록 (1개)\n  - catalog_item_id=7 | name=pump | category=c | unit=set | aliases=p1, p2, p3"
    assert texts["t"].endswith("## 카탈로그 품목 목록 (0개)\n")
    saved = M.save_suggestions(items, M.suggest(items, catalog))
    assert {(r.item_id, r.match_status, r.catalog_item_id) for r in saved.collect()} == {("i1", "suggested", 7), ("i2", "unmatched", None), ("i3", None, None), ("i4", "unmatched", None)}
    history = spark.createDataFrame([], "catalog_item_id bigint, item_id string")
    decided = saved.where("item_id = 'i1'").select("item_id", "catalog_item_id")
    now, new = M.confirm(saved, decided, history)
    assert [(r.item_id, r.unit_price, r.vendor_name, r.project_name, r.unit) for r in new.collect()] == [("i1", 5.0, "v", "P", "EA")] and M.confirm(now, decided, new)[1].count() == 0
    twice = spark.createDataFrame([("i1", 7, 2), ("i1", 8, 1), ("i2", 8, 1), ("i2", None, 2)], "item_id string, catalog_item_id bigint, decided_at int")
    assert {(r.item_id, r.catalog_item_id, r.match_status) for r in M.confirm(saved, twice, history)[0].where("submission_id = 's' AND NOT is_header").collect()} == {("i1", 7, "confirmed"), ("i2", None, "unmatched")}


def test_an_item_in_a_cluster_still_counts_in_its_category(spark):
    row = "bid_id int, vendor_id int, category string, amount long, item_id string"
    items = spark.createDataFrame([(1, 1, "LARGE", 10, "a"), (1, 1, "LARGE", 5, "b"), (1, 2, "SMALL", 7, "c")], row)
    for members in ([], [(1, 1, "LARGE", 10, "a")]):
        got = {(r.vendor_id, r.category): r.total for r in P.compared_totals(items, spark.createDataFrame(members, row), ["LARGE", "SMALL"]).collect()}
        assert got == {(1, "LARGE"): 15, (1, "SMALL"): 0, (2, "LARGE"): 0, (2, "SMALL"): 7}


def test_merges_roles_lines_and_runs(spark):
    sheet = cells(spark, [["품명", "수량", "단가", "금액"], ["a", "", "", ""], ["", "", "", ""]])
    merges = spark.createDataFrame([("f", "s", 2, 0, 3, 1)], "file string, sheet string, r1 int, c1 int, r2 int, c2 int")
    assert {(r.row, r.col) for r in X.expand_merges(sheet, merges).where("value = 'a'").collect()} == {(2, 0), (2, 1), (3, 0), (3, 1)}
    r = X.suggest_roles(sheet).first()
    assert (r.row, r.confidence, r.mapping) == (1, "high", {0: "name", 1: "qty", 2: "price", 3: "amount"})
    assert [x.line for x in X.sheet_lines(sheet).orderBy("row").collect()] == ["R001 | 품명 | 수량 | 단가 | 금액", "R002 | a |  |  | "]
    rows = spark.createDataFrame([("f", k, v) for k, v in enumerate("aabbba")], "file string, row int, v string")
    assert [(x.run, x.chunk) for x in X.runs(rows, ["file"], "row", "v", most=2).orderBy("row").collect()] == [(1, 0), (1, 0), (2, 0), (2, 0), (2, 1), (3, 0)]


def test_text_chunks_repeat_what_is_no_data(spark):
    lines = spark.createDataFrame([("d", k, v) for k, v in enumerate(["# head", *[f"R{k:03d} | x" for k in range(5)]])], "doc string, k int, line string")
    got = X.text_chunks(lines, "doc", "k", 2).orderBy("chunk").collect()
    assert [r.n_lines for r in got] == [3, 3, 2] and all(r.text.startswith("# head") for r in got)


def test_rates(spark):
    rows = spark.createDataFrame([("a", 1, 100.0, 2.0, 260_000.0, "USD"), ("a", 2, 1.0, 1.0, 900.0, "USD"), ("b", 1, 1.0, 1.0, 5000.0, "USD"), ("c", 1, 0.0, 1.0, 5.0, "USD")], "sub string, seq int, price double, quantity double, amount double, currency string")
    rates = X.fx_rate(rows, "sub", "seq")
    assert {r["sub"]: r.fx_rate for r in rates.collect()} == {"a": 1300}
    got = X.convert(rows, rates, "sub").where("sub = 'a' AND seq = 1").first()
    assert (got.price, got.price_orig) == (130_000, 100)


def test_provider_failures_are_kept(spark):
    chunks = spark.createDataFrame([(1, "ok"), (2, "bad")], "k int, text string")
    calls = X.ask_provider(chunks, lambda t: {"ok": "fine"}[t])
    assert {r.k: (r.answer, r.error is None) for r in calls.collect()} == {1: ("fine", True), 2: (None, False)}
    assert spark.range(1).select(X.clean_json(F.lit('```json\n{"a": 1}\n```'))).first()[0] == '{"a": 1}'


def members(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, item_id string")


def test_cluster_changes(spark):
    m = members(spark, [("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("b", "1")])
    left, gone = C.remove_members(m, members(spark, [("a", "2")]))
    assert [r.cluster_id for r in gone.collect()] == ["a"] and left.count() == 3
    clusters = spark.createDataFrame([("a", "pending"), ("b", "held"), ("c", "accepted")], "cluster_id string, status string")
    status, moved = C.merge(clusters, m, spark.createDataFrame([("a", "b")], "source string, target string"))
    assert {r.cluster_id: r.status for r in status.collect()}["a"] == "rejected" and moved.where("cluster_id = 'b'").count() == 4
    now, empty = C.move_items(members(spark, [("a", "1"), ("b", "2")]), spark.createDataFrame([("1", "b")], "item_id string, cluster_id string"))
    assert {(r.cluster_id, r.item_id) for r in now.collect()} == {("b", "1"), ("b", "2")} and [r.cluster_id for r in empty.collect()] == ["a"]
    stay, rest = C.reset(clusters, m)
    assert [r.cluster_id for r in stay.collect()] == ["c"] and rest.count() == 0
    one = spark.createDataFrame([("k", True, 1.0), ("d", True, 1.0), ("d", False, 0.95), ("e", True, 1.0), ("e", False, 0.5)], "cluster_id string, is_representative boolean, similarity_score double")
    assert {r.cluster_id: r.is_confident for r in C.high_confidence(one).collect()} == {"k": False, "d": True, "e": False}


def test_one_vendor_is_no_cluster_and_hangul_names_win(spark):
    items = spark.createDataFrame([("1", 1, "pump"), ("2", 2, "펌프 장치"), ("3", 3, "펌프"), ("4", 1, "x"), ("5", 1, "X")], "item_id string, vendor_id int, name string")
    proposals = spark.createDataFrame([("k", 0.9, ["9", "1", "2", "3"]), ("m", 0.9, ["4", "5"])], "cluster_id string, score double, item_ids array<string>")
    r = C.valid_clusters(proposals, items).collect()
    assert [(x.cluster_id, x.rep_item_id, x.name) for x in r] == [("k", "1", "펌프")]


def test_shared_catalog_item_is_kept(spark):
    accepted = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "cluster_id string, catalog_item_id int")
    history = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "cluster_id string, catalog_item_id int")
    catalog, rest = C.release(accepted, spark.createDataFrame([("a",)], "cluster_id string"), history, spark.createDataFrame([(1,), (2,), (3,)], "catalog_item_id int"))
    assert sorted(r[0] for r in catalog.collect()) == [1, 3] and [(r.cluster_id, r.catalog_item_id) for r in rest.collect()] == [("b", 1)]


def test_prices_are_recorded_once(spark):
    old = spark.createDataFrame([(1, "i", 5)], "catalog_item_id int, item_id string, unit_price long")
    new = spark.createDataFrame([(1, "i", 6), (1, "j", 7)], "catalog_item_id int, item_id string, unit_price long")
    assert sorted((r.item_id, r.unit_price) for r in C.record_prices(old, new).collect()) == [("i", 5), ("j", 7)]


def test_changes_keep_negotiated_items(spark):
    items = spark.createDataFrame([("1", "s", True), ("2", "s", False), ("3", "t", None)], "item_id string, submission_id string, is_nego boolean")
    gone = spark.createDataFrame([("s",)], "submission_id string")
    assert sorted(r.item_id for r in L.reset_submission(items, gone, keep_nego=True).collect()) == ["1", "3"]
    assert [r.item_id for r in L.reset_submission(items, gone).collect()] == ["3"]
    nego = L.nego_items(spark.createDataFrame([("9", "s", "d", 500)], "item_id string, submission_id string, label string, amount long")).first()
    assert (nego.amount, nego.unit_price, nego.sort_order) == (-500, -500, 99999)
    rows = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "x")], "k int, v string")
    assert sorted(tuple(r) for r in L.upsert(rows, new, ["k"], True).collect()) == [(1, "new"), (2, "x")]
    assert sorted(tuple(r) for r in L.upsert(rows, new, ["k"], False).collect()) == [(1, "old"), (2, "x")]


def test_similarity(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "id int, v array<float>")
    got = V.nearest(v, v.where("id = 0"), "id", "v", k=3, least=0.0).orderBy("place").collect()
    assert [(r.other, r.similarity) for r in got] == [(1, 0.995), (2, 0.0), (3, 0.0)]
    t = spark.createDataFrame([(0, "abcd"), (1, "abce"), (2, "zzz")], "id int, t string")
    assert {r.id: r.similarity for r in V.lexical(t, t.where("id = 0"), "id", "t").collect()} == {1: 0.75, 2: 0.0}


def test_search_treats_backslash_as_text(spark):
    rows = spark.createDataFrame([("a\\b",), ("aXb",)], "name string")
    assert [r[0] for r in rows.where(G.contains("name", "A\\B")).collect()] == ["a\\b"]
    assert rows.where(G.contains("name", "a_b")).count() == 2


def test_xlsx(spark, tmp_path):
    from bidloom.sources.office import read_quotations, xlsx_merges

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="견적" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>품명</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>12</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>')
    (tmp_path / "q.xlsx").write_bytes(raw.getvalue())
    got = {(r.row, r.col): r.value for r in read_quotations(spark, str(tmp_path), "xlsx").collect()}
    assert got == {(1, 1): "품명", (1, 28): "12"}
    assert [(r.r1, r.c1, r.r2, r.c2) for r in xlsx_merges(spark, str(tmp_path)).collect()] == [(1, 1, 2, 2)]
    with pytest.raises(ValueError):
        read_quotations(spark, str(tmp_path), "pdf")


def test_docx(spark, tmp_path):
    from bidloom.sources.office import read_quotations

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "q.docx").write_bytes(raw.getvalue())
    assert [r.line for r in read_quotations(spark, str(tmp_path), "docx").orderBy("seq").collect()] == ["P000  [align=center,bold]: Title", "R001 | a <GRIDSPAN=2>"]


def test_prices_that_land_twice_are_recorded_once(spark, tmp_path):
    from bidloom.streaming.landing import follow_prices

    schema = "catalog_item_id int, item_id string, unit_price long"
    for k in range(2):
        spark.createDataFrame([(1, "i", 5), (1, f"j{k}", 7)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        follow_prices(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["i", "j0", "j1"]
    known = spark.createDataFrame([(1, "j0", 9)], schema)
    follow_prices(spark, str(tmp_path / "in"), schema, str(tmp_path / "rest"), str(tmp_path / "ck2"), known).awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "rest")).collect()) == ["i", "j1"]


def test_files_over_the_limit_are_listed(spark, tmp_path):
    from bidloom.sources.office import files, refused

    (tmp_path / "small.xlsx").write_bytes(b"1234")
    (tmp_path / "large.xlsx").write_bytes(b"12345")
    assert [r.path[-10:] for r in files(spark, str(tmp_path), "*.xlsx", 4).collect()] == ["small.xlsx"]
    assert [(r.file[-10:], r.length, r.error) for r in refused(spark, str(tmp_path), "*.xlsx", 4).collect()] == [("large.xlsx", 5, "over 4 bytes")]


def test_units_collapse_to_items(spark):
    schema = "submission_id string, bid_id int, vendor_id int, item_id string, category string, seq int, name string, path string, brand string, quantity double, amount long, unit_price long"
    leaves = [("s", 1, 7, f"i{k}", "c", k, n, p, "b", 2.0, a, a) for k, (n, p, a) in enumerate([("z", "A|B|x", 5), ("y", "A > B", None), ("", "A > B > q", 2), ("o", "A > BB", 9), ("n", None, 1)])]
    items = spark.createDataFrame(leaves, schema)
    units = spark.createDataFrame([("s", "A > B"), ("t", "A")], "submission_id string, unit string")
    got = {r.item_id: r for r in H.collapse_units(items, units).collect()}
    assert sorted(got) == ["i2", "i3", "i4"] and [k for k, r in got.items() if r.is_unit] == ["i2"]
    r = got["i2"]
    assert (r.name, r.path, r.brand, r.quantity, r.amount, r.unit_price) == ("B", "A > B", "(2개: y, z)", 1.0, 7, 7)
    many = spark.createDataFrame([("s", 1, 7, f"i{k}", "c", k, f"n{k}", "A > B", "b", 1.0, 1, 1) for k in range(7)], schema)
    assert H.collapse_units(many, units).first().brand == "(7개: n0, n1, n2, n3, n4 ...)"


def test_queries_match_their_sql(spark):
    import duckdb

    from bidloom.plans import queries as Q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("bid_summary", "tree_rollup", "compare_pivot_long", "benchmark_by_project", "cluster_vendor_totals", "fill_down", "price_history", "header_guess", "keyword_cell", "merged_cells", "extract_items", "guarded_delete"):
        got, want = Q.Q[name](spark, d).toPandas(), con.sql(Q.SQL[name]).df()
        keys = sorted(got.columns)
        assert keys == sorted(want.columns)
        a, b = (x[keys].astype(object).where(x[keys].notna(), None).map(lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v.date() if hasattr(v, "date") else v)).sort_values(keys).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name


def test_lexical_similarity_has_all_anchors(spark):
    import difflib

    from bidloom.plans.queries import Q

    d = "/root/testdata/sf0.001"
    names = {r[0]: f"{r[1]} {r[2]} {r[3]}" for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_type").collect()}
    want = {}
    for a in (k for k in names if k % 100 == 0):
        for b in names:
            similarity = round(difflib.SequenceMatcher(None, names[a], names[b]).ratio(), 4)
            if a != b and similarity >= 0.55:
                want[a, b] = similarity
    assert len({a for a, _ in want}) > 1
    assert {(r.anchor_id, r.part_id): r.similarity for r in Q["lexical_similarity"](spark, d).collect()} == want
