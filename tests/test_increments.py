"""Totals under changes, nested trees, and substring search by an index."""

import json
import random

from pyspark.sql import functions as F

from bidloom.operators import compare, hierarchy, increments
from bidloom.operators.listing import contains
from bidloom.operators.textindex import TextIndex, search
from bidloom.stages import new_path

HISTORY = "item_id long, catalog_item_id long, project_id long, bid_id long, unit_price long, amount long, is_deleted boolean"


def _random_row(r, i):
    project = r.randrange(3)
    return (i, r.choice([1, 1, 1, 2, None]), project, project * 10 + r.randrange(2), r.randrange(-2, 6), r.randrange(100), False)


def test_random_changes_equal_recomputation(spark):
    r = random.Random(5)
    rows = {i: _random_row(r, i) for i in range(60)}
    totals = increments.prices(new_path(spark, "prices"))
    totals.apply(spark.createDataFrame(list(rows.values()), HISTORY).withColumn("sign", F.lit(1)), 1)
    projects = spark.createDataFrame([(0,), (1,), (2,)], "project_id long")
    for batch in (2, 3, 4):
        now = spark.createDataFrame(list(rows.values()), HISTORY)
        changed = [(*_random_row(r, i), r.random() < 0.5) for i in r.sample(range(80), 25)]
        for c in changed:
            rows.pop(c[0], None)
            if not c[-1]:
                rows[c[0]] = c[:-1]
        changes = increments.signed(now, spark.createDataFrame(changed, HISTORY + ", is_deleted_row boolean"), "item_id")
        totals.apply(changes, batch)
        totals.apply(changes, batch)  # an attempt that is repeated
        if batch == 3:
            totals = totals.compact(spark, new_path(spark, "prices"))
        want = compare.benchmark(spark.createDataFrame(list(rows.values()), HISTORY), projects)
        got = compare.benchmark_of_sums(increments.price_sums(totals.read(spark)), projects)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert totals.overdrawn(spark).isEmpty()
    few = totals.read(spark, spark.createDataFrame([(2,), (None,)], "catalog_item_id long"))
    assert {x.catalog_item_id for x in few.collect()} == {x[1] for x in rows.values()} - {1}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]


def test_totals_edges(spark):
    totals = increments.subtotals(new_path(spark, "subtotals"))
    kinds = "submission_id string, amount long, sign int"
    totals.apply(spark.createDataFrame([("a", None, 1), (None, 5, 1), ("b", 7, 1), ("b", 7, -1), ("c", 3, -1)], kinds), 1)
    assert {(x.submission_id, x.amount, x.n) for x in totals.read(spark).collect()} == {("a", 0, 1), (None, 5, 1), ("c", -3, -1)}
    assert [x.submission_id for x in totals.overdrawn(spark).collect()] == ["c"]
    totals.apply(spark.createDataFrame([("c", 3, 1)], kinds), 2)
    assert totals.overdrawn(spark).isEmpty() and totals.read(spark).where("submission_id = 'c'").isEmpty()
    assert totals.read(spark, spark.createDataFrame([], "submission_id string")).isEmpty()


def brute_tree(items):
    """The tree of one submission's items, in order of seq."""
    nodes, deepest = {}, 0
    for it in sorted(items, key=lambda x: x["seq"]):
        parts = [p.strip() for p in (it["path"] or "").split(">") if p.strip()] or ([it["category"]] if it["category"] else [])
        if it["name"] and (not parts or parts[-1] != it["name"]):
            parts = [*parts, it["name"]]
        parts = parts or [hierarchy.UNCLASSIFIED]
        deepest = max(deepest, len(parts))
        for k in range(1, len(parts) + 1):
            n = nodes.setdefault(tuple(parts[:k]), {"amount": 0, "n_items": 0, "leaf_data": None})
            n["amount"] += it["amount"] or 0
            n["n_items"] += 1
            if k == len(parts):
                n["leaf_data"] = {"item_id": it["item_id"], "amount": it["amount"] or 0}

    def under(prefix):
        out = []
        for p, n in nodes.items():
            if p[:-1] == prefix:
                children = under(p)
                out.append({"name": p[-1], "path": " > ".join(p), "amount": n["amount"], "n_items": n["n_items"], "depth": len(p), "is_leaf": not children, "leaf_data": n["leaf_data"], "children": children})
        return out

    return {"tree": under(()), "total": sum(x["amount"] or 0 for x in items), "max_depth": deepest}


def test_nested_tree_equals_brute_force(spark):
    r = random.Random(9)
    kinds = "submission_id string, item_id string, path string, category string, name string, amount long, seq long, is_header boolean"
    names = ["x", 'q"u\\o', "é", "b", None, ""]
    rows = [(r.choice("st"), f"i{i}", r.choice(["a > b", "a>b > c", "a", "", None, "b > x"]), r.choice(["a", "k", None]), r.choice(names), r.choice([None, 1, 5, -3]), (i * 37) % 101, i % 17 == 0) for i in range(100)]
    rows.append((None, "lost", "a", None, "x", 1, 0, False))
    df = spark.createDataFrame(rows, kinds)
    got = {x.submission_id: json.loads(x.tree) for x in hierarchy.nested_tree(df, leaf=("item_id",)).collect()}
    held = [dict(zip([c.split()[0] for c in kinds.split(", ")], x, strict=True)) for x in rows]
    assert got == {s: brute_tree([x for x in held if x["submission_id"] == s and not x["is_header"]]) for s in "st"}
    assert hierarchy.nested_tree(df.limit(0), leaf=("item_id",)).isEmpty()


def test_index_finds_what_a_scan_finds(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcABé%_\\ ") for _ in range(r.randrange(0, 12))) for _ in range(400)] + ["abcabc", "İstanbul", None, ""]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, t string, u string")
    index = TextIndex(new_path(spark, "texts"), 8).build(rows, "t")
    for pattern in ("abc", "ABCA", "a%b", "bca%abc", "ab_ab", "\\", "éab", "zzz", "", "abczzz", "cab%"):
        got = sorted(x.id for x in search(rows, {"t": (index, pattern)}).collect())
        assert got == sorted(x.id for x in rows.where(contains("t", pattern)).collect()), pattern
    both = search(rows, {"t": (index, "abca"), "u": (index, "bcab")})
    assert both.count() == rows.where(contains("t", "abca") | contains("u", "bcab")).count()
    plan = index._read(spark, "postings").where(F.col("bucket").isin([1]) & F.col("run").isin(["abc"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    empty = TextIndex(new_path(spark, "texts"), 8).build(rows.limit(0), "t")
    assert empty.search(spark, "abc").isEmpty()
