"""Clustering window by window, scans over groups of any size, and joins of similar names."""

import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.operators import names, rounds, scan
from bidloom.plans.linkage import by_last_word


@pytest.fixture
def uncoalesced(spark):
    """Small data stays in as many partitions as large data would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_equals_windows(spark, uncoalesced):
    n = 100_000
    k = F.col("id") * 7919 % n
    rows = spark.range(n).select(k.alias("k"), F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 97 == 0, None).otherwise("hot").alias("g"), F.when(F.hash("id") % 4 == 0, F.hash("id")).alias("v"), F.when(F.hash(F.floor(k / 5)) % 3 > 0, F.hash(F.floor(k / 5)) % 3).alias("lab")).repartition(5)
    w = Window.partitionBy("g").orderBy("k")
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("lab").eqNullSafe(F.lag("lab").over(w))).cast("int"))
    want = rows.withColumns({"position": F.row_number().over(w).cast("long") - 1, "n": F.count("*").over(Window.partitionBy("g")), "filled": F.last("v", True).over(w), "_new": new}).withColumn("run", F.sum("_new").over(w))
    want = want.withColumn("run_place", F.row_number().over(Window.partitionBy("g", "run").orderBy("k")).cast("long") - 1)
    got = scan.number(rows, ["g"], ["k"], size="n")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == n
    got = scan.fill_forward(rows.withColumn("filled", F.col("v")), ["g"], ["k"], ["filled"])
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == n
    got = scan.runs(rows, ["g"], ["k"], "lab")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == n
    assert scan.spread(rows, ["g"], ["k"]).where("g = 'hot'").select("_part").distinct().count() > 1  # no task holds the group


def test_scan_edges(spark):
    empty = spark.createDataFrame([], "g string, k long, v long, _at string")
    assert scan.number(empty, ["g"], ["k"]).count() == scan.runs(empty, ["g"], ["k"], "v").count() == 0
    rows = spark.createDataFrame([("a", None, 1), ("a", None, None), ("a", 2, None), (None, 1, None), (None, 0, 5)], "g string, position long, v long")
    got = {(r.g, r.position, r.v) for r in scan.fill_forward(rows, ["g"], ["position"], ["v"]).where("position IS NOT NULL").collect()}
    assert got == {("a", 2, 1), (None, 1, 5), (None, 0, 5)}
    assert sorted(r.place for r in scan.number(rows.withColumn("place", F.lit("x")), ["g"], ["position"], name="place").where("g = 'a'").collect()) == [0, 1, 2]


# Rounds


def brute_rounds(items, provider_key, size):
    """The clusters of one bid's items (name, id, vendor), as lists of ids in order of joining, and what is left."""
    items = sorted(items, key=lambda x: (x[0].lower(), x[1]))
    clusters, carry, calls = [], [], 0
    for c in range(0, len(items), size):
        combined, carry = carry + items[c : c + size], []
        for w in range(0, len(combined), size):
            pool, rest = combined[w : w + size], []
            calls += 1
            for x in pool:
                own = [cl for cl in clusters if provider_key(cl["name"]) == provider_key(x[0])]
                for cl in own:
                    cl["ids"].append(x[1])
                if not own:
                    rest.append(x)
            groups = {}
            for x in rest:
                groups.setdefault(provider_key(x[0]), []).append(x)
            held = [g for g in groups.values() if len(g) > 1 and len({x[2] for x in g}) > 1]
            clusters += [{"name": min((x[0] for x in g), key=len), "ids": [x[1] for x in g]} for g in held]
            taken = {x[1] for g in held for x in g}
            carry += [x for x in rest if x[1] not in taken]
    return [sorted(c["ids"]) for c in clusters], sorted(x[1] for x in carry)


def test_rounds(spark, tmp_path):
    rnd = random.Random(8)
    items = {"a": [(f"{rnd.choice('abcdefgh')}{k:03} k{rnd.randrange(60)}", f"a{k}", f"v{rnd.randrange(4)}") for k in range(200)], "b": [(f"n{k} k{k % 9}", f"b{k}", f"v{k % 2}") for k in range(20)], "c": [("lone k1", "c1", "v1")]}
    items["a"] += [("aaaa k999", "far1", "v1"), ("zzzz k999", "far2", "v2")]  # first and last of 202 names
    seen = tmp_path / "calls"

    def provider(task, text):
        with seen.open("a") as f:
            f.write(f"{task} {len(re.findall('품목명=', text))} {len(re.findall('cluster_id=', text))}\n")
        return by_last_word(task, text)

    frame = spark.createDataFrame([(b, i, v, n) for b, rows in items.items() for n, i, v in rows], "bid string, item_id string, vendor_id string, name string")
    clusters, members, left, failed = rounds.cluster_in_rounds(frame, ["bid"], provider, run="r1")
    got = {}
    for r in members.join(clusters.select("cluster_id", "bid"), "cluster_id").collect():
        got.setdefault((r.bid, r.cluster_id), []).append(r.item_id)
    for b, rows in items.items():
        want, rest = brute_rounds(rows, lambda n: n.split(" ")[-1], 90)
        assert sorted(sorted(x) for k, x in got.items() if k[0] == b) == sorted(want), b
        assert sorted(r.item_id for r in left.where(F.col("bid") == b).collect()) == rest
    assert any({"far1", "far2"} <= set(x) for x in got.values())
    assert failed.count() == 0 and all(k[1].startswith("r1:") for k in got)
    assert members.where("role = 'representative'").count() == clusters.count() == len(got)
    calls = [x.split() for x in seen.read_text().splitlines()]
    assert all(int(n) <= 90 and int(c) <= 90 for _, n, c in calls)


def test_rounds_failures(spark):
    rows = [("a", "1", "v1", "x k1"), ("a", "2", "v2", "y k1"), ("b", "3", "v1", "bad k1"), ("b", "4", "v2", "y k1"), ("c", "5", "v1", None), ("c", "6", "v2", ""), ("d", "7", "v1", "p k2"), ("d", "8", "v1", "q k2")]

    def provider(task, text):
        if "bad" in text:
            raise ValueError("no answer")
        answer = json.loads(by_last_word(task, text))
        for c in answer.get("clusters", []):
            c["all_item_ids"] += ["no such", c["all_item_ids"][0]]
        return json.dumps(answer)

    frame = spark.createDataFrame(rows, "bid string, item_id string, vendor_id string, name string")
    clusters, members, left, failed = rounds.cluster_in_rounds(frame, ["bid"], provider)
    assert [r.bid for r in failed.collect()] == ["b"]
    assert sorted((r.item_id, r.role, r.similarity_score) for r in members.collect()) == [("1", "representative", 1.0), ("2", "duplicate", 0.9)]
    assert sorted(r.item_id for r in left.collect()) == ["3", "4", "5", "6", "7", "8"] and clusters.first().name == "x k1"
    none = rounds.cluster_in_rounds(frame.limit(0), ["bid"], provider)
    assert [x.count() for x in none] == [0, 0, 0, 0]


def test_texts(spark):
    rows = spark.createDataFrame([("a", 0, "1", "v1", "n", "c", "EA", "5", "s" * 70), ("a", 1, "2", "v2", "m", None, None, None, None), ("a", 2, "3", "v1", "k", "c", None, None, "")], "b string, place long, item_id string, vendor_id string, name string, category string, unit string, unit_price string, spec string")
    text = rounds._listed(rows, ["b"]).select(rounds.form_text(F.col("rows"))).first()[0]
    assert text == f"## 신규 입찰 품목 (3개 / 2개 업체)\n\n### v1\n  - id=1 | 품목명=n | 카테고리=c | 단위=EA | 단가=5 | 규격={'s' * 60}\n  - id=3 | 품목명=k | 카테고리=c | 단위= | 단가= | 규격=\n\n### v2\n  - id=2 | 품목명=m | 카테고리= | 단위= | 단가= | 규격=\n\n## 전체 품목\n  - k  [v1] (id=3)\n  - m  [v2] (id=2)\n  - n  [v1] (id=1)\n"


# Names


def brute_grams(name):
    return frozenset(("  " + w + " ")[i : i + 3] for w in (name or "").lower().split() for i in range(len(w) + 1))


def some_names(rnd, n):
    words = ["red", "widget", "steel", "bolt", "gear", "anchor", "납", "BLOCK", "차폐"]
    out = []
    for _ in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randrange(1, 5))]
        if rnd.random() < 0.5:
            k = rnd.randrange(len(w))
            w[k] = w[k][:-1] + rnd.choice("xyz")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_names(spark, least):
    rnd = random.Random(3)
    rows = [(rnd.choice(["p", "q"]), n) for n in some_names(rnd, 150)] + [("p", None), ("p", " "), (None, "red bolt"), ("p", "bolt red"), ("p", "red bolt"), ("q", "x")] + [("q", "gear gear")] * 500
    got = names.similar(spark.createDataFrame(rows, "g string, name string"), None, ["g"], "name", least).collect()
    sets = {}
    for g, n in rows:
        if g and brute_grams(n):
            sets.setdefault((g, brute_grams(n)), []).append(n)
    low = {(g, min(x)): s for (g, s), x in sets.items()}
    want = {(g, a, b): len(s & t) / len(s | t) for (g, a), s in low.items() for (h, b), t in low.items() if g == h and a < b and len(s & t) / len(s | t) >= least - 1e-9}
    assert {(r.g, r.a, r.b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)


def test_no_pair_without_a_shared_rare_gram(spark):
    """The join's output is far smaller than all pairs, and the plan has no nested loop."""
    rows = spark.range(2000).select(F.concat(F.lit("part number "), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    pairs = names.similar(rows, None, [], "name", 0.8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and pairs.count() == 0


def test_similar_clusters_and_matches(spark):
    items = [("a", "1", "v1", 1, "steel anchor bolt"), ("a", "2", "v2", 2, "bolt anchor steel"), ("a", "3", "v3", 3, "steel anchr bolt"), ("a", "4", "v1", 4, "pump"), ("b", "5", "v1", 5, "steel anchor bolt"), ("a", "6", "v1", 6, None), ("a", "7", "v1", 7, "PUMP")]
    frame = spark.createDataFrame(items, "bid string, item_id string, vendor_id string, seq long, name string")
    found = names.similar_clusters(frame, "bid", 0.5)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster_id, set()).add(r.item_id)
    assert sorted(map(sorted, groups.values())) == [["1", "2", "3"], ["4", "7"], ["5"]]
    catalog = spark.createDataFrame([(1, "anchor bolt, steel", ["steel anchor bolt"]), (2, "water pump", ["pumps"]), (3, "pumps", None)], "catalog_item_id long, name string, aliases array<string>")
    got = {r.item_id: (r.catalog_item_id, r.reason) for r in names.match_similar(frame, catalog, 0.5).collect()}
    assert got == {"1": (1, "alias"), "2": (1, "alias"), "3": (1, "alias"), "4": (3, "name"), "5": (1, "alias"), "6": (None, ""), "7": (3, "name")}
    assert names.match_similar(frame, catalog.limit(0), 0.5).where("catalog_item_id IS NULL AND confidence = 0").count() == 7


@pytest.mark.parametrize("first", [1, 2, 50])
def test_candidates(spark, first):
    rnd = random.Random(6)
    asked, known = some_names(rnd, 40) + [None, "", "zzz"], list(enumerate(some_names(rnd, 60))) + [(99, None)]
    got = {}
    for r in names.candidates(spark.createDataFrame([(n,) for n in asked], "name string"), spark.createDataFrame(known, "catalog_item_id long, name string"), 3, first).collect():
        got.setdefault(r.name, []).append((r.place, r.catalog_item_id, r.score))
    df = {}
    for _, n in known:
        for g in brute_grams(n):
            df[g] = df.get(g, 0) + 1
    for n in set(asked):
        scores = [(sum(1_000_000 // df[g] for g in brute_grams(n) & brute_grams(c)), i) for i, c in known]
        best = sorted((x for x in scores if x[0]), key=lambda x: (-x[0], x[1]))[:3]
        assert sorted(got.get(n, [])) == [(k + 1, i, s) for k, (s, i) in enumerate(best)], n
