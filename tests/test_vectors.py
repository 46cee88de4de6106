"""Vectors of texts, and the nearest of them by an index of cells."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from bidloom.operators import similarity, vectors


def _rows(spark, n=1500, dims=12, kinds=30):
    r = random.Random(3)
    heads = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(kinds)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in heads[0 if i % 3 == 0 else r.randrange(kinds)]]) for i in range(n)]  # a third are of one kind
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_index_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)  # the large cell is cut
    rows = _rows(spark)
    anchors = rows.where("id % 10 = 0")
    want = {(r.anchor_id, r.place): (r.other, r.similarity) for r in similarity.nearest(rows, anchors, "id", "v", 5, 0.3).collect()}
    index = vectors.cell_index(rows, "id", "v")
    assert index.blocks.agg(F.max("n_blocks")).first()[0] > 1
    got = vectors.search(index, anchors, "id", "v", 5, 0.3, probes=2).collect()
    assert {(r.anchor_id, r.place): (r.other, r.similarity) for r in got} == want
    near = vectors.search(index, anchors, "id", "v", 5, 0.3, probes=8, exact=False).collect()
    found = {(r.anchor_id, r.other) for r in near}
    recall = sum((a, o) in found for (a, _), (o, _) in want.items()) / len(want)
    assert recall >= 0.9


def test_index_compares_few_pairs(spark, monkeypatch):
    rows, visits, kept = _rows(spark, 1200, dims=4, kinds=40).where("id % 3 <> 0"), [], vectors.keep

    def watch(df, name):
        out = kept(df, name)
        if name == "visits":
            visits.append(out)
        return out

    monkeypatch.setattr(vectors, "keep", watch)
    index = vectors.cell_index(rows, "id", "v", cells=40)
    anchors = rows.where("id % 10 = 0")
    got = vectors.search(index, anchors, "id", "v", 3, 0.9, probes=2)
    assert {(r.anchor_id, r.place): r.other for r in got.collect()} == {(r.anchor_id, r.place): r.other for r in similarity.nearest(rows, anchors, "id", "v", 3, 0.9).collect()}
    compared = sum(v.join(index.rows, ["cell", "block"]).count() for v in visits)
    assert compared < 0.5 * anchors.count() * rows.count()


def test_index_edges(spark):
    kinds = "id long, v array<float>, place int, other long"
    rows = spark.createDataFrame([(1, None, 0, 0), (2, [0.0, 0.0], 0, 0), (3, [1.0, 0.0], 0, 0), (3, [1.0, 0.1], 0, 0), (4, [1.0, 0.0], 0, 0), (5, [float("nan"), 1.0], 0, 0), (6, [float("inf"), 1.0], 0, 0)], kinds)
    got = sorted((r.anchor_id, r.place, r.other) for r in vectors.search(vectors.cell_index(rows, "id", "v"), rows.where("id < 3 OR id > 3"), "id", "v").collect())
    assert got == [(4, 1, 3)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(50, [2.0, 1.0])], "id long, v array<double>")
    copies = vectors.cell_index(same, "id", "v")
    assert copies.rows.count() == 2
    got = sorted((r.anchor_id, r.place, r.other) for r in vectors.search(copies, same.where("id IN (1, 40, 50)"), "id", "v", 3).collect())
    assert got == [(1, 1, 0), (1, 2, 2), (1, 3, 3), (40, 1, 0), (40, 2, 1), (40, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    with pytest.raises(ValueError):
        vectors.search(copies, same, "id", "v", 16)
    empty = vectors.cell_index(rows.limit(0), "id", "v")
    assert vectors.search(empty, rows, "id", "v").isEmpty() and vectors.search(vectors.cell_index(rows, "id", "v"), rows.limit(0), "id", "v").isEmpty()


def test_embed_asks_once_and_retries(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    log = f"{folder}/log"

    def provider(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if any(t == "bad" for t in texts):
            raise ValueError("no answer")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "aa", "x"), (2, "aa", "x"), (3, "bbb", "x"), (4, None, "x"), (5, " ", "x"), (6, "bad", "x")], "id long, t string, vector string")
    first = {r.id: r.vector for r in vectors.embed(rows, "t", provider, f"{folder}/cache", size=1, retries=2).collect()}
    assert first == {1: [2.0], 2: [2.0], 3: [3.0], 4: None, 5: None, 6: None}
    asked = open(log).read().split()
    assert asked.count("aa") == 1 and asked.count("bad") == 3
    again = {r.id: r.vector for r in vectors.embed(rows, "t", provider, f"{folder}/cache", size=1, retries=0).collect()}
    asked = open(log).read().split()
    assert again == first and asked.count("aa") == 1 and asked.count("bbb") == 1 and asked.count("bad") == 4
    other = vectors.embed(rows, "t", lambda texts: [[1.0]] * len(texts), f"{folder}/cache", model="second")
    assert {r.id: r.vector for r in other.collect()}[6] == [1.0]
    assert vectors.embed(rows.limit(0), "t", provider, f"{folder}/new").isEmpty()


def test_threshold_join_equals_all_pairs(spark):
    r = random.Random(4)
    words = ["pumpe", "Ventil 20", "rohr", "kabel 3x1,5", "펌프 조립", "😀😀", "motor", "11"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(150)] + ["", "", None, "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    anchors = rows.where("id % 7 = 0 OR id > 148")
    for least in (0.55, 0.9):
        want = {(x.anchor_id, x.id): x.similarity for x in similarity.lexical(rows, anchors, "id", "t", least).collect()}
        got = similarity.lexical_above(rows, anchors, "id", "t", least).collect()
        assert {(x.anchor_id, x.id): x.similarity for x in got} == want and len(got) == len(want)
    pairs = similarity.reachable(rows, anchors, "t", 0.9).count()
    assert pairs < 0.1 * len(set(texts)) * anchors.select("t").distinct().count()
    assert similarity.lexical_above(rows.limit(0), anchors, "id", "t").isEmpty()


def test_suggestions(spark):
    clusters = spark.createDataFrame([("b", c, n, s) for c, n, s in [("1", "z", "pending"), ("2", "y", "rejected"), ("3", "x", None), ("4", "w", "held"), ("5", "v", "pending"), ("6", "u", "pending"), ("7", None, "pending")]] + [("other", "8", "q", "pending")], "bid string, cluster_id string, representative_name string, status string")
    similar = spark.createDataFrame([("1", c, s) for c, s in [("2", 0.99), ("3", 0.6), ("4", 0.6), ("5", 0.7), ("6", 0.56), ("1", 1.0)]], "anchor_id string, cluster_id string, similarity double")
    asked = spark.createDataFrame([("1",), ("8",)], "anchor_id string")
    got = similarity.suggestions(clusters, asked, similar, ["bid"]).orderBy("place").collect()
    assert [(x.cluster_id, x.is_suggested) for x in got] == [("5", True), ("4", True), ("3", True), ("2", False), ("6", False), ("7", False)]
