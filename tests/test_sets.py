"""Pairs of sets in blocks: the same pairs as one by one, and links that don't grow with them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.operators import names, sets, similarity
from tests.test_linkage import brute_grams, some_names


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(sets, "MANY", 1)
    monkeypatch.setattr(sets, "SIZE", 16)


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_names_meet_in_blocks(spark, blocks, least):
    rnd = random.Random(5)
    rows = [(rnd.choice("pq"), n) for n in some_names(rnd, 120)] + [("q", "bolt red"), ("q", "red bolt"), (None, "red"), ("p", None), ("r", "alone")]
    frame = spark.createDataFrame(rows, "g string, name string")
    pairs = names.similar(frame, None, ["g"], "name", least)
    assert "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
    low = {}
    for g, n in rows:
        if g and brute_grams(n):
            low[g, brute_grams(n)] = min(n, low.get((g, brute_grams(n)), n))
    want = {(g, a, b): len(s & t) / len(s | t) for (g, s), a in low.items() for (h, t), b in low.items() if g == h and a < b and len(s & t) / len(s | t) >= least - 1e-9}
    got = pairs.collect()
    assert {(r.g, r.a, r.b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    two = names.similar(frame.where("g = 'p'"), frame.where("g = 'q'"), [], "name", least).collect()
    sides = {g: {s: n for (h, s), n in low.items() if h == g} for g in "pq"}
    want = {(a, b): len(s & t) / len(s | t) for s, a in sides["p"].items() for t, b in sides["q"].items() if len(s & t) / len(s | t) >= least - 1e-9}
    assert {(r.a, r.b): r.similarity for r in two} == pytest.approx(want) and len(two) == len(want)


def test_wide_blocks_are_multiplied_in_parts():
    rnd = np.random.default_rng(1)
    lists = [np.sort(rnd.choice(3 * sets.WIDTH, 2 * sets.WIDTH, False)) for _ in range(5)]
    side = (np.array([len(x) for x in lists]), np.concatenate(lists))
    found = {(i, j): n for a, b, c in sets._near(side, side, 0.3) for i, j, n in zip(a.tolist(), b.tolist(), c.tolist())}
    assert found == {(i, j): len(np.intersect1d(lists[i], lists[j])) for i, j in itertools.product(range(5), repeat=2)}


def test_clusters_are_linked_by_few_links(spark, blocks, monkeypatch):
    kept = {}
    own = names.keep

    def keep(df, name):
        out = own(df, name)
        kept[name] = out.count()
        return out

    rnd = random.Random(7)
    rows = [("a", str(k), k, n) for k, n in enumerate(some_names(rnd, 60))] + [("a", str(100 + k), 100 + k, f"steel anchor bolt {k:02}") for k in range(60)]
    frame = spark.createDataFrame(rows, "bid string, item_id string, seq long, name string")
    monkeypatch.setattr(names, "keep", keep)
    groups = {}
    for r in names.similar_clusters(frame, "bid", 0.5).collect():
        groups.setdefault(r.cluster_id, (r.score, set()))[1].add(r.item_id)
    own_sets = {r[1]: brute_grams(r[3]) for r in rows}
    near = {(x, y): len(s & t) / len(s | t) for x, s in own_sets.items() for y, t in own_sets.items() if len(s & t) / len(s | t) >= 0.5 - 1e-9}
    todo, want = set(own_sets), []
    while todo:
        part, new = set(), {min(todo)}
        while new:
            part |= new
            new = {y for x, y in near if x in new} - part
        todo -= part
        want.append((min([s for (x, y), s in near.items() if x in part and own_sets[x] != own_sets[y]], default=1.0), part))
    assert sorted((round(s, 9), sorted(p)) for s, p in groups.values()) == sorted((round(s, 9), sorted(p)) for s, p in want)
    pairs = len({frozenset((own_sets[x], own_sets[y])) for x, y in near if own_sets[x] != own_sets[y]})
    assert kept["links"] < pairs / 2


def test_reachable_texts_meet_in_blocks(spark, blocks):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(0, 9))) for _ in range(80)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = similarity.reachable(frame, frame.limit(20), "t", 0.8)
    assert "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
    asked = {r.t or "" for r in frame.limit(20).collect()}
    common = lambda a, b: sum(min(a.count(c), b.count(c)) for c in set(a))
    want = {(a, b) for a in asked for b in {t or "" for t in texts} if (a == b == "") or (len(a) + len(b) and 2 * common(a, b) >= 0.8 * (len(a) + len(b)) - 1e-9)}
    got = pairs.select(F.col("anchor"), F.col("text")).collect()
    assert {(r.anchor, r.text) for r in got} == want and len(got) == len(want)
