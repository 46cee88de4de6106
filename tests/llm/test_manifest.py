"""Merkle manifest, conversation repair and URL filters against brute force, and on null, empty, long, repeated and clashing input."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidloom.llm import conversations, merkle, urls
from bidloom.llm.queries import Q
from bidloom.session import table

# 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    """(top, for each node its siblings level by level as (before, after))."""
    paths, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(owner):
            run = nodes[at - at % 8 : at - at % 8 + 8]
            paths[k].append((run[: at % 8], run[at % 8 + 1 :]))
            owner[k] = at // 8
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted result tuples."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees.append(brute_tree([x[2] for x in groups[g]]))
    root, tops = brute_tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for g, (top, paths), above in zip(order, trees, tops):
        for (_, _, leaf, r), path in zip(groups[g], paths):
            seen = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                seen[4] = re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
            h, siblings = brute_leaf(seen), []
            for before, after in path + above:
                h = sha(*before, h, *after)
                siblings += before + after
            out.append((str(r[0]), leaf, top, root, sha(*siblings), h, h == root))
    return sorted(out)


FIELDS = ["doc_id", "source", "lang", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def manifest(spark, rows, schema=DOCS):
    docs = spark.createDataFrame(rows, schema)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.verify(docs, "doc_id", "lang", [*FIELDS, "text"], [*FIELDS, tampered])
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def test_merkle(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["Ab c", "É", "", None, "x" * 30_000, "low"]) if k % 7 else f"T{k}", rnd.choice(["en"] * 12 + ["de", "fr", "É", "Z"]), f"s{k % 3}", k) for k in range(180)]
    rows += [(None, "N", "en", None, None), (None, None, None, None, None), (5, "Twice", None, "s", 1), (5, "Twice", None, "s", 1), (6, "one", "lone", None, 2), (-3, "Neg", "en", "s", 9)]
    got = manifest(spark, rows)
    assert got == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert {True, False} == {r[6] for r in got}


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_merkle_sizes(spark, n):
    rows = [(k, f"T{k}", "en", "s", k) for k in range(n)]
    assert manifest(spark, rows) == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    if n == 1:
        assert manifest(spark, rows)[0][1] == manifest(spark, rows)[0][3]


def test_merkle_clashes(spark):
    rows = [(k, f"T{k}", "en", "s", k) for k in range(10)]
    wide = spark.createDataFrame([(*r, "x", 1, True) for r in rows], f"{DOCS}, Root string, node int, verified boolean")
    got = merkle.verify(wide, "doc_id", "lang", [*FIELDS, "text"], [*FIELDS, "text"])
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.where("verified").count() == 10


# 12


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """rows (turn, role, text) of one conversation in order; edits searched by cost, then audit (Dijkstra over rows x output so far)."""
    strip = " \t\n\x0b\x0c\r"
    blank = duplicate = truncated = illegal = 0
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(strip)
        fault = "blank" if not body.strip(strip) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if (i, roles) in best and best[i, roles] < (cost, audit):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return gaps, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(lines))

        def go(add, letter, j, role=None, text=""):
            now = roles + (role[:1] if role else "")
            if role and not re.fullmatch("s?(ua)*u?", now):
                return
            now = now if len(now) < 4 else now[-2:]  # what may follow depends on the last initial; "ua" and "au" end alike
            now = {"au": "uau", "ua": "ua"}.get(now, now) if len(roles) >= 3 else now
            new = (cost + add, audit + letter, j, now, lines + ((f"{role}:{text}",) if role else ()))
            if (j, now) not in best or best[j, now] > new[:2]:
                best[j, now] = new[:2]
                heapq.heappush(heap, new)

        if i < len(rows):
            _, role, text = rows[i]
            go(3, "D", i + 1)
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role:
                    go(cut, "K", i + 1, role, text)
                for r in ("user", "assistant"):
                    go(2 + cut, "R", i + 1, r, text)
        for r in ("user", "assistant"):
            go(2, "I", i, r)


CONV = "conv_id long, turn long, role string, text string"


def brute_conversations(rows):
    by = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        by[r[0]].append(r[1:])
    return {c: brute_repair(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))) if x else (0, 0, 0, 0, 0, 0, "", sha("")) for c, x in by.items()}


def some_conversations(rnd, n=60):
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.4 else ("system" if t == 0 and rnd.random() < 0.5 else ["user", "assistant"][t % 2])
            rows.append((c, None if rnd.random() < 0.05 else t * rnd.choice([1, 1, 2]), rnd.choice([role] * 9 + [None, "tool", ""]), rnd.choice(["One.", "Two?\n ", "three", " \t", "", None, "Four!", "Five. six"])))
    return rows


def test_repair(spark, monkeypatch):
    rows = some_conversations(random.Random(11))
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ho."), (900, 0, "user", "long " * 20_000 + "."), (900, 1, "assistant", "A."), (900, 1, "assistant", "A.")]
    rows += [(k, 0, "user", "Only.") for k in range(1000, 1100)]  # some are dropped whole
    frame = spark.createDataFrame(rows, CONV)
    expected = brute_conversations(rows)
    got = conversations.repair(conversations.damage(frame), frame).collect()
    assert len(got) == len(expected) and {r.conv_id: tuple(r)[1:] for r in got} == expected
    assert any(x[:7] == (0, 0, 0, 0, 0, 0, "") for x in expected.values())
    assert {"K", "D", "I", "R"} <= set("".join(x[6] for x in expected.values()))


def test_repair_in_blocks(spark):
    """A conversation of many blocks gives what it gives in one piece; batches end inside it."""
    rnd = random.Random(2)
    rows = [(7, t, ["user", "assistant"][t % 2] if rnd.random() < 0.8 else rnd.choice(["system", "user", "assistant", "x"]), rnd.choice([f"Text {t}.", f"text {t}", "Again.", " "])) for t in range(3000)] + [(8, 0, "user", "Q?"), (8, 1, "assistant", "A.")]
    frame = spark.createDataFrame(rows, CONV)
    whole = {r.conv_id: tuple(r) for r in conversations.repair(frame).collect()}
    walk, code = {0: (0, "")}, []
    seen = set()
    for _, _, role, text in rows[:3000]:
        code.append("d" if not text.strip() or (role, text) in seen else (role[0] if role[0] in "sua" else "x") + ("t" if text[-1] != "." else ""))
        seen.add((role, text))
    moves = conversations._moves().to_pylist()
    for kind in code:
        new = {}
        for m in moves:
            if m["kind"] == kind and m["state"] in walk:
                x = (walk[m["state"]][0] + m["cost"], walk[m["state"]][1] + m["letters"])
                new[m["became"]] = min(new.get(m["became"], x), x)
        walk = new
    best = min((walk[s][0] + c, walk[s][1] + a) for s, (c, a) in conversations.ENDS.items() if s in walk)
    assert whole[7][6:8] == best and whole[8][6:8] == (0, "KK")


def test_chain_carries(spark, monkeypatch):
    """Batches of a few rows give the same as one."""
    import pyarrow as pa

    rnd = random.Random(4)
    kinds = [(f"1{c}", p // 5, p, rnd.choice(["u", "a", "s", "ut", "at", "d", "x"])) for c in range(4) for p in range(37)]
    batch = pa.RecordBatch.from_pydict({"g": [k[0] for k in kinds], "block": [k[1] for k in kinds], "pos": [k[2] for k in kinds], "kind": [k[3] for k in kinds]})

    def run():
        links = [b for b in conversations._advance(iter([batch]))]
        rows = sorted((r for b in links for r in b.to_pylist()), key=lambda r: (r["g"], r["block"], r["start"]))
        return sorted(tuple(r.values()) for b in conversations._chain(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist())

    one = run()
    monkeypatch.setattr(conversations, "BATCH", 8)
    assert run() == one and len(one) == 4


def test_repair_empty(spark):
    frame = spark.createDataFrame([], CONV)
    assert conversations.repair(conversations.damage(frame), frame).collect() == []
    odd = spark.createDataFrame([(1, 0, "user", "A.", "x", 5)], f"{CONV}, audit string, g int")
    assert conversations.repair(odd).collect()[0].audit == "KI"


# 13


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def brute_rule(host, path):
    fit = [(v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[1]), default=(None, None))


ODD = [None, "", "nothing", "://", "http://", "https://www.EXAMPLE.com/en/1?x=1#a", "http://example.com/en/", "http://example.com/EN/", "http://a.b.net/es/x", "http://net/fr/", "http://notnet/fr/", "http://com", "http://com/", "http://x.com?y=/en/", "ftp://É.Com#/en/", "a://b://c.com/x", "http://example.com/en", "http://x.org/" + "a/" * 20_000, "http://x.net/es/?q=a&b=2&c", "mailto:a@b.com", "http://example.com/en/"]


def test_url_rules(spark):
    rows = [(k, u, "z") for k, u in enumerate(ODD)] + [(None, "http://h.net/de/1", "z")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, Rule string"), urls.RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k, u, _ in rows:
        host, path = brute_parts(u)
        said, rule = brute_rule(host, path)
        r = by[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (said or r.verdict) and r.verdict in ("allow", "block") and 0 <= r.blocked <= 1


def test_url_features(spark):
    host, path, query = urls.parts(F.col("url"))
    got = urls.lexical(spark.createDataFrame([(u,) for u in ODD], "url string").withColumns({"host": host, "path": path, "query": query})).collect()
    for r in got:
        u = r.url or ""
        counts = Counter(u)
        assert abs(r.entropy + sum(c / len(u) * math.log2(c / len(u)) for c in counts.values())) < 1e-9
        assert r.n_url == len(u) and abs(r.digits * max(1, len(u)) - sum(c.isdigit() for c in u)) < 1e-9 and r.depth == len([s for s in r.path.split("/") if s])
        assert r.n_params == (len(r.query.split("&")) if r.query else 0)


def test_url_model(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    host, path, query = urls.parts(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path, "query": query})
    rows = rows.withColumn("verdict", urls.judge(F.col("host"), F.col("path"), urls.RULES)[1]).where("verdict IS NOT NULL")
    held = F.crc32("url") % 4 == 0
    model = urls.learn(rows.where(~held).drop("page_id"))
    right = model.score(rows.where(held)).select(((F.col("blocked") >= 0.5) == (F.col("verdict") == "block")).cast("double").alias("x")).collect()
    assert len(right) > 15 and sum(r.x for r in right) / len(right) > 0.9


def test_url_one_verdict(spark):
    frame = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org/")], "page_id long, url string")
    assert {r.verdict for r in urls.filter_urls(frame, urls.RULES).collect()} == {"allow"}
    assert {r.verdict for r in urls.filter_urls(frame, [("block", "com", "/")]).collect()} == {"block"}
    assert {r.verdict for r in urls.filter_urls(frame, []).collect()} == {"allow"}
    assert urls.filter_urls(frame.limit(0), urls.RULES).collect() == []
    labels = spark.createDataFrame([(f"http://b{k}.org/x{k}?a=1", "block") for k in range(20)] + [(f"http://b{k}.edu/{k}", "allow") for k in range(20)], "url string, verdict string")
    got = {r.url: r.verdict for r in urls.filter_urls(spark.createDataFrame([(1, "http://q.org/x77?a=1"), (2, "http://q.edu/99")], "page_id long, url string"), [], labels=labels).collect()}
    assert got == {"http://q.org/x77?a=1": "block", "http://q.edu/99": "allow"}


def test_queries_run(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table(spark, d, "documents").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in Q["op11_merkle_manifest"](spark, d).collect()) == brute_manifest(docs)
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in Q["op12_conversation_repair"](spark, d).collect()} == brute_conversations(rows)
    for r, u in zip(Q["op13_url_filter"](spark, d).orderBy("page_id").collect(), table(spark, d, "pages").orderBy("page_id").collect()):
        host, path = brute_parts(u.url)
        said, rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (said or r.verdict)
