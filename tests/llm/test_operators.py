"""Each operator against a brute-force version, and on null, empty, long, repeated and clashing input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bidloom.llm import decontaminate, html, linededup, packing, paragraphs, pii, quality, scan, simhash, sstable, tokens, toxicity
from bidloom.llm.common import components, new_path
from bidloom.llm.queries import tokenizer_path

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def words(rnd, n, vocabulary=60):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# 1


def brute_hits(text, items, width=10):
    w, hit, found = WORD.findall(low(text)), set(), set()
    places = {}
    for p, x in enumerate(w):
        places.setdefault(x, []).append(p)
    for i, t in items:
        own = WORD.findall(low(t))
        for k in range(max(1, len(own) - width + 1) if own else 0):
            x = own[k : k + width]
            for p in places.get(x[0], []):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate(spark, block_bytes):
    rnd = random.Random(3)
    items = [(k, words(rnd, rnd.choice([0, 1, 3, 12, 15]), 8)) for k in range(12)] + [(90, None), (91, "Été, ÉTÉ x1!"), (92, "w1 w1 w1 w1")]
    items.append((93, items[3][1]))
    docs = [(k, words(rnd, rnd.randrange(60), 8)) for k in range(40)] + [(100, None), (101, ""), (102, "..."), (103, "a " + (items[4][1] or "") + " b"), (104, "ÉtÉ x1"), (105, words(rnd, 30_000, 8)), (1, words(rnd, 20, 8))]
    got = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_bytes=block_bytes, shard_bytes=500).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items)
        assert sum(s.end - s.start for s in r.word_spans) == r.n_hit
        for s, c in zip(r.word_spans, r.spans):
            assert WORD.findall(low(r.text[c.start : c.end])) == WORD.findall(low(r.text))[s.start : s.end]


def test_decontaminate_edges(spark):
    docs = frame(spark, [(1, "one two three", "x", 5)], "doc_id long, text string, items string, n_hit int")
    got = decontaminate.decontaminate(docs, frame(spark, [(1, "two three")], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "word_spans", "spans", "items"]
    assert decontaminate.cut_spans(got).first().text == "one " and decontaminate.clean(got).count() == 0
    empty = frame(spark, [], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, [(1, "a")]), empty).first().n_hit == 0
    assert decontaminate.decontaminate(frame(spark, []), empty).count() == 0


def twins(n=1024):
    """Two words whose sums of powers of any odd base are equal modulo 2**64."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart_by_their_bytes(spark, monkeypatch):
    a, b = twins()
    docs = frame(spark, [(1, a), (2, b), (3, f"x {b} y")])
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, frame(spark, [(7, b)], "item_id long, text string")).collect()}
    assert [got[k].n_hit for k in (1, 2, 3)] == [0, 1, 1]
    row = quality.signals(frame(spark, [(1, " ".join(["p q", a, "r s p q", b, "r s"]))])).first()
    assert row.n_words == 10 and row.n_repeat_words == 0
    # with one hash for all words, and for all windows, bytes still decide
    monkeypatch.setattr(scan, "hash_spans", lambda data, start, end, *_: np.zeros(len(start), np.uint64))
    windows = decontaminate.Windows([("1", "a b"), ("2", "b")], 2)
    text = scan.find_words(*scan.strings(pa.array(["b a b c A"])), scan.WORDS)
    hit, items = decontaminate.search_shard(text, windows)
    assert hit.tolist() == [True, True, True, False, False] and items == [{0, 1}]
    monkeypatch.setattr(scan, "mix", lambda h: h * np.uint64(0))
    batch = pa.record_batch({"text": ["a b c d e f a b c d e", "a b c d e f g h i j", "1 2 3 4 5 1 2 3 4 5 1 2 3 4 5"]})
    assert quality._signals("text")(batch)["n_repeat_words"].to_pylist() == [10, 0, 15]


def test_suffix_order_and_ranks():
    rnd = np.random.default_rng(1)
    text = rnd.integers(0, 4, 400).astype(np.int32)
    text[-1] = 0
    stops = np.flatnonzero(text == 0)
    key = [(0, int(np.searchsorted(stops, k))) if text[k] == 0 else (1, int(text[k])) for k in range(len(text))]
    assert decontaminate.suffix_order(text, 3).tolist() == sorted(range(len(text)), key=lambda k: key[k:])
    w = decontaminate.Wavelet(text.astype(np.int64), 3)
    for c in range(4):
        at = np.arange(len(text) + 1)
        base = w.follow(np.full(1, c), np.zeros(1, np.int64))
        assert (w.follow(np.full(len(at), c), at) - base).tolist() == [int((text[:k] == c).sum()) for k in at]


# 2


def brute_segments(x):
    """All maximal segments by their definition: the best one, then those left and right of it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += x[j]
                if s > 0 and (top is None or s > top[0] + 1e-9):
                    top = (s, i, j + 1)
        if top is None:
            return []
        return best(a, top[1]) + [(top[1], top[2])] + best(top[2], b)

    return best(0, len(x))


def test_segments():
    rnd = random.Random(5)
    for _ in range(150):
        x = np.array([rnd.choice([-3.1, -1.7, -1.3, 1.1, 2.3, 0.7]) * rnd.random() for _ in range(rnd.randrange(25))])
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == brute_segments(x)
    assert len(toxicity.segments(np.tile([1.0, -0.5], 100_000))) == 1


def test_toxicity_learns_and_leaves_fold_0_out(spark):
    rnd = random.Random(2)
    rows = [(k, words(rnd, 60, 3000) + (" vile nasty rotten" if k % 4 == 0 else "") + " " + words(rnd, 10, 3000)) for k in range(800)]
    labels = [(k, int(k % 4 == 0)) for k, _ in rows] + [(5, None)]
    docs = frame(spark, rows)
    model = toxicity.learn(docs, frame(spark, labels, "doc_id long, toxic int"))
    few = toxicity.learn(docs, frame(spark, labels, "doc_id long, toxic int"), fit_rows=20)
    assert (few.rate, round(few.size, 9)) == (model.rate, round(model.size, 9))  # the bound is for the logistic fit alone
    got = toxicity.toxicity(docs, model).withColumn("held", toxicity.fold_of("doc_id") == 0).where("held").toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 4 == 0)).mean() > 0.97 and len(got) > 100
    flipped = [(k, 1 - y if y is not None and zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    again = toxicity.learn(docs, frame(spark, flipped, "doc_id long, toxic int"))
    assert np.array_equal(again.weights, model.weights)
    odd = toxicity.toxicity(frame(spark, [(1, None, 1.0), (2, "", 2.0), (3, "vile nasty rotten " * 20_000, 3.0)], "doc_id long, text string, score double"), model).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in odd] == [False, False, True] and odd[2].passages[0].end == 60_000
    none = toxicity.learn(docs, frame(spark, [], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.toxicity(frame(spark, []), model).count() == 0


def test_toxicity_of_the_table(spark):
    from bidloom.llm.queries import op2_toxicity

    d = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97


# 3


def test_tokens_equal_the_tokenizers():
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    alphabet = ["a", "B", "é", "ß", "Ñ", " ", "  ", "\n", "\t", "'s", "'LL", "1", "½", ".", "!?", "<|endoftext|>", "<|", "日", "İ", "　", "\xa0", "\x85", "\x1c", "\xad", "Σ", "😀", "µ", "×", "word", "the "]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        ours, theirs = tokens.Encoder(tokenizer_path(name), most=50), Tokenizer.from_file(tokenizer_path(name))
        for _ in range(3000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(16)))
            assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_best_fit_is_best_fit():
    rnd = random.Random(4)
    for _ in range(30):
        sizes = np.array([rnd.randrange(1, 60) for _ in range(80)])
        order, counts = packing.best_fit(sizes, 60)
        bins = []
        for n in sorted(sizes.tolist(), reverse=True):
            room = [b for b in bins if sum(b) + n <= 60]
            (max(room, key=sum) if room else bins.append([]) or bins[-1]).append(n)
        assert sorted(order.tolist()) == list(range(80)) and len(counts) == len(bins)
        got = [sizes[order[a : a + c]].sum() for a, c in zip(np.cumsum(counts) - counts, counts)]
        assert sorted(got) == sorted(map(sum, bins))


def test_packing(spark):
    rnd = random.Random(6)
    docs = [(k, words(rnd, rnd.choice([0, 1, 20, 300, 2000]), 500)) for k in range(120)] + [(500, None), (501, ""), (3, words(rnd, 30)), (502, words(rnd, 9000))]
    got = packing.pack_documents(frame(spark, docs).repartition(6), tokenizer_path("word_bpe_49k.json"), carry=["doc_id"]).toPandas()
    encode = tokens.Encoder(tokenizer_path("word_bpe_49k.json")).encode
    want = []
    for k, t in docs:
        ids = encode(t or "") + np.array([1], "<u4").tobytes()
        want += [(k, a // 16384, a // 4, len(ids[a : a + 16384]) // 4, zlib.crc32(ids[a : a + 16384])) for a in range(0, len(ids), 16384)]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= 1.1 * len(packing.best_fit(got.length.to_numpy(), 4096)[1])
    assert packing.pack_documents(frame(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_that_cannot_pack(spark):
    pieces = spark.range(400).select("id", F.lit(2100).cast("long").alias("length"), F.lit("x").alias("offset"))
    got = packing.pack(pieces.repartition(5), task_items=50)
    assert got.select("sequence_id").distinct().count() == 400 and got.columns == ["id", "length", "offset", "sequence_id"]


# 4


def brute_signals(t):
    b = (t or "").encode()
    w = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(w), sum(len(x.decode()) for x in w), sum(b.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_signals(spark):
    rnd = random.Random(8)
    docs = [(k, "\n".join(words(rnd, rnd.randrange(12), 3) for _ in range(rnd.randrange(8)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "é# ñ|　x\x0by\n\n \né# ñ|　x\x0by"), (103, "a " * 50_000)]
    got = quality.signals(frame(spark, docs)).collect()
    for r in got:
        if r.doc_id != 103:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_signals(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert got[-1].n_repeat_words == 50_000 and quality.signals(frame(spark, [])).count() == 0


def test_cutoffs_keep_to_their_risk(spark):
    from math import comb

    assert abs(quality.binomial_at_most(3, 50, 0.1) - sum(comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))) < 1e-12
    rnd = random.Random(9)
    rows = []
    for k in range(3000):
        good = k % 3 > 0
        rows.append((k, "en" if k % 2 else None, " ".join(f"v{rnd.randrange(9999)}" + ("" if good or rnd.random() < 0.3 else "#$") for _ in range(30)), int(good)))
    docs = frame(spark, [r[:3] for r in rows], "doc_id long, lang string, text string")
    labels = frame(spark, [(r[0], r[3]) for r in rows] + [(1, None)], "doc_id long, quality int")
    got = quality.risk_controlled(docs, labels).toPandas()
    good = got.doc_id % 3 > 0
    assert got[good].kept.mean() > 0.95 and got[~good].kept.mean() < 0.1
    few = quality.risk_controlled(docs, labels.where("doc_id < 60")).toPandas()
    assert few.kept.all()
    assert quality.risk_controlled(docs, labels.limit(0)).where("NOT kept").count() == 0


# 5


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shards(spark, kind):
    rnd = random.Random(10)
    docs = [(k * 7 - 100, words(rnd, rnd.randrange(200), 900)) for k in range(300)] + [(5000, None), (5001, ""), (None, "null key"), (40, "again"), (40, "again"), (6000, words(rnd, 60_000, 900))]
    df = frame(spark, docs).withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(7)
    path = tokenizer_path("byte_bpe_50k.json")
    manifest = sstable.write(df, new_path(spark, "t"), path, shards=5)
    got = sstable.read(manifest, kind=df.schema["doc_id"].dataType).collect()
    encode = tokens.Encoder(path).encode
    want = sorted(((str(k) if kind == "string" and k is not None else k), np.frombuffer(encode(t or ""), "<u4").tolist() + [2]) for k, t in docs if k is not None)
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == want and len(got) == len(docs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert got[[r.start for r in got].index(0)].doc_id is None
    keys = frame(spark, [(40,), (-100,), (6000,), (41,), (None,)], "doc_id long").withColumn("doc_id", F.col("doc_id").cast(kind))
    found = sstable.lookup(manifest, keys).collect()
    as_key = (lambda k: str(k)) if kind == "string" else (lambda k: k)
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(None if k is None else as_key(k)), np.frombuffer(encode(t), "<u4").tolist() + [2]) for k, t in docs if k in (40, -100, 6000, None))
    assert sstable.read(sstable.write(df.limit(0), new_path(spark, "t"), path)).count() == 0


# 6


def brute_lines(docs, least=20):
    def norm(s):
        return re.sub(r"[\x20\x09-\x0D]+", " ", s.lower()).strip(" ")

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    first = {}
    for k, t in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        for n, x in enumerate(t.split("\n")):
            if norm(x):
                first.setdefault(norm(x), (k, n))
    gone = {b for b in first for a in first if first[a] < first[b] and min(len(a), len(b)) >= least and near(a, b)}
    return {k: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if norm(x) not in first or norm(x) not in gone and first[norm(x)] == (k, n)) for k, t in docs}


def test_line_dedup(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abé ") for _ in range(n)).strip() or "x" for n in (20, 21, 22, 23, 40, 41, 300)]

    def edit(s):
        k = rnd.randrange(len(s) + 1)
        return rnd.choice([s, s, s[:k] + rnd.choice("abc") + s[k:], s[:k] + s[k + 1 :], s[:k] + "Z" + s[k + 1 :], s.upper(), "  " + s.replace(" ", " \t")])

    docs = [(k, "\n".join(edit(edit(rnd.choice(base))) if rnd.random() < 0.8 else rnd.choice(["", "short", "shirt", " \t"]) for _ in range(rnd.randrange(6)))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, "q" * 3000 + "\n" + "q" * 3001 + "\n" + "p" + "q" * 3001)]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, docs)).collect()}
    want = brute_lines(docs)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_lines - r.n_removed == len(want[k].split("\n")) for k, r in got.items() if want[k])


def test_line_dedup_edges(spark):
    line = "the same line of more than twenty"
    docs = frame(spark, [(1, line, 7), (1, line, 7), (None, line, 8), (2, f"a\n{line}", 9)], "doc_id long, text string, near int")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "near", "n_lines", "n_removed", "n_near"]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", ""), ("1", ""), ("2", "a"), ("None", line)]
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_has_no_python(spark):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        linededup.dedup_lines(frame(spark, [(1, "a")])).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


# 7


def brute_print(t):
    w = low(t).encode().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, most=3):
    ids, root = list(prints), {k: k for k in prints}
    for a in ids:
        for b in ids:
            if bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = root[a], root[b]
                if x != y:
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_simhash(spark):
    rnd = random.Random(12)
    docs = []
    for k in range(60):
        t = words(rnd, rnd.choice([1, 2, 3, 4, 200]), 300)
        docs += [(10 * k, t), (10 * k + 1, t.upper()), (10 * k + 2, t + " extra"), (10 * k + 3, t.replace("w7", "x7", 1))]
    docs += [(9001, None), (9002, ""), (9003, " \n")]
    got = simhash.near_duplicates(frame(spark, docs), carry=["text"]).collect()
    prints = {k: brute_print(t) for k, t in docs}
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)
    stay = simhash.one_of_each(frame(spark, docs)).collect()
    assert sorted(r.doc_id for r in stay) == sorted(set(brute_components(prints).values()))


def test_simhash_links_are_all_found(spark):
    rnd = random.Random(13)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    prints = {}
    for k, s in enumerate(seeds):
        for j in range(15):
            for _ in range(rnd.randrange(4)):
                s ^= 1 << rnd.randrange(64)
            prints[k * 100 + j] = s
    df = frame(spark, [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()], "id long, fingerprint long")
    roots = {r.node: r.root for r in components(simhash.link(df)).collect()}
    want = brute_components(prints)
    groups = {}
    for k, v in prints.items():
        signed = v - (1 << 64) if v >> 63 else v
        groups.setdefault(roots.get(signed, signed), set()).add(k)
    brute = {}
    for k, r in want.items():
        brute.setdefault(r, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_dense_cells(monkeypatch):
    rnd = random.Random(21)
    nodes = [rnd.getrandbits(64) & ~0xFFFF for _ in range(400)]
    for x in nodes[:150]:
        for b in rnd.sample(range(64), rnd.randrange(1, 6)):
            x ^= 1 << b
        nodes.append(x)
    nodes = np.unique(np.array(nodes, np.uint64))
    want = simhash._forest(nodes, 32, 3)
    monkeypatch.setattr(simhash, "DENSE", 20)
    got = simhash._forest(nodes, 32, 3)

    def parts(edges):
        up = {int(n): int(n) for n in nodes}

        def top(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in edges:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(int(n)) for n in nodes]

    assert want and parts(got) == parts(want) and all((a ^ b).bit_count() <= 3 for a, b in got)


def test_simhash_edges(spark):
    docs = frame(spark, [(None, "a b c d", "x"), (4, "a b c d", "y"), (4, "a b c d", "y"), (None, "zz", "z")], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.one_of_each(docs).count() == 2 and simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(edges).select("root").distinct().collect()[0].root == 0


# 8


def test_paragraphs(spark):
    rnd = random.Random(14)
    passage = words(rnd, 70, 5000).split()
    changed = list(passage)
    changed[35] = "changed"
    docs = [(k, words(rnd, 120, 100_000)) for k in range(200)]
    docs += [(1000, "\n".join([words(rnd, 30, 100_000), " ".join(passage), "tail"])), (1001, words(rnd, 33, 100_000) + " " + " ".join(passage) + " " + words(rnd, 25, 100_000)), (1002, words(rnd, 7, 100_000) + "\n" + " ".join(changed))]
    whole = words(rnd, 40, 5000)
    near = whole.replace(whole.split()[2], "q", 1)
    docs += [(2000, whole.upper()), (2001, near), (2002, None), (2003, ""), (2004, whole + "\n" + whole)]
    got = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    assert {r.doc_id for r in got} == {1000, 1001, 1002, 2000, 2001, 2004}
    text = dict(docs)
    for r in got:
        assert len(text[r.doc_id][r.start : r.end].split()) == r.n_words
    assert {(r.doc_id, r.removed) for r in got if r.class_id == 2000} == {(2000, False), (2001, True), (2004, True)}
    cut = {r.doc_id: r.text for r in paragraphs.cut_paragraphs(frame(spark, docs), paragraphs.repeated_paragraphs(frame(spark, docs))).collect()}
    assert cut[2001] == "" and cut[2004] == "\n" and cut[5] == text[5] and cut[2002] is None
    assert paragraphs.repeated_paragraphs(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size, lines, least", [(51, 0, 0.98), (51, 7, 0.98), (60, 0, 0.98), (60, 11, 0.98), (100, 0, 1.0)])
def test_passages_are_found_wherever_they_stand(spark, size, lines, least):
    """End to end: two documents share a passage in mid-line, or one broken into lines of so many words."""
    rnd = random.Random(size + lines)
    docs = []
    for k in range(100):
        passage = words(rnd, size, 100_000).split()
        if lines:
            passage = [w + ("\n" if i % lines == lines - 1 else "") for i, w in enumerate(passage)]
        docs += [(2 * k + c, f"{words(rnd, rnd.randrange(1, 80), 100_000)} {' '.join(passage)} {words(rnd, rnd.randrange(1, 80), 100_000)}") for c in (0, 1)]
    docs += [(k, words(rnd, 300, 100_000)) for k in range(1000, 1100)] + [(2000, None), (2001, "x " * 7)]
    got = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    found = {r.doc_id for r in got}
    assert len(found) >= 200 * least and max(found) < 200
    assert all(len(dict(docs)[r.doc_id][r.start : r.end].split()) == r.n_words for r in got)
    assert all(r.removed == (r.doc_id % 2 == 1) and r.class_id == r.doc_id - r.doc_id % 2 for r in got)


def test_no_piece_of_a_text_is_lost():
    rnd = random.Random(19)
    texts = ["\n".join(words(rnd, rnd.choice([1, 3, 7, 8, 9, 40, 49, 200]), 50) for _ in range(rnd.randrange(1, 9))) for _ in range(300)] + ["", " ", "a"]
    p = paragraphs.Paragraphs(*scan.strings(pa.array(texts, pa.large_string())))
    assert (p.last - p.first >= paragraphs.MIN_WORDS).all() and (p.first[1:] >= p.last[:-1]).all()
    held = np.bincount(p.doc, p.last - p.first, len(texts))
    for k, t in enumerate(texts):
        sizes = [len(x.split()) for x in t.split("\n")]
        assert held[k] >= sum(n for n in sizes if n >= paragraphs.MIN_WORDS)


def test_forests_connect_what_links_connect(monkeypatch, spark):
    rnd = random.Random(20)
    sets = []
    for _ in range(30):
        base = rnd.sample(range(300), 30)
        sets += [frozenset(base[: rnd.randrange(24, 31)] + rnd.sample(range(300, 900), rnd.randrange(4))) for _ in range(10)]
    want = {(a, b) for a in range(300) for b in range(a) if paragraphs._similar(sets[a], sets[b], 0.8)}

    def roots(links):
        up = list(range(300))

        def top(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in links:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(k) for k in range(300)]

    got = paragraphs.forest(sets, 0.8)
    assert roots(got) == roots(want) and all((max(e), min(e)) in want for e in got)
    keys = spark.createDataFrame([(7, 100, k) for k in range(100)], "bucket long, n long, k long")
    parts = paragraphs._blocks_of(keys, 30).groupBy("part").agg(F.collect_set("k").alias("k")).collect()
    assert len({(a, b) for r in parts for a in r.k for b in r.k}) == 100 * 100 and max(len(r.k) for r in parts) < 100


def test_paragraphs_edges(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = frame(spark, [(None, a, "x"), (1, a, "y"), (2, b, "z"), (2, b, "z"), (3, None, None), (4, "", "k"), (5, " ".join(f"c{k % 977} d{k}" for k in range(60_000)), "l")], "doc_id long, text string, class_id string")
    got = sorted((str(r.doc_id), str(r.class_id), r.removed, r.n_occurrences) for r in paragraphs.repeated_paragraphs(docs).collect())
    assert got == [("1", "None", True, 2), ("2", "2", False, 2), ("2", "2", False, 2), ("None", "None", False, 2)]


def test_bands():
    bands, rows = paragraphs.tune_bands(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 > 1 - (1 - 0.8**rows) ** (bands - 1)


# 9


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b <b>c</b>  d", "a\n\nb c d"),
        ("<ol start=3><li>one<li>two<ul><li>in</ul><li value=9>n</ol>", "3. one\n4. two\n   - in\n9. n"),
        ("<table><tr><th>Name<th>Qty<tr><td>Bolt<td>12<tr><td colspan=2>all<tr><td>Washer M6<td>3</table>", "Name       Qty\nBolt       12\nall\nWasher M6  3"),
        ("<div style='display:none'>no</div><span hidden>no</span><script>if (a < b) '</p>'</script><style>p{}</style>yes<template>no</template>", "yes"),
        ("<span style='visibility: hidden'>no <i style='visibility:visible'>yes</i></span>", "yes"),
        ("<pre> x\n  y</pre>&lt;t&gt;&nbsp;z<br><br>k", " x\n  y\n\n<t> z\n\nk"),
        ("<details><summary>S</summary>no<p>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("a<!-- <p>no --> b <![CDATA[x]]>c<a href=\"x>y\">d</a></p>e", "a b cd\ne"),
        ("a < b <3 <unclosed q='", "a < b <3"),
        ("<title>no</title><h1>H</h1>t<hr>u<dl><dt>k<dd>v</dl>", "H\n\nt\nu\n\nk\n  v"),
        ("", ""),
    ],
)
def test_render(page, want):
    assert "\n".join(html.render(page)) == want


def test_tables_align(spark):
    long, page = "x" * 61, "<table><tr><td>{}<td>1<tr><td>b<td>2<tr><td>c<p>d</p><td>3</table>"
    assert html.render(page.format(long)) == [long + "  1", "b" + " " * 62 + "2", "c" + " " * 62 + "3", "", "d"]
    wide = "<table>" + "<tr><td>" + "y" * 50_000 + "<td>1" + "<tr><td>a<td>2" * 5_000 + "</table>"
    assert sum(map(len, html.render(wide))) < 200_000


def test_pages(spark):
    deep = "<div>" * 20_000 + "x" + "<b>" * 5_000
    pages = frame(spark, [(1, None, "a"), (2, "<p>a", "b"), (3, deep, "c"), (4, "<a '" * 50_000, "d"), (2, "<p>a", "b")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html.visible_text(pages).collect()}
    assert got == {1: "", 2: "a", 3: "x", 4: ""} and html.visible_text(pages.limit(0)).count() == 0


# 10


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base():
    rnd = random.Random(16)
    for _ in range(8000):
        t = "".join(rnd.choice("ab.@-+% 0123456789()\n") for _ in range(rnd.randrange(60)))
        assert pii.detect(t) == brute_pii(t), t
    card = "4539 1488 0343 6467"
    assert pii.detect(f"x {card} y") == brute_pii(f"x {card} y") == [(2, 2, 21)]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("é john at example dot com", "email", "john at example dot com"),
        ("jane (at) mail.example.org", "email", "jane (at) mail.example.org"),
        ("call plus one four one five five five five two six seven one please", "phone", "plus one four one five five five five two six seven one"),
        ("card: four five three nine 1488 0343 6467", "card", "four five three nine 1488 0343 6467"),
        ("x ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("john​.doe@exam​ple.com", "email", "john​.doe@exam​ple.com"),
    ],
)
def test_pii_disguises(text, kind, span):
    base, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans if (a, k, b) not in base] == [(kind, span)]
    assert set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "kind", "whole", "part"),
    [
        ("jоhn.smith@example.com", "email", "jоhn.smith@example.com", "hn.smith@example.com"),
        ("to john​.doe@example.com now", "email", "john​.doe@example.com", ".doe@example.com"),
        ("+1415555019 nine nine nine", "phone", "+1415555019 nine nine nine", "+1415555019"),
    ],
)
def test_pii_disguised_in_part(text, kind, whole, part):
    base, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in base] == [(kind, part)]
    assert {(pii.KINDS[k], text[a:b]) for a, k, b in spans} == {(kind, part), (kind, whole)}


@pytest.mark.parametrize(
    "text, kind",
    [
        ("jo" + " " * 9 + "at" + " " * 12 + "example.org", "email"),
        ("jo[" + " " * 9 + "at" + " " * 9 + "]example" + " " * 9 + "dot" + " " * 9 + "org", "email"),
        ("jo at " + "h" * 70 + ".org", "email"),
        ("jo" + " " * 7 + "@" + " " * 7 + "example.org", "email"),
        ("+1 415 555 01 nine nine", "phone"),
        ("plus vier neun drei null eins zwei drei vier fünf sechs sieben", "phone"),
        ("+ trois trois un deux trois quatre cinq six sept huit neuf", "phone"),
        ("10.0.0.one", "ip"),
    ],
)
def test_pii_disguises_of_any_width(text, kind):
    base, spans = pii.find(text)
    assert [(a, pii.KINDS[k], b) for a, k, b in spans if (a, k, b) not in base] == [(0, kind, len(text))]


def test_pii_disguises_take_linear_time():
    for text in (" " * 200_000, "[" * 200_000, "a @ " * 50_000, "one " * 50_000 + "x", "a at " * 40_000, ("x" + " " * 2000) * 100 + "[at]"):
        pii.find(text)


def test_pii_leaves_prose_alone():
    for t in ("the one or two at home dot", "we met at five. dot", "one two three four five, once I caught a fish", "naïve café at noon"):
        assert pii.find(t) == ([], [])


def test_pii_frame(spark):
    docs = frame(spark, [(1, None, 1), (2, "a@b.co", 2), (2, "a@b.co", 2), (3, "9" * 200_000 + "@" * 50_000 + "a" * 200_000 + "+" * 1000, 3)], "doc_id long, text string, base int")
    got = pii.find_pii(docs).collect()
    assert [len(r.base) for r in got] == [0, 1, 1, 0] and pii.find_pii(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"email:0:6").hexdigest() == hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[1].base).encode()).hexdigest()


def test_paragraph_places_in_short_texts():
    """Places cost no more than bands do, however many texts a block has."""
    import time

    rnd = random.Random(1)
    texts = [" ".join(f"wé{rnd.randrange(999)}" for _ in range(17)) for _ in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": texts})
    took = []
    for f in (lambda: list(paragraphs._banded(iter([batch]), "t", 4, 2)), lambda: pa.Table.from_batches(paragraphs._places(iter([batch]), "t"))):
        began = time.process_time()
        found = f()
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0]
    for r in found.to_pylist()[::97]:
        assert len(texts[r["id"]][r["start"] : r["end"]].split()) == r["n_words"]


def test_table_spans():
    """Each cell of a random table with row and column spans begins where its column does; equal columns begin alike."""
    assert html.render("<table><tr><td rowspan=2>Alpha<td>b<td>x<tr><td>c<td>y</table>") == ["Alpha  b  x", "       c  y"]
    assert html.render("<table><tr><td rowspan=0>가나<td>b<tr><td>c<tbody><tr><td>z<td>d</table>") == ["가나  b", "      c", "z     d"]
    rnd = random.Random(12)
    for _ in range(60):
        taken, text, spans, n = {}, [], {}, 0
        for r in range(rnd.randrange(2, 7)):
            cells, c = [], 0
            for _ in range(rnd.randrange(1, 5)):
                while (r, c) in taken:
                    c += 1
                wide, down = rnd.choice([1, 1, 1, 2]), rnd.choice([1, 1, 2, 3])
                if any((r, c + k) in taken for k in range(wide)):
                    wide = 1
                name = f"c{n}" + "x" * rnd.randrange(1, 6) + "."
                n += 1
                for y in range(down):
                    for k in range(wide):
                        taken[r + y, c + k] = name
                spans[name] = (r, c, wide)
                cells.append(f"<td colspan={wide} rowspan={down}>{name}")
                c += wide
            text.append("<tr>" + "".join(cells))
        lines = html.render(f"<table>{''.join(text)}</table>")
        if all(c == 0 for _, c, _ in spans.values()):
            continue
        widths = {}
        for name, (_, c, wide) in spans.items():
            if wide == 1:
                widths[c] = max(widths.get(c, 0), len(name))
        for name, (r, c, _) in spans.items():
            begin = sum(widths.get(k, 0) + 2 for k in range(c))
            before = [lines[r].index(x) + len(x) + 2 for x, (q, a, _) in spans.items() if q == r and a < c]
            assert lines[r].index(name) == max([begin, *before])  # a spanning cell that is wider than its columns moves what follows



def test_disguises_in_four_languages():
    def texts(t):
        return [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t)[1]]

    assert texts("mail jane arroba example punto com hoy") == [("email", "jane arroba example punto com")]
    assert texts("an jane at example punkt de senden") == [("email", "jane at example punkt de")]
    assert texts("à jane arobase example point fr merci") == [("email", "jane arobase example point fr")]
    assert texts("jane [arroba] example (punto) com") == [("email", "jane [arroba] example (punto) com")]
    assert texts("jane@example punto com") == [("email", "jane@example punto com")]
    assert texts("écrivez à a@b.fr point final") == [("email", "a@b.fr")]
    for prose in ("we arrived at exit point blank", "look at this point now", "el punto com", "ein Punkt de Mire", "(punto) y (point)"):
        assert texts(prose) == []
    number = "+1.four.one.five.five.five.five.zero.one.two.three"
    assert texts(f"call {number} now") == [("phone", number)]
    assert [k for k, _ in texts("+1 (four)(one)(five) (five)(five)(five) (zero)(one)(two)(three)")] == ["phone"]
    assert texts("ping one nine two dot one six eight dot zero dot one") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert texts("host one.two.three.four up") == [("ip", "one.two.three.four")]
