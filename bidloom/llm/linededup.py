"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is what \\n parts. It is compared in normal form: lower-cased, runs of space and 0x09 to 0x0D made one space, trimmed. Lines
whose normal form is empty stay. Of equal lines the earliest occurrence stays (by document id, then row, then line number). Of two
lines of `MIN_CHARS` code points or more within one edit (a code point replaced, inserted or removed) the one with the earlier first
occurrence stays: the other, and all its copies, go. Shorter lines, where one edit is another word, go only if they are equal.

The neighbourhood of a line are its variants with one code point deleted. Lines of equal length within one edit share the variant that
lacks the same place; of lines whose lengths differ by one, the shorter is itself a variant of the longer. Variants are hashed keys,
equal keys meet in an aggregate, never as pairs, and the edit distance to the earliest of a key is verified on the texts. Lines have
thousands of variants, few have a neighbour, so variants are emitted only where one is possible, which loses none:
 1. one edit leaves either the first or the second half of a line alone, so a line needs a partner with an equal half;
 2. in the other half it leaves all blocks but one alone, so a block needs a partner that is equal before and after it;
 3. the variants of such blocks are emitted, keyed with what stands before and after.

Lines are split and hashed once and kept in the shared folder without their texts; a document's text is read again only for the lines
that may have a neighbour, and to cut it.

Nulls: a null text stays null and has no lines; null ids come first. Empty texts have one empty line. A very long text is one row
of many lines, none of which is grouped by anything but itself. Ties and repeated rows: rows with equal id and text count as one
document and come out alike; of rows with one id and different texts the order of the texts' hashes decides. An empty table gives an
empty one. Extra columns pass; those named n_lines, n_removed or n_near are replaced. A document can lose all its lines; its text is then
empty. Hashes of lines and of variants have 128 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import is_small, join_skewed, keep, semi_join, without

ADDED = ["n_lines", "n_removed", "n_near"]
MIN_CHARS = 20
WHITE = ("  ", "\t", "\n", "\x0b", "\x0c", "\r")


def normal(line: Column) -> Column:
    """The normal form. Only lines with white space other than single spaces need the pattern."""
    low = F.lower(line)
    odd = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in WHITE])
    return F.trim(F.when(odd, F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")).otherwise(low))


def _two(prefix: str, *columns: Column) -> list[Column]:
    """128 bits of hash in two columns."""
    return [F.xxhash64(*columns).alias(f"{prefix}1"), F.xxhash64(F.lit(71), *columns).alias(f"{prefix}2")]


def split_lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """r1, r2 (row), id, line, raw."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"), *_two("r", F.col(id), F.col(text)))
    return rows.select("id", "r1", "r2", F.posexplode(F.split("t", "\n")).alias("line", "raw"))


def lines_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Lines that may be removed, without their texts: r1, r2 (row), id, line, n (code points), k1, k2 (hash of the normal form), h1 to h4 (of its halves)."""
    out = split_lines(docs, id, text).select("id", "r1", "r2", "line", normal(F.col("raw")).alias("s")).withColumn("n", F.length("s")).where(F.col("n") > 0)
    return out.select("id", "r1", "r2", "line", "n", *_two("k", F.col("s")), *[h.alias(f"h{k}") for k, h in enumerate(_halves(F.col("s"), F.col("n")), 1)])


def _right(s: Column, n: Column) -> Column:
    """The last n code points."""
    return F.substring(s, F.length(s) - n + 1, n)


def _halves(s: Column, n: Column) -> list[Column]:
    """What a line has in common with a partner: hashes of its first and second half, r being its length, then r one less. Null where r is too short."""
    out = []
    for r in (n, n - 1):
        h = F.floor(r / 2).cast("int")
        for side, part in ((0, F.substring(s, F.lit(1), h)), (1, _right(s, r - h))):
            out.append(F.when(r >= MIN_CHARS, F.xxhash64(r, F.lit(side), part)))
    return out


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys with two different lines or more, one of which has the length r."""
    many = rows.groupBy(key).agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min(F.col("n") - F.col("r")).alias("base"))
    return keep(many.where("lo <> hi AND base = 0").select(key), "shared")


def near_lines(docs: DataFrame, classes: DataFrame, id: str, text: str) -> DataFrame:
    """(k1, k2) of the distinct lines that have an earlier neighbour. classes: k1, k2, first, n, h1 to h4."""
    each = [F.struct((F.col("n") - k // 2).alias("r"), F.lit(k % 2).alias("side"), F.col(f"h{k + 1}").alias("half")) for k in range(4)]
    halves = classes.where(F.col("n") >= MIN_CHARS).select("k1", "k2", "n", "first", F.explode(F.array(*each)).alias("h")).select("k1", "k2", "n", "first", "h.*").where("half IS NOT NULL")
    possible = keep(semi_join(halves, _shared(halves, "half"), ["half"]), "halves")
    wanted = keep(possible.select("k1", "k2", F.col("first.r1").alias("r1"), F.col("first.r2").alias("r2"), F.col("first.line").alias("line")).distinct(), "wanted")
    small = F.broadcast(wanted) if is_small(wanted, 200_000) else wanted
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"), *_two("r", F.col(id), F.col(text))).join(small.select("r1", "r2"), ["r1", "r2"], "left_semi")
    split = rows.select("r1", "r2", F.posexplode(F.split("t", "\n")).alias("line", "raw")).join(small, ["r1", "r2", "line"])
    texts = keep(split.select("k1", "k2", normal(F.col("raw")).alias("s")).dropDuplicates(["k1", "k2"]), "texts")

    # Blocks of the half that may hold the edit.
    r, half = F.col("r"), F.floor(F.col("r") / 2).cast("int")
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(r)).cast("int"))
    low, high = F.when(F.col("side") == 0, half).otherwise(0), F.when(F.col("side") == 0, r).otherwise(half)
    cut = possible.join(texts, ["k1", "k2"]).select("k1", "k2", "n", "first", "s", "r", F.explode(F.sequence(low, high - 1, size)).alias("a"), high.alias("top"), size.alias("size"))
    cut = cut.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("top")))
    keyed = cut.select(
        "k1", "k2", "n", "r", "first",
        F.xxhash64("r", "a", F.substring("s", F.lit(1), F.col("a")), F.lit("|"), _right(F.col("s"), F.col("r") - F.col("b"))).alias("block"),
        F.substring("s", F.col("a") + 1, F.col("n") - F.col("a") - (F.col("r") - F.col("b"))).alias("mid"),
    )
    keyed = keep(keyed, "blocks")
    keyed = semi_join(keyed, _shared(keyed, "block"), ["block"])

    # Variants: without place i for lines of length r, so equal ones differ in that place alone; without any one place for longer
    # lines, to meet the line of length r that is what remains.
    def without_place(i: Column) -> Column:
        return F.concat(F.substring("mid", F.lit(1), i), F.lit("\x00"), F.substring("mid", i + 2, F.length("mid")))

    def less(i: Column) -> Column:
        return F.concat(F.substring("mid", F.lit(1), i), F.substring("mid", i + 2, F.length("mid")))

    def variant(same: bool, base: bool, *what: Column) -> Column:
        return F.struct(*_two("v", F.col("block"), *what), F.lit(base).alias("base"), F.lit(same).alias("same"))

    places = F.sequence(F.lit(0), F.greatest(F.length("mid") - 1, F.lit(0)))
    short = F.col("n") == F.col("r")
    variants = F.when(
        short,
        F.concat(
            F.transform(places, lambda i: variant(True, False, F.lit(1), i, without_place(i))),
            F.array(variant(False, True, F.lit(2), F.col("mid"))),
        ),
    ).otherwise(F.array_distinct(F.transform(places, lambda i: variant(False, False, F.lit(2), less(i)))))
    emitted = keyed.select(F.struct("first", "k1", "k2").alias("me"), F.explode(variants).alias("v")).select("me", "v.*")
    least = emitted.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("same"), F.col("me"))).alias("best"),
        F.min(F.when(F.col("base"), F.col("me"))).alias("short"),
        F.min(F.when(~F.col("base") & ~F.col("same"), F.col("me"))).alias("long"),
        F.count("*").alias("n"),
    )
    met = emitted.join(least.where("n > 1"), ["v1", "v2"])
    earlier = F.when(F.col("same"), F.col("best")).when(F.col("base"), F.col("long")).otherwise(F.col("short"))
    links = met.select("me", earlier.alias("to")).where("to.first < me.first").groupBy("me").agg(F.min("to").alias("to"))
    links = links.select(F.col("me.k1").alias("k1"), F.col("me.k2").alias("k2"), F.col("to.k1").alias("t1"), F.col("to.k2").alias("t2"))
    pair = links.join(texts, ["k1", "k2"]).join(texts.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("s").alias("other")), ["t1", "t2"])
    return pair.where(F.levenshtein("s", "other", 1).between(0, 1)).select("k1", "k2")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text's duplicate lines removed, n_lines, n_removed, and n_near: those removed whose kind of line went for a neighbour."""
    base = without(docs, *ADDED)
    lines = keep(lines_of(base, id, text), "lines")
    place = F.struct("id", "r1", "r2", "line")
    classes = keep(lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("n", "h1", "h2", "h3", "h4")]), "classes")
    near = keep(near_lines(base, classes, id, text), "near").withColumn("near", F.lit(True))
    repeated = keep(classes.select("k1", "k2", "first", "copies").join(near, ["k1", "k2"], "left").where("copies > 1 OR near"), "repeated")
    met = join_skewed(lines.select("r1", "r2", "line", "k1", "k2", place.alias("here")), repeated, ["k1", "k2"], "copies")
    removed = met.where("near OR here <> first").groupBy("r1", "r2").agg(F.array_sort(F.collect_set("line")).alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("near"))
    rows = base.select(F.struct("*").alias("row"), *_two("r", F.col(id), F.col(text)))
    joined = rows.join(removed, ["r1", "r2"], "left").select("row.*", F.struct("gone", "near").alias("~line"))
    parts = F.split(text, "\n")
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("`~line`.gone")).alias("a"), F.concat(F.col("`~line`.gone"), F.array(F.size(parts))).alias("b"))
    kept = F.flatten(F.transform(edges, lambda e: F.slice(parts, e["a"] + 2, e["b"] - e["a"] - 1)))
    return joined.select(
        *[(F.when(F.col("`~line`.gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"`{c}`")) for c in base.columns],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("`~line`.gone").isNull(), F.lit(0)).otherwise(F.size("`~line`.gone")).cast("long").alias("n_removed"),
        F.coalesce("`~line`.near", F.lit(0)).cast("long").alias("n_near"),
    )


#: The same over plain pairs: lines with an equal half are compared code point by code point.
SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
lines AS (
  SELECT doc_id, line, raw, trim(regexp_replace(lower(raw), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS s FROM split),
kinds AS (
  SELECT s, length(s) AS n, min(doc_id * 1000000 + line) AS first FROM lines WHERE s <> '' GROUP BY s),
long AS (SELECT * FROM kinds WHERE n >= {MIN_CHARS}),
close AS (
  SELECT a.s AS a, b.s AS b, a.n AS n, b.n AS m, a.first AS fa, b.first AS fb FROM long a JOIN long b
    ON a.n = b.n AND left(a.s, a.n // 2) = left(b.s, b.n // 2) AND a.s <> b.s
  UNION SELECT a.s, b.s, a.n, b.n, a.first, b.first FROM long a JOIN long b
    ON a.n = b.n AND right(a.s, a.n - a.n // 2) = right(b.s, b.n - b.n // 2) AND a.s <> b.s
  UNION SELECT a.s, b.s, a.n, b.n, a.first, b.first FROM long a JOIN long b
    ON a.n + 1 = b.n AND left(a.s, a.n // 2) = left(b.s, (b.n - 1) // 2)
  UNION SELECT a.s, b.s, a.n, b.n, a.first, b.first FROM long a JOIN long b
    ON a.n + 1 = b.n AND right(a.s, a.n - a.n // 2) = right(b.s, b.n - 1 - (b.n - 1) // 2)),
links AS (
  SELECT * FROM close WHERE
    (n = m AND len(list_filter(range(1, n + 1), lambda i: a[i:i] <> b[i:i])) <= 1)
    OR (n < m AND len(list_filter(range(1, m + 1), lambda i: left(b, i - 1) || substr(b, i + 1) = a)) > 0)),
near AS (SELECT b AS s FROM links WHERE fa < fb UNION SELECT a FROM links WHERE fb < fa),
marked AS (
  SELECT l.doc_id, l.line, l.raw, n.s IS NOT NULL AS near, k.s IS NOT NULL AND (n.s IS NOT NULL OR l.doc_id * 1000000 + l.line <> k.first) AS gone
  FROM lines l LEFT JOIN kinds k ON l.s = k.s LEFT JOIN near n ON l.s = n.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (near) AS n_near,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
