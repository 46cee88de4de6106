"""Merkle manifest of a table: a digest for each row, for each group and for all of it, with each row's proof.

Leaves. A row's leaf is the SHA-256 (lower-case hexadecimal) of its fields, one after the other: `-` for null, else the number of UTF-8
bytes, a colon and the value (integers in decimal). Digests enter further digests as their hexadecimal text.

Tree. A group's leaves ascend by id. While a group has more than one node, each run of eight neighbours (the last run may be shorter, even a
single node) becomes one node, their digest. The last one is the group's subroot. Subroots, in the order of their groups (null first, then
by bytes), are reduced likewise to the root.

Method. A leaf's place in its group comes from a prefix scan (`operators.scan`), so no task holds a group. A level is one window over
(group, parent): collect_list over the full frame gives a run's digests to each of its nodes, from which come the parent's digest and the
node's siblings; parents are then deduplicated and are the next level. A partition of the window never holds more than eight rows. The
paths come down again by one join of each level with the one above it, on (group, node), which is unique there. The number of levels
grows with the logarithm of the largest group. Every level is a table in the shared folder.

Null ids are first; rows with equal ids follow by their digests, and rows that are equal in all fields are leaves of their own, in any
order (they have the same digest). Null fields, empty and very long texts are digested as any other, whole. A null group is a group of
its own. An empty table gives an empty result. Columns named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.common import keep, without
from bidloom.operators import scan

#: Nodes of a run.
WIDTH = 8


def field(c: str | Column) -> Column:
    """A field as it enters a leaf: its length in bytes and its text, so that no two rows give the same bytes."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(fields: list[str | Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _reduce(nodes: DataFrame) -> list[DataFrame]:
    """The levels from nodes (g, node, n: nodes of the group at this level, h, others) up. Each level has also `before` and `after`: the digests
    of a node's siblings to either side of it, in one text each; null at a group's last node. Other columns stay at the lowest level."""
    levels, most = [], None
    while True:
        run = Window.partitionBy("g", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = nodes.withColumn("parent", F.floor(F.col("node") / WIDTH).cast("long"))
        rows = rows.withColumn("run", F.collect_list("h").over(run))
        at = (F.col("node") % WIDTH).cast("int")
        many = F.col("n") > 1
        rows = rows.withColumns(
            {
                "before": F.when(many, F.array_join(F.slice("run", F.lit(1), at), "")),
                "after": F.when(many, F.array_join(F.slice("run", at + 2, F.lit(WIDTH)), "")),
                "up": F.when(many, F.sha2(F.array_join("run", ""), 256)),
            }
        ).drop("run")
        rows = keep(rows, "level")
        levels.append(rows)
        most = (rows.agg(F.max("n")).first()[0] or 0) if most is None else most
        if most <= 1:
            return levels
        most = -(-most // WIDTH)
        nodes = rows.where("n > 1").dropDuplicates(["g", "parent"]).select("g", F.col("parent").alias("node"), F.ceil(F.col("n") / WIDTH).cast("long").alias("n"), F.col("up").alias("h"))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the lowest level (with their other columns) with `path`, their siblings from there to the root, and what `tops` (g, path, ...) has
    of their group's last node. They meet the level above by (group, parent), so the path of each is made after the shuffle."""
    extra = [c for c in tops.columns if c not in ("g", "path")]
    own = [c for c in levels[0].columns if c not in ("g", "node", "n", "before", "after", "up", "parent")]
    down = None
    for k in reversed(range(len(levels))):
        rows = levels[k]
        kept = ["g", "node", *([] if k else own)]
        lone = rows.where("n <= 1").select(*kept).join(tops, "g").select(*kept, "path", *extra)
        if down is not None:
            step = F.array(F.struct("before", "after"))
            above = down.withColumnsRenamed({"node": "parent", "path": "rest"})
            lone = rows.where("n > 1").join(above, ["g", "parent"]).select(*kept, F.concat(step, "rest").alias("path"), *extra).unionByName(lone)
        down = keep(lone, "paths") if k else lone
    return down


def proof(path: Column) -> Column:
    """The siblings of a path in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(rows: DataFrame, id: str, group: str, fields: list[str | Column], carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row its id, `leaf`, `subroot`, `root` and `path` (array of before and after: siblings' digests to either side, level by
    level), and the expressions of `carry`, which are taken where the row is read, so that texts don't travel."""
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    none = "array<struct<before:string,after:string>>"
    leaves = rows.select(F.col(id), key.alias("g"), leaf(fields).alias("h"), *[c.alias(f"_c{k}") for k, c in enumerate(carry.values())])
    levels = _reduce(scan.number(leaves.withColumnRenamed(id, "_id"), ["g"], ["_id", "h"], name="node", size="n"))
    subroots = None
    for level in levels:
        top = level.where("n = 1").select(F.col("g").alias("own"), "h")
        subroots = top if subroots is None else subroots.unionByName(top)
    subroots = keep(scan.number(subroots.withColumn("g", F.lit("")), ["g"], ["own"], name="node", size="n"), "subroots")
    upper = _reduce(subroots)
    root = upper[-1].where("n = 1").select("g", F.array().cast(none).alias("path"), F.col("h").alias("root"))
    tops = _paths(upper, root).select(F.col("own").alias("g"), "path", "root", F.col("h").alias("subroot"))
    done = _paths(levels, keep(tops, "tops"))
    return done.select(F.col("_id").alias(id), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)])


def verify(rows: DataFrame, id: str, group: str, fields: list[str | Column], seen: list[str | Column]) -> DataFrame:
    """Each row's leaf, subroot, root and `proof_sha256`, and whether the row as it is `seen` now (its fields, perhaps altered since) still
    gives the root: `folded_root` from the digest of what is seen and the siblings of the manifest, `verified` if it is the root."""
    done = manifest(without(rows, "leaf", "subroot", "root", "path", "_seen"), id, group, fields, {"_seen": leaf(seen)})
    done = done.withColumns({"proof_sha256": F.sha2(proof(F.col("path")), 256), "folded_root": fold(F.col("_seen"), F.col("path"))})
    return done.select(F.col(f"`{id}`"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows by recursion over levels, in DuckDB's SQL.
CRC32 = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))"
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql() -> str:
    def digest(text: str) -> str:
        return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = f"xor({CRC32.format('CAST(doc_id AS VARCHAR)')}, CAST(4294967295 AS BIGINT))"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(_LOWER)} ELSE {digest('text')} END AS seen FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves),
    low AS (SELECT g, 0 AS level, node, n, leaf AS h FROM placed UNION ALL
      SELECT g, level + 1, node // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY node)) FROM low WHERE n > 1 GROUP BY g, level, node // 8, n),
    subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS node, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (SELECT 0 AS level, node, n, h FROM subroots UNION ALL
      SELECT level + 1, node // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY node)) FROM high WHERE n > 1 GROUP BY level, node // 8, n),
    root AS (SELECT h FROM high WHERE n = 1),
    runs AS (SELECT g, level, node // 8 AS run, list(h ORDER BY node) AS hs FROM low WHERE n > 1 GROUP BY ALL UNION ALL SELECT NULL, level, node // 8, list(h ORDER BY node) FROM high WHERE n > 1 GROUP BY ALL),
    walk AS (SELECT p.doc_id, p.g, p.leaf, s.h AS subroot, p.node AS first, s.node AS top, false AS upper, 0 AS level, p.node, p.n, s.n AS groups, p.seen AS folded, '' AS proof FROM placed p JOIN subroots s USING (g) UNION ALL
      SELECT w.doc_id, w.g, w.leaf, w.subroot, w.first, w.top, w.upper OR w.n = 1, CASE WHEN w.n = 1 AND NOT w.upper THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 AND NOT w.upper THEN w.top ELSE w.node // 8 END,
        CASE WHEN w.n = 1 AND NOT w.upper THEN w.groups ELSE (w.n + 7) // 8 END, w.groups,
        CASE WHEN w.n = 1 THEN w.folded ELSE sha256(array_to_string(r.hs[:w.node % 8], '') || w.folded || array_to_string(r.hs[w.node % 8 + 2:], '')) END,
        CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || array_to_string(r.hs[:w.node % 8], '') || array_to_string(r.hs[w.node % 8 + 2:], '') END
      FROM walk w LEFT JOIN runs r ON w.n > 1 AND r.g IS NOT DISTINCT FROM CASE WHEN w.upper THEN NULL ELSE w.g END AND r.level = w.level AND r.run = w.node // 8 WHERE NOT (w.upper AND w.n = 1))
    SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified FROM walk, root WHERE upper AND n = 1"""


SQL = _sql()
