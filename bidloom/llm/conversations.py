"""Conversation structure repair: the cheapest edits that bring a conversation's turns into its grammar.

Grammar. The initials of a conversation's roles are `(s?(ua)+)?`: nothing, or a system turn at most and then user and assistant in turn.

Faults. Of each row the first that holds counts: blank (no character but white space: space and 0x09 to 0x0D), duplicate (role and text seen
earlier in the conversation), truncated (the last character that isn't white space is none of `.!?`).

Edits. Keep costs 0, Rerole (to user or assistant, whichever the grammar expects) 2, Delete 3, Insert (an empty user or assistant turn,
anywhere) 2. Blank and duplicate rows must be deleted; a truncated row that stays adds 1. The audit is the initials of the cheapest edits in
order; of equally cheap ones, the least in ASCII. Two inserts never stand together in it: what they reach is reached more cheaply
without them, or by deleting the system turn before them. So the search allows one before each row and one at the end.

Method. Places in a conversation come from a prefix scan. Rows are dealt by hash of (conversation, block of `BLOCK` places), so a
conversation that holds much of the table lies in many tasks. Within each batch of whole blocks a recursive DuckDB query advances one turn
for all blocks at once and keeps, for each state of the grammar that a block may begin in and each that it may end in, the least cost and
audit. A second recursion advances one block of all conversations of a batch at a time; what is unfinished at a batch's end is carried to
the next one, so a task holds four audits of a conversation beside its batch. The repaired texts run through SHA-256 in order, row by row;
that digest is sequential, so one task reads (but doesn't hold) all rows of a conversation.

Nulls in conversation, turn, role and text: a null conversation is one of its own; null turns come first; null roles and texts count as one
space. Rows of one turn come in order of role (by bytes), then of the text's SHA-256; equal rows are duplicates of each other. Very long
texts are taken whole. An empty table gives an empty result; a conversation that has no rows left gives zeros, an empty audit and the
digest of nothing. Other columns are ignored, and a clash with names of the results is harmless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import keep
from bidloom.operators import scan
from bidloom.session import ship

#: Places of a block, and rows (times states to begin in) of a batch.
BLOCK = 256
BATCH = 40_000
BLANKS = " \t\n\x0b\x0c\r"
#: State 0: nothing yet, 1: after system, 2: after user, 3: after assistant. What follows each by initial.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
INSERT = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = {0: (0, ""), 2: (2, "I"), 3: (0, "")}


def _moves() -> pa.Table:
    """What one row allows in each state: its kind is `d` (must go) or its role's initial (others: x) and t if it is truncated."""
    rows = []
    for state in NEXT:
        for at, cost, letters in ((state, 0, ""), (INSERT[state], 2, "I")):
            rows.append((state, "d", at, cost + 3, letters + "D"))
            for initial in "suax":
                for cut in (0, 1):
                    kind = initial + "t" * cut
                    rows.append((state, kind, at, cost + 3, letters + "D"))
                    rows.append((state, kind, INSERT[at], cost + 2 + cut, letters + "R"))
                    if initial in NEXT[at]:
                        rows.append((state, kind, NEXT[at][initial], cost + cut, letters + "K"))
    return pa.table(dict(zip(("state", "kind", "became", "cost", "letters"), map(pa.array, zip(*rows, strict=True)), strict=True)))


ADVANCE = """WITH RECURSIVE walk AS (
    SELECT unit, 0 AS i, start, start AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM starts
    UNION ALL
    SELECT w.unit, w.i + 1, w.start, m.became, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters})
    FROM walk w JOIN turns t ON t.unit = w.unit AND t.i = w.i JOIN moves m ON m.state = w.state AND m.kind = t.kind GROUP BY w.unit, w.i, w.start, m.became
  ) SELECT w.unit, w.start, w.state, w.best.cost AS cost, w.best.audit AS audit FROM walk w JOIN sizes s ON s.unit = w.unit AND s.n = w.i ORDER BY 1, 2, 3"""

CHAIN = """WITH RECURSIVE walk AS (
    SELECT unit, 0 AS i, state, {'cost': cost, 'audit': audit} AS best FROM begun
    UNION ALL
    SELECT w.unit, w.i + 1, b.state, min({'cost': w.best.cost + b.cost, 'audit': w.best.audit || b.audit})
    FROM walk w JOIN links b ON b.unit = w.unit AND b.i = w.i AND b.start = w.state GROUP BY w.unit, w.i, b.state
  ) SELECT w.unit, w.state, w.best.cost AS cost, w.best.audit AS audit FROM walk w JOIN sizes s ON s.unit = w.unit AND s.n = w.i ORDER BY 1, 2"""


def _connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '600MB'; SET temp_directory = ''")
    return con


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[list[tuple[tuple, list[dict]]]]:
    """Lists of (key, rows) of about `most` rows. Rows come sorted by key; a key's rows stay together."""
    ready, n, key, rows = [], 0, None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = tuple(r[c] for c in keys)
            if k != key:
                if rows:
                    ready.append((key, rows))
                if n >= most:
                    yield ready
                    ready, n = [], 0
                key, rows = k, []
            rows.append(r)
            n += 1
    if rows:
        ready.append((key, rows))
    if ready:
        yield ready


def _table(con, name: str, columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> None:
    data = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
    con.register(name, pa.table({c: pa.array(v, t) for (c, t), v in zip(columns, data, strict=True)}))


INT, LONG, STR = pa.int32(), pa.int64(), pa.string()
_BLOCKS = "g string, block long, start int, state int, cost long, audit string"


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    con.register("moves", _moves())
    for units in _whole(batches, ["g", "block"], BATCH // 4):
        _table(con, "turns", [("unit", INT), ("i", INT), ("kind", STR)], [(u, i, r["kind"]) for u, (_, rows) in enumerate(units) for i, r in enumerate(rows)])
        _table(con, "sizes", [("unit", INT), ("n", INT)], [(u, len(rows)) for u, (_, rows) in enumerate(units)])
        _table(con, "starts", [("unit", INT), ("start", INT)], [(u, s) for u, ((_, block), _) in enumerate(units) for s in (NEXT if block else (0,))])
        found = con.execute(ADVANCE).fetchall()
        keys = [k for k, _ in units]
        yield pa.RecordBatch.from_pydict(
            {"g": pa.array([keys[x[0]][0] for x in found], STR), "block": pa.array([keys[x[0]][1] for x in found], LONG)}
            | {c: pa.array([x[k] for x in found], t) for k, (c, t) in enumerate((("start", INT), ("state", INT), ("cost", LONG), ("audit", STR)), 1)}
        )


_AUDITS = "g string, cost long, audit string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    open_, states = None, [(0, 0, "")]

    def ended(done: list[tuple[str, list[tuple]]]) -> pa.RecordBatch:
        best = [(g, min((cost + ENDS[s][0], audit + ENDS[s][1]) for s, cost, audit in x if s in ENDS)) for g, x in done]
        return pa.RecordBatch.from_pydict({"g": pa.array([g for g, _ in best], STR), "cost": pa.array([b[0] for _, b in best], LONG), "audit": pa.array([b[1] for _, b in best], STR)})

    for units in _whole(batches, ["g", "block"], BATCH // 4):
        by: dict[str, list[list[dict]]] = {}
        for (g, _), rows in units:
            by.setdefault(g, []).append(rows)
        names = list(by)
        if open_ is not None and open_ not in by:
            yield ended([(open_, states)])
        _table(con, "links", [("unit", INT), ("i", INT), ("start", INT), ("state", INT), ("cost", LONG), ("audit", STR)], [(u, i, r["start"], r["state"], r["cost"], r["audit"]) for u, g in enumerate(names) for i, rows in enumerate(by[g]) for r in rows])
        _table(con, "sizes", [("unit", INT), ("n", INT)], [(u, len(by[g])) for u, g in enumerate(names)])
        _table(con, "begun", [("unit", INT), ("state", INT), ("cost", LONG), ("audit", STR)], [(u, *s) for u, g in enumerate(names) for s in (states if g == open_ else [(0, 0, "")])])
        after: dict[int, list[tuple]] = {}
        for unit, *rest in con.execute(CHAIN).fetchall():
            after.setdefault(unit, []).append(tuple(rest))
        yield ended([(g, after[u]) for u, g in enumerate(names[:-1])])
        open_, states = names[-1], after[len(names) - 1]
    if open_ is not None:
        yield ended([(open_, states)])


_DIGESTS = "g string, repaired_sha256 string"


class _Repair:
    """The lines of one conversation, one after the other, as its audit's edits leave them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.lines, self.sha = audit, 0, "", 0, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines, self.last = self.lines + 1, role[0]

    def expected(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(self.expected(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else self.expected(), text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's row with its audit comes before its own rows."""
    key, now = None, None
    for batch in batches:
        done = []
        for g, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("g", "audit", "role", "text")), strict=True):
            if audit is not None:
                if now is not None:
                    done.append((key, now.digest()))
                key, now = g, _Repair(audit)
            else:
                now.row(role, text)
        yield pa.RecordBatch.from_pydict({"g": pa.array([x[0] for x in done], STR), "repaired_sha256": pa.array([x[1] for x in done], STR)})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"g": pa.array([key], STR), "repaired_sha256": pa.array([now.digest()], STR)})


def damage(rows: DataFrame) -> DataFrame:
    """conversations with the faults that crc32 of `conv_id:turn` deals out: drop, empty, no sentence ends, repeat, role user."""
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    kept = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), part.alias("k")).where("k <> 0")
    kept = kept.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("_copy"))
    return kept.drop("_copy")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text) its gaps, faults, cost, audit and the digest of its repaired turns; for those of
    `conversations` (conv_id) that have no rows, zeros."""
    ship(rows.sparkSession)
    key = F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0"))
    plain = rows.select(key.alias("g"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    plain = plain.withColumn("digest", F.sha2("text", 256))
    turns = keep(scan.number(plain, ["g"], ["turn", "role", "digest"], name="pos"), "turns")
    firsts = turns.groupBy("g", "role", "digest").agg(F.min("pos").alias("pos")).select("g", "pos", F.lit(True).alias("is_first"))
    ended = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    states = turns.select("g", "pos", "turn", initial.alias("initial"), (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut"))
    states = states.join(firsts, ["g", "pos"], "left").join(states.select("g", (F.col("pos") + 1).alias("pos"), F.col("turn").alias("before"), F.col("initial").alias("other")), ["g", "pos"], "left")
    again = F.col("is_first").isNull() & ~F.col("blank")
    cut = F.col("cut") & ~F.col("blank") & ~again
    kind = F.when(F.col("blank") | again, "d").otherwise(F.concat(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x"), F.when(cut, "t").otherwise("")))
    pair = F.concat("other", "initial")
    states = keep(states.select("g", "pos", "turn", "before", "blank", again.alias("duplicate"), cut.alias("truncated"), kind.alias("kind"), (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal")), "states")

    gaps = F.max("turn") - F.min("turn") + 1 - F.count_if(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before")))
    totals = states.groupBy("g").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])

    keys = ["g", "block"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    dealt = states.select("g", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "pos", "kind").repartition(tasks, *keys).sortWithinPartitions(*keys, "pos")
    blocks = dealt.mapInArrow(_advance, _BLOCKS)
    audits = keep(blocks.repartition("g").sortWithinPartitions(*keys, "start").mapInArrow(_chain, _AUDITS), "audits")

    none = F.lit(None).cast("string")
    lines = turns.select("g", "pos", none.alias("audit"), "role", "text").unionByName(audits.select("g", F.lit(-1).cast("long").alias("pos"), "audit", none.alias("role"), none.alias("text")))
    digests = lines.repartition("g").sortWithinPartitions("g", "pos").mapInArrow(_digest, _DIGESTS)

    owners = (rows if conversations is None else conversations).select("conv_id", key.alias("g")).distinct()
    done = owners.join(totals, "g", "left").join(audits, "g", "left").join(digests, "g", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    from bidloom.llm.merkle import CRC32

    moves = ", ".join(str(tuple(r.values())) for r in _moves().to_pylist())
    crc = f"xor({CRC32.format('tag')}, CAST(4294967295 AS BIGINT))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE moves(state, kind, became, cost, letters) AS (VALUES {moves}),
    tagged AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS tag FROM conversations),
    marked AS (SELECT conv_id, turn, role, text, {crc} % 20 AS k FROM tagged),
    damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE k <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, {blanks}) AS ended FROM damaged),
    faults AS (SELECT *, left(role, 1) AS initial, ended = '' AS blank, ended <> '' AND seen > 1 AS duplicate, ended <> '' AND seen = 1 AND right(ended, 1) NOT IN ('.', '!', '?') AS truncated FROM placed),
    turns AS (SELECT *, CASE WHEN blank OR duplicate THEN 'd' ELSE CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END || CASE WHEN truncated THEN 't' ELSE '' END END AS kind,
      coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
    totals AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id),
    walk AS (SELECT conv_id, 0 AS i, 0 AS state, {{'cost': 0, 'audit': ''}} AS best FROM totals UNION ALL
      SELECT w.conv_id, w.i + 1, m.became, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters}}) FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN moves m ON m.state = w.state AND m.kind = t.kind GROUP BY w.conv_id, w.i, m.became),
    audits AS (SELECT w.conv_id, min({{'cost': w.best.cost + CASE WHEN state = 2 THEN 2 ELSE 0 END, 'audit': w.best.audit || CASE WHEN state = 2 THEN 'I' ELSE '' END}}) AS best FROM walk w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i WHERE state <> 1 GROUP BY w.conv_id),
    letters AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS place FROM audits),
    edits AS (SELECT conv_id, place, substr(audit, place, 1) AS edit, place - length(replace(substr(audit, 1, place), 'I', '')) AS inserted FROM letters),
    lines AS (SELECT e.conv_id, e.place, e.edit, t.role, CASE WHEN e.edit = 'I' THEN '' ELSE t.text END AS text, CASE WHEN e.edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END AS system FROM edits e LEFT JOIN turns t ON e.edit <> 'I' AND t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.place - e.inserted WHERE e.edit <> 'D'),
    spoken AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) - sum(system) OVER (PARTITION BY conv_id ORDER BY place) AS k FROM lines),
    digests AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS digest FROM spoken GROUP BY conv_id)
    SELECT c.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
      CAST(coalesce(a.best.cost, 0) AS BIGINT) AS cost, coalesce(a.best.audit, '') AS audit, coalesce(d.digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = _sql()
