"""Clustering with a provider that sees a window at a time: assign to the clusters so far, form new ones, carry the rest.

A bid's items are sorted by name and cut into chunks of `size`. Chunk by chunk, what was carried so far and the chunk's items are asked about
in windows of `size` at most: first which of them belong to the bid's clusters so far (a call for each page of `size` clusters), then
which of the others form new clusters; the rest is carried to the next chunk. So equal things that stand far apart by name meet in a
window or in a cluster. Each window of a bid depends on those before it, so a bid's windows are asked one after the other by one task, which
reads its rows in order; bids run side by side. The task holds a chunk, what is carried, and of each cluster its name and eight members' names; members
go out as they are found. What is carried is asked about again with each chunk, so calls, not memory, bound how much of it there can be. A window,
a page and a call are never larger than `size`. A round is a window of its bid, counted from 1.

A form call that still fails after its retries fails its bid, which then has no clusters and whose items are all left; an assign call that
fails assigns nothing. Answers are JSON, in fences or not. Ids that don't exist are ignored; a cluster needs two items and two vendors.
Null names count as empty. An empty table gives empty results. Items of equal names follow by id. A null bid is no bid.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.operators import scan
from bidloom.session import ship
from bidloom.stages import keep

SIZE = 90
RETRIES = 2
_WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _strip(text: str) -> str:
    return re.sub(f"\\A{_WHITE}|{_WHITE}\\Z", "", text)


def _field(name: str, value) -> str:
    return f" | {name}={'' if value is None else value}"


def _vendors(rows: list) -> list:
    return list(dict.fromkeys(r["vendor_id"] for r in rows))


def _by_vendor(rows: list, line: Callable) -> str:
    """Blocks of lines for each vendor, as first seen."""
    return "\n".join(f"### {v}\n" + "\n".join(line(r) for r in rows if r["vendor_id"] == v and r["item_id"] is not None) + "\n" for v in _vendors(rows) if v is not None)


# Headings and field names of the texts that a provider is shown.
def _form_text(rows: list) -> str:
    def line(r) -> str:
        return f"  - id={r['item_id']}{_field('품목명', r['name'])}{_field('카테고리', r['category'])}{_field('단위', r['unit'])}{_field('단가', r['unit_price'])}{_field('규격', (r['spec'] or '')[:60])}"

    named = sorted((r for r in rows if r["name"] != "" and r["item_id"] is not None and r["vendor_id"] is not None), key=lambda r: (r["name"].lower(), r["item_id"], r["name"]))
    again = "\n".join(f"  - {r['name']}  [{r['vendor_id']}] (id={r['item_id']})" for r in named)
    return f"## 신규 입찰 품목 ({len(rows)}개 / {len(_vendors(rows))}개 업체)\n\n{_by_vendor(rows, line)}\n## 전체 품목\n{again}\n"


def form_text(rows: Column) -> Column:
    """Items by vendor, and all of them once more by name. rows: at most a window of structs."""
    ship(SparkSession.active())
    return F.udf(lambda window: _form_text(window), "string")(rows)


def _assign_text(clusters: list, rows: list) -> str:
    """A page of clusters with up to eight members' names, and a window of items by vendor."""
    known = "\n".join(f"  - cluster_id={c['cluster_id']}{_field('대표명', c['name'])} | 멤버: {' | '.join(c['names'])}" for c in clusters)
    items = _by_vendor(rows, lambda r: f"  - id={r['item_id']}{_field('품목명', r['name'])}{_field('카테고리', r['category'])}")
    return f"## 기존 클러스터 ({len(clusters)}개)\n{known}\n\n## 미분류 품목 ({len(rows)}개)\n{items}"


def _ask(provider: Callable[[str, str], str], task: str, text: str) -> dict | None:
    """A provider's answer as a document; none if it fails after all retries or gives no document."""
    for _ in range(RETRIES + 1):
        try:
            answer = provider(task, text)
            break
        except Exception:  # a provider may fail in any way
            answer = None
    if answer is None:
        return None
    answer = re.sub(r"\s*```\Z", "", re.sub(r"\A```[a-zA-Z]*\s*", "", _strip(answer)))
    try:
        doc = json.JSONDecoder().raw_decode(answer)[0]
    except ValueError:
        return None
    return doc if isinstance(doc, dict) else None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _objects(doc: dict | None, name: str) -> list[tuple[int, dict]] | None:
    """The objects of a list, with their places in it; none if there is no list."""
    found = (doc or {}).get(name)
    return [(k, x) for k, x in enumerate(found) if isinstance(x, dict)] if isinstance(found, list) else None


def _hangul(text: str) -> bool:
    return re.search("[가-힣]", text) is not None


def _representative(given: str, rows: list) -> str:
    """The given name if it is in Hangul, else the shortest of the members' and it, those in Hangul first."""
    given = given or rows[0]["name"]
    return given if _hangul(given) else min([(not _hangul(r["name"]), len(r["name"]), k, r["name"]) for k, r in enumerate(rows)] + [(True, len(given), len(rows), given)])[3]


class _Bid:
    """One bid's clusters and what it carries."""

    def __init__(self, head: str, provider: Callable[[str, str], str], size: int):
        self.head, self.provider, self.size = head, provider, size
        self.clusters, self.carry, self.turn, self.failed = {}, [], 0, False

    def chunk(self, fresh: list) -> Iterator[dict]:
        both, self.carry = self.carry + fresh, []
        for k in range(0, len(both), self.size):
            yield from self._window(both[k : k + self.size])
            if self.failed:
                self.carry = []
                return

    def _member(self, c: dict, item: str) -> dict:
        first = item == c["item_id"]
        return {"kind": "member", "cluster_id": c["cluster_id"], "item_id": item, "role": "representative" if first else "duplicate", "score": 1.0 if first else c["score"], "round": self.turn}

    def _window(self, pool: list) -> Iterator[dict]:
        self.turn += 1
        known, said = list(self.clusters.values()), set()
        for k in range(0, len(known), self.size):
            doc = _ask(self.provider, "assign", _assign_text(known[k : k + self.size], pool))
            said |= {(_text(x.get("item_id")), _text(x.get("cluster_id"))) for _, x in _objects(doc, "additions") or []}
        to: dict[str, list[dict]] = {}
        for item, cluster in sorted((i, c) for i, c in said if i is not None and c in self.clusters):
            to.setdefault(item, []).append(self.clusters[cluster])
        for r in pool:
            for c in to.get(r["item_id"], []):
                c["names"] += [r["name"]] * (len(c["names"]) < 8)
                yield self._member(c, r["item_id"])
        rest = [r for r in pool if r["item_id"] not in to]
        taken = set()
        if len(rest) >= 2:
            found = _objects(_ask(self.provider, "form", _form_text(rest)), "clusters")
            if found is None:
                self.failed = True
                return
            own = {r["item_id"]: r for r in rest if r["item_id"] is not None}
            for k, x in found:
                ids = x.get("all_item_ids")
                rows = [own[i] for i in dict.fromkeys(map(_text, ids if isinstance(ids, list) else [])) if i in own]
                if len(rows) < 2 or len({r["vendor_id"] for r in rows} - {None}) < 2:
                    continue
                score = x.get("similarity_score")
                score = float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else 0.8
                name = _representative(_strip(_text(x.get("representative_name")) or ""), rows)
                c = {"cluster_id": f"{self.head}:{self.turn}:{k}", "name": name, "item_id": rows[0]["item_id"], "score": score, "names": [r["name"] for r in rows[:8]]}
                self.clusters[c["cluster_id"]] = c
                taken |= {r["item_id"] for r in rows}
                yield {"kind": "cluster", "cluster_id": c["cluster_id"], "name": name, "item_id": c["item_id"], "score": score, "summary": _text(x.get("similarity_summary")) or "", "round": self.turn}
                yield from (self._member(c, r["item_id"]) for r in rows)
        self.carry += [r for r in rest if r["item_id"] not in taken]


_ADDED = [("kind", "string"), ("cluster_id", "string"), ("name", "string"), ("item_id", "string"), ("role", "string"), ("score", "double"), ("summary", "string"), ("round", "int")]


def _run(batches: Iterator[pa.RecordBatch], by: list[str], provider: Callable[[str, str], str], size: int) -> Iterator[pa.RecordBatch]:
    """batches: rows in order of bid and place."""
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    bid, key, fresh, out, schema = None, None, [], [], None

    def finish() -> Iterator[dict]:
        if bid is not None:
            if not bid.failed:
                yield from bid.chunk(fresh) if fresh else ()
            yield from [{"kind": "failed"}] if bid.failed else ({"kind": "left", "item_id": r["item_id"]} for r in bid.carry)

    for batch in batches:
        schema = schema or pa.schema([*(pa.field(c, batch.schema.field(c).type) for c in by), *(pa.field(n, kinds[t]) for n, t in _ADDED)])
        for r in batch.to_pylist():
            now = tuple(r[c] for c in by)
            if now != key:
                out += [dict(zip(by, key, strict=True)) | x for x in finish()] if bid else []
                bid, key, fresh = _Bid(r["head"], provider, size), now, []
            if bid.failed:
                continue
            fresh.append(r)
            if len(fresh) == size:
                out += [dict(zip(by, key, strict=True)) | x for x in bid.chunk(fresh)]
                fresh = []
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    out += [dict(zip(by, key, strict=True)) | x for x in finish()] if bid else []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _listed(pool: DataFrame, by: list[str]) -> DataFrame:
    row = F.struct("place", "item_id", "vendor_id", "name", "category", "unit", "unit_price", "spec")
    return pool.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def cluster_in_rounds(items: DataFrame, by: list[str], provider: Callable[[str, str], str], size: int = SIZE, run: str = "") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, members, left, failed) of the items of each `by`.

    items: by, item_id (string), vendor_id, name, and category, unit, unit_price, spec if they have them. provider(task, text) answers
    `assign` and `form` texts. run is part of the clusters' ids, so that those of several runs differ. Clusters: by, cluster_id, name,
    representative_item_id, score, summary, round; members: cluster_id, item_id, role, similarity_score, round; left: by, item_id;
    failed: by.
    """
    spark = items.sparkSession
    types = dict(items.dtypes)
    for c in ("category", "unit", "unit_price", "spec"):
        if c not in types:
            items = items.withColumn(c, F.lit(None).cast("string"))
    ship(spark)
    rows = items.dropna(subset=by).select(*by, F.col("item_id").cast("string").alias("item_id"), F.col("vendor_id").cast("string").alias("vendor_id"), F.coalesce("name", F.lit("")).alias("name"), *[F.col(c).cast("string").alias(c) for c in ("category", "unit", "unit_price", "spec")])
    rows = scan.number(rows.withColumn("_folded", F.lower("name")), by, ["_folded", "item_id"], name="place").drop("_folded")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    head = F.concat_ws(":", *([F.lit(run)] if run else []), *[F.col(c).cast("string") for c in by])
    schema = T.StructType([*(rows.schema[c] for c in by), *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in _ADDED)).fields])
    done = rows.withColumn("head", head).repartition(parts, *by).sortWithinPartitions(*by, "place").mapInArrow(lambda b: _run(b, by, provider, size), schema)
    done = keep(done, "rounds")
    failed = done.where("kind = 'failed'").select(*by)
    held = done.join(failed, by, "left_anti")
    clusters = held.where("kind = 'cluster'").select(*by, "cluster_id", "name", F.col("item_id").alias("representative_item_id"), "score", "summary", "round")
    members = held.where("kind = 'member'").select("cluster_id", "item_id", "role", F.col("score").alias("similarity_score"), "round").dropDuplicates(["cluster_id", "item_id"])
    lost = items.join(failed, by, "left_semi").select(*by, F.col("item_id").cast("string").alias("item_id"))
    return clusters, members, held.where("kind = 'left'").select(*by, "item_id").unionByName(lost), failed
