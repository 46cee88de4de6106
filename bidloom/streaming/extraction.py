"""Extraction followed as a stream: answers of a provider arrive chunk by chunk, and each submission's state says how far it is.

Answers (submission_id, n_chunks, chunk, at, answer, error) land in a folder. For each submission the stream keeps which chunks are done, which
have failed for good, and how often each was tried, and emits events: `chunk` (an answer that is a document, once for each chunk, however
often it arrives), `retry` (a chunk that failed and is to be asked again) and `status` (each change: processing, done, failed). A submission
is done once every chunk is done or has failed for good, failed if all have, and failed if nothing arrives for `patience` of event time. What
arrives later is ignored; its state is dropped after another `patience`, so state holds the submissions of that time only.

Submissions are dealt to `BUCKETS` groups by their ids. A group has one state, that of its submissions, and is one call of Python, so a call's cost
is borne by many submissions. A group's answers of one batch are in memory at a time, whose texts are kept only if they are documents. A
checkpoint belongs to one number of groups.

The file sink commits each batch once, so a stream that is stopped and started again with its checkpoint neither loses nor repeats events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidloom.operators import extract
from bidloom.session import ship

ANSWERS = "submission_id string, n_chunks int, chunk int, at timestamp, answer string, error string"
EVENTS = "submission_id string, seq long, kind string, chunk int, attempt int, answer string, status string, n_done int, n_failed int, n_chunks int"

NAMES = [c.split()[0] for c in EVENTS.split(", ")]

#: Groups of submissions. Changing it makes checkpoints unreadable.
BUCKETS = 1024


class Progress:
    """One submission's state and the events that an answer, or time, makes of it."""

    def __init__(self, kept: str | dict | None, retries: int):
        fresh = {"n": 0, "done": [], "failed": [], "tries": {}, "status": "", "seq": 0}
        self.s, self.retries = (json.loads(kept) if isinstance(kept, str) else kept) or fresh, retries

    @property
    def final(self) -> bool:
        return self.s["status"] in ("done", "failed")

    def _event(self, kind: str, chunk: int | None = None, attempt: int | None = None, answer: str | None = None) -> tuple:
        self.s["seq"] += 1
        return self.s["seq"], kind, chunk, attempt, answer, self.s["status"], len(self.s["done"]), len(self.s["failed"]), self.s["n"]

    def answer(self, n: int, chunk: int, answer: str, is_document: bool) -> Iterator[tuple]:
        s = self.s
        s["n"] = max(s["n"], n)
        if self.final or chunk in s["done"] or not 0 <= chunk < s["n"]:
            return
        tries = s["tries"][str(chunk)] = s["tries"].get(str(chunk), 0) + 1
        if is_document:
            s["done"].append(chunk)
            s["failed"] = [c for c in s["failed"] if c != chunk]
            yield self._event("chunk", chunk, tries, answer)
        elif tries > self.retries:
            s["failed"] = sorted({*s["failed"], chunk})
        else:
            yield self._event("retry", chunk, tries)
        over = len(s["done"]) + len(s["failed"]) == s["n"]
        s["status"] = ("done" if s["done"] else "failed") if over else "processing"
        yield self._event("status")

    def expire(self) -> Iterator[tuple]:
        self.s["status"] = "failed"
        yield self._event("status")


def _advance(retries: int, patience_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each submission what its Progress keeps, and the time at which it has waited long enough
        held = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        rows, answers, heard = [], [], set()
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["at"].to_numpy("datetime64[ns]").astype("int64").tolist()
                answers += zip(frame["submission_id"].tolist(), at, frame["chunk"].tolist(), frame["n_chunks"].tolist(), frame["answer"].tolist(), frame["is_document"].tolist(), strict=True)
        # no time comes last
        answers.sort(key=lambda r: (r[0], r[1] < -(2**62), r[1], r[2]))
        for submission, own_answers in groupby(answers, key=itemgetter(0)):
            own, latest = Progress(held[submission][0] if submission in held else None, retries), now
            for _, at, chunk, n, text, good in own_answers:
                rows += [(submission, *r) for r in own.answer(int(n), int(chunk), text, bool(good))]
                latest = max(latest, at // 1_000_000)
            held[submission] = (own.s, latest + patience_ms)
            heard.add(submission)
        for submission in [s for s, (_, until) in held.items() if until < now and s not in heard]:
            own = Progress(held.pop(submission)[0], retries)
            if not own.final:
                rows += [(submission, *r) for r in own.expire()]
                held[submission] = (own.s, now + patience_ms)
        if held:
            state.update((json.dumps(held, separators=(",", ":")),))
            state.setTimeoutTimestamp(min(until for _, until in held.values()))
        else:
            state.remove()
        if rows:
            yield pd.DataFrame({c: pd.array(v, "Int32") if c in ("chunk", "attempt") else v for c, v in zip(NAMES, zip(*rows, strict=True), strict=True)})

    return run


def progress(answers: DataFrame, retries: int = 2, patience: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Events of a stream of answers. retries: how often a chunk may fail and be asked again. delay: how late an answer may arrive."""
    ship(answers.sparkSession)
    patience_ms = answers.sparkSession.range(1).select((F.expr(f"timestamp_seconds(0) + interval {patience}").cast("double") * 1000).cast("long")).first()[0]
    named = answers.withWatermark("at", delay).where("submission_id IS NOT NULL AND chunk IS NOT NULL AND n_chunks IS NOT NULL")
    # answers are parsed where they are dealt to: a folder of one file is one task
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("submission_id"), F.lit(BUCKETS)).cast("int")).repartition("bucket")
    marked = dealt.withColumn("is_document", is_document(F.col("answer"), F.col("error"))).withColumn("answer", F.when(F.col("is_document"), F.col("answer")))
    rows = marked.select("bucket", "submission_id", "n_chunks", "chunk", "at", "answer", "is_document")
    return rows.groupBy("bucket").applyInPandasWithState(_advance(retries, patience_ms), EVENTS, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def is_document(answer: Column, error: Column) -> Column:
    text = extract.clean_json(answer)
    doc = F.from_json(text, extract.DOCUMENT, {"mode": "PERMISSIVE"})
    return F.coalesce(error.isNull() & text.startswith("{") & doc.isNotNull(), F.lit(False))


def follow_extraction(spark: SparkSession, landing: str, events: str, checkpoint: str, retries: int = 2, patience: str = "10 minutes", delay: str = "1 minute") -> StreamingQuery:
    """Follow the Parquet files of answers that land, and write events to a table at a path."""
    rows = progress(spark.readStream.schema(ANSWERS).parquet(landing), retries, patience, delay)
    return rows.writeStream.format("parquet").option("path", events).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(events: DataFrame) -> DataFrame:
    """The state of each submission: status, how many chunks are done and have failed, and what a user is shown while it goes on."""
    last = events.where("kind = 'status'").groupBy("submission_id").agg(F.max_by(F.struct("status", "n_done", "n_failed", "n_chunks"), "seq").alias("s")).select("submission_id", "s.*")
    shown = F.when(F.col("status") == "processing", F.concat(F.lit("추출 중 "), F.col("n_done") + F.col("n_failed"), F.lit("/"), "n_chunks"))
    return last.withColumn("progress", shown)


def extracted(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads and items (as `extract.merge_chunks`) of the chunks that are done."""
    rows = events.where("kind = 'chunk'").select("submission_id", "chunk", "answer", F.lit(None).cast("string").alias("error"))
    return extract.merge_chunks(extract.parse_answers(rows), "submission_id")
