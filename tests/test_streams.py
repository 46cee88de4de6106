"""Extraction followed as a stream: progress, retries, timeouts, answers that come late or twice, and a restart in between."""

import datetime
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from bidloom.streaming.extraction import ANSWERS, EVENTS, Progress, _advance, extracted, follow_extraction, latest

OK = '```json\n{"currency": "USD", "items": [{"name_raw": "%s", "amount": 2}]}\n```'


def at(minute):
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(minutes=minute)


def land(spark, folder, rows):
    spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(folder)


def follow(spark, tmp_path):
    follow_extraction(spark, f"{tmp_path}/answers", f"{tmp_path}/events", f"{tmp_path}/checkpoint", retries=1, patience="30 minutes").awaitTermination()
    events = spark.read.schema(EVENTS).parquet(f"{tmp_path}/events")
    return events, {r.submission_id: tuple(r)[1:] for r in latest(events).collect()}


def test_progress_with_a_restart(spark, tmp_path):
    folder = f"{tmp_path}/answers"
    land(spark, folder, [("a", 3, 0, at(0), OK % "a0", None), ("a", 3, 1, at(1), "sorry", None), ("b", 1, 0, at(1), None, "timeout"), ("c", 2, 0, at(2), OK % "c0", None), ("d", 1, 0, at(2), OK % "d0", None), ("a", 3, 0, at(2), OK % "twice", None), (None, 1, 0, at(0), OK % "x", None), ("e", 1, 7, at(2), OK % "out of range", None)])
    events, now = follow(spark, tmp_path)
    assert now == {"a": ("processing", 1, 0, 3, "추출 중 1/3"), "b": ("processing", 0, 0, 1, "추출 중 0/1"), "c": ("processing", 1, 0, 2, "추출 중 1/2"), "d": ("done", 1, 0, 1, None)}
    assert {(r.submission_id, r.chunk, r.attempt) for r in events.where("kind = 'retry'").collect()} == {("a", 1, 1), ("b", 0, 1)}
    # the stream has ended and starts again with its checkpoint: the rest of a, a second failure of b, a repeated d; c hears nothing more
    land(spark, folder, [("a", 3, 1, at(5), OK % "a1", None), ("b", 1, 0, at(5), "[]", None), ("d", 1, 0, at(6), OK % "d again", None)])
    land(spark, folder, [("a", 3, 2, at(6), OK % "a2", None), ("z", 1, 0, at(45), OK % "z0", None)])
    events, now = follow(spark, tmp_path)
    assert now["a"] == ("done", 3, 0, 3, None) and now["b"] == ("failed", 0, 1, 1, None) and now["d"] == ("done", 1, 0, 1, None)
    # at minute 45 the watermark has passed c's patience; what comes for it then is too late
    land(spark, folder, [("c", 2, 1, at(44), OK % "late", None), ("y", 1, 0, at(46), OK % "y0", None)])
    events, now = follow(spark, tmp_path)
    assert now["c"] == ("failed", 1, 0, 2, None)
    heads, items = extracted(events)
    assert sorted((r.submission_id, r.chunk, r.name_raw) for r in items.collect()) == [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("c", 0, "c0"), ("d", 0, "d0"), ("y", 0, "y0"), ("z", 0, "z0")]
    assert {r.submission_id: (r.items_sum, r.currency) for r in heads.collect()}["a"] == (6.0, "USD")
    assert events.groupBy("submission_id", "seq").count().where("count > 1").isEmpty()


def test_progress_is_the_same_in_any_batches():
    """Random answers, given one by one with the state kept as text between, end as the rules say."""
    rnd = random.Random(9)
    for _ in range(200):
        n, retries, kept, out = rnd.randrange(1, 5), rnd.randrange(3), None, []
        failures, done, over = {}, set(), False
        for _ in range(20):
            chunk, good = rnd.randrange(n), rnd.random() < 0.5
            own = Progress(kept, retries)
            out += list(own.answer(n, chunk, "x", good))
            kept = json.dumps(own.s)
            if not over and chunk not in done:
                if good:
                    done.add(chunk)
                    failures[chunk] = 0
                else:
                    failures[chunk] = failures.get(chunk, 0) + 1
            over = over or own.final
        assert sorted(e[2] for e in out if e[1] == "chunk") == sorted(done)
        assert [e[0] for e in out] == list(range(1, len(out) + 1))
        last = [e for e in out if e[1] == "status"][-1]
        assert last[6] == len(done) and (last[5] in ("done", "failed")) == over and (last[5] != "done" or done)


def test_merge_sums(spark, tmp_path):
    land(spark, f"{tmp_path}/answers", [("a", 2, 1, at(0), '{"currency_unit": "천원", "items": [{"name_raw": "h", "is_category_header": true, "amount": 9}, {"name_raw": "x", "amount": 4}, {"name_raw": "y"}]}', None), ("a", 2, 0, at(1), '{"currency_unit": "원", "items": []}', None)])
    events, _ = follow(spark, tmp_path)
    heads, _ = extracted(events)
    assert heads.select("currency_unit", "items_sum", "n_leaves", F.col("n_chunks").cast("int")).first()[:] == ("천원", 4.0, 2, 2)


class Kept:
    """A state as Spark gives it to a call."""

    hasTimedOut, value, until, now = False, None, None, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, until):
        assert until >= self.now
        self.until = until


def test_submissions_of_a_group_are_one_call():
    """F1 extraction_progress: a call of Python for each submission took longer than its answers."""
    run, state, minute = _advance(0, 10 * 60_000), Kept(), 60_000
    names = ["submission_id", "at", "chunk", "n_chunks", "answer", "is_document"]
    frame = lambda *rows: pd.DataFrame(rows, columns=names).astype({"at": "datetime64[ns]"})
    # a's failure comes first by time, though in a later frame: so it is final, and the document is too late
    first = [frame(("a", at(2), 0, 1, "x", True), ("b", at(1), 0, 2, "x", True)), frame(("a", at(1), 0, 1, None, False), ("c", at(9), 1, 2, "x", True))]
    events = pd.concat(run((7,), iter(first), state))
    assert list(events["submission_id"]) == ["a", "b", "b", "c", "c"] and list(events["seq"]) == [1, 1, 2, 1, 2]
    assert list(events["status"][events["kind"] == "status"]) == ["failed", "processing", "processing"]
    base = int(at(0).replace(tzinfo=datetime.UTC).timestamp()) * 1000
    assert state.until == base + 11 * minute
    # b has waited long enough and hears nothing; c, whose time has not come, is heard
    state.now = base + 12 * minute
    events = pd.concat(run((7,), iter([frame(("c", at(12), 0, 2, "x", True))]), state))
    assert sorted(zip(events["submission_id"], events["kind"], events["status"], strict=True)) == [("b", "status", "failed"), ("c", "chunk", "processing"), ("c", "status", "done")]
    assert set(json.loads(state.value[0])) == {"a", "b", "c"}  # a was final; its time, 12 minutes, is not over
    state.hasTimedOut, state.now = True, base + 23 * minute
    assert list(run((7,), iter([]), state)) == [] and state.value is None
