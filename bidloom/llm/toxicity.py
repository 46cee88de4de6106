"""Toxic passages as maximal-scoring segments of token log-odds.

Learning. Of the labelled rows, those of folds 1 to 3 (crc32 of the id as text, modulo 5) give for each word the number of toxic and of
other documents that hold it, a text that occurs more than once counting once. The log-odds of a word are those of a posterior with a
Dirichlet prior: its mean is the toxic share of the word's beginning (its first 6 bytes), whose own prior mean is the share of all
documents, so a word seen rarely says little and a new compound inherits from its beginning. Words are hashed into 2**20 places and
beginnings into 2**18, which bounds what is gathered and sent to the executors whatever the size of the corpus; the counts in them
cover all rows of these folds.

Search. Each token scores its log-odds less a drift, so that text has a negative mean. The algorithm of Ruzzo and Tompa finds all
maximal segments in one pass. By extreme-value theory the best segment of a harmless text of n tokens exceeds x with probability
1 - exp(-K n exp(-lambda x)); lambda and K are the maximum-likelihood ones of the harmless rows of fold 4. A segment's evidence is
lambda x - ln(K n); those with positive evidence above `significant` are passages. The score of a document is a logistic function,
fitted on fold 4, of the best segment's evidence and the log of the summed evidence of its passages. That fit alone uses at most
about `fit_rows` labelled rows, chosen by a hash of the id; lambda and K rest on sums over all. Fold 0 is never learned from.

Null or empty texts have no tokens and get the logistic function's value without evidence. Repeated rows score alike. Labels that are
null are ignored; of several labels of an id the highest counts. With no label of either kind all scores are 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import scan
from bidloom.llm.common import giving_back, is_small, keep, map_documents
from bidloom.session import ship

WORD_BITS, HEAD_BITS, HEAD_BYTES = 20, 18, 6
BLOCK = 1 << 20
#: Evidence beyond these bounds counts as the bound.
LEAST, MOST = -5.0, 40.0
#: The values of lambda that are tried.
RATES = np.geomspace(0.05, 8, 200)
PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())]))
ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGE)])


@dataclass
class Odds:
    toxic: np.ndarray
    other: np.ndarray
    head: np.ndarray
    base: float
    prior: float = 8.0
    drift: float = 0.5
    low: float = -1.5

    def scores(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        a, b = self.toxic[word], self.other[word]
        share = (a + self.prior * self.head[head]) / (a + b + self.prior)
        odds = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base))
        return np.maximum(odds, self.low) - self.drift


@dataclass
class Model:
    odds: Odds | None = None
    rate: float = 1.0
    size: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0, 0]))
    significant: float = 3.0


def places(words: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where each word and its beginning are counted."""
    whole = scan.hash_spans(words.data, words.start, words.end)
    head = scan.hash_spans(words.data, words.start, np.minimum(words.end, words.start + HEAD_BYTES))
    return (whole >> np.uint64(64 - WORD_BITS)).astype(np.int64), (head >> np.uint64(64 - HEAD_BITS)).astype(np.int64)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa, in linear time."""
    total = np.cumsum(score)
    gains = np.flatnonzero(score > 0)
    begin, stop, left, right, link = [], [], [], [], []
    for k, r in zip(gains.tolist(), total[gains].tolist(), strict=True):
        s, lo = k, r - float(score[k])
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= r:
                break
            s, lo = begin[j], left[j]
            del begin[j:], stop[j:], left[j:], right[j:], link[j:]
        begin.append(s)
        stop.append(k + 1)
        left.append(lo)
        right.append(r)
        link.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(begin, stop, left, right, strict=True)]


def _batches(column: pa.Array):
    """(words, first word of each text) of each block of a batch."""
    raw, offsets = scan.strings(column)
    for a, b in scan.blocks(offsets, BLOCK):
        words = scan.find_words(raw, offsets[a : b + 1], scan.WORDS)
        yield a, words, np.concatenate([[0], np.cumsum(words.counts())])


def _count(batches, text: str):
    n = (1 << WORD_BITS) + (1 << HEAD_BITS) + 1
    counts = np.zeros((2, n), np.int64)
    for batch in batches:
        toxic = np.asarray(batch.column("toxic")).astype(np.int64)
        for a, words, _ in _batches(batch.column(text)):
            word, head = places(words)
            docs = len(words.bounds) - 1
            for at, bits, base in ((word, WORD_BITS, 0), (head, HEAD_BITS, 1 << WORD_BITS)):
                seen = np.unique((words.doc << bits) | at)
                label = toxic[a + (seen >> bits)]
                for y in (0, 1):
                    mine = seen[label == y] & ((1 << bits) - 1)
                    counts[y, base : base + (1 << bits)] += np.bincount(mine, minlength=1 << bits)
            for y in (0, 1):
                counts[y, -1] += int((toxic[a : a + docs] == y).sum())
    used = np.flatnonzero(counts.sum(axis=0))
    for k in range(0, len(used), 50_000):
        part = used[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["place", "other", "toxic"])


def _calm_sums(batches, odds: Odds, text: str):
    """Of the harmless texts with a segment: their number, the sum of their best scores, and for each rate the sum of n exp(-rate best)."""
    sums = np.zeros(2 + len(RATES))
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        for a, words, first in _batches(batch.column(text)):
            score = odds.scores(*places(words))
            best = np.array([max((s for _, _, s in segments(score[p:q])), default=0.0) for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            calm = (toxic[a : a + len(best)] == 0) & (best > 0)
            best, n = best[calm], np.diff(first)[calm]
            sums[0] += len(best)
            sums[1] += best.sum()
            sums[2:] += np.exp(-np.outer(RATES, best)) @ n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["k", "x"])


def _features(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    if not found:
        return np.array([1.0, LEAST, 0.0]), []
    floor = np.log(model.size * n)
    evidence = [(a, b, model.rate * s - floor) for a, b, s in found]
    passages = [e for e in evidence if e[2] > model.significant]
    return np.array([1.0, np.clip(max(e[2] for e in evidence), LEAST, MOST), np.log1p(sum(e[2] for e in passages))]), passages


def _score(model: Model, text: str):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows, passages = [], []
        for _, words, first in _batches(batch.column(text)):
            score = model.odds.scores(*places(words)) if model.odds else np.zeros(len(words.start))
            for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                x, mine = _features(model, q - p, segments(score[p:q]))
                rows.append(x)
                passages.append([{"start": a, "end": b, "evidence": e} for a, b, e in mine])
        z = np.clip(np.array(rows) @ model.weights, -500, 500)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
        return {"score": pa.array(1 / (1 + np.exp(-z))), "passages": pa.array(passages, kind)}

    return work


def _extreme_value(sums: np.ndarray) -> tuple[float, float]:
    """lambda and K of greatest likelihood, by the sums that _calm_sums gives."""
    count, total, room = sums[0], sums[1], sums[2:]
    if count < 10 or not room.any():
        return 1.0, 0.1
    rates, room = RATES[room > 0], room[room > 0]
    k = int(np.argmax(count * (np.log(rates) + np.log(count / room)) - rates * total))
    return float(rates[k]), float(count / room[k])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fold_of(id: str):
    return F.crc32(F.col(id).cast("string")) % 5


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 100_000) -> Model:
    """Learn from the labelled rows of folds 1 to 4."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg((F.max(label) > 0).cast("int").alias("toxic")).withColumn("fold", fold_of(id)).where("fold <> 0")
    known = keep(known, "known")
    near = F.broadcast(known) if is_small(known, 1_000_000) else known
    texts = docs.select(id, text)
    hashes = texts.join(near, id).select(id, "toxic", "fold", F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    once = keep(hashes.groupBy("h", "n").agg(F.min(F.struct(id, "toxic", "fold")).alias("x")).select("x.*"), "once")
    learned = texts.join(F.broadcast(once) if is_small(once, 1_000_000) else once, id)
    model = Model()
    counts = learned.where("fold < 4").select(text, "toxic").mapInArrow(giving_back(lambda b: _count(b, text)), "place long, other long, toxic long")
    rows = counts.groupBy("place").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    size = (1 << WORD_BITS) + (1 << HEAD_BITS) + 1
    table = np.zeros((2, size))
    place = rows["place"].to_numpy()
    table[0, place], table[1, place] = rows["other"].to_numpy(), rows["toxic"].to_numpy()
    del rows
    if not table[0, -1] or not table[1, -1]:
        return model
    base = table[1, -1] / table[:, -1].sum()
    heads = table[:, 1 << WORD_BITS : -1]
    head = (heads[1] + 20 * base) / (heads.sum(axis=0) + 20)
    model.odds = Odds(table[1, : 1 << WORD_BITS].astype(np.float32), table[0, : 1 << WORD_BITS].astype(np.float32), head.astype(np.float32), float(base))
    sent = spark.sparkContext.broadcast(model.odds)
    held = learned.where("fold = 4")
    parts = held.mapInArrow(giving_back(lambda b: _calm_sums(b, sent.value, text)), "k long, x double")
    sums = parts.groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    if len(sums):
        model.rate, model.size = _extreme_value(sums.sort_values("k")["x"].to_numpy())
    total = once.where("fold = 4").count()
    if total > fit_rows:
        held = held.where(F.pmod(F.xxhash64(id), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    sent = spark.sparkContext.broadcast(model)
    feats = held.mapInArrow(giving_back(lambda b: _fit_rows(b, sent.value, text)), "toxic int, a double, b double, c double").toPandas()
    x = feats[["a", "b", "c"]].to_numpy(float)
    if len(x) and 0 < feats["toxic"].sum() < len(x):
        model.weights = _logistic(x, feats["toxic"].to_numpy(float))
    return model


def _fit_rows(batches, model: Model, text: str):
    for batch in batches:
        rows = []
        for _, words, first in _batches(batch.column(text)):
            score = model.odds.scores(*places(words))
            rows += [_features(model, q - p, segments(score[p:q]))[0] for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        x = np.array(rows).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(x[:, k]) for k in range(3))], names=["toxic", "a", "b", "c"])


def toxicity(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and passages (start and end in words, evidence) of each significant toxic segment."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_documents(docs, lambda: _score(sent.value, text), ADDED, carry)
