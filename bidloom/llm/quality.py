"""Quality rules whose cutoffs are controlled for the risk of rejecting good documents.

Signals of a text: words are runs of other characters than space and 0x09 to 0x0D. n_words; word_chars, code points in words;
n_symbols, characters of `#*$%&|<>`; n_dup_lines, lines (\\n) with a word that equal an earlier line of the text; n_repeat_words, words
in 5-word windows that the text holds twice or more. A document fails the base with fewer than 10 words or over 20 % repeated words.

Rules. Each rule compares one ratio of the signals with a cutoff of a fixed ladder, from lenient to strict. The labelled rows that pass
the base are split in two halves by a hash of the id. In each stratum (language) the first half proposes a cutoff: the one with the
best share of bad rows rejected less ten times the share of good rows rejected. The second half certifies it: going from lenient to
strict, a cutoff is certified while the exact binomial test rejects, at level `error` / proposals of all strata, that the share of good
rows rejected exceeds `risk` / proposals of the stratum; the first failure ends the walk (fixed-sequence testing within a ladder, Bonferroni across ladders).
The cutoff used is the strictest certified one that is no stricter than the proposal. With probability 1 - `error`, all strata at
once reject at most `risk` of their good documents beyond the base. A stratum with too few labels certifies nothing and rejects
nothing.

Words and windows are equal if their bytes are; hashes only bring them together. Null texts count as empty, and fail the base. Very long
texts are measured whole, one at a time. Null strata are one stratum of their own. Repeated rows are judged alike; ties of cutoffs go to
the more lenient one. Null ids are judged, but never learned from. Null labels are ignored; of several labels of an id the highest counts.
Without documents or labels nothing is certified. `signals` passes extra columns, and replaces those that have the name of a signal;
`risk_controlled` returns the id, the stratum and the columns asked for.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import scan
from bidloom.llm.common import keep, map_documents

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
ADDED = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLOCK = 1 << 20

#: Rule: (ratio as SQL, direction, ladder from lenient to strict).
RULES: dict[str, tuple[str, int, list[float]]] = {
    "symbols": ("n_symbols / n_words", 1, [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "repeats": ("n_repeat_words / n_words", 1, [0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1]),
    "line copies": ("n_dup_lines / greatest(n_lines, 1)", 1, [0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25]),
    "long words": ("word_chars / n_words", 1, [30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0]),
    "short words": ("word_chars / n_words", -1, [1.0, 1.5, 2.0, 2.5, 2.8, 3.0, 3.2, 3.4, 3.6, 3.8, 4.0]),
}
Cutoffs = dict[str, dict[str, float]]


def _signals(text: str):
    def block(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = scan.find_words(raw, offsets, scan.SPACED)
        counts, docs = w.counts(), len(w.bounds) - 1
        first = np.concatenate([[0], np.cumsum(counts)])

        def total(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[w.bounds])

        out = np.zeros((docs, len(NAMES)), np.int64)
        out[:, 0] = counts
        out[:, 1] = total(scan.SPACED[w.data] & ((w.data & 0xC0) != 0x80))
        out[:, 2] = total(SYMBOLS[w.data])
        for d in range(docs):
            lines = [x for x in w.data[w.bounds[d] : w.bounds[d + 1]].tobytes().split(b"\n") if x and not x.isspace()]
            out[d, 3], out[d, 5] = len(lines) - len(set(lines)), len(lines)
        n = len(w.start) - 4
        if n > 0:
            h = scan.hash_spans(w.data, w.start, w.end, scan.SAME)
            code, _ = scan.codes(w.data, w.start, w.end, h)
            at = np.flatnonzero(w.doc[:n] == w.doc[4:])
            columns = [w.doc[at], *(code[at + k] for k in range(5))]
            key = np.zeros(len(at), np.uint64)
            for c in columns:
                key = scan.mix(key * np.uint64(3) + c.astype(np.uint64) + np.uint64(1))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            equal = np.ones(len(same), bool)
            for c in columns:
                equal &= c[order][1:] == c[order][:-1]
            if (same & ~equal).any():  # windows that share a hash: sorted by their words instead
                order = np.lexsort(columns)
                equal = np.ones(len(same), bool)
                for c in columns:
                    equal &= c[order][1:] == c[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            cover = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + 5, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            out[:, 4] = hit[first[1:]] - hit[first[:-1]]
        return out

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        raw, offsets = scan.strings(batch.column(text))
        rows = np.concatenate([block(raw, offsets[a : b + 1]) for a, b in scan.blocks(offsets, BLOCK)])
        return {n: pa.array(rows[:, k]) for k, n in enumerate(NAMES)}

    return work


def signals(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with the signals, n_lines (lines with a word) and base_failed."""
    out = map_documents(docs, lambda: _signals(text), ADDED, [c for c in (docs.columns if carry is None else carry) if c.lower() != "base_failed"])
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _rejects(rule: str, cutoff: Column | float) -> Column:
    ratio, sign, _ = RULES[rule]
    return F.expr(ratio) > cutoff if sign > 0 else F.expr(ratio) < cutoff


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def learn(measured: DataFrame, labels: DataFrame, id: str = "doc_id", stratum: str = "lang", label: str = "quality", risk: float = 0.05, error: float = 0.05) -> Cutoffs:
    """Certified cutoffs by stratum and rule. measured: signals() with id and stratum. What is gathered are counts by stratum, rule and step of the ladder."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg((F.max(label) > 0).alias("good"))
    rows = measured.where("NOT base_failed").join(known, id).withColumn("half", F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(2)))
    steps = []
    for rule, (_, _, ladder) in RULES.items():
        passed = reduce(lambda a, b: a + b, [_rejects(rule, c).cast("int") for c in ladder])  # the ladder is ordered: so many steps reject, the strictest ones
        steps.append(F.struct(F.lit(rule).alias("rule"), passed.alias("strict")))
    counts = (
        rows.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "good", "half", F.explode(F.array(*steps)).alias("s"))
        .groupBy("stratum", "s.rule", "half", "good", "s.strict").count().collect()
    )
    table: dict[tuple[str, str], np.ndarray] = {}
    for stratum_, rule, half, good, strict, n in counts:
        size = len(RULES[rule][2])
        t = table.setdefault((stratum_, rule), np.zeros((2, 2, size + 1), np.int64))
        t[half, int(good), size - strict] += n  # index of the first step that rejects; size: none does
    proposed: dict[tuple[str, str], tuple[int, np.ndarray, np.ndarray]] = {}
    for key, t in table.items():
        rejected, all_ = np.cumsum(t, axis=2)[:, :, :-1], t.sum(axis=2)
        gain = rejected[0, 0] / max(1, all_[0, 0]) - 10 * rejected[0, 1] / max(1, all_[0, 1])
        if gain.max() > 0 and all_[1, 1]:
            proposed[key] = int(np.argmax(gain)), rejected[1, 1], all_[1, 1]
    out: Cutoffs = {}
    for (stratum_, rule), (proposal, rejected, good) in proposed.items():
        share = risk / sum(s == stratum_ for s, _ in proposed)
        certified = -1
        while certified < proposal and binomial_at_most(int(rejected[certified + 1]), int(good), share) <= error / len(proposed):
            certified += 1
        if certified >= 0:
            out.setdefault(stratum_, {})[rule] = RULES[rule][2][certified]
    return out


def judge(measured: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """measured with broken (the rules that a document breaks) and kept."""
    place = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    broken = []
    for rule in RULES:
        cut = F.lit(None).cast("double")
        for s, own in cutoffs.items():
            if rule in own:
                cut = F.when(place == s, F.lit(own[rule])).otherwise(cut)
        broken.append(F.when((F.col("n_words") > 0) & _rejects(rule, cut), F.lit(rule)))
    return measured.withColumn("broken", F.array_compact(F.array(*broken))).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def risk_controlled(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """docs with signals, base_failed, broken and kept, by cutoffs learned from the labels. Signals are measured once and kept in the shared folder."""
    measured = keep(signals(docs, text, list(dict.fromkeys([id, stratum, *(carry or [])]))), "signals")
    return judge(measured, learn(measured, labels, id, stratum), stratum)
