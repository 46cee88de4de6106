"""Personal data in plain and disguised form, at offsets of the source text.

Base. Leftmost matches of each kind that do not overlap: e-mail addresses, IPv4 addresses (parts up to 255), payment cards (14 to 19
digits that pass Luhn) and telephone numbers (10 to 15 digits after a plus). A match that fails its test is dropped, without retries.

Disguises. Transducers rewrite a text step by step and keep for each character the source characters it stands for:
 1. homoglyphs: letters, digits and signs that look like ASCII ones become those; invisible characters vanish;
 2. spelled digits (English, German, French, Spanish): runs of at least four digit words or digits, with plus, dot, point and dash
    between them, become figures; full stops between the words are dots if there are three of them, as in an IP, and else mere separators;
 3. at and dot in these languages: bracketed ones anywhere, bare ones in the form `name at host dot domain`, and spaces around @ before a
    domain. A bare point, punto or punkt parts a host only where it has no other dot yet.
The base detectors then run on the rewritten text, and their spans are mapped back. A span is added unless a base span of its kind covers
it: one that only holds a base span's part of an identifier is whole beside it. Spans may overlap. A text without a disguise's traces is not rewritten.

Null texts count as empty and have no spans. Very long texts are searched whole; work and memory are linear in the text, as a run of
characters is never scanned again from its middle. Repeated rows are searched alike; spans that tie in start come in the order of the
kinds. An empty table gives an empty one. Extra columns pass, and those named base or spans are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bidloom.llm.common import map_documents

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = T.StructType([T.StructField("base", SPANS), T.StructField("spans", SPANS)])
Span = tuple[int, int, int]  # start, place of the kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never starts inside a run of digits
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")


def _emails(t: str) -> list[Span]:
    out, low, i = [], 0, t.find("@")
    while i >= 0:
        j = i
        while j > low and t[j - 1] in LOCAL:
            j -= 1
        m = HOST.match(t, i + 1) if j < i else None
        if m:
            out.append((j, 0, m.end()))
            low = m.end()
        i = t.find("@", m.end() if m else i + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(t: str) -> list[Span]:
    """The base spans of all kinds, by start and then kind."""
    out = _emails(t) if "@" in t else []
    if DIGIT.search(t):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 14:
                digits = NO_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# Characters of other scripts that look like the ASCII character before them.
LOOKALIKES = "aаαɑ bЬ cсϲ dԁ eеҽ gɡ hһ iіıι jјϳ kκ lӏ mм nո oоοօ pрρ qԛ rг sѕ uυս vνѵ wԝ xхχ yуγ zᴢ AАΑ BВΒ CС EЕΕ HНΗ IІΙ JЈ KКΚ MМΜ NΝ OОΟ PРΡ SЅ TТΤ XХΧ YΥҮ ZΖ @﹫＠ .．。․ -‐‑‒–—−－ +＋"
INVISIBLE = "­​‌‍⁠﻿"
_SPOKEN = (
    "zero oh one two three four five six seven eight nine",
    "null null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro zéro un deux trois quatre cinq six sept huit neuf",
    "cero cero uno dos tres cuatro cinco seis siete ocho nueve",
)
JOINTS = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-", "punkt": ".", "punto": ".", "más": "+", "mas": "+", "strich": "-", "tiret": "-", "guion": "-", "guión": "-"}
DIGIT_WORDS = {w: str(max(0, k - 1)) for names in _SPOKEN for k, w in enumerate(names.split())} | {"zwo": "2", "fuenf": "5"}

_SAME = {c: group[0] for group in LOOKALIKES.split(" ") for c in group[1:]}
_OTHER = re.compile(r"[^\x00-\xAC\xAE-\xFF]")
_NAMED = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_WHITE = re.compile(r"\s")
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:(?:{'|'.join(JOINTS)})[\s,(-]+|\+\s*)?(?:{_NAMED}|[0-9])(?:[\s,()-]*(?:(?<![^\W_])(?:{_NAMED}|{'|'.join(JOINTS)})(?![^\W_])|[0-9.])){{3,}}(?![^\W_])")
_TOKEN = re.compile(rf"(?i){_NAMED}|{'|'.join(JOINTS)}|[0-9.+]")
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_NAMED})[\s.,()-]+(?:{_NAMED}|{'|'.join(JOINTS)}|[0-9])(?![^\W_])|[0-9][\s.,()-]++(?:{_NAMED})(?![^\W_])")
# The words for @, each with those for the dot that go with it.
AT_DOT = {"at": ("dot", "punkt"), "arroba": ("punto", "dot"), "arobase": ("point", "dot"), "klammeraffe": ("punkt", "dot")}
_AT_WORDS, _DOT_WORDS = "|".join(AT_DOT), "|".join(sorted({d for dots in AT_DOT.values() for d in dots}))
_BRACKET = re.compile(rf"(?i)(?:(?<!\s)\s++)?[\[({{<]\s*+({_AT_WORDS}|@|{_DOT_WORDS}|\.)\s*+[\])}}>]\s*+")
_BARE = re.compile("(?i)(?<=[A-Za-z0-9_%+-])(\\s++(?:" + "|".join(f"{a}(?=\\s++[A-Za-z0-9-]++(?:\\s++(?:{'|'.join(dots)})\\s++|\\.)[A-Za-z0-9-])" for a, dots in AT_DOT.items()) + ")\\s++)")
_WIDE_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:\s++@\s*+|@\s++)(?=[A-Za-z0-9-]++(?:\s++\.\s*+|\.)[A-Za-z]{2})")
_HOST = re.compile(r"[A-Za-z0-9.-]+")
_AT_HOST = re.compile(rf"(?i)@[A-Za-z0-9-]++\s++(?:{_DOT_WORDS})\s++[A-Za-z0-9-]")
_HOST_DOT = re.compile(rf"(?i)\s++({_DOT_WORDS})\s++(?=[A-Za-z0-9-])|\s++\.\s*+(?=[A-Za-z]{{2}})")


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Put text in place of spans, which ascend. Each new character stands for the whole span."""
        if not changes:
            return
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in [*changes, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            starts.append(self.start[at:a])
            ends.append(self.end[at:a])
            if new:
                starts.append(np.full(len(new), self.start[a]))
                ends.append(np.full(len(new), self.end[b - 1]))
            at = b
        self.text, self.start, self.end = "".join(parts), np.concatenate(starts), np.concatenate(ends)


def _homoglyphs(m: Mapped) -> None:
    changes = []
    for x in _OTHER.finditer(m.text):
        c = x[0]
        new = "" if c in INVISIBLE else _SAME.get(c)
        if new is None:
            flat = unicodedata.normalize("NFKC", c)
            digit = unicodedata.decimal(c, None)
            new = str(digit) if digit is not None else flat if len(flat) == 1 and flat.isascii() else None
        if new is not None:
            changes.append((x.start(), x.end(), new))
    m.rewrite(changes)


def _spelled(m: Mapped) -> None:
    changes = []
    for run in _RUN.finditer(m.text):
        tokens = list(_TOKEN.finditer(m.text, run.start(), run.end()))
        words = sum(t[0].lower() in DIGIT_WORDS for t in tokens)
        # One or two words among figures count in a run without white space or as long as a telephone number; elsewhere they are prose.
        if not words or words < 3 and len(tokens) < 10 and _WHITE.search(run[0]):
            continue
        low = run.start()
        stops = sum(t[0] == "." for t in tokens[1:]) != 3 and any(t[0] == "." for t in tokens)  # more or fewer than an IP has: they only part the words
        for t in tokens:
            word = t[0].lower()
            changes.append((low, t.end(), "" if stops and word == "." else DIGIT_WORDS.get(word) or JOINTS.get(word) or word))
            low = t.end()
    m.rewrite(changes)


def _at_and_dot(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), "@" if x[1].lower() in AT_DOT or x[1] == "@" else ".") for x in _BRACKET.finditer(m.text)])
    bare = [(x.start(1), x.end(1), "@") for x in _BARE.finditer(m.text)]
    m.rewrite(bare)
    m.rewrite([(x.start(), x.end(), "@") for x in _WIDE_AT.finditer(m.text)])
    dots, low = [], 0
    for x in re.finditer("@", m.text):  # bare dots count only in the host that follows an at
        at = max(low, x.end())
        while True:
            host = _HOST.match(m.text, at)
            dot = host and _HOST_DOT.match(m.text, host.end())
            if not dot or dot[1] and dot[1].lower() != "dot" and "." in host[0]:
                break
            dots.append((dot.start(), dot.end(), "."))
            at = low = dot.end()
    m.rewrite(dots)


# What a text in small letters must hold for a transducer to find anything; each begins with a set of characters, which is quick to look for.
_SOME_SPELLED = re.compile(rf"(?:{_NAMED})[\s.,()-]+(?:{_NAMED}|{'|'.join(JOINTS)}|[0-9])|[0-9][\s.,()-]+(?:{_NAMED})")
_SOME_BRACKET = re.compile(rf"[\[({{<]\s*+(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)\s*+[\])}}>]")
_SOME_BARE = re.compile("\\s(?:" + "|".join(f"{a}\\s++[a-z0-9-]++(?:\\s++(?:{'|'.join(dots)})\\s|\\.)" for a, dots in AT_DOT.items()) + ")")


def _is_disguised(t: str) -> bool:
    if ("\xad" in t or not t.isascii()) and _OTHER.search(t) or "@" in t and (_WIDE_AT.search(t) or _AT_HOST.search(t)):
        return True
    low = t.lower()
    return bool(_SOME_SPELLED.search(low) and _SPELLED.search(t) or _SOME_BRACKET.search(low) or _SOME_BARE.search(low) and _BARE.search(t))


def find(t: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = detect(t)
    if not _is_disguised(t):
        return base, base
    m = Mapped(t)
    for transducer in (_homoglyphs, _spelled, _at_and_dot):
        transducer(m)
    taken: list[tuple[list[int], list[int]]] = [([], []) for _ in KINDS]  # starts and ends of each kind, which do not overlap
    for a, kind, b in base:
        taken[kind][0].append(a)
        taken[kind][1].append(b)
    more = []
    for a, kind, b in detect(m.text):
        lo, hi = int(m.start[a]), int(m.end[b - 1])
        starts, ends = taken[kind]
        k = bisect_right(starts, lo)
        if not k or ends[k - 1] < hi:
            more.append((lo, kind, hi))
    return base, sorted(base + more)


def find_pii(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with base and spans: arrays of (kind, start, end), in code points, by start and then kind."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            both = [find(t.as_py() or "") for t in batch.column(text)]
            return {n: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x[i]] for x in both], kind) for i, n in enumerate(("base", "spans"))}

        return work

    return map_documents(docs, make, ADDED, carry)
