"""Quotation files as DataFrames: cells and merges of XLSX, lines of DOCX, registered by format.

Files come through Spark's binaryFile reader, so any store that Spark reads will do, and each is decoded in a task of its own. A file is
one quotation; the upload limit of 50 MB bounds what a task holds of one. Files over it aren't decoded; `refused` lists them. PDF needs a
library that is not a dependency; a decoder can be registered.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.session import ship

LIMIT = 50 << 20
CELLS = "file string, sheet string, row int, col int, value string, bold boolean, fill string, indent int"
MERGES = "file string, sheet string, r1 int, c1 int, r2 int, c2 int"
LINES = "file string, part string, seq int, line string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REF = re.compile(r"([A-Z]+)([0-9]+)")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    m = _REF.match(ref)
    return int(m[2]), column_number(m[1])


def _text(node: ElementTree.Element | None) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t")) if node is not None else ""


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        self.strings = [_text(x) for x in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        self.styles = self._styles() if "xl/styles.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        sheets = self._xml("xl/workbook.xml").find(f"{_MAIN}sheets")
        self.sheets = {s.get("name"): "xl/" + targets[s.get(_REL)].removeprefix("/xl/") for s in sheets}

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _styles(self) -> list[tuple[bool, str | None, int]]:
        root = self._xml("xl/styles.xml")
        bold = [f.find(f"{_MAIN}b") is not None for f in root.iterfind(f"{_MAIN}fonts/{_MAIN}font")]
        fills = []
        for f in root.iterfind(f"{_MAIN}fills/{_MAIN}fill"):
            color = f.find(f"{_MAIN}patternFill/{_MAIN}fgColor")
            fills.append(color.get("rgb", "")[-6:] or None if color is not None else None)
        out = []
        for x in root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf"):
            align = x.find(f"{_MAIN}alignment")
            font, fill = int(x.get("fontId", 0)), int(x.get("fillId", 0))
            out.append((font < len(bold) and bold[font], fills[fill] if fill < len(fills) else None, int(align.get("indent", 0)) if align is not None else 0))
        return out

    def cells(self, sheet: str) -> Iterator[tuple]:
        for c in self._xml(self.sheets[sheet]).iter(f"{_MAIN}c"):
            kind, raw = c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                value = _text(c.find(f"{_MAIN}is"))
            elif raw is None or raw.text is None:
                value = None
            elif kind == "s":
                value = self.strings[int(raw.text)]
            elif kind == "b":
                value = "TRUE" if raw.text == "1" else "FALSE"
            else:
                value = raw.text
            style = int(c.get("s", 0))
            bold, fill, indent = self.styles[style] if style < len(self.styles) else (False, None, 0)
            yield (*_place(c.get("r")), value, bold, fill, indent)

    def merges(self, sheet: str) -> Iterator[tuple]:
        for m in self._xml(self.sheets[sheet]).iter(f"{_MAIN}mergeCell"):
            a, _, b = m.get("ref").partition(":")
            yield (*_place(a), *_place(b or a))


def _each(files: DataFrame, decode: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    ship(files.sparkSession)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(decode(path, content), columns=names)

    return files.mapInPandas(run, schema)


def _found(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def files(spark: SparkSession, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """Files below a path by name pattern, up to the limit; `refused` has the others."""
    return _found(spark, path, pattern).where(F.col("length") <= limit).select("path", "content")


def refused(spark: SparkSession, path: str, pattern: str = "*", limit: int = LIMIT) -> DataFrame:
    """(file, length, error) of the files that are too large to be decoded. Their contents are not read."""
    large = _found(spark, path, pattern).where(F.col("length") > limit)
    return large.select(F.col("path").alias("file"), "length", F.lit(f"over {limit} bytes").alias("error"))


def xlsx_cells(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """Cells of the named sheets; of all, if none is named; of the first one, if none of the names exists."""

    def decode(name: str, content: bytes) -> list[tuple]:
        book = Workbook(content)
        wanted = [s for s in book.sheets if not sheets or s in sheets] or list(book.sheets)[:1]
        return [(name, s, *c) for s in wanted for c in book.cells(s)]

    return _each(files(spark, path, "*.xlsx"), decode, CELLS)


def xlsx_merges(spark: SparkSession, path: str) -> DataFrame:
    def decode(name: str, content: bytes) -> list[tuple]:
        book = Workbook(content)
        return [(name, s, *m) for s in book.sheets for m in book.merges(s)]

    return _each(files(spark, path, "*.xlsx"), decode, MERGES)


def xlsx_sheets(spark: SparkSession, path: str) -> DataFrame:
    return _each(files(spark, path, "*.xlsx"), lambda name, content: [(name, s, k) for k, s in enumerate(Workbook(content).sheets)], "file string, sheet string, place int")


def _word(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def _is_on(node: ElementTree.Element | None) -> bool:
    return node is not None and node.get(f"{_W}val", "1") not in ("0", "false", "none")


def docx_lines(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs (with alignment and bold) and then table rows (cells with background, bold and spans), as lines."""

    def decode(name: str, content: bytes) -> list[tuple]:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
        out = []
        for k, p in enumerate(body.findall(f"{_W}p")):
            text = _word(p).strip()
            if not text:
                continue
            align = p.find(f"{_W}pPr/{_W}jc")
            marks = [f"align={align.get(f'{_W}val')}"] if align is not None else []
            if any(_is_on(b) for b in p.iterfind(f"{_W}r/{_W}rPr/{_W}b")):
                marks.append("bold")
            out.append((name, "body", len(out), f"P{k:03d}{f'  [{",".join(marks)}]' if marks else ''}: {text}"))
        for t, table in enumerate(body.findall(f"{_W}tbl")):
            for r, row in enumerate(table.findall(f"{_W}tr")):
                cells = []
                for cell in row.findall(f"{_W}tc"):
                    marks = []
                    shade, span, merge = (cell.find(f"{_W}tcPr/{_W}{n}") for n in ("shd", "gridSpan", "vMerge"))
                    if shade is not None and shade.get(f"{_W}fill", "auto") != "auto":
                        marks.append(f"BG={shade.get(f'{_W}fill')}")
                    if any(_is_on(b) for b in cell.iter(f"{_W}b")):
                        marks.append("BOLD")
                    if span is not None:
                        marks.append(f"GRIDSPAN={span.get(f'{_W}val')}")
                    if merge is not None:
                        marks.append(f"VMERGE={merge.get(f'{_W}val', 'continue')}")
                    text = " / ".join(x for p in cell.findall(f"{_W}p") if (x := _word(p).strip()))
                    cells.append((text or "(empty)") + (f" <{';'.join(marks)}>" if marks else ""))
                out.append((name, f"table {t}", len(out), f"R{r + 1:03d} | " + " | ".join(cells)))
        return out

    return _each(files(spark, path, "*.docx"), decode, LINES)


READERS: dict[str, Callable[..., DataFrame]] = {"xlsx": xlsx_cells, "docx": docx_lines}


def register(suffix: str, reader: Callable[..., DataFrame]) -> None:
    READERS[suffix.lower().lstrip(".")] = reader


def read_quotations(spark: SparkSession, path: str, suffix: str, **options) -> DataFrame:
    """Quotations of one format; only some formats take options."""
    key = suffix.lower().lstrip(".")
    if key not in READERS:
        raise ValueError(f"no reader for {suffix}; register one")
    return READERS[key](spark, path, **options)
