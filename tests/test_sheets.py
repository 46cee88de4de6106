"""Workbooks as a data source: a file a task, filters that reach it, merged cells, signals, lines and previews."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from bidloom.sources.sheets import header_preview, register_sheets, workbook_lines

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f'<styleSheet {NS}><fonts><font/><font><b/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FFFFFF00"/></patternFill></fill></fills><cellXfs><xf fontId="0" fillId="0"/><xf fontId="1" fillId="1"/><xf fontId="0" fillId="0"><alignment indent="2"/></xf></cellXfs></styleSheet>'


def book(path, sheets):
    """sheets: name to (cells {ref: (value, style)}, merges)."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{''.join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets)))}</Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        for k, (cells, merges) in enumerate(sheets.values()):
            rows = "".join(f'<c r="{ref}" t="inlineStr" s="{s}"><is><t>{v}</t></is></c>' for ref, (v, s) in cells.items())
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData><row>{rows}</row></sheetData><mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merges)}</mergeCells></worksheet>")
    path.write_bytes(raw.getvalue())


def test_quotation_sheets(spark, tmp_path):
    register_sheets(spark)
    first = ({"A1": ("품명", 1), "B1": ("수량", 0), "A2": ("분류", 2), "B2": ("1", 0), "B3": ("2", 0), "C3": (" ", 0), "B9": ("3", 1)}, ["A2:A3", "D5:E6"])
    book(tmp_path / "a.xlsx", {"견적": first, "일정": ({"A1": ("x", 0)}, [])})
    (tmp_path / "more").mkdir()
    book(tmp_path / "more" / "b.xlsx", {"견적": ({"A1": ("y", 0)}, [])})
    (tmp_path / "c.txt").write_text("no book")
    cells = spark.read.format("quotation_sheets").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 2  # a file is a task
    got = {(r.file[-6:], r.sheet, r.row, r.col): (r.value, r.merged, r.bold, r.fill, r.indent) for r in cells.collect()}
    assert got["a.xlsx", "견적", 1, 1] == ("품명", False, True, "FFFF00", 0) and got["a.xlsx", "견적", 3, 1] == ("분류", True, False, None, 0) and got["a.xlsx", "견적", 2, 1][4] == 2
    assert len(got) == 8 + 1 + 1 and got["b.xlsx", "견적", 1, 1][0] == "y"
    some = cells.where("sheet = '견적' AND row >= 2 AND row < 9 AND col > 0")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter.*(sheet#\d+ =|row#\d+ [<>])", plan) and re.search(r"Filter.*col#\d+ > 0", plan)  # sheet and rows are left to the source
    assert sorted((r.row, r.col) for r in some.collect()) == [(2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    assert cells.where(F.col("sheet").isin("일정", "none")).count() == 1 and cells.where("row = 9").first().value == "3"
    tiny = spark.read.format("quotation_sheets").option("limit", "10").load(str(tmp_path)).collect()
    assert [(r.value, r.error) for r in tiny] == [(None, "over 10 bytes")] * 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("quotation_sheets").load(str(tmp_path / "none")).count() == 0
    lines = [r.line for r in workbook_lines(cells).where("sheet = '견적' AND file LIKE '%a.xlsx'").orderBy("row").collect()]
    assert lines == ["R001 | 품명 | 수량 |    <<A1:BOLD,FILL=FFFF00>>", "R002 | [indent=2] 분류 | 1 | ", "R003 | 분류 | 2 |  ", "R009 |  | 3 | "]


def test_header_preview(spark):
    rows = [["", "견적서", ""], ["품명", "수량", ""], ["a", "", "z"], ["", "1", ""], ["b", "2", ""], ["c", "3", ""], ["d", "4", ""]]
    cells = spark.createDataFrame([("f", "s", r + 1, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)] + [("f", "blank", 1, 0, None)], "file string, sheet string, row int, col int, value string")
    got = header_preview(cells).collect()
    assert len(got) == 1 and got[0].header_row == 2 and [tuple(c) for c in got[0].columns] == [(0, "품명"), (1, "수량")]
    assert got[0].preview == [["a", ""], ["", "1"], ["b", "2"], ["c", "3"]]
