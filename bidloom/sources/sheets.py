"""Sheets of XLSX workbooks as a data source: spark.read.format("quotation_sheets").load(path).

A file is a partition, so a task holds one workbook; sheets that a filter leaves out aren't decoded, and rows that it leaves out aren't made.
Files are listed and read through pyarrow.fs, which knows local folders and the stores that it has drivers for; for any other store the
readers of `office` go through Spark's own file reader. Files over `limit` bytes (50 MB unless it is given) are rows with an `error` and no
cells. Rows: file, sheet, place (of the sheet in its book), row, col, value (an empty cell of a merged range has its top-left value),
merged (the value is another cell's), bold, fill, indent, error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from bidloom.functions import scalars as S
from bidloom.operators.extract import SHEET
from bidloom.session import ship
from bidloom.sources.office import LIMIT, Workbook

SCHEMA = "file string, sheet string, place int, row int, col int, value string, merged boolean, bold boolean, fill string, indent int, error string"
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("place", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("merged", pa.bool_()), ("bold", pa.bool_()), ("fill", pa.string()), ("indent", pa.int32()), ("error", pa.string())])
ROWS = 10_000


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit
        self.sheets: set[str] | None = None
        self.low, self.high = 1, 1 << 31

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of sheet names, and bounds of rows; leaves the rest to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "sheet" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sheets = wanted if self.sheets is None else self.sheets & wanted
            elif name == "row" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = self._store()
        one = store.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(x.path, x.size) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.lower().endswith(".xlsx")] or [_File("", 0)]

    def _rows(self, part: _File) -> Iterator[tuple]:
        if not part.path:
            return
        if part.size > self.limit:
            if self.sheets is None and self.low == 1 and self.high == 1 << 31:
                yield part.path, None, None, None, None, None, None, None, None, None, f"over {self.limit} bytes"
            return
        with self._store()[0].open_input_file(part.path) as f:
            book = Workbook(f.read())
        for place, sheet in enumerate(book.sheets):
            if self.sheets is not None and sheet not in self.sheets:
                continue
            cells = {(r, c): x for r, c, *x in book.cells(sheet)}
            for r1, c1, r2, c2 in book.merges(sheet):
                value = cells.get((r1, c1), [None])[0]
                if value is None:
                    continue
                for r in range(max(r1, self.low), min(r2, self.high) + 1):
                    for c in range(c1, c2 + 1):
                        own = cells.get((r, c), [None, False, None, 0])
                        if (r, c) != (r1, c1) and not (own[0] or "").strip():
                            cells[r, c] = [value, *own[1:], True]
            for (r, c), x in sorted(cells.items()):
                if self.low <= r <= self.high:
                    yield part.path, sheet, place, r, c, x[0], len(x) > 4, *x[1:4], None

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for row in self._rows(part):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class QuotationSheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotation_sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("limit", LIMIT)))


def register_sheets(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuotationSheets)


def header_preview(cells: DataFrame, top: int = 6, rows: int = 4) -> DataFrame:
    """The row that is most likely the header of each sheet (`header_row`), its columns that hold something, and the rows below it in these columns."""
    # only rows that can be shown are gathered, a sheet's in one list: no join, and nothing of many sheets is sent to the driver
    near = cells.withColumn("value", F.coalesce("value", F.lit(""))).where(F.col("row") <= top + rows).where(" AND ".join(f"`{c}` IS NOT NULL" for c in SHEET))
    lines = near.groupBy(*SHEET, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("line"), F.count_if(S.strip(F.col("value")) != "").alias("n"))
    best = F.min(F.when((F.col("row") <= top) & (F.col("n") > 0), F.struct((-F.col("n")).alias("n"), "row")))
    sheets = lines.groupBy(*SHEET).agg(best["row"].alias("header_row"), F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("all")).where("header_row IS NOT NULL")
    sheets = sheets.withColumn("heads", F.col("all")[F.col("header_row")]).withColumn("cols", F.map_keys(F.map_filter("heads", lambda _, v: S.strip(v) != "")))
    body = F.filter(F.array_sort(F.map_keys("all")), lambda r: (r > F.col("header_row")) & (r <= F.col("header_row") + rows))
    preview = F.transform(body, lambda r: F.transform("cols", lambda c: F.coalesce(F.col("all")[r][c], F.lit(""))))
    return sheets.select(*SHEET, "header_row", F.transform("cols", lambda c: F.struct(c.alias("col"), F.col("heads")[c].alias("value"))).alias("columns"), preview.alias("preview"))


def workbook_lines(cells: DataFrame) -> DataFrame:
    """Each sheet's rows as the lines a provider is shown: `R001 | a | b`, and in the first six rows which cells are bold or filled."""
    # The form of lines and signals.
    shown = F.when(F.coalesce(F.col("indent"), F.lit(0)) > 0, F.concat(F.lit("[indent="), "indent", F.lit("] "), "value")).otherwise(F.col("value"))
    n = F.col("col") - 1
    letters = F.concat(F.when(n >= 702, F.char(65 + F.floor((n - 702) / 676) % 26)).otherwise(""), F.when(n >= 26, F.char(65 + F.floor((n - 26) / 26) % 26)).otherwise(""), F.char(65 + n % 26))
    fill = F.when(F.col("fill").isNotNull() & ~F.col("fill").isin("000000", "FFFFFF"), F.concat(F.lit("FILL="), "fill"))
    marks = F.concat_ws(",", F.when(F.col("bold"), F.lit("BOLD")), fill)
    signal = F.when((F.col("row") <= 6) & (marks != ""), F.concat(letters, F.col("row").cast("string"), F.lit(":"), marks))
    full = cells.where("sheet IS NOT NULL").withColumns({"shown": F.when(F.coalesce("value", F.lit("")) != "", F.coalesce(F.when(~F.col("merged"), shown), F.col("value"))).otherwise(""), "signal": signal})
    width = full.where("shown <> ''").groupBy(*SHEET).agg(F.max("col").alias("width"))
    rows = full.join(width, SHEET).where("col <= width").groupBy(*SHEET, "place", "row", "width").agg(F.map_from_entries(F.collect_list(F.struct("col", "shown"))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("signal").isNotNull(), F.struct("col", "signal"))))["signal"].alias("signals"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.col("m")[c], F.lit(""))), " | ")
    line = F.concat(S.row_label(F.col("row")), F.lit(" | "), text, F.when(F.size("signals") > 0, F.concat(F.lit("   <<"), F.array_join("signals", "  ;  "), F.lit(">>"))).otherwise(""))
    return rows.where(F.exists(F.map_values("m"), lambda v: v != "")).select(*SHEET, "place", "row", line.alias("line"))
