"""From the cells of a quotation sheet to items.

Cells: file, sheet, row, col, value. Merges: file, sheet, r1, c1, r2, c2. Rows of a sheet are ordered by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import scalars as S
from bidloom.session import ship

SHEET = ["file", "sheet"]

#: Roles in the order in which they are tried, and the words in a header that name them.
ROLE_WORDS: list[tuple[str, tuple[str, ...]]] = [
    ("seq", ("no.", "no", "번호", "순번", "항번", "item no")),
    ("cat1", ("대분류",)),
    ("cat2", ("중분류",)),
    ("cat3", ("소분류",)),
    ("cat4", ("세분류", "세세분류")),
    ("name", ("품명", "품목", "주요구성품", "주요부품", "name", "item")),
    ("spec", ("규격", "사양", "spec", "remark주요")),
    ("qty", ("수량", "q'ty", "qty", "수 량")),
    ("unit", ("단위", "unit")),
    ("price", ("단가", "unit price", "unitprice")),
    ("amount", ("금액", "amount", "total", "공급가", "합계금액")),
    ("remark", ("비고", "remark", "remarks")),
]
TOTALS = r"total|subtotal|합계|소계|총계|grand"


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the top-left value of a merged range in all of its cells; a range whose top-left cell is empty is left alone."""
    corner = merges.join(cells, [merges.file == cells.file, merges.sheet == cells.sheet, F.col("r1") == F.col("row"), F.col("c1") == F.col("col")]).where("value IS NOT NULL").select(merges.file, merges.sheet, "r1", "c1", "r2", "c2", "value")
    filled = corner.select(*SHEET, F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2", "value").select(*SHEET, "row", F.explode(F.sequence("c1", "c2")).alias("col"), F.col("value").alias("filled"))
    filled = filled.groupBy(*SHEET, "row", "col").agg(F.first("filled").alias("filled"))
    return cells.join(filled, [*SHEET, "row", "col"], "full").select(*SHEET, "row", "col", F.coalesce("filled", "value").alias("value"))


def header_row(cells: DataFrame, top: int = 6) -> DataFrame:
    """The first row with the most cells that hold something, among the first rows of each sheet."""
    counts = cells.where((F.col("row") <= top) & (F.coalesce(S.strip(F.col("value")), F.lit("")) != "")).groupBy(*SHEET, "row").agg(F.count("*").alias("n"))
    return counts.groupBy(*SHEET).agg(F.min_by(F.struct("row", "n"), F.struct(-F.col("n"), "row")).alias("h")).select(*SHEET, F.col("h.row").alias("header_row"), F.col("h.n").alias("n_cells"))


def find_keyword(cells: DataFrame, keyword: str, top: int = 10) -> DataFrame:
    """The first cell that holds the keyword, row by row, in the first rows of each sheet."""
    return cells.where((F.col("row") <= top) & F.col("value").contains(keyword)).groupBy(*SHEET).agg(F.min(F.struct("row", "col")).alias("x")).select(*SHEET, "x.row", "x.col")


def role_of(value: Column) -> Column:
    """The first role that a header names. With a price beside it, a unit is none."""
    text = F.lower(S.strip(value))
    out = F.lit(None).cast("string")
    for role, words in reversed(ROLE_WORDS):
        named = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(named & ~text.contains("price") if role == "unit" else named, role).otherwise(out)
    return out


def suggest_roles(cells: DataFrame, top: int = 8) -> DataFrame:
    """The row among the first ones most of whose columns name a role (the first of equals), the columns' roles, and how sure that is. Several columns may have one role."""
    named = cells.where(F.col("row") <= top).withColumn("role", role_of(F.col("value"))).where("role IS NOT NULL")
    rows = named.groupBy(*SHEET, "row").agg(F.count("*").alias("hits"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "role")))).alias("mapping"))
    best = rows.groupBy(*SHEET).agg(F.min_by(F.struct("row", "hits", "mapping"), F.struct(-F.col("hits"), "row")).alias("b")).select(*SHEET, "b.*")
    return best.withColumn("confidence", F.when(F.col("hits") >= 4, "high").when(F.col("hits") >= 2, "low").otherwise("none"))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """Rows that hold anything as lines `R001 | a | b`, empty cells at the end left out."""
    shown = cells.withColumn("shown", F.coalesce(S.strip(F.col("value")), F.lit("")))
    last = shown.where("shown <> ''").groupBy(*SHEET).agg(F.max("col").alias("width"))
    rows = shown.join(last, SHEET).where("col <= width").groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", "shown")))["shown"].alias("all"))
    return rows.where(F.exists("all", lambda x: x != "")).select(*SHEET, "row", F.concat_ws(" | ", S.row_label(F.col("row")), F.array_join("all", " | ")).alias("line"))


def runs(rows: DataFrame, by: list[str], order: str, label: str, most: int = 30) -> DataFrame:
    """Rows grouped by runs of one label in order, each run cut at so many rows: run and chunk, numbered from 0 and 1."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    inner = Window.partitionBy(*by, "run").orderBy(order)
    return numbered.withColumn("chunk", F.floor((F.row_number().over(inner) - 1) / most).cast("long"))


def fill_down(rows: DataFrame, by: list[str], order: str, levels: list[str]) -> DataFrame:
    """Category columns filled down: the own value, else the level's last one, else the value of the level above, which is then
    remembered. A change above doesn't clear what is below. Levels are filled from the first to the last."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k, c in enumerate(levels):
        own = F.last(F.nullif(S.strip(F.col(c)), F.lit("")), ignorenulls=True).over(w)
        above = F.first(F.col(levels[k - 1]), ignorenulls=True).over(w) if k else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(own, above))
    return out


def rows_by_role(cells: DataFrame, mapping: dict[int, str], header: int, excluded: list[int] | None = None) -> DataFrame:
    """One row for each sheet row below the header, with a column for each role; a role's first column counts. Excluded and blank rows are absent."""
    first: dict[str, int] = {}
    for c, role in mapping.items():
        if role != "ignore":
            first.setdefault(role, c)
    below = cells.where((F.col("row") > header) & ~F.col("row").isin(excluded or []))
    wide = below.groupBy(*SHEET, "row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(r) for r, c in first.items()])
    roles = list(first)
    for r in ("cat1", "name", "spec", "qty", "unit", "price", "amount", "seq"):
        if r not in first:
            wide = wide.withColumn(r, F.lit(None).cast("string"))
    return wide.where(reduce(lambda a, b: a | b, [F.coalesce(S.strip(F.col(r)), F.lit("")) != "" for r in roles]))


def _sequence_paths(rows: DataFrame) -> DataFrame:
    """Paths from numbers such as 2 or 2.1.3. A top-level number's name is remembered for the rows below it, else the number stands for
    it; a number between is itself a level. Top-level rows without an amount are headings; rows without a number are items of their own
    name, unless they have an amount and are totals or have no name."""
    seq, name = F.coalesce(S.strip(F.col("seq")), F.lit("")), S.truthy(F.col("name"))
    is_seq = seq.rlike(r"^\d+(\.\d+)*$")
    rows = rows.withColumn("levels", F.when(is_seq, F.split(seq, r"\.")))
    top, own = F.coalesce(F.size("levels") == 1, F.lit(False)), F.when(name != "", name).otherwise(seq)
    w = Window.partitionBy(*SHEET, F.try_element_at("levels", F.lit(1))).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    head = F.coalesce(F.last(F.when(top, own), ignorenulls=True).over(w), F.element_at("levels", 1))
    rows = rows.withColumn("head", head)
    between = F.transform(F.sequence(F.lit(2), F.size("levels") - 1), lambda k: F.array_join(F.slice("levels", 1, k), "."))
    above = F.when(F.size("levels") > 2, between).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    parts = F.when(top, F.array(own)).when(is_seq, F.concat(F.array("head"), above, F.array(own))).when(name != "", F.array(name)).otherwise(none)
    paid = F.coalesce(S.strict_number(F.col("amount")), F.lit(0.0)) != 0
    total = F.lower(F.concat_ws(" ", name, seq)).rlike(TOTALS) | (seq == "") & (name == "")
    return rows.withColumn("parts", parts).where(~(top & ~paid) & ~(~is_seq & paid & total))


def extract_by_mapping(cells: DataFrame, mapping: dict[int, str], header: int, fill: bool = True, excluded: list[int] | None = None, nego: list[int] | None = None) -> DataFrame:
    """Items of a sheet whose columns' roles are known: path, depth, category, line_no, name, spec, quantity, unit, unit_price, amount, is_category_header, is_nego."""
    rows = rows_by_role(cells, mapping, header, excluded)
    cats = sorted({r for r in mapping.values() if r.startswith("cat")})
    if "seq" in mapping.values() and not cats:
        rows = _sequence_paths(rows)
    else:
        if fill:
            rows = fill_down(rows, SHEET, "row", cats)
        else:
            for k, c in enumerate(cats):
                rows = rows.withColumn(c, F.coalesce(F.nullif(S.strip(F.col(c)), F.lit("")), F.col(cats[k - 1]) if k else F.lit(None)))
        rows = rows.withColumn("parts", F.array_compact(F.array(*cats)) if cats else F.array().cast("array<string>"))
    is_nego = F.col("row").isin(nego or [])

    def money(c: str) -> Column:
        x = S.strict_number(F.col(c))
        return F.when(is_nego, -F.abs(x)).otherwise(x)

    out = rows.withColumn("n", S.truthy(F.col("name"))).withColumn("a", money("amount"))
    header_only = (F.col("n") == "") & (F.coalesce("a", F.lit(0.0)) != 0)
    out = out.where((F.col("n") != "") | header_only)
    label = F.when(header_only, F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("(소계)"))).otherwise(F.col("n"))
    empty = F.size("parts") == 0
    return out.select(
        *SHEET, "row",
        F.when(empty, label).otherwise(S.join_path(F.col("parts"))).alias("path"),
        F.greatest(F.size("parts"), F.lit(1)).alias("depth"),
        F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("기타")).alias("category"),
        F.concat(F.lit("R"), F.col("row").cast("string")).alias("line_no"),
        label.alias("name"), F.coalesce(S.strip(F.col("spec")), F.lit("")).alias("spec"), S.strict_number(F.col("qty")).alias("quantity"),
        F.coalesce(S.strip(F.col("unit")), F.lit("")).alias("unit"), money("price").alias("unit_price"), F.col("a").alias("amount"),
        header_only.alias("is_category_header"), is_nego.alias("is_nego"),
    )


def page_type(text: Column, lines: int = 5) -> Column:
    """The kind of a page by words in its first lines. The kinds, their words, and the order in which they are tried."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    low = F.lower(head)
    return (
        F.when(head.contains("랙 배치도") | low.contains("front view"), "DRAWING")
        .when(head.contains("구성도") & low.contains("logical"), "DIAGRAM")
        .when(head.contains("거래조건") | head.contains("거 래 조 건"), "TERMS")
        .when(head.contains("견적서") & ~head.contains("명세"), "SUMMARY (갑지)")
        .when(head.contains("명세"), "DETAIL (명세)")
        .otherwise("UNKNOWN")
    )


def fx_rate(items: DataFrame, by: str, order: str, low: float = 500, high: float = 2000) -> DataFrame:
    """The rate of each submission: that of its first foreign row whose amount over price and quantity lies in the range, rounded half to even."""
    rate = F.try_divide(F.col("amount"), F.col("price") * F.col("quantity"))
    return items.where("currency <> 'KRW'").withColumn("rate", rate).where(F.col("rate").between(low, high)).groupBy(by).agg(F.bround(F.min_by("rate", order), 0).alias("fx_rate"))


def convert(items: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    """Items with foreign prices converted (rounded half to even), the original one kept."""
    foreign = (F.col("currency") != "KRW") & F.col("fx_rate").isNotNull()
    joined = items.join(rates, by, "left")
    return joined.withColumn("price_orig", F.when(foreign, F.col("price"))).withColumn("price", F.when(foreign, F.bround(F.col("price") * F.col("fx_rate"), 0)).otherwise(F.col("price")))


def validate_sums(items: DataFrame, stated: DataFrame, by: str, tolerance: int = 1) -> DataFrame:
    """The items' sum against the stated total: the discrepancy in hundredths of a percent, rounded down, and whether it is within tolerance percent."""
    sums = items.groupBy(by).agg(F.sum(F.when(~F.col("is_header"), F.col("amount"))).alias("items_sum"))
    off = F.when(F.col("stated") != 0, F.floor(F.abs(F.col("items_sum") - F.col("stated")) * 10000 / F.abs("stated"))).cast("long")
    return stated.join(sums, by, "left").withColumn("discrepancy", off).withColumn("matches", F.coalesce(off <= 100 * tolerance, F.lit(False)))


def text_chunks(lines: DataFrame, by: str, order: str, size: int = 150) -> DataFrame:
    """Data lines (R followed by digits) of a text in chunks of so many; all other lines go to every chunk. Chunk texts keep the order of lines."""
    data = F.col("line").rlike(r"^R[0-9]+")
    w = Window.partitionBy(by).orderBy(order)
    numbered = lines.where(data).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    chunks = numbered.select(by, "chunk").distinct()
    shared = lines.where(~data).join(chunks, by)
    rows = numbered.select(by, "chunk", order, "line").unionByName(shared.select(by, "chunk", order, "line"))
    return rows.groupBy(by, "chunk").agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, "line")))["line"], "\n").alias("text"), F.count("*").alias("n_lines"))


def clean_json(text: Column) -> Column:
    """A provider's answer without the fence around it."""
    return F.regexp_replace(F.regexp_replace(S.strip(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


#: What a provider answers for one chunk.
DOCUMENT = (
    "vendor_name string, proposal_no string, proposal_date string, currency string, currency_unit string, "
    "amount_summary struct<subtotal_excl_vat:double,vat:double,grand_total:double>, "
    "items array<struct<line_no:string,depth:int,is_category_header:boolean,category:string,parent_path:string,path:string,name_raw:string,"
    "name_normalized:string,spec:string,quantity:double,unit:string,unit_price:double,amount:double>>"
)


def parse_answers(answered: DataFrame) -> DataFrame:
    """answered (answer, error) with `doc`, the answer as a document; an answer that is no document has none and an error that says so."""
    doc = F.from_json(clean_json(F.col("answer")), DOCUMENT, {"mode": "PERMISSIVE"})
    out = answered.withColumn("doc", F.when(clean_json(F.col("answer")).startswith("{"), doc))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("doc").isNull(), "no document in the answer")))


def merge_chunks(parsed: DataFrame, by: str, order: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """Heads and items of documents that came in chunks. Heads: those of the first chunk, the last chunk's currency and currency unit that are
    not empty, the sum of the items that are no headings (amount_summary's subtotal) and their number, how many chunks failed, and status
    (failed if all did). Items keep the order of chunks and, in them, of the answer; a failed chunk has none."""
    currency, unit = F.nullif(F.col("doc.currency"), F.lit("")), F.nullif(F.col("doc.currency_unit"), F.lit(""))
    leaves = F.filter(F.coalesce("doc.items", F.array()), lambda i: ~F.coalesce(i["is_category_header"], F.lit(False)))
    heads = parsed.groupBy(by).agg(
        F.min_by("doc.vendor_name", F.when(F.col("doc").isNotNull(), F.col(order))).alias("vendor_name"),
        F.max_by(currency, F.when(currency.isNotNull(), F.col(order))).alias("currency"),
        F.max_by(unit, F.when(unit.isNotNull(), F.col(order))).alias("currency_unit"),
        F.sum(F.aggregate(leaves, F.lit(0.0), lambda s, i: s + F.coalesce(i["amount"], F.lit(0.0)))).alias("items_sum"),
        F.sum(F.size(leaves)).alias("n_leaves"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
        F.count("*").alias("n_chunks"),
    )
    heads = heads.withColumn("status", F.when(F.col("n_failed") == F.col("n_chunks"), "failed").otherwise("done"))
    items = parsed.select(by, order, F.posexplode("doc.items").alias("place", "i")).select(by, order, "place", "i.*")
    return heads, items


def run_extraction(submissions: DataFrame, lines: DataFrame, provider: Callable[[str], str], by: str = "submission_id", order: str = "line_no", size: int = 150) -> tuple[DataFrame, DataFrame]:
    """Submissions with extraction_status done or failed, and their items: lines in chunks, each asked of the provider, answers parsed and merged.
    A submission without lines fails."""
    heads, items = merge_chunks(parse_answers(ask_provider(text_chunks(lines, by, order, size), provider)), by)
    done = submissions.drop("extraction_status").join(heads.select(by, "currency", "n_failed", F.col("status").alias("extraction_status")), by, "left")
    return done.withColumn("extraction_status", F.coalesce("extraction_status", F.lit("failed"))), items


def sheet_chunks(cells: DataFrame, keyword: str = "중분류", top: int = 10, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """All sheets' lines in chunks of one value of the column whose header holds the keyword (chunk, text, n_lines), the header before each,
    and the sheets without such a column, which need a choice."""
    head = find_keyword(cells, keyword, top).withColumnRenamed("row", "header").withColumnRenamed("col", "group_col")
    lines = sheet_lines(cells)
    value = cells.join(head, SHEET).where("col = group_col").select(*SHEET, "row", S.strip(F.col("value")).alias("v"))
    body = lines.join(head, SHEET).where("row > header").join(value, [*SHEET, "row"], "left")
    last = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("label", F.last(F.nullif("v", F.lit("")), ignorenulls=True).over(last))
    first = lines.join(head, SHEET).where("row = header").select(*SHEET, F.col("line").alias("title"))
    parts = runs(body, SHEET, "row", "label", most).groupBy(*SHEET, "run", "chunk").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "line")))["line"], "\n").alias("body"), F.count("*").alias("n_lines"))
    chunks = parts.join(first, SHEET).select(*SHEET, "run", "chunk", F.concat_ws("\n", "title", "body").alias("text"), "n_lines")
    return chunks, cells.select(*SHEET).distinct().join(head, SHEET, "left_anti")


def ask_provider(chunks: DataFrame, provider: Callable[[str], str], text: str = "text", retries: int = 2) -> DataFrame:
    """chunks with `answer`, from any callable; a chunk that fails after all retries has a null answer and its error."""
    ship(chunks.sparkSession)
    schema = f"{', '.join(f'`{n}` {t}' for n, t in chunks.dtypes)}, answer string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for t in pdf[text]:
                answer = error = None
                for _ in range(retries + 1):
                    try:
                        answer, error = provider(t), None
                        break
                    except Exception as e:  # a provider may fail in any way
                        error = str(e)
                answers.append(answer)
                errors.append(error)
            yield pdf.assign(answer=answers, error=errors)

    return chunks.mapInPandas(run, schema)
