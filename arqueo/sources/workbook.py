"""Cells of XLSX workbooks (zip and XML, no formulas are run), and the tables of their sheets."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions.identity import header_key
from arqueo.functions.readings import money
from arqueo.functions.text import identifier
from arqueo.session import ship

SCHEMA = "sheet string, row int, col int, value string, is_formula boolean"
#: A workbook that unpacks to more bytes is refused.
MAX_BYTES = 100_000_000
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def cells(data: bytes, max_bytes: int = MAX_BYTES):
    """(sheet, row, column, value, is_formula) of every cell with a value or formula; of a formula the text is given."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > max_bytes:
            raise ValueError(f"the workbook unpacks to more than {max_bytes} bytes")
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = rels[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}c"):
                letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                formula, v = c.find("m:f", _NS), c.find("m:v", _NS)
                if formula is not None:
                    yield sheet.get("name"), int(row), col, "=" + (formula.text or ""), True
                elif c.get("t") == "inlineStr":
                    yield sheet.get("name"), int(row), col, "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), False
                elif v is not None:
                    yield sheet.get("name"), int(row), col, shared[int(v.text)] if c.get("t") == "s" else v.text, False


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the workbooks at a path of any file system, one task for each: sheet, row, col, value, is_formula."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                rows = list(cells(content))
                if rows:
                    yield pd.DataFrame(rows, columns=["sheet", "row", "col", "value", "is_formula"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def sheet_table(book: DataFrame, sheet: str, columns: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows below the header of a sheet: sheet, row, the columns as text, and formulas, the names of those that hold one (their value is null).

    columns, optional: name -> header spellings, compared by letters and digits without accents. A missing sheet or mandatory header, and two headers
    for one column, raise ValueError; rows whose first column is empty are left out. The header is read by the driver: one row.
    """
    own = book.filter(F.col("sheet") == sheet)
    keys = {header: name for name, headers in {**columns, **(optional or {})}.items() for header in headers}
    heads = own.filter("row = 1").select("col", header_key(F.col("value")).alias("key")).collect()
    if not heads:
        raise ValueError(f"no sheet {sheet}, or it has no header")
    found: dict[str, int] = {}
    for r in heads:
        name = keys.get(r["key"])
        if name in found:
            raise ValueError(f"{sheet}: two columns for {name}")
        if name:
            found[name] = r["col"]
    missing = [n for n in columns if n not in found]
    if missing:
        raise ValueError(f"{sheet}: no columns {missing}")
    x = own.filter("row > 1").groupBy("sheet", "row").agg(
        *[F.max(F.when((F.col("col") == c) & ~F.col("is_formula"), F.col("value"))).alias(n) for n, c in found.items()],
        F.array_compact(F.array(*[F.max(F.when((F.col("col") == c) & F.col("is_formula"), F.lit(n))) for n, c in found.items()])).alias("formulas"),
        F.max(F.when(F.col("col") == found[next(iter(columns))], F.col("value"))).alias("__first"),
    )
    return x.filter(F.trim("__first") != "")


def master(book: DataFrame, sheets: dict[str, dict[str, list[str]]]) -> dict[str, DataFrame]:
    """``sheet_table`` of each mandatory sheet; any that is missing is an error."""
    return {name: sheet_table(book, name, columns) for name, columns in sheets.items()}


def history(book: DataFrame, sheet: str, columns: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, notes, warnings) of an optional sheet whose columns are order and total, at least; all empty if it isn't there.

    A row whose order is a formula or no order number is a note: its text and place. A total that is a formula or can't be read is null and gives a warning.
    """
    empty = book.filter("false").select("sheet", "row", F.lit("").alias("__first"))
    if book.filter(F.col("sheet") == sheet).limit(1).count() == 0:
        return empty.select("sheet", "row", F.col("__first").alias("order"), F.lit("").alias("total")), empty.select("sheet", "row", F.col("__first").alias("text")), empty.select("sheet", "row", F.col("__first").alias("order"), F.lit("").alias("reason"))
    x = sheet_table(book, sheet, columns, optional).withColumn("__key", identifier(F.col("__first")))
    is_order = ~F.array_contains("formulas", "order") & F.col("__key").rlike("^PO-[0-9]{4}-[A-Z0-9-]+$")
    total = money(F.col("total"))
    rest = [c for c in x.columns if c not in ("sheet", "row", "order", "total", "formulas") and not c.startswith("__")]
    orders = x.filter(is_order).select("sheet", "row", F.col("__key").alias("order"), total.cast("string").alias("total"), *rest)
    return orders, x.filter(~is_order).select("sheet", "row", F.col("__first").alias("text")), x.filter(is_order & total.isNull()).select("sheet", "row", F.col("__key").alias("order"), F.lit("unreadable_total").alias("reason"))


def sheet_page(book: DataFrame, sheet: str, page: int = 1, column_page: int = 1, rows: int = 50, columns: int = 8) -> DataFrame:
    """A page of a sheet as a viewer shows it: row, col and value, formulas as their text. Page numbers below one count as one."""
    r, c = (max(1, page) - 1) * rows, (max(1, column_page) - 1) * columns
    return book.filter((F.col("sheet") == sheet) & F.col("row").between(r + 1, r + rows) & F.col("col").between(c + 1, c + columns)).select("row", "col", "value").orderBy("row", "col")
