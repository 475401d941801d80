"""Reading sheets and writing reports as tables."""
from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.roles import unique_headers
from .files import open_file
from .stage import staged


def read_sheet(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table of parquet, csv, json or xlsx with headers made unique; empty tables are
    an error.  Text formats keep all columns as text, which the number functions read."""
    format = format or path.rsplit(".", 1)[-1].lower()
    if format == "xlsx":
        spark.dataSource.register(SheetSource)
        df = spark.read.format("sheet").options(**options).load(path)
    elif format == "csv":
        # headers by position: Spark would number every one of a repeated name, the first too
        header = spark.read.options(**{**options, "header": "false"}).csv(path).first()
        if header is None:
            raise ValueError(f"no rows in {path}")
        names = unique_headers(h or f"column_{i}" for i, h in enumerate(header, 1))
        df = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).options(**{**options, "header": "true"}).csv(path)
    else:
        df = spark.read.format(format).options(**options).load(path)
    df = df.toDF(*unique_headers(df.columns))
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def first_named(df: DataFrame, name: str) -> Column:
    """The first of the columns that a sheet had under a name, which keeps it when
    read_sheet() numbers the others; null numbers where there is none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("double")


def with_row_id(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """_row_id that keeps the order of the input files (unique, increasing), or numbers
    from 1 by given columns where the order must not depend on the layout: rows are
    sorted by ranges, numbered within them, and each range starts after those before."""
    if not order:
        return df.withColumn("_row_id", F.monotonically_increasing_id())
    rows = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(parts), "_part").withColumn("_row_id", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


class SheetSource(DataSource):
    """One worksheet of an xlsx workbook; option `sheet` names it (default: the first)."""

    @classmethod
    def name(cls):
        return "sheet"

    def _rows(self) -> Iterator[list[str | None]]:
        with open_file(self.options["path"]) as f:
            yield from workbook_rows(f, self.options.get("sheet"))

    def schema(self):
        header = next(self._rows(), None)
        if header is None:
            raise ValueError("the sheet is empty")
        return ", ".join(f"`{h.replace('`', '')}` string" for h in unique_headers(c or f"column_{i + 1}" for i, c in enumerate(header)))

    def reader(self, schema):
        return SheetReader(self, len(schema))


class SheetReader(DataSourceReader):
    def __init__(self, source: SheetSource, width: int):
        self.source, self.width = source, width

    def partitions(self):
        return [InputPartition(0)]  # a worksheet is one compressed stream

    def read(self, partition):
        rows = self.source._rows()
        next(rows, None)
        for r in rows:
            if any(v not in (None, "") for v in r):
                yield tuple((r + [None] * self.width)[: self.width])


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Member of each worksheet by its name, in the workbook's order."""
    ident = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return {s.get("name"): "xl/" + links[s.get(ident)].removeprefix("/xl/") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")}


def sheet_names(path: str) -> list[str]:
    """The worksheets of a workbook, to choose from where there are several."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        return list(_sheets(z))


def _elements(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a member one by one; each is emptied after its use, and the tree above
    holds none."""
    with book.open(member) as f:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if e.tag == MAIN + tag:
                yield e
                e.clear()
                if path:
                    path[-1].remove(e)


def workbook_rows(file, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of a worksheet as text, row by row as they are read; only the workbook's
    shared texts are held."""
    text_of = lambda e: "".join(t.text or "" for t in e.iter(MAIN + "t"))
    with zipfile.ZipFile(file) as z:
        sheets = _sheets(z)
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(sheets)}")
        shared = "xl/sharedStrings.xml"
        strings = [text_of(e) for e in _elements(z, shared, "si")] if shared in z.namelist() else []
        for row in _elements(z, sheets[sheet] if sheet else next(iter(sheets.values())), "row"):
            cells: dict[int, str | None] = {}
            for c in row:
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = 0
                for ch in letters.group() if letters else "":
                    at = at * 26 + ord(ch) - 64
                v = c.find(MAIN + "v")
                kind = c.get("t")
                text = text_of(c) if kind == "inlineStr" else None if v is None else v.text
                cells[at - 1 if at else len(cells)] = strings[int(text)] if kind == "s" and text is not None else text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def write_report(neighbours: DataFrame, diagnostics: DataFrame, excluded: DataFrame, flagged: DataFrame, path: str, format: str = "parquet") -> None:
    """The four tables of a report below a folder; diagnostics as key and value."""
    keys = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in diagnostics.columns]
    flat = diagnostics.select(F.explode(F.array(*keys)).alias("kv")).select("kv.*")
    for name, df in (("comparables", neighbours), ("diagnostics", flat), ("excluded", excluded), ("flagged", flagged)):
        flatten = [F.array_join(c, "; ").alias(c) if t.startswith("array<string") and format == "csv" else F.col(f"`{c}`") for c, t in df.dtypes]
        writer = df.select(*flatten).write.mode("overwrite")
        (writer.option("header", "true").csv if format == "csv" else writer.format(format).save)(f"{path}/{name}")


def content_id(path_df: DataFrame) -> DataFrame:
    """(path, sha1) of files read with format binaryFile."""
    return path_df.select("path", F.sha1("content").alias("sha1"))
