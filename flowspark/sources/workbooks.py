"""Workbooks of points: zipped XML sheets as rows, and the points of a summary sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.functions.text import entrance_type, point_type

#: Fixed value: the status of points before any row states one.
UNVERIFIED = "待验证"
#: Fixed value: the heading of the column of point ids.
HEADING = "点位编号"


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    """All text of a string item, but for phonetic hints."""
    return "".join(t.text or "" for part in node for t in ([part] if _plain(part.tag) == "t" else part if _plain(part.tag) == "r" else []) if _plain(t.tag) == "t")


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, column number from 0 -> text) of a sheet, row by row; a missing sheet is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        named = {n.get("name"): next(v for k, v in n.attrib.items() if _plain(k) == "id") for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _plain(n.tag) == "sheet"}
        if sheet not in named:
            raise ValueError(f"no sheet {sheet}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[named[sheet]]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        number = 0
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, node in ElementTree.iterparse(f):
                if _plain(node.tag) != "row":
                    continue
                number = int(node.get("r") or number + 1)
                cells, at = {}, -1
                for c in node:
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else at + 1
                    value = next((v.text for v in c if _plain(v.tag) == "v"), None)
                    kind = c.get("t")
                    inline = next((_texts(v) for v in c if _plain(v.tag) == "is"), None)
                    text = inline if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                    if text is not None:
                        cells[at] = text
                yield number, cells
                node.clear()


def read_workbook(spark: SparkSession, path: str, sheet: str = "Sheet1", columns: int = 12) -> DataFrame:
    """(path, row_no, cells: array of ``columns`` texts) of a sheet of each workbook at ``path``; a workbook a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(sheet_rows(content, sheet))
                cells = [[c.get(i) for i in range(columns)] for _, c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["path", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no long, cells array<string>")


def _cell(i: int) -> Column:
    """A cell's text without white space around it; null where there is none."""
    return F.trim(F.get("cells", F.lit(i)))


def points(rows: DataFrame, excluded: Column | None = None) -> DataFrame:
    """Points of a summary sheet, by name: (name, point_id, category, longitude, latitude, status, entrance_type, point_type).

    Columns: E the id, F the category, G and H the old and the new name, J and K the place, L the status. Rows without an
    id or a name, headings, and rows that ``excluded`` (of point_id and name) tells are left out. A row without a status
    has that of the last row kept before it in its sheet. Of rows of one name, the last counts.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    told = rows.select("path", "row_no", blank(_cell(4)).alias("point_id"), _cell(5).alias("category"), F.coalesce(blank(_cell(7)), blank(_cell(6))).alias("name"), F.get("cells", F.lit(9)).cast("double").alias("longitude"), F.get("cells", F.lit(10)).cast("double").alias("latitude"), blank(_cell(11)).alias("stated"))
    kept = told.where(F.col("point_id").isNotNull() & (F.col("point_id") != HEADING) & F.col("name").isNotNull())
    kept = kept if excluded is None else kept.where(~F.coalesce(excluded, F.lit(False)))
    upto = Window.partitionBy("path").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = kept.withColumn("status", F.coalesce(F.last("stated", ignorenulls=True).over(upto), F.lit(UNVERIFIED)))
    last = filled.groupBy("name").agg(F.max_by(F.struct("point_id", "category", "longitude", "latitude", "status"), F.struct("path", "row_no")).alias("p")).select("name", "p.*")
    return last.withColumns({"entrance_type": entrance_type(F.col("category")), "point_type": point_type(F.col("category"))})
