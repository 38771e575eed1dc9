"""Excel workbooks (xlsx) as rows (path, sheet, row, values): an archive of XML, read without further libraries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx

_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]+", reference).group():
        out = out * 26 + ord(c) - 64
    return out - 1


def sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cells as text) of each sheet; shared, inline and plain values; missing cells are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [["".join(t.text or "" for t in s.iter(f"{_N}t"))][0] for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_N}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_N}sheet"):
            target = targets[sheet.get(f"{_R}id")]
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_N}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.findall(f"{_N}c")):
                    v = c.find(f"{_N}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_N}t"))
                    else:
                        text = "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells[_column(c.get("r")) if c.get("r") else i] = text
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)] if cells else [])
            yield sheet.get("name"), rows


def excel_files(spark: SparkSession, path: str, content: list[str] | None = None, joiner: str = "\n") -> DataFrame:
    """(path, sheet, row, text, metadata): each row below a sheet's header as lines ``column: value``; rows without values go.

    ``content`` names the columns of the text; the others are metadata.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for name, rows in sheets(raw):
                    for n, row in enumerate(rows[1:]):
                        values = dict(zip(rows[0], row, strict=False))
                        held = {k: v.strip() for k, v in values.items() if v and v.strip()}
                        text = joiner.join(f"{k}: {v}" for k, v in held.items() if content is None or k in content)
                        if text:
                            out.append((i, name, n, text, [(k, v) for k, v in held.items() if content is not None and k not in content]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.string()), pa.array([o[4] for o in out], pa.map_(pa.string(), pa.string()))], names=["path", "sheet", "row", "text", "metadata"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, text string, metadata map<string,string>")


def excel_documents(spark: SparkSession, path: str, **how) -> DataFrame:
    rows = excel_files(spark, path, **how)
    return rows.select(tx.document_id(F.col("path"), F.concat_ws(":", "sheet", F.col("row").cast("string")), F.col("text")).alias("doc_id"), F.col("path").alias("source"), F.col("text").alias("page_content"), "metadata")
