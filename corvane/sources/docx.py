"""Word files as rows (path, pos, kind, text)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs(content: bytes) -> Iterator[tuple[str, str]]:
    """(kind, text) of headings, marked by level, paragraphs and, last, tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") if style is not None else "") or ""
        if text := said(p):
            level = int(name.removeprefix("Heading")) if name.startswith("Heading") and name[7:].isdigit() else 0
            yield ("heading", "#" * level + " " + text) if level else ("paragraph", text)
    for table in body.findall(f"{_W}tbl"):
        rows = [" | ".join(said(c) for c in r.findall(f"{_W}tc")) for r in table.findall(f"{_W}tr")]
        yield "table", "\n".join(r for r in rows if r.replace("|", "").strip())


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [(i, k, *x) for i, c in enumerate(batch.column(1).to_pylist()) for k, x in enumerate(paragraphs(c))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *(pa.array([f[j] for f in found], t) for j, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string())))], names=["path", "pos", "kind", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, pos int, kind string, text string")
