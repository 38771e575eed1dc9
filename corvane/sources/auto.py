"""Whatever a path holds: the reader by type of file, documents cut into chunks, checks before reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunkers
from corvane.sources import docx, excel, files, html

COLUMNS = ["doc_id", "source", "page_content", "metadata"]


def _docx(spark: SparkSession, path: str) -> DataFrame:
    """A Word file's pieces, in order, as one document."""
    parts = docx.docx_files(spark, path).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return files.as_documents(parts, F.col("path"), F.col("t"), F.expr("cast(map() as map<string,string>)"))


def _html(spark: SparkSession, path: str) -> DataFrame:
    raw = files._whole(spark, path, "{*.html,*.htm}").select("path", files.decoded(F.col("content")).alias("html"))
    found = html.extract(raw, "path").where("kind = 'text'").join(raw.select("path", html.title(F.col("html")).alias("title")), "path")
    return files.as_documents(found, F.col("path"), F.col("content"), F.map_filter(F.create_map(F.lit("title"), F.col("title")), lambda k, v: v.isNotNull()))


#: Readers of whole folders, each of which picks the files of its type by name, and readers of one file, whose columns are its own.
FOLDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "text": lambda spark, path: files.text_files(spark, path, "*.txt"),
    "markdown": lambda spark, path: files.markdown_files(spark, path, names="{*.md,*.markdown}"),
    "html": _html,
    "docx": _docx,
    "excel": excel.excel_documents,
}
SINGLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"csv": files.csv_files, "json": files.json_files, "jsonl": files.json_lines}


def load(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """Documents (doc_id, source, page_content, metadata) of all files of a known type below a folder or of one file.

    Files are listed once. CSV and JSON files are read one by one, as each has
    columns of its own, so their names come to the driver; all other types are
    one scan each. Types without a reader here (PDF, unknown) give no documents:
    see ``unread``.
    """
    listed = files.directory(spark, path, exclude=exclude)
    parts = []
    for kind in sorted(r.type for r in listed.select("type").distinct().collect()):  # a handful of types
        mine = listed.where(F.col("type") == kind)
        if kind in FOLDERS:
            found = FOLDERS[kind](spark, path).select(COLUMNS)
            parts.append(found.join(mine.select(F.col("path").alias("source")), "source", "left_semi").select(COLUMNS) if exclude else found)
        elif kind in SINGLE:
            parts += [SINGLE[kind](spark, r.path).select(COLUMNS) for r in mine.select("path").toLocalIterator()]
    out = parts[0] if parts else spark.createDataFrame([], "doc_id string, source string, page_content string, metadata map<string,string>")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unread(spark: SparkSession, path: str) -> DataFrame:
    """Files that no reader here takes."""
    return files.directory(spark, path).where(~F.col("type").isin([*FOLDERS, *SINGLE]))


def problems(listed: DataFrame, most: int = 100 << 20) -> DataFrame:
    """``listed`` files with ``problem``: empty, too large, of an unknown type; null if there is none."""
    return listed.withColumn("problem", F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large").when(F.col("type") == "unknown", "unknown type"))


def load_and_split(spark: SparkSession, path: str, mode: str = "structural") -> DataFrame:
    """The chunks of all documents below a folder."""
    return chunkers.chunked(load(spark, path), mode, text="page_content")
