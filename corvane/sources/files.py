"""Readers that turn files into documents (doc_id, source, page_content, metadata)."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx

#: File name endings and what reads them.
TYPES = {"txt": "text", "md": "markdown", "markdown": "markdown", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf", "xlsx": "excel", "xls": "excel"}


def source_type(path: Column) -> Column:
    """web for a URL, else by the ending of the name, else unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])
    return F.when(path.rlike(r"^(?i)https?://"), "web").otherwise(F.coalesce(F.element_at(known, ending), F.lit("unknown")))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are that, else as ISO-8859-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path or its last part matches one of the shell patterns."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    out = F.lit(False)
    for p in patterns:
        regex = "^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"
        out = out | path.rlike(f"(?s){regex}") | name.rlike(f"(?s){regex}")
    return out


def as_documents(df: DataFrame, source: Column, content: Column, metadata: Column, page: Column | None = None) -> DataFrame:
    page = page if page is not None else F.lit("")
    return df.select(tx.document_id(source, page, content).alias("doc_id"), source.alias("source"), content.alias("page_content"), metadata.alias("metadata")).where(tx.strip(F.col("page_content")) != "")


def directory(spark: SparkSession, path: str, endings: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, type): files below a folder, without reading their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    files = files.withColumn("type", source_type(F.col("path")))
    if endings:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin([e.lower().lstrip(".") for e in endings]))
    return files.where(~excluded(F.col("path"), exclude)) if exclude else files


def directory_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("type").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _whole(spark: SparkSession, path: str, names: str | None) -> DataFrame:
    """Files below a folder with their contents; ``names``: a glob that their names match."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", names) if names else reader).load(path)


def text_files(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """Each file a document; metadata char_count and line_count."""
    raw = _whole(spark, path, names).select("path", decoded(F.col("content")).alias("t"))
    return as_documents(raw, F.col("path"), F.col("t"), text_metadata(F.col("t")))


def text_metadata(c: Column) -> Column:
    return F.create_map(F.lit("char_count"), F.length(c).cast("string"), F.lit("line_count"), (tx.count(c, "\n") + 1).cast("string"))


def markdown_metadata(c: Column) -> Column:
    return F.create_map(F.lit("title"), tx.markdown_title(c), F.lit("has_code_blocks"), F.contains(c, F.lit("```")).cast("string"), F.lit("heading_count"), tx.count(c, "\n#").cast("string"))


def markdown_files(spark: SparkSession, path: str, strip: bool = False, names: str | None = None) -> DataFrame:
    raw = _whole(spark, path, names).select("path", decoded(F.col("content")).alias("t"))
    return as_documents(raw, F.col("path"), tx.strip_markdown(F.col("t")) if strip else F.col("t"), markdown_metadata(F.col("t")))


def row_text(columns: list[str], joiner: str = "\n") -> Column:
    """Lines ``column: value`` of the values that are not blank."""
    return F.concat_ws(joiner, *[F.when(tx.strip(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), tx.strip(F.col(c).cast("string")))) for c in columns])


def csv_files(spark: SparkSession, path: str, content: list[str] | None = None, sep: str = ",", quote: str = '"', encoding: str = "UTF-8", joiner: str = "\n") -> DataFrame:
    """Each row with a value a document."""
    raw = spark.read.option("header", "true").option("sep", "\t" if path.endswith(".tsv") else sep).option("quote", quote).option("encoding", encoding).csv(path)
    columns = content or raw.columns
    rest = [c for c in raw.columns if c not in columns]
    metadata = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.expr("cast(map() as map<string,string>)")
    return as_documents(raw, F.lit(path), row_text(columns, joiner), metadata)


def json_text(v: str) -> Column:
    """Lines ``key: value`` of a JSON object's values; nested values as JSON, nulls and empty ones go."""
    entries = F.map_entries(F.from_json(F.col(v), "map<string,string>"))
    return F.array_join(F.transform(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def json_lines(spark: SparkSession, path: str, content_key: str | None = None) -> DataFrame:
    """Each valid line a document; blank and broken lines go."""
    raw = spark.read.text(path).where(F.try_parse_json("value").isNotNull() & (F.trim("value") != ""))
    content = F.get_json_object("value", f"$.{content_key}") if content_key else json_text("value")
    return as_documents(raw, F.lit(path), content, F.create_map(F.lit("raw"), F.col("value")))


def json_files(spark: SparkSession, path: str, content_key: str | None = None) -> DataFrame:
    """A list's elements, or a file's one object, are documents; a lone value is {"value": it}."""
    whole = spark.read.text(path, wholetext=True)
    trimmed = tx.strip(F.col("value"))
    records = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<string>")).when(trimmed.startswith("{"), F.array(trimmed)).otherwise(F.array(F.concat(F.lit('{"value": '), trimmed, F.lit("}"))))
    raw = whole.select(F.posexplode(records).alias("i", "value"))
    content = F.get_json_object("value", f"$.{content_key}") if content_key else json_text("value")
    return as_documents(raw, F.lit(path), content, F.create_map(F.lit("record_index"), F.col("i").cast("string")))


def sanitised(metadata: Column) -> Column:
    """A string map without nulls."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull())
