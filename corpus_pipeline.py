"""From raw documents to token ids: the stages of a training-text pipeline.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``, with ``n_chars`` of
the text as it then is. An empty table gives an empty table, and further columns
are kept as they are, whatever their names. Rows that repeat an id are rows of
their own until near_dedup, which judges each by its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fold, fresh, read, written
from corvane.llm.language import UNKNOWN, identify
from corvane.llm.mixing import mix, words
from corvane.llm.near_copies import drop_near_copies
from corvane.llm.pieces import encode_pieces
from corvane.llm.substring import deduplicate

#: A document whose language is less sure than this is rejected.
LEAST_SURE = 0.4


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    known = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return df.withColumns(known).select([F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told or is unsure; ``lang`` becomes the predicted language.

    Null texts and those without a letter go. A null ``lang`` teaches nothing
    and is filled; a null id counts as the empty text in the choice of rows.
    """
    said, sure = fresh(docs.columns, "__lang", "__sure")
    found = identify(docs, fold("doc_id", 4) != 2, pred=said, score=sure).where((F.col(said) != UNKNOWN) & (F.col(sure) >= LEAST_SURE))
    return found.withColumn("lang", F.col(said)).select([F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the smallest id.

    Null and empty texts are copies of each other. Of rows that share an id
    each is judged by its text; a group without ids keeps one row.
    """
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every repeat of a passage of twenty words or more but the first; null texts become empty, no row goes."""
    words_, removed = fresh(docs.columns, "__words", "__removed")
    return _as_documents(deduplicate(docs, words=words_, removed=removed), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often, 0 to 2 times, as its source's target wants; a second copy is a second row.

    A null source is a source of its own, the last; texts without words are never taken.
    """
    names = tuple(fresh(docs.columns, "__size", "__source_size", "__target", "__copies"))
    (again,) = fresh([*docs.columns, *names], "__copy")
    mixed = mix(docs, size=words("text"), names=names).where(F.col(names[3]) > 0)
    return mixed.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select([F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and hashes of the ids and of the text that they decode to; a null or empty text has no ids."""
    return encode_pieces(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: None: SQL can't express the language machines, fingerprints or id tables; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
