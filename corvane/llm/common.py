"""What the operators of this subpackage share: inputs, held-out folds, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir

__all__ = ["WORD", "fold", "fresh", "give_back", "new_path", "open_path", "read", "shared_dir", "written"]

#: One word: a run of bytes other than ASCII white space. Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"


def open_path(path: str) -> tuple[pa.fs.FileSystem, str]:
    """A path's file system: a URI of any kind that pyarrow knows, or a local path."""
    path = re.sub(r"^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs the rereading of a few files, and
    what follows sees the same rows in every pass.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands memory that is free in this worker back to the system: workers live on, and the next task's may be another stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fold(id_column: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
