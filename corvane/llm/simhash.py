"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

Fingerprints are made per task, one pass over the text. Documents that share a
fingerprint are one class from then on, so thousands of copies are one row.
Links between classes: the 64 bits are four quarters, and each of four tables
indexes a 48-bit segment, all quarters but one. Two fingerprints at two bits or
fewer differ in the left-out quarter of some table alone, or by one further bit
in its segment. So each fingerprint probes a table with its own segment and with
the ball of segments one bit away, and the complete distance of what it meets is
verified. Probes only ever set a bit, which finds each pair from one side, and a
ball leaves out the quarters before the table's own, whose pairs an earlier
table finds. Keys of 48 bits keep buckets near the size of the true links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fresh, give_back, read, written
from corvane.llm.components import components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = 256 * np.arange(8)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 if it has no words."""
    w = (text or "").encode().lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
    return fold_bits(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64))


def fold_bits(h: np.ndarray) -> int:
    """The bits set in over half of some hashes, as a signed 64-bit integer; 0 for no hashes."""
    if not len(h):
        return 0
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(h), 1 << 20):
        lanes = h[at : at + (1 << 20)].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048)
    ones = np.einsum("kv,vb->kb", counts.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of each row."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])
        give_back()

    return out.mapInArrow(run, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): pairs of different fingerprints ``fp`` at two bits or fewer, each once."""
    fp = F.col("fp")
    segments = [(t, ~(0xFFFF << (16 * t)) & 0xFFFFFFFFFFFFFFFF) for t in range(4)]
    signed = [(t, m - (1 << 64) if m >> 63 else m) for t, m in segments]
    table = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in signed])).alias("s")).select("s.t", "s.key", F.col("fp").alias("v"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))
    own = table.select("t", "key", F.col("v").alias("u"), F.lit(False).alias("moved"))
    ball = (
        table.where("t < 3")
        .select("t", "key", F.col("v").alias("u"), F.explode(F.sequence(F.lit(16) * (F.col("t") + 1), F.lit(63))).alias("b"))
        .where(F.col("key").bitwiseAND(bit) == 0)
        .select("t", F.col("key").bitwiseOR(bit).alias("key"), "u", F.lit(True).alias("moved"))
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    return own.union(ball).join(table, ["t", "key"]).where(near & (F.col("moved") | (F.col("u") < F.col("v")))).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    component_id is the smallest id among the documents reachable over links,
    the row's own included. Null, empty and white-space texts have fingerprint
    zero and are linked like any other; a text of fewer words than a shingle is
    one shingle. Repeated rows stay repeated. A null id never becomes a
    component_id; a component of such rows alone has none. Other columns are not
    read.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _found(texts, words, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _found(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row."""
    prints = written(fingerprints(texts, "doc_id", "text", words, seed), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    rooted = components(links(classes.select("fp")))
    named = classes.join(rooted, classes.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = named.where("root <> fp").select("root").distinct()
    groups = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("reached"))
    named = named.join(groups, "root", "left").select("fp", "root", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text: str, kind: str, kind_of: Callable[[str | None], int]) -> DataFrame:
    """``docs`` with one row of each component of ``found`` (doc_id, ``kind``, root, component_id).

    The row kept has the id that names the component and, of the kinds of text
    that stand under this id there, the smallest; if rows repeat both, one stays.
    A component without ids keeps one row of its smallest kind. ``kind_of`` gives
    a text's kind as found; it is worked out again only for ids that stay and
    stand in several rows.
    """
    found = written(found, "found")
    kept, wants, sort = fresh(docs.columns, "__stay", "__least", "__kind")
    mine, names_it = F.col(f"`{id_col}`"), F.col("doc_id") == F.col("component_id")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(names_it).alias("stays")).where("stays")
    once = docs.join(ids.where("n = 1").select(F.col("doc_id").alias(kept)), mine == F.col(kept), "left_semi")
    named = found.where(names_it | F.col("component_id").isNull()).groupBy("root", F.col("component_id").alias(kept)).agg(F.min(kind).alias(wants))
    several = ids.where("n > 1").select(F.col("doc_id").alias(kept))
    wanted = named.join(several, kept, "left_semi").select(kept, wants).union(named.where(F.col(kept).isNull()).select(kept, wants))
    wanted = written(wanted, "wanted")
    names, at = docs.columns, docs.columns.index(text)

    def kinds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([kind_of(x.as_py()) for x in batch.column(at)], pa.int64())], names=[*names, sort])

    some = docs.join(wanted.select(kept).distinct(), mine.eqNullSafe(F.col(kept)), "left_semi")
    typed = some.mapInArrow(kinds, T.StructType([*docs.schema.fields, T.StructField(sort, T.LongType())]))
    again = typed.join(wanted, mine.eqNullSafe(F.col(kept)) & (F.col(sort) == F.col(wants)), "left_semi")
    # Of rows that repeat id and kind one stays: a combined aggregate over whole rows.
    first = again.groupBy(mine.alias("i"), F.col(sort).alias("k")).agg(F.first(F.struct(*[F.col(f"`{n}`") for n in names])).alias("row"))
    return once.union(first.select("row.*"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: one of those whose id names it, of the smallest fingerprint.

    Rows are told apart by id and fingerprint, so of rows that share an id but
    not a text each is judged by its own text. A component of rows without an id
    keeps one of them. An empty table stays empty; all columns are kept.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = _found(texts, words, seed)
    return one_of_each(docs, found, id_col, text, "fp", lambda t: fingerprint(t, words, seed))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
