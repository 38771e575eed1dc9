"""Row stores: upsert, delete, fetch, deduplication, and similar pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.let import let
from corvane.session import shared_dir


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace the store's rows of the same key, and add those that it lacks."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def fetch(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_semi")


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key. A combined aggregate finds it, so a key that a third of all rows share is no single task's."""
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(F.struct(*order)).alias("__first")).select(*[F.col(f"__first.{c}").alias(c) for c in order])
    return rows.join(first, order, "left_semi")


def similar_pairs(docs: DataFrame, least: float = 0.3, k: int = 5, text: str = "text", once: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """(a, b, jaccard): pairs of documents whose sets of k-word shingles are alike, each set standing for all documents that have it.

    a and b are the smallest ids of their sets, so thousands of copies are one
    row and not all their pairs; ``copies`` tells which documents a set has.
    Prefix filtering: a pair that reaches ``least`` shares one of the rarest
    shingles of either set. Only these prefixes meet in a join, between sets
    whose sizes allow ``least``; the whole sets of the candidates are then
    compared. ``once`` writes a table that is used several times.
    """
    once = once or (lambda name, build: build())
    classes = once(f"classes-{k}", lambda: _sets(docs, k, text).groupBy(F.xxhash64("set").alias("cls")).agg(F.min("doc_id").alias("least_id"), F.first("set").alias("set")).select(F.col("least_id").alias("id"), "set"))
    each = classes.select("id", F.size("set").alias("n"), F.explode("set").alias("s"))
    # Shingles of one set alone can't bring two together, and are the rarest of all.
    common = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), "s"))
    prefix = once(f"prefix-{k}-{least}", lambda: each.join(common, "s").withColumn("r", rank).where(F.col("r") > F.ceil(F.col("n") * least) - 1).select("id", "n", "s"))
    a, b = prefix.alias("a"), prefix.alias("b")
    sizes = (F.col("a.n") >= least * F.col("b.n") - 1e-9) & (F.col("b.n") >= least * F.col("a.n") - 1e-9)
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.id") < F.col("b.id")) & sizes).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("set").alias("x")), classes.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = let(both, lambda n: F.round(n / (F.size("x") + F.size("y") - n), 6))
    return pairs.join(left, "a").join(right, "b").select("a", "b", alike.alias("jaccard")).where(F.col("jaccard") >= least)


def _sets(docs: DataFrame, k: int, text: str) -> DataFrame:
    return docs.select("doc_id", F.array_sort(F.transform(tx.shingles(F.col(text), k), lambda s: F.xxhash64(s))).alias("set"))


def copies(docs: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, first): the smallest id of the documents that have the same set of shingles."""
    keyed = _sets(docs, k, text).select("doc_id", F.xxhash64("set").alias("cls"))
    return keyed.join(keyed.groupBy("cls").agg(F.min("doc_id").alias("first")), "cls").select("doc_id", "first")


def drop_similar(docs: DataFrame, pairs: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """Drops a row that is alike to an earlier row that stays: rounds of settled rows until none is open.

    ``pairs`` may be between the firsts of ``same`` (doc_id, first); all others go, as what drops a first drops its copies.
    """
    shared_dir(docs.sparkSession)
    edges = pairs.select(F.col("a").alias("early"), F.col("b").alias("late")).checkpoint()
    gone = edges.select(F.col("late").alias("doc_id")).where("false")
    open_edges = edges
    while not open_edges.isEmpty():
        late = open_edges.select(F.col("late").alias("early")).distinct()
        keep = open_edges.select("early").distinct().join(late, "early", "left_anti")
        new = open_edges.join(keep, "early", "left_semi").select("late").distinct()
        gone = gone.union(new.select(F.col("late").alias("doc_id"))).distinct().checkpoint()
        dead = gone.select(F.col("doc_id").alias("early"))
        open_edges = open_edges.join(keep, "early", "left_anti").join(dead, "early", "left_anti").join(gone.select(F.col("doc_id").alias("late")), "late", "left_anti").checkpoint()
    if same is not None:
        gone = gone.union(same.where("doc_id <> first").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")


def running(df: DataFrame, group: str, order: list[str | Column], once: Callable, value: Column | None = None) -> DataFrame:
    """``df`` with ``place`` (from 1) and ``n`` of its row in its group, and ``reached``, the sum of ``value`` up to it.

    No task gets a whole group: rows are dealt in ranges of (group, order), and
    what stands before a range is summed up from a row for each range. ``order``
    must tell rows apart.
    """
    amount = value if value is not None else F.lit(0)
    ranged = once(f"ranged-{group}", lambda: df.withColumn("__amount", amount.cast("long")).repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id()))
    whole, ranges = Window.partitionBy("g"), Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col(group).alias("g"), F.col("__part").alias("p")).agg(F.count("*").alias("c"), F.sum("__amount").alias("s"))
    before = sums.select("g", "p", F.sum("c").over(whole).alias("n"), F.coalesce(F.sum("c").over(ranges), F.lit(0)).alias("c"), F.coalesce(F.sum("s").over(ranges), F.lit(0)).alias("s"))
    here = Window.partitionBy(group, "__part").orderBy(*order)
    inside = ranged.withColumns({"__row": F.row_number().over(here), "__sum": F.sum("__amount").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    joined = inside.join(before, F.col(group).eqNullSafe(F.col("g")) & (F.col("__part") == F.col("p")))
    return joined.select(*df.columns, (F.col("c") + F.col("__row")).alias("place"), "n", (F.col("s") + F.col("__sum")).alias("reached"))


def within_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, fits): rows of each group in order, each taken if it still fits; one that does not is passed over.

    Whether a row fits depends on all before it, so a group's rows (three
    numbers each) stream through one task, which holds one sum and no row.
    """
    kept = df.select(group, order, F.col(size).cast("long").alias("size"))
    schema = f"{group} {df.schema[group].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, fits boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = object(), 0
        for batch in batches:
            fits = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != last:
                    last, used = g, 0
                fits.append(used + n <= budget)
                used += n * fits[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fits, pa.bool_())], names=[group, order, "fits"])

    return kept.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)
