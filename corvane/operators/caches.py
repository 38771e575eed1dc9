"""Caches and states as tables: keys, hits within a time to live, statistics, feedback that is saved and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx


def query_key(query: Column, filters: Column | None = None) -> Column:
    """md5 of the question, trimmed and lower-cased, and of its filters (a string map) in order of their keys."""
    raw = F.lower(tx.strip(query))
    if filters is not None:
        raw = F.concat(raw, F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(filters)))), F.lit("")))
    return F.md5(raw)


def replayed(requests: DataFrame, ttl_seconds: int, key: str = "key", at: str = "at", by: list[str] | None = None) -> DataFrame:
    """``requests`` with ``hit``: whether the same key was put within the time to live, for a cache that holds every key and renews on a miss.

    Between misses a key's entry ages from the miss that put it; so each key's
    requests are folded in order of time, inside the JVM.
    """
    rest = [c for c in requests.columns if c != key]
    ordered = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("__at"), *[F.col(c) for c in rest]))).alias("r"))
    start = F.struct(F.lit(None).cast(requests.schema[at].dataType).alias("put"), F.expr("cast(array() as array<boolean>)").alias("hits"))

    def step(a: Column, x: Column) -> Column:
        hit = F.coalesce(F.unix_micros(x["__at"].cast("timestamp")) - F.unix_micros(a["put"].cast("timestamp")) <= ttl_seconds * 1_000_000, F.lit(False))
        return F.struct(F.when(hit, a["put"]).otherwise(x["__at"]).alias("put"), F.array_append(a["hits"], hit).alias("hits"))

    hits = F.aggregate("r", start, step, lambda a: a["hits"])
    return ordered.select(key, F.explode(F.arrays_zip(F.col("r"), hits.alias("hit"))).alias("x")).select(key, *[F.col(f"x.r.{c}").alias(c) for c in rest], F.col("x.hit").alias("hit"))


def stats(replay: DataFrame, key: str = "key") -> DataFrame:
    """size, hits, misses and hit_rate of a replayed cache."""
    out = replay.agg(F.count_distinct(key).alias("size"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 6))


def save_state(state: DataFrame, path: str) -> None:
    """Feedback, metrics or any other state as Parquet, whole or not at all."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved state; an empty one of ``schema`` where nothing was saved."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def enriched_query(history: DataFrame, current: DataFrame, n: int = 2) -> DataFrame:
    """(conv_id, query): a question after its conversation's last n answered ones; history: conv_id, turn, query, answer."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = history.withColumn("k", k).where(F.col("k") <= n).where((F.col("query") != "") & (F.col("answer") != ""))
    qa = F.concat(F.lit("Q: "), "query", F.lit("\nA: "), "answer")
    told = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", qa.alias("qa")))), lambda x: x["qa"]), "\n\n").alias("told"))
    whole = F.concat(F.lit("[Previous conversation:\n"), "told", F.lit("]\n\nCurrent question: "), "query")
    return current.join(told, "conv_id", "left").select("conv_id", F.coalesce(whole, F.col("query")).alias("query"))
