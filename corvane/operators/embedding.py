"""Text into vectors: a pluggable encoder over Arrow batches, a cache that splits known texts from new ones, batches, costs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import vectors as vx

#: US dollars for a million tokens; fixed values.
PRICES = {"text-embedding-3-large": 0.13, "text-embedding-3-small": 0.02, "text-embedding-ada-002": 0.10, "mistral-embed": 0.10}


def hashed(c: Column, buckets: int = 256) -> Column:
    """Counts of a text's words by bucket, at length one, with built-in functions alone; a text without words is the zero vector."""
    spots = F.transform(tx.tokens(c), lambda w: vx.term_bucket(w, buckets))
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(spots, lambda s: s == b)).cast("double"))
    return vx.normalised(counts)


def with_retry(encode: Callable[[list[str]], np.ndarray], tries: int = 3, wait: float = 0.0) -> Callable[[list[str]], np.ndarray]:
    """``encode`` again, waiting twice as long each time, when it raises; the last error is raised."""

    def run(texts: list[str]) -> np.ndarray:
        for n in range(tries):
            try:
                return encode(texts)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    return run


def encoded(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], id_col: str = "doc_id", text: str = "text", batch: int = 32, normalise: bool = True) -> DataFrame:
    """(id, embedding) of each row: ``encode`` gets lists of at most ``batch`` prepared texts. Null and blank texts get no vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                texts = [(t or "").strip() for t in some.column(1).to_pylist()]
                full = [i for i, t in enumerate(texts) if t]
                out: list = [None] * len(texts)
                if full:
                    m = np.asarray(encode([texts[i] for i in full]), np.float64)
                    if normalise:
                        n = np.linalg.norm(m, axis=1, keepdims=True)
                        m = np.divide(m, n, out=m.copy(), where=n > 0)
                    for i, v in zip(full, m, strict=True):
                        out[i] = v.tolist()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(pa.float64()))], names=[id_col, "embedding"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, embedding array<double>")


def cache_key(c: Column, model: str) -> Column:
    return F.md5(F.concat(F.lit(f"{model}:"), tx.strip(c)))


def through_cache(docs: DataFrame, cache: DataFrame, encode: Callable[[list[str]], np.ndarray], model: str, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, embedding) of each row, and the cache (key, embedding) with what was new.

    A text is encoded once however many rows hold it, and not at all if the cache has it.
    """
    keyed = docs.select(id_col, text).withColumn("key", cache_key(F.col(text), model))
    new = keyed.groupBy("key").agg(F.min(text).alias("t")).join(cache.select("key"), "key", "left_anti")
    made = encoded(new, encode, "key", "t").where("embedding IS NOT NULL")
    grown = cache.select("key", "embedding").union(made)
    return keyed.join(grown, "key", "left").select(id_col, "embedding"), grown


def cost(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """texts, tokens (estimated) and dollars of encoding all texts once."""
    if model not in PRICES:
        raise ValueError(f"no price for {model}")
    spent = docs.agg(F.count(text).alias("texts"), F.coalesce(F.sum(tx.token_estimate(F.col(text))), F.lit(0)).alias("tokens"))
    return spent.withColumn("dollars", F.round(F.col("tokens") / 1_000_000 * PRICES[model], 8))
