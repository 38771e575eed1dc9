"""Search over vectors and over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx

#: Bytes of query vectors that are compared at once, and rows of a block that they are compared with.
QUERY_BYTES, BLOCK_ROWS = 32 << 20, 4096


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for broadcast if it holds ``most`` rows at most; a join beyond that is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ m.T
    if metric == "ip":
        return dots
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
        return np.divide(dots, n, out=np.zeros_like(dots), where=n > 0)
    far = np.stack([np.sqrt(((m - x) ** 2).sum(1)) for x in q])
    return -far if metric == "l2" else 1 / (1 + far)


def compared(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", least: float | None = None, k: int | None = None) -> DataFrame:
    """Every query (query_id, q) against every row (vec_id, embedding, label), in blocks: query_id, q_label, vec_id, label and score.

    Queries go to the tasks in groups of bounded size; each task multiplies
    blocks of its rows with a group. Of a block, only scores of ``least`` or more
    are returned, or the k best of each query that are not its own row, ties
    among them kept. Vectors of unlike length don't meet.
    """
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, q_label int, vec_id {id_type}, label int, score double"
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.col("q_label").cast("int") if "q_label" in queries.columns else F.lit(None).cast("int").alias("q_label"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>"), F.col("label").cast("int") if "label" in vectors.columns else F.lit(None).cast("int").alias("label"))

    def one(group: list) -> DataFrame:
        by_dim: dict[int, tuple] = {}
        for d in {len(r.q) for r in group}:
            mine = [r for r in group if len(r.q) == d]
            by_dim[d] = ([r.query_id for r in mine], [r.q_label for r in mine], np.array([r.q for r in mine], np.float64).reshape(len(mine), d))
        shared = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(at, BLOCK_ROWS).filter(pa.compute.is_valid(whole.slice(at, BLOCK_ROWS).column(1)))
                    lists = batch.column(1)
                    begins, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
                    flat = lists.values.to_numpy(zero_copy_only=False)
                    for d in np.unique(sizes):
                        if d not in shared.value:
                            continue
                        spots = np.nonzero(sizes == d)[0]
                        m = flat[begins[spots][:, None] + np.arange(d)]
                        ids, labels, q = shared.value[d]
                        own = batch.column(0).take(pa.array(spots)).to_pylist() if k is not None else []
                        for a in range(0, len(ids), 256):
                            s = np.round(_scores(q[a : a + 256], m, metric), 6)
                            hit = s >= least if least is not None else np.ones(s.shape, bool)
                            if k is not None and s.shape[1] > k + 1:
                                mine = np.array(ids[a : a + 256])[:, None] == np.array(own)[None, :]
                                t = np.where(mine, -np.inf, s)
                                hit &= (s >= np.partition(t, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]) | mine
                            i, j = np.nonzero(hit)
                            yield pa.RecordBatch.from_arrays([pa.array([ids[a + x] for x in i.tolist()]), pa.array([labels[a + x] for x in i.tolist()], pa.int32()), batch.column(0).take(pa.array(spots[j])), batch.column(2).take(pa.array(spots[j])), pa.array(s[i, j])], names=["query_id", "q_label", "vec_id", "label", "score"])

        return rows.mapInArrow(run, schema)

    out, group, size = None, [], 0
    for r in asked.where("q IS NOT NULL").toLocalIterator():
        group.append(r)
        size += 8 * len(r.q)
        if size >= QUERY_BYTES:
            out, group, size = (one(group) if out is None else out.union(one(group))), [], 0
    if group:
        out = one(group) if out is None else out.union(one(group))
    return out if out is not None else spark.createDataFrame([], schema)


def top_k(scored: DataFrame, k: int, by: str = "query_id", ties: str = "vec_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(ties))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, length) of each term of each row; a row's words stand together, so they are counted there, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(1)
                size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                code, kinds = words.indices.to_numpy(), max(1, len(words.dictionary))
                pair, n = np.unique(np.repeat(np.arange(batch.num_rows), size) * kinds + code, return_counts=True)
                row = pair // kinds
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.dictionary.take(pa.array(pair % kinds)), pa.array(n), pa.array(size[row], pa.int32())], names=[id_col, "term", "tf", "length"])

    return docs.where(F.col(text).isNotNull()).select(id_col, tx.tokens(F.col(text)).alias("w")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, term string, tf long, length int")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, held: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    Query terms, few, meet the postings (``held``, if they are there already)
    before anything is shuffled by them.
    """
    held = postings(docs, "doc_id", "text") if held is None else held
    terms = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
    few = terms.limit(100_001).count() <= 100_000
    asked = F.broadcast(terms.select("term").distinct()) if few else terms.select("term").distinct()
    # Every token stands in some posting; documents without tokens have none, so they are counted apart.
    corpus = docs.agg(F.count("*").alias("docs")).crossJoin(F.broadcast(held.agg(F.sum("tf").alias("tokens")))).select("docs", (F.col("tokens") / F.col("docs")).alias("mean"))
    hits = held.join(asked, "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return weighed.select("doc_id", "term", part.alias("part")).join(F.broadcast(terms) if few else terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def fuse(rankings: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): weighted reciprocal ranks over rankings (query_id, doc_id, rank)."""
    parts = None
    for ranking, weight in rankings:
        part = ranking.select("query_id", "doc_id", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def composite(vector: Column, keyword: Column, quality: Column, recency: Column, rank: Column) -> Column:
    """0.40 vector, 0.25 keyword, 0.20 quality of 3, 0.10 recency, 0.05 position."""
    return F.round(0.40 * vector + 0.25 * keyword + 0.20 * quality / 3 + 0.10 * recency + 0.05 * F.greatest(F.lit(0.0), 1.0 - rank * 0.01), 6)
