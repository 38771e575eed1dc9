"""Exact top-k by integer inner product, block at a time.

Each component is a term, floor(256 x) its weight. Rows, put in order of the
closest of some sampled rows so that a block holds like rows, form blocks
(document ranges); a block holds its forward index, a matrix of weights, and the
largest and least weight of each term. For a query, the sum over terms of what a
block's extreme weight can give bounds every score in the block. A query's bar is
the k-th best score among the sampled rows, and rises as blocks are scored. Each
query's block of the highest bound goes first; then blocks go in falling order of
their bounds, each scored through its forward index for those queries whose bound
reaches their bar; a bound equal to it is still scored, because ties go to
smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import read, written
from corvane.llm.topk import Best, finite, matrices, passes, queries_in_groups, ranked

#: Rows of a block, blocks that a task holds at once, and rows that the order and the first bars come from, at most.
BLOCK_ROWS, BLOCKS, SAMPLE_ROWS = 64, 512, 1024
_EXACT = float(1 << 53)


def weights(m: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers; values beyond their range stop at its ends."""
    return np.clip(np.floor(m * 256.0), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _product(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of integers: by floating point while every partial sum is exact, else in 64-bit integers, which wrap."""
    if q.size and d.size and float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q @ d.T


def sampled(vectors: DataFrame, id_col: str, vector: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, weights) by length of vectors of at most SAMPLE_ROWS rows: those of the smallest hashes."""
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("i", "v"), "i").limit(SAMPLE_ROWS).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r.i):
        out.setdefault(len(r.v), []).append(r)
    return {d: (np.array([r.i for r in some]), weights(np.array([r.v for r in some]).reshape(len(some), d))) for d, some in out.items()}


def neighbours_together(w: np.ndarray) -> np.ndarray:
    """An order of rows in which like rows stand together: halves by the line between two far rows, halved again."""
    out, todo = [], [np.arange(len(w))]
    while todo:
        rows = todo.pop()
        x = w[rows].astype(np.float64)
        far = x[((x - x.mean(0)) ** 2).sum(1).argmax()] if len(rows) > 2 else None
        other = x[((x - far) ** 2).sum(1).argmax()] if far is not None else None
        along = x @ (far - other) if far is not None else None
        if along is None or not along.max() > along.min():
            out.append(rows)
            continue
        order = np.argsort(-along, kind="stable")
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def blocks(vectors: DataFrame, id_col: str, vector: str, sample: dict, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: length of the vectors, ids, forward index, largest and least weights."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast({d: w[neighbours_together(w)].astype(np.float64) for d, (_, w) in sample.items()})
    valid = vectors.where(F.col(id_col).isNotNull() & finite(vector)).select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                for ids, m in matrices(whole.slice(at, 4096)):
                    c = shared.value.get(m.shape[1])
                    place = ((c**2).sum(1) - 2 * (256 * m @ c.T)).argmin(1) if c is not None and m.shape[1] else np.zeros(len(m), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(list(m), pa.list_(pa.float64())), pa.array(place, pa.int64())], names=["i", "v", "near"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                for ids, m in matrices(whole.slice(at, rows)):
                    w = weights(m)
                    w = w.astype(np.int16) if w.size and np.abs(w.astype(np.float64)).max() < 32767 else w
                    high, low = (x(w, axis=0).astype(np.int64).tobytes() for x in (np.max, np.min))
                    yield pa.RecordBatch.from_arrays([pa.array([w.shape[1]], pa.int32()), pa.array([w.dtype.itemsize], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.astype(np.int64).tobytes(), w.tobytes(), high, low))], names=["dim", "width", "ids", "index", "high", "low"])

    parts = max(8, 2 * spark.sparkContext.defaultParallelism)
    # Rows beside one sampled row may be many, so the range goes by their ids too.
    placed = valid.mapInArrow(near, "i long, v array<double>, near long").repartitionByRange(parts, F.size("v"), "near", "i").sortWithinPartitions(F.size("v"), "near", "i")
    return placed.select("i", "v").mapInArrow(run, "dim int, width int, ids binary, index binary, high binary, low binary")


def _bars(q_ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """The k-th best score of each query among the sampled rows; the least value where there are fewer."""
    bars = np.full(len(q), np.iinfo(np.int64).min)
    if sample is None or len(sample[0]) <= k:
        return bars
    ids, w = sample
    for at in range(0, len(q), 4096):
        some = slice(at, at + 4096)
        scores = _product(q[some], w)
        scores[q_ids[some][:, None] == ids] = np.iinfo(np.int64).min
        bars[some] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return bars


def _scored(held: list, best: Best, q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray) -> int:
    """Offers the held blocks (ids, index, high, low) to the queries whose bounds reach their bars; returns how many (query, block) were scored."""
    high, low = np.stack([b[2] for b in held]).astype(np.float64), np.stack([b[3] for b in held]).astype(np.float64)
    done = 0
    for begin in range(0, len(q), 4096):
        mine = np.arange(begin, min(begin + 4096, len(q)))
        qf = q[mine].astype(np.float64)
        # Beyond 2^53 a bound in floating point may be low; the margin covers its rounding.
        bound = np.maximum(qf, 0) @ high.T + np.minimum(qf, 0) @ low.T
        bound += np.abs(bound) * 1e-9
        first = bound.argmax(1)
        order = np.argsort(-bound.max(0), kind="stable")
        for step, numbers in ((0, np.unique(first)), (1, order)):
            for b in numbers:
                rows = first == b if step == 0 else (first != b)
                rows = np.nonzero(rows & (bound[:, b] >= np.maximum(best.worst()[mine], bars[mine])))[0]
                if not len(rows):
                    continue
                ids, index, *_ = held[b]
                own = q_ids[mine[rows]][:, None] == ids
                best.push(mine[rows], _product(q[mine[rows]], index.astype(np.int64)), ids, own if own.any() else None)
                done += len(rows)
    return done


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", query_bytes: int = 32 << 20, tally: tuple | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query.

    Ties go to the smaller id. A row with the query's own id is no candidate of
    it. Null ids, null vectors and vectors with null or non-finite components
    take no part; vectors of unlike length don't meet. Of repeated rows each is
    a candidate, and each a query, of its own. Other columns are not read. An
    empty table gives no rows. ``tally``: two accumulators, for the (query,
    block) pairs there are and those that are scored.
    """
    spark = vectors.sparkSession
    sample = sampled(vectors.where(F.col(id_col).isNotNull() & finite(vector)), id_col, vector)
    first = spark.sparkContext.broadcast(sample)
    index = written(blocks(vectors, id_col, vector, sample), "blocks")
    schema = "query_no long, query_id long, vec_id long, score long"

    def one(group: list) -> DataFrame:
        shared = spark.sparkContext.broadcast([(no, ids, weights(m)) for no, ids, m in group])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, list] = {}
            for no, ids, w in shared.value:
                by_dim.setdefault(w.shape[1], []).append((no + np.arange(len(ids)), ids, w))
            asked = {d: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for d, v in by_dim.items()}
            best = {d: Best(len(v[0]), k, np.int64) for d, v in asked.items()}
            bars = {d: _bars(v[1], v[2], first.value.get(d), k) for d, v in asked.items()}
            held: dict[int, list] = {d: [] for d in asked}

            def score(d: int) -> None:
                done = _scored(held[d], best[d], *asked[d][1:], bars[d])
                if tally:
                    tally[0].add(len(asked[d][1]) * len(held[d]))
                    tally[1].add(done)
                held[d] = []

            for batch in batches:
                for dim, width, *raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if dim not in asked:
                        continue
                    ids = np.frombuffer(raw[0], np.int64)
                    held[dim].append((ids, np.frombuffer(raw[1], np.int16 if width == 2 else np.int64).reshape(len(ids), dim), np.frombuffer(raw[2], np.int64), np.frombuffer(raw[3], np.int64)))
                    if len(held[dim]) >= BLOCKS:
                        score(dim)
            for d, (no, q_ids, _) in asked.items():
                if held[d]:
                    score(d)
                at, ids, scores = best[d].found()
                yield pa.RecordBatch.from_arrays([pa.array(no[at]), pa.array(q_ids[at]), pa.array(ids), pa.array(scores)], names=["query_no", "query_id", "vec_id", "score"])

        return index.mapInArrow(run, schema)

    valid = queries.where(F.col(id_col).isNotNull() & finite(vector))
    return ranked(passes(queries_in_groups(valid, id_col, vector, query_bytes), one, spark.createDataFrame([], schema), "exact"), k)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(d.w) = len(q.w)
), n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM n WHERE k <= 5
"""
