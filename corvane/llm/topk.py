"""What the two searches over vectors share: valid vectors as numpy blocks, bounded groups of queries, running best lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import new_path

#: Bytes of query vectors that one pass broadcasts. More queries take more passes.
QUERY_BYTES = 32 << 20


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int, dtype: type):
        self.low = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self.k = k
        self.score = np.full((queries, k), self.low, dtype)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.n = np.zeros(queries, np.int64)

    def worst(self) -> np.ndarray:
        """The k-th best score of each query; the least value while there are fewer than k."""
        return self.score[:, -1]

    def push(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, out: np.ndarray | None = None) -> None:
        """Offers candidates to queries ``rows``. scores: a row per query, a column per candidate; ids ascend; out: candidates that don't count."""
        if not scores.size:
            return
        k = min(self.k, scores.shape[1])
        if out is not None:
            scores = np.where(out, self.low, scores)
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
            above, even = scores > kth, scores == kth
            take = above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            at = np.nonzero(take)[1].reshape(-1, k)
            scores, new, gone = np.take_along_axis(scores, at, 1), ids[at], None if out is None else np.take_along_axis(out, at, 1)
        else:
            new, gone = np.broadcast_to(ids, scores.shape), out
        if gone is not None:
            new = np.where(gone, np.iinfo(np.int64).max, new)
        counted = scores.shape[1] if gone is None else (~gone).sum(axis=1)
        score, ident = np.concatenate([self.score[rows], scores], axis=1), np.concatenate([self.id[rows], new], axis=1)
        # An unsigned view of integers keeps the order when it is turned round, which a minus sign would not at the least value.
        order = np.lexsort((ident, ~score if np.issubdtype(score.dtype, np.integer) else -score), axis=-1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ident, order, 1)
        self.n[rows] = np.minimum(self.n[rows] + counted, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, id and score of each one found."""
        q, at = np.nonzero(np.arange(self.k) < self.n[:, None])
        return q, self.id[q, at], self.score[q, at]


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length among the vectors of a batch (id, vector), ids ascending, equal ids as stored."""
    lists = batch.column(1)
    ids, lengths = batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    begins = lists.offsets.to_numpy()[:-1]
    for n in np.unique(lengths):
        rows = np.nonzero(lengths == n)[0]
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], flat[begins[rows][:, None] + np.arange(n)]


def queries_in_groups(queries: DataFrame, id_col: str, vector: str, most: int = QUERY_BYTES) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The queries as (first number, ids, matrix), in groups of bounded size, as stored, streamed to the driver one partition at a time.

    What stands on the driver and is broadcast at once is at most ``most`` bytes
    and one batch of 2048 queries, however many queries there are.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for ids, m in matrices(whole.slice(at, 2048)):
                    yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["dim", "ids", "matrix"])

    group, size, number = [], 0, 0
    for r in queries.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector}`").cast("array<double>")).mapInArrow(pack, "dim int, ids binary, matrix binary").toLocalIterator():
        ids = np.frombuffer(r.ids, np.int64)
        group.append((number, ids, np.frombuffer(r.matrix, np.float64).reshape(len(ids), r.dim)))
        number, size = number + len(ids), size + len(r.matrix)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def passes(groups: Iterator, one: Callable[[list], DataFrame], empty: DataFrame, name: str) -> DataFrame:
    """The rows of one pass for each group of queries. A single pass stays lazy; several are written one after another."""
    first = next(groups, None)
    if first is None:
        return empty
    second = next(groups, None)
    if second is None:
        return one(first)
    path = new_path(empty.sparkSession, name)
    group = first
    while group is not None:
        one(group).write.mode("append").parquet(path)
        group, second = second, next(groups, None)
    return empty.sparkSession.read.schema(empty.schema).parquet(path)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over what all tasks found: at most k rows of a query from each task."""
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
