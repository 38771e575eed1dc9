"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words, split at all but letters and digits and
lower-cased in A-Z, and the beginnings of longer words, hashed into buckets. A
text holds a term or not. Besides a weight for each term the machine has a
vector for each, and the inner product of two vectors weighs that both terms
are there: an insult beside the mention of a group, say, which a sum of weights
can't tell from either. It is fitted on the driver to a bounded sample of
labelled rows. Two kinds of terms have weights and vectors: those whose presence
tells something of the label by itself, and those of the pairs, among the most
frequent terms, whose presence together does though neither may alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fold, read, written
from corvane.llm.segments import U, _runs, _STEP, _VALUE, mixed

#: Labelled rows of each label that are learnt from, at most: those of smallest id hash.
PER_LABEL = 8_000
#: Bits of a bucket, and lengths in bytes of word beginnings.
BITS, BEGINNINGS = 20, (5, 6, 7, 8)
#: Rows that a term has to be in, and how telling, in standard errors, one has to be by itself; the most such terms.
LEAST_ROWS, TELLING, TERMS = 5, 4.0, 4_096
#: Most frequent terms that are tried in pairs, how telling a pair has to be, and the most telling pairs that count.
FREQUENT, TELLING_PAIR, PAIRS = 2_048, 6.0, 128
#: Length of the vectors.
FACTORS = 8
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms of some texts, repeats included, and the text of each."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    edge = np.diff(_APART[data].astype(np.int8), prepend=np.int8(1))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    values = _VALUE[data]
    out, texts_of = [mixed(_runs(values, start, end, _STEP))], [of]
    for n in BEGINNINGS:
        longer = np.nonzero(end - start > n)[0]
        out.append(mixed(_runs(values, start[longer], start[longer] + n, _STEP) + U(n)))
        texts_of.append(of[longer])
    return (np.concatenate(out) >> U(64 - BITS)).astype(np.int64), np.concatenate(texts_of)


class Machine:
    """score = logistic(bias + sum of weights + sum over pairs of inner products), over the terms that have weights."""

    def __init__(self, buckets: np.ndarray):
        self.row = np.full(1 << BITS, -1, np.int32)
        self.row[buckets] = np.arange(len(buckets))
        self.bias, self.w, self.v = 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), FACTORS))

    def active(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, row) of each term with a weight, once a text, by text."""
        bucket, of = terms(texts)
        row = self.row[bucket]
        has = row >= 0
        pair = np.unique(of[has] * len(self.w) + row[has]) if len(self.w) else np.zeros(0, np.int64)
        return pair // max(1, len(self.w)), pair % max(1, len(self.w))

    def raw(self, of: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and each text's sum of vectors."""
        total = np.stack([np.bincount(of, self.v[row, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(of, (self.v[row] ** 2).sum(1), n)
        return self.bias + np.bincount(of, self.w[row], n) + 0.5 * ((total**2).sum(1) - squares), total

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.active(texts), len(texts))[0], -30, 30)))

    def fit(self, rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, steps: int = 2000, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> None:
        """Adaptive gradient steps on the weighted logistic loss with decay, ``steps`` or more."""
        rng, n = np.random.default_rng(seed), len(self.w)
        self.v = rng.normal(0, 0.05, self.v.shape)
        share = float((label * weight).sum() / weight.sum())
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        seen_w, seen_v, seen_b = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        flat, size = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.array([len(r) for r in rows], np.int64)
        begin = np.cumsum(size) - size
        for _ in range(-(-steps // -(-len(rows) // batch))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                many = size[some]
                row = flat[np.repeat(begin[some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                of = np.repeat(np.arange(len(some)), many)
                raw, total = self.raw(of, row, len(some))
                off = weight[some] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[some]) / len(some)
                seen_b += off.sum() ** 2
                self.bias -= rate * off.sum() / np.sqrt(seen_b)
                each = off[of][:, None] * (total[of] - self.v[row])
                gw = np.bincount(row, off[of], n) + decay * self.w
                gv = np.stack([np.bincount(row, each[:, f], n) for f in range(FACTORS)], axis=1) + decay * self.v
                seen_w += gw * gw
                seen_v += gv * gv
                self.w -= rate * gw / np.sqrt(seen_w)
                self.v -= 0.5 * rate * gv / np.sqrt(seen_v)


def telling_pairs(rows: list[np.ndarray], label: np.ndarray, terms_: int) -> np.ndarray:
    """The terms, numbered below ``terms_``, of the pairs that stand together unlike often, beyond their own shares, in rows of the two labels."""
    covariance, share, size = [], [], []
    for y in (0, 1):
        mine = [r for r, x in zip(rows, label, strict=True) if x == y]
        both = np.zeros((terms_, terms_), np.float32)
        for at in range(0, len(mine), 512):
            held = np.zeros((len(mine[at : at + 512]), terms_), np.float32)
            for i, r in enumerate(mine[at : at + 512]):
                held[i, r] = 1
            both += held.T @ held
        size.append(len(mine))
        share.append(np.diag(both) / len(mine))
        covariance.append(both / len(mine) - np.outer(share[-1], share[-1]))
    p = (share[0] * size[0] + share[1] * size[1]) / sum(size)
    error = np.sqrt(np.outer(p * (1 - p), p * (1 - p)) * (1 / size[0] + 1 / size[1]) + 1e-12)
    z = np.triu(np.abs(covariance[1] - covariance[0]) / error, 1).ravel()
    best = np.argsort(-z, kind="stable")[:PAIRS]
    best = best[z[best] >= TELLING_PAIR]
    return np.unique(np.concatenate([best // max(1, terms_), best % max(1, terms_)]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> Machine | None:
    """A machine fitted to a bounded sample; None unless both labels are there.

    Of ids labelled more than once the larger label counts, of texts that share
    an id the smallest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    there = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(there) < 2:
        return None
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(PER_LABEL) for y in (0, 1)]
    # At most 2 x PER_LABEL rows of two numbers are broadcast.
    found = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen[0].union(chosen[1])), "i")
    sample = written(found.groupBy("i").agg(F.first("y").alias("y"), F.min("t").alias("t")).select("y", "t").repartition(docs.sparkSession.sparkContext.defaultParallelism), "labelled")

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                y = np.array(batch.column(0), np.int64)
                bucket, of = terms(batch.column(1).to_pylist())
                pair = np.unique(of * (1 << BITS) + bucket)
                bucket, of = pair & ((1 << BITS) - 1), pair >> BITS
                one, n = np.bincount(bucket, y[of]).astype(np.int64), np.bincount(bucket)
                hit = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(one[hit]), pa.array(n[hit])], names=["bucket", "one", "n"])

    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    ones, others = float(size[1]), float(size[0])
    a, b = F.col("one"), F.col("n") - F.col("one")
    p = F.col("n") / (ones + others)
    z = F.abs(a / ones - b / others) / F.sqrt(p * (1 - p) * (1 / ones + 1 / others))
    stats = sample.mapInArrow(counts, "bucket long, one long, n long").groupBy("bucket").agg(F.sum("one").alias("one"), F.sum("n").alias("n"))
    stats = written(stats.where((F.col("n") >= LEAST_ROWS) & (p < 1)).select("bucket", "n", z.alias("z")), "terms")
    alone = {r.bucket for r in stats.where(F.col("z") >= TELLING).orderBy(F.desc("z"), "bucket").limit(TERMS).collect()}
    common = {r.bucket for r in stats.orderBy(F.desc("n"), "bucket").limit(FREQUENT).collect()}
    tried = np.array(sorted(alone | common), np.int64)
    of_all = Machine(tried)

    def reduced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                of, row = of_all.active(batch.column(1).to_pylist())
                cuts = np.searchsorted(of, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["y", "x"])

    rows = sorted((r.y, bytes(r.x)) for r in sample.mapInArrow(reduced, "y int, x binary").collect())
    label_of, held = np.array([y for y, _ in rows], np.float64), [np.frombuffer(x, np.uint16) for _, x in rows]
    often = np.full(len(tried) + 1, -1, np.int64)
    often[np.nonzero(np.isin(tried, list(common)))[0]] = np.arange(len(common))
    paired = telling_pairs([often[r][often[r] >= 0] for r in held], label_of, len(common))
    keep = np.isin(tried, list(alone)) | np.isin(often[:-1], paired)
    model, place = Machine(tried[keep]), np.where(keep, np.cumsum(keep) - 1, -1)
    weight = np.where(label_of > 0, there[1] / ones, there[0] / others)
    model.fit([place[r][place[r] >= 0] for r in held], label_of, weight / weight.mean())
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, learnt from ``labels`` (id, label).

    Only the text is an input of a score. A null or empty text gets the score of
    a text without telling terms. If one of the labels is missing there is
    nothing to learn from and every score is 0. An empty table stays empty. Rows keep their number and
    their other columns; a column of that name is replaced.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text, label))
    kept = [f for f in docs.schema.fields if f.name != "toxicity"]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                score = fitted.value.score(batch.column(names.index(text)).to_pylist()) if fitted.value else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "toxicity"])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField("toxicity", T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    held = fold("doc_id", 4) == 2
    scored = toxicity(docs.select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic"))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
