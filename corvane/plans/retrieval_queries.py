"""Retrieval: keyword search, fusion, ranking and budgeted context for the questions of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import query as qx
from corvane.functions import text as tx
from corvane.operators import rows, search
from corvane.plans.registry import Tables, query
from corvane.plans.text_queries import TOKENS

_BM25 = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark), d AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""
_JAC = f"""t AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS qt FROM benchmark), j AS (SELECT query_id, doc_id, count(*) AS k, any_value(len(qt)) AS m FROM (SELECT query_id, qt, unnest(qt) AS term FROM t) JOIN (SELECT DISTINCT doc_id, term FROM p) USING (term) GROUP BY ALL),
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(k / m, 6) DESC, doc_id) AS rank FROM j)"""


def _questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _postings(t: Tables) -> DataFrame:
    """The postings of all documents, written once and shared by keyword scores and overlap."""
    return t.once("postings", lambda: search.postings(t.documents, "doc_id", "text"))


def _bm25(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    held = _postings(t)
    if docs is not None:
        held = t.once("kept-postings", lambda: held.join(docs.select("doc_id"), "doc_id", "left_semi"))
    counted = docs if docs is not None else t.documents
    return search.top_k(search.bm25(counted, _questions(t), held=held), 20, ties="doc_id")


def _overlap(t: Tables) -> DataFrame:
    """The share of a question's words that a document has, the best 20."""
    q = _questions(t).select("query_id", F.array_distinct(tx.tokens(F.col("query"))).alias("w")).select("query_id", F.size("w").alias("m"), F.explode("w").alias("term"))
    terms = _postings(t).select("doc_id", "term")
    hits = terms.join(search.small(q, 500_000), "term").groupBy("query_id", "doc_id").agg(F.round(F.count("*") / F.first("m"), 6).alias("score"))
    return search.top_k(hits, 20, ties="doc_id")


@query(f"WITH {_BM25} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 20")
def bm25_topk(t: Tables) -> DataFrame:
    return _bm25(t).select("query_id", "doc_id", "rank", "score")


@query(f"""WITH {_BM25}, {_JAC}, u AS (SELECT query_id, doc_id, 0.6 / (60 + rank) AS part FROM r WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 0.3 / (60 + rank) FROM o WHERE rank <= 20)
SELECT query_id, doc_id, round(sum(part)::DOUBLE, 6) AS score FROM u GROUP BY ALL""")
def rrf_fusion(t: Tables) -> DataFrame:
    return search.fuse([(_bm25(t), 0.6), (_overlap(t), 0.3)])


_RANKED = f"""{_BM25}, b AS (SELECT query_id, max(score) AS top FROM r GROUP BY 1), y AS (SELECT doc_id, CASE quality WHEN 1 THEN 3 ELSE 1 END AS quality FROM labels),
x AS (SELECT r.query_id, r.doc_id, round(0.40 * r.score / top + 0.20 * coalesce(quality, 0) / 3 + 0.05 * greatest(0, 1 - (rank - 1) * 0.01), 6) AS score FROM r JOIN b USING (query_id) LEFT JOIN y USING (doc_id) WHERE rank <= 20),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM x)"""


@query(f"WITH {_RANKED} SELECT query_id, doc_id, CAST(place AS INTEGER) AS place, score FROM z WHERE place <= 15")
def composite_rank(t: Tables) -> DataFrame:
    """The 15 best by vector score, here the share of the best keyword score, quality and place."""
    hits = _bm25(t)
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    quality = t.labels.select("doc_id", F.when(F.col("quality") == 1, 3).otherwise(1).alias("quality"))
    scored = hits.join(best, "query_id").join(quality, "doc_id", "left")
    total = search.composite(F.col("score") / F.col("top"), F.lit(0.0), F.coalesce("quality", F.lit(0)), F.lit(0.0), F.col("rank") - 1)
    scored = scored.select("query_id", "doc_id", total.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(order)).where("place <= 15").select("query_id", "doc_id", "place", "score")


@query(f"WITH {_RANKED}, g AS (SELECT z.*, d.source, max(score) OVER (PARTITION BY query_id, source) AS top FROM z JOIN documents d USING (doc_id) WHERE place <= 15) SELECT query_id, doc_id, source, dense_rank() OVER (PARTITION BY query_id ORDER BY top DESC, source) AS part FROM g")
def group_by_source(t: Tables) -> DataFrame:
    """Sources in order of their best document."""
    placed = composite_rank(t).join(t.documents.select("doc_id", "source"), "doc_id")
    top = F.max("score").over(Window.partitionBy("query_id", "source"))
    return placed.withColumn("top", top).select("query_id", "doc_id", "source", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("top"), "source")).cast("long").alias("part"))


@query()
def ranked_context(t: Tables) -> DataFrame:
    """The whole way: drop copies, search, fuse, rank by quality too, and take what the question's budget holds.

    Each step is a query of its own above with SQL beside it.
    """
    docs = t.once("kept-documents", lambda: rows.keep_first(t.documents, tx.content_hash(F.col("text")), ["doc_id"]).where(~tx.is_noise(F.col("text"))))
    questions = _questions(t)
    fused = search.fuse([(_bm25(t, docs), 0.6), (_overlap(t).join(docs.select("doc_id"), "doc_id", "left_semi"), 0.3)])
    quality = t.labels.select("doc_id", F.when(F.col("quality") == 1, 3).otherwise(1).alias("quality"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    hits = fused.withColumn("rank", F.row_number().over(order)).where("rank <= 20").join(quality, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id").join(search.small(questions, 100_000), "query_id")
    keyword = qx.contained_share(F.col("text"), qx.keywords(F.col("query")))
    scored = hits.select("query_id", "query", "doc_id", F.length("text").alias("n"), search.composite(F.least(F.lit(1.0), F.col("score") * 60), keyword, F.coalesce("quality", F.lit(0)), F.lit(0.0), F.col("rank") - 1).alias("score"))
    placed = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 15")
    reached = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank"))
    return placed.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", (reached <= qx.budget(qx.complexity(F.col("query")))).alias("included"))
