"""Search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vectors as vx
from corvane.operators import search
from corvane.plans.registry import Tables, query

_V = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_SCORE = {
    "cosine": "list_inner_product(d.v, q.v) / (sqrt(list_inner_product(d.v, d.v)) * sqrt(list_inner_product(q.v, q.v)))",
    "ip": "list_inner_product(d.v, q.v)",
    "l2": "-list_distance(d.v, q.v)",
    "euclidean": "1 / (1 + list_distance(d.v, q.v))",
}


def _top(metric: str, where: str = "", k: int = 10, queries: str = "q.vec_id = 0") -> str:
    return f"""
    WITH v AS ({_V}), s AS (SELECT q.vec_id AS query_id, d.vec_id, round({_SCORE[metric]}, 6) AS score FROM v q JOIN v d ON {queries} {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""


def _asked(t: Tables, where: str) -> DataFrame:
    return t.embeddings.where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def _found(t: Tables, metric: str, rows: DataFrame | None = None, asked: str = "vec_id = 0", k: int = 10) -> DataFrame:
    scored = search.compared(rows if rows is not None else t.embeddings, _asked(t, asked), metric, k=k)
    return search.top_k(scored, k).select("query_id", "rank", "vec_id", "score")


@query(_top("cosine"))
def vec_topk_cosine(t: Tables) -> DataFrame:
    return _found(t, "cosine")


@query(_top("l2"))
def vec_topk_l2(t: Tables) -> DataFrame:
    return _found(t, "l2")


@query(_top("ip"))
def vec_topk_ip(t: Tables) -> DataFrame:
    return _found(t, "ip")


@query(_top("euclidean"))
def vec_topk_euclidean(t: Tables) -> DataFrame:
    return _found(t, "euclidean")


@query(_top("cosine", "AND d.label IN (1, 3)"))
def vec_topk_filtered(t: Tables) -> DataFrame:
    """The filter holds before the k are chosen, so it never leaves fewer than there are."""
    return _found(t, "cosine", t.embeddings.where("label IN (1, 3)"))


@query(_top("cosine", "AND d.vec_id <> q.vec_id", 5, "q.vec_id % 25 = 0"))
def vec_batch_topk(t: Tables) -> DataFrame:
    scored = search.compared(t.embeddings, _asked(t, "vec_id % 25 = 0"), k=5).where("vec_id <> query_id")
    return search.top_k(scored, 5).select("query_id", "rank", "vec_id", "score")


@query(f"WITH v AS ({_V}) SELECT d.vec_id, round({_SCORE['cosine']}, 6) AS score FROM v q JOIN v d ON q.vec_id = 0 WHERE round({_SCORE['cosine']}, 6) >= 0.2")
def vec_threshold(t: Tables) -> DataFrame:
    return search.compared(t.embeddings, _asked(t, "vec_id = 0"), least=0.2).select("vec_id", "score")


@query(_top("cosine", "AND d.vec_id <> q.vec_id", 7, "q.vec_id = 42"))
def vec_neighbours_of_id(t: Tables) -> DataFrame:
    return _found(t, "cosine", t.embeddings.where("vec_id <> 42"), "vec_id = 42", 7)


@query(f"""WITH v AS ({_V}), s AS (SELECT d.vec_id, max(round({_SCORE['cosine']}, 6)) AS score FROM v q JOIN v d ON q.label = 0 AND d.label <> 0 GROUP BY d.vec_id)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def vec_neighbours_of_group(t: Tables) -> DataFrame:
    """For a group's vectors the best score of each row outside the group; ten of these."""
    scored = search.compared(t.embeddings.where("label <> 0"), _asked(t, "label = 0"), k=10)
    return scored.groupBy("vec_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"""WITH v AS ({_V}) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS total FROM v""")
def vec_normalize(t: Tables) -> DataFrame:
    unit = vx.normalised(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"), F.round(unit[0], 6).alias("first"), F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT label) AS labels, CAST(min(len(embedding)) AS BIGINT) AS least_dim, CAST(max(len(embedding)) AS BIGINT) AS most_dim FROM embeddings")
def vec_stats(t: Tables) -> DataFrame:
    d = F.size("embedding").cast("long")
    return t.embeddings.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min(d).alias("least_dim"), F.max(d).alias("most_dim"))


@query(f"""WITH v AS ({_V}), s AS (SELECT q.vec_id AS query_id, d.label, max(round({_SCORE['cosine']}, 6)) AS score FROM v q JOIN v d ON q.vec_id % 50 = 1 AND d.vec_id % 50 <> 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM s)
SELECT query_id, label, score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.60 THEN 'medium' WHEN score >= 0.40 THEN 'low' ELSE 'none' END AS confidence FROM r WHERE rank = 1""")
def route_max_example(t: Tables) -> DataFrame:
    """Labels as routes, their rows as examples: the route of the most similar example, and how sure that is."""
    scored = search.compared(t.embeddings.where("vec_id % 50 <> 1"), _asked(t, "vec_id % 50 = 1"), k=1).groupBy("query_id", "label").agg(F.max("score").alias("score"))
    best = search.top_k(scored, 1, ties="label")
    return best.select("query_id", "label", "score", F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.60, "medium").when(F.col("score") >= 0.40, "low").otherwise("none").alias("confidence"))


@query(f"""WITH v AS ({_V}), s AS (SELECT a.vec_id AS a, d.vec_id AS b, round(list_inner_product(a.v, d.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(d.v, d.v))), 6) AS score FROM v a JOIN v d ON a.vec_id < d.vec_id)
SELECT a, b, score FROM s WHERE score >= 0.35""")
def vec_similar_pairs(t: Tables) -> DataFrame:
    """All pairs of rows at 0.35 or more: the whole table as queries, in blocks, of which only what passes the threshold comes out."""
    scored = search.compared(t.embeddings, _asked(t, "true"), least=0.35).where("query_id < vec_id")
    return scored.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score")


@query(f"""WITH v AS ({_V}), c AS (SELECT label, i, avg(v[i]) AS m FROM v, range(1, 65) r(i) GROUP BY ALL) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS mean FROM c""")
def vec_label_centroids(t: Tables) -> DataFrame:
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY GROUPING SETS ((label), ())")
def namespaces_rollup(t: Tables) -> DataFrame:
    return t.embeddings.groupingSets([["label"], []], "label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).select("label", "n", "first", "last")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_anti(t: Tables) -> DataFrame:
    from corvane.operators.rows import delete

    return delete(t.embeddings.select("vec_id", "label"), t.labels.where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 1, 4, 15, 92, 65, 35, 89)")
def fetch_semi(t: Tables) -> DataFrame:
    from corvane.operators.rows import fetch

    return fetch(t.embeddings.select("vec_id", "label"), t.spark.createDataFrame([(i,) for i in (3, 1, 4, 15, 92, 65, 35, 89)], "vec_id long"), "vec_id")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 11 = 0")
def upsert(t: Tables) -> DataFrame:
    from corvane.operators import rows

    store = t.embeddings.select("vec_id", "label")
    new = store.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 100).union(store.where("vec_id % 11 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return rows.upsert(store, new, "vec_id")


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings QUALIFY n <= 3")
def doc_chunks_by_group(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long").alias("n")).where("n <= 3")
