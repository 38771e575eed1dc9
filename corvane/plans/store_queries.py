"""Queries of stores and embedding: filters, checks, tenants, caches and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import vectors as vx
from corvane.operators import embedding, stores
from corvane.plans.registry import Tables, query
from corvane.plans.text_queries import STRIP, TOKENS, WORDS


def _chunks(t: Tables) -> DataFrame:
    """Vectors as chunks: their label the document, their number's parity the tenant."""
    meta = F.create_map(F.lit("year"), (F.lit(2020) + F.col("label")).cast("string"), F.lit("lang"), F.when(F.col("vec_id") % 3 == 0, "en").otherwise("de"), F.lit("note"), F.lit(None).cast("string"))
    return t.embeddings.select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.concat(F.lit("d"), "label").alias("doc_id"), F.lit("text").alias("text"), "embedding", meta.alias("metadata"))


def _store(t: Tables) -> stores.Store:
    """A store with two tenants' chunks, made anew for each query."""
    import uuid

    from corvane.session import shared_dir

    path, held = f"{shared_dir(t.spark)}/corvane/store-{uuid.uuid4().hex}", _chunks(t)
    for name, parity in (("a", 0), ("b", 1)):
        stores.Store(t.spark, path, tenant=name).add(held.where(F.substring("chunk_id", 2, 20).cast("long") % 2 == parity))
    return stores.Store(t.spark, path, tenant="a")


@query("SELECT 'c' || vec_id AS chunk_id, 'd' || label AS doc_id FROM embeddings WHERE vec_id % 2 = 0 AND 2020 + label >= 2023 AND vec_id % 3 = 0")
def store_filter(t: Tables) -> DataFrame:
    """What a tenant sees of a filter: {"year": {"$gte": 2023}, "lang": "en"}."""
    return _store(t).rows().where(stores.matches(F.col("metadata"), {"year": {"$gte": 2023}, "lang": "en"})).select("chunk_id", "doc_id")


@query("SELECT 'c' || vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS tenant FROM embeddings WHERE vec_id % 2 = 1 OR label IN (0, 2) OR 2020 + label < 2025 AND label <> 1")
def store_delete(t: Tables) -> DataFrame:
    """Both tenants' rows after one tenant deletes a document, and what a filter names; the other's stay."""
    s = _store(t)
    s.delete(doc_ids=["d1"])
    s.delete(filters={"year": {"$gte": 2025}, "lang": {"$in": ["en", "de"]}})
    return s.everything().select("chunk_id", F.col("metadata")["tenant_id"].alias("tenant"))


@query("SELECT CASE WHEN grouping(namespace) = 0 THEN namespace END AS namespace, count(*) AS chunks, count(DISTINCT doc) AS documents, 64 AS dim FROM (SELECT '' AS namespace, 'd' || label AS doc FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'other', 'd' || label FROM embeddings WHERE vec_id % 2 = 0 AND vec_id < 40) GROUP BY GROUPING SETS ((namespace), ())")
def store_stats(t: Tables) -> DataFrame:
    """Counts by namespace after a second namespace is filled."""
    s = _store(t)
    s.add(_chunks(t).where("cast(substring(chunk_id, 2) as long) % 2 = 0 AND cast(substring(chunk_id, 2) as long) < 40"), "other")
    return s.stats()


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 2 = 0), s AS (SELECT q.vec_id AS query_id, d.vec_id, d.label, round(list_inner_product(d.v, q.v) / (sqrt(list_inner_product(d.v, d.v)) * sqrt(list_inner_product(q.v, q.v))), 6) AS score FROM v q JOIN v d ON q.vec_id IN (0, 4) AND 2020 + d.label >= 2024),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'c' || vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, 'c' || vec_id AS chunk_id, 'd' || label AS doc_id, score FROM r WHERE rank <= 6""")
def store_search(t: Tables) -> DataFrame:
    """The six best rows of a filter for two queries, filtered before they are chosen."""
    asked = t.embeddings.where("vec_id IN (0, 4)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return _store(t).search(asked, 6, filters={"year": {"$gte": 2024}})


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'chunk_id is required' WHEN doc_id % 7 = 0 THEN 'doc_id is required' WHEN doc_id % 11 = 0 THEN 'text cannot be empty' END AS problem FROM documents")
def chunk_problems(t: Tables) -> DataFrame:
    """Why a store refuses a row; null if it does not."""
    c = t.documents.select(F.col("doc_id").alias("i"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise("d").alias("doc_id"), F.when(F.col("doc_id") % 11 == 0, "\n").otherwise(F.col("text")).alias("text"))
    return stores.problems(c).select(F.col("i").alias("doc_id"), "problem")


@query(f"SELECT count(*) AS texts, CAST(sum(CAST(floor(len({WORDS.format('text')}) * 1.3) AS BIGINT)) AS BIGINT) AS tokens, round(sum(CAST(floor(len({WORDS.format('text')}) * 1.3) AS BIGINT)) / 1000000 * 0.02, 8) AS dollars FROM documents")
def embedding_cost(t: Tables) -> DataFrame:
    return embedding.cost(t.documents, "text-embedding-3-small")


@query(f"""WITH d AS (SELECT item_id, md5('hash:' || {STRIP.format('text')}) AS key, {TOKENS.format('text')} AS w FROM benchmark), b AS (SELECT item_id, CAST(('0x' || substr(md5(x), 1, 7)) AS BIGINT) % 256 AS b, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(w) AS x FROM d) GROUP BY ALL)
SELECT item_id, round(max(n) / sqrt(sum(n * n)), 6) AS top, count(*) AS filled FROM b GROUP BY 1""")
def embedding_hashed(t: Tables) -> DataFrame:
    """The largest component of each question's vector, and how many are not zero; through a cache that knows half of the texts."""
    import numpy as np

    def encode(texts: list[str]) -> np.ndarray:
        import hashlib

        import regex

        out = np.zeros((len(texts), 256))
        for i, x in enumerate(texts):
            for w in regex.findall(r"[\p{L}\p{N}_]+", x.lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 256] += 1
        return out

    known = t.benchmark.where("item_id % 2 = 0").select(embedding.cache_key(F.col("text"), "hash").alias("key"), embedding.hashed(F.col("text")).alias("embedding")).dropDuplicates(["key"])
    found, _ = embedding.through_cache(t.benchmark, known, encode, "hash", "item_id")
    return found.select("item_id", F.round(F.array_max("embedding"), 6).alias("top"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("filled"))


@query("SELECT vec_id, round(list_inner_product(v, v), 6) AS length FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS v FROM embeddings)")
def store_unit_vectors(t: Tables) -> DataFrame:
    return stores.unit(t.embeddings).select("vec_id", F.round(vx.dot(F.col("embedding"), F.col("embedding")), 6).alias("length"))
