"""Routing, prompts and parsed output over conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import validation as va
from corvane.operators import parsed, prompts, routing
from corvane.plans.event_queries import _OUT, _outputs
from corvane.plans.registry import Tables, query
from corvane.plans.retrieval_queries import _BM25, _bm25

_ROUTES = [("news", [], ["the", "and", "report"], ["token"], 0.05, True), ("help", ["a"], ["is", "in", "to", "of"], [], 0.0, True), ("open", [], [], [], -0.1, True), ("off", [], ["e"], [], 0.3, False)]


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS x FROM conversations WHERE role = 'user'),
k AS (SELECT query_id, 'news' AS route, CASE WHEN contains(x, 'token') THEN 0 ELSE (contains(x, 'the')::INT + contains(x, 'and')::INT + contains(x, 'report')::INT) / 3 END AS k, 0.05 AS b FROM q
UNION ALL SELECT query_id, 'help', CASE WHEN NOT contains(x, 'a') THEN 0 ELSE (contains(x, 'is')::INT + contains(x, 'in')::INT + contains(x, 'to')::INT + contains(x, 'of')::INT) / 4 END, 0 FROM q UNION ALL SELECT query_id, 'open', 0.1, -0.1 FROM q),
s AS (SELECT query_id, route, round(least(1, k * (0.2 / 0.9) + b)::DOUBLE, 6) AS score FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, route) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, route, score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.60 THEN 'medium' WHEN score >= 0.40 THEN 'low' ELSE 'none' END AS confidence FROM r WHERE rank <= 2""")
def route_keywords(t: Tables) -> DataFrame:
    routes = t.spark.createDataFrame(_ROUTES, "route string, required array<string>, any_of array<string>, excluded array<string>, bias double, enabled boolean")
    asked = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return routing.route(asked, routes, 2)


_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{k}'" for k, words in prompts.TYPES) + " ELSE 'qa' END"


@query(rf"""WITH u AS (SELECT conv_id, turn, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_KIND} AS kind, CASE WHEN n > 40 THEN 'complex' WHEN n > 20 THEN 'moderate' ELSE 'simple' END AS complexity, CASE WHEN n <= 7 THEN text ELSE array_to_string(w[1:7], ' ') || ' [...]' END AS capped FROM u""")
def prompt_requests(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.conversations.where("role = 'user'").select("conv_id", "turn", prompts.prompt_type(c).alias("kind"), prompts.complexity(c, F.lit(1)).alias("complexity"), prompts.capped(c, 10).alias("capped"))


@query(f"""WITH {_BM25}, b AS (SELECT query_id, rank, '[' || rank || '] doc' || doc_id || ' (relevance: ' || printf('%.2f', score) || ')' || chr(10) || text AS block FROM r JOIN documents USING (doc_id) WHERE rank <= 3)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS block FROM b GROUP BY 1""")
def prompt_context_block(t: Tables) -> DataFrame:
    """The numbered block of whole documents, the three best of each question, that a prompt carries; its digest keeps rows small."""
    best = _bm25(t).where("rank <= 3").join(t.documents.select("doc_id", "text"), "doc_id")
    docs = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "text"))), lambda x: F.struct(F.concat(F.lit("doc"), x["doc_id"].cast("string")).alias("source"), x["score"].alias("score"), x["text"].alias("content"))).alias("docs"))
    return docs.select("query_id", F.md5(prompts.context_block(F.col("docs"))).alias("block"))


@query("SELECT o_orderkey, '{\"key\": ' || o_orderkey || ', \"status\": \"' || o_orderstatus || '\"}' AS parsed, CAST(NULL AS VARCHAR) AS error FROM orders WHERE o_orderkey % 6 = 0")
def parse_json_output(t: Tables) -> DataFrame:
    return parsed.parse(_outputs(t).where("o_orderkey % 6 = 0")).drop("output")


@query(f"""WITH o AS ({_OUT}) SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'passed' ELSE 'failed' END AS key, CASE WHEN o_orderkey % 6 = 0 THEN 'passed' ELSE 'skipped' END AS status, o_orderkey % 6 = 0 AS valid FROM o""")
def validate_output(t: Tables) -> DataFrame:
    o = _outputs(t).select("o_orderkey", F.when(F.try_parse_json("output").isNotNull(), F.col("output")).alias("j"))
    key, status = va.field(F.get_json_object("j", "$.key"), True, "int"), va.field(F.get_json_object("j", "$.status"), False, "str", ["F", "O", "P"])
    return o.select("o_orderkey", key.alias("key"), status.alias("status"), va.valid(key, status).alias("valid"))
