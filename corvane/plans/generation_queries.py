"""Queries of caches, enriched questions, calls of a model and what becomes of its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import validation as va
from corvane.operators import caches, generation, prompts, routing
from corvane.plans.registry import Tables, query

_WORDS = r"len(regexp_extract_all(text, '\s*\S+|\s+$'))"


@query("""WITH RECURSIVE k AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, ts AS put, false AS hit FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.event_id, k.i, CASE WHEN k.ts - r.put <= INTERVAL 6 HOUR THEN r.put ELSE k.ts END, k.ts - r.put <= INTERVAL 6 HOUR FROM r JOIN k ON k.user_id = r.user_id AND k.i = r.i + 1)
SELECT event_id, hit FROM r""")
def cache_replay(t: Tables) -> DataFrame:
    """Which events would find their user's entry in a cache of six hours."""
    return caches.replayed(t.events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id"), 6 * 3600).select("event_id", "hit")


@query("""WITH g AS (SELECT event_type, CAST(epoch(ts) // 1 AS BIGINT) AS s FROM events) SELECT count(DISTINCT user_id) AS size, CAST(0 AS BIGINT) AS hits, count(*) AS misses, 0.0::DOUBLE AS hit_rate FROM events""")
def cache_stats(t: Tables) -> DataFrame:
    """A cache whose entries live for less than nothing never hits."""
    return caches.stats(caches.replayed(t.events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id"), -1))


@query("SELECT conv_id, turn, md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS key FROM conversations")
def cache_keys(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", caches.query_key(F.col("text")).alias("key"))


@query("""WITH p AS (SELECT conv_id, turn, text AS query, lead(text) OVER w AS answer, lead(role) OVER w AS next, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM p WHERE role = 'user' AND next = 'assistant'), t AS (SELECT conv_id, string_agg('Q: ' || query || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY turn) AS told FROM a WHERE k <= 2 AND query <> '' AND answer <> '' GROUP BY 1)
SELECT c.conv_id, md5(CASE WHEN told IS NULL THEN 'And now?' ELSE '[Previous conversation:' || chr(10) || told || ']' || chr(10) || chr(10) || 'Current question: And now?' END) AS query FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t USING (conv_id)""")
def enriched_query(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    h = t.conversations.withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)}).where("role = 'user' AND next = 'assistant'")
    now = t.conversations.select("conv_id").distinct().withColumn("query", F.lit("And now?"))
    return caches.enriched_query(h.select("conv_id", "turn", F.col("text").alias("query"), "answer"), now).select("conv_id", F.md5("query").alias("query"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN NULL ELSE 're: ' || text END AS answer, turn % 5 = 0 AS failed FROM conversations WHERE role = 'user'")
def model_calls(t: Tables) -> DataFrame:
    """A model that repeats what it is told and fails on every fifth turn: only those rows have errors."""

    def call(batch: list[list[dict]]) -> list[str]:
        if any(m[0]["content"] == "fail" for m in batch):
            raise ConnectionError("down")
        return ["re: " + m[-1]["content"] for m in batch]

    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", generation.chat(F.when(F.col("turn") % 5 == 0, "fail").otherwise(""), F.col("text")).alias("messages"))
    return generation.generated(asked, call).select("conv_id", "turn", "answer", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT doc_id, {_WORDS} AS pieces, length(text) AS chars FROM documents WHERE text <> ''")
def model_stream(t: Tables) -> DataFrame:
    """How many pieces each text streams in, and that no character is lost."""
    p = generation.streamed(t.documents, "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("chars"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'mended' WHEN 2 THEN 'mended' ELSE 'fallback' END AS how, CASE WHEN o_orderkey % 4 = 3 THEN 'no answer ' || o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS answer, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM orders""")
def answers_parsed(t: Tables) -> DataFrame:
    """Answers written as JSON, as loose JSON, as lines and as words: how each was read, and what it says."""
    n, k = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    out = F.when(n == 0, F.concat(F.lit('{"answer": "'), k, F.lit('", "confidence": 7}'))).when(n == 1, F.concat(F.lit("{answer: '"), k, F.lit("', confidence: 0.5,}"))).when(n == 2, F.concat(F.lit("Answer: "), k)).otherwise(F.concat(F.lit("no answer "), "o_orderstatus"))
    p = generation.parsed_or(t.orders.select("o_orderkey", out.alias("output")))
    s = generation.answer_schema(F.col("parsed"))
    return p.select("o_orderkey", "how", s["answer"].alias("answer"), s["confidence"].alias("confidence"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_1s(t: Tables) -> DataFrame:
    """Requests of the last second: the window of a limit of so many a second."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-1_000_000, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("n"))


@query("SELECT doc_id, round(least(1.0, quality * 0.9 + toxic * 0.3), 6)::DOUBLE AS score FROM labels")
def route_effective(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", routing.effective(F.col("quality") * 0.9, F.col("toxic") * 0.3).alias("score"))


@query("""WITH g AS (SELECT * FROM (VALUES ('rag', ['according', 'find', 'search', 'retrieve', 'document', 'manual', 'policy', 'report'], ['write', 'create', 'generate', 'code'], 0.08), ('talk', ['hello', 'thanks', 'please'], []::VARCHAR[], 0.0)) v(grp, any_of, excluded, boost)),
s AS (SELECT conv_id, turn, grp, boost, CASE WHEN len(list_filter(excluded, lambda w: contains(lower(text), w))) > 0 THEN 0 ELSE len(list_filter(any_of, lambda w: contains(lower(text), w))) / len(any_of) END AS s FROM conversations, g WHERE role = 'user')
SELECT conv_id, turn, grp, round(least(1.0, s + CASE WHEN s > 0 THEN boost ELSE 0 END)::DOUBLE, 6) AS score FROM s""")
def route_group_scores(t: Tables) -> DataFrame:
    """How well each question fits the ready-made group for documents, and one for talk."""
    groups = t.spark.createDataFrame([("rag", routing.RAG_WORDS, routing.RAG_EXCLUDED, 0.08), ("talk", ["hello", "thanks", "please"], [], 0.0)], "grp string, any_of array<string>, excluded array<string>, boost double")
    asked = t.conversations.where("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    return routing.group_scores(asked, groups).select("query_id.conv_id", "query_id.turn", "grp", "score")


@query("""SELECT c_custkey, CASE WHEN length(c_name) BETWEEN 5 AND 18 THEN 'passed' ELSE 'failed' END AS name, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'passed' ELSE 'failed' END AS balance, CASE WHEN regexp_matches(c_mktsegment, '^[A-M]') THEN 'passed' ELSE 'failed' END AS segment,
CAST((length(c_name) BETWEEN 5 AND 18)::INT + (c_acctbal BETWEEN 0 AND 5000)::INT + regexp_matches(c_mktsegment, '^[A-M]')::INT AS INTEGER) AS passed FROM customer""")
def validation_rules(t: Tables) -> DataFrame:
    name, balance, segment = va.rule(F.col("c_name"), 5, 18), va.rule(F.col("c_acctbal").cast("string"), low=0, high=5000), va.rule(F.col("c_mktsegment"), pattern="^[A-M]")
    return t.customer.select("c_custkey", name.alias("name"), balance.alias("balance"), segment.alias("segment"), va.summary(F.array(name, balance, segment))["passed"].alias("passed"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS tidy FROM conversations""".replace("\\\\", "\\"))
def prompt_tidy(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", prompts.tidy(F.col("text")).alias("tidy"))
