"""Queries of the chunkers that use meaning or structure, and of their manager."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import chunkers
from corvane.plans.registry import Tables, query
from corvane.plans.text_queries import _STOP, TOKENS, WORDS

_HARD = f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
f AS (SELECT doc_id, list_reduce(w, lambda a, x: CASE WHEN a.n + length(x) + 1 > 300 AND len(a.now) > 0 THEN {{'done': list_append(a.done, array_to_string(a.now, ' ')), 'now': [x], 'n': length(x) + 1}} ELSE {{'done': a.done, 'now': list_append(a.now, x), 'n': a.n + length(x) + 1}} END, {{'done': []::VARCHAR[], 'now': []::VARCHAR[], 'n': 0::BIGINT}}) AS f FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, list_append(f.done, array_to_string(f.now, ' ')) AS c FROM f)"""


def _digest(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", F.md5("chunk"))


@query(f"{_HARD} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(len(c) AS INTEGER) AS total, md5(c[i]) AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)")
def chunk_hard_words(t: Tables) -> DataFrame:
    """Cuts between words alone, 300 characters at most."""
    return _digest(chunkers.chunked(t.documents, lambda x: [("words", None, c) for c in chunkers.by_words_hard(x, 300)], deduplicate=False)).select("doc_id", "pos", "total", "chunk")


_PARTS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?؟۔])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"""WITH s AS (SELECT doc_id, text, {_PARTS} AS s FROM documents WHERE text <> ''),
f AS (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN [text] ELSE list_reduce(s, lambda a, x: CASE WHEN length(a[len(a)]) > 0 AND length(a[len(a)]) + length(x) > 1500 THEN list_append(a, x) ELSE list_append(a[1:len(a) - 1], trim(a[len(a)] || ' ' || x)) END, ['']::VARCHAR[]) END AS c FROM s)
SELECT doc_id, CAST(len(c) AS BIGINT) AS chunks, CAST(list_max(list_transform(c, lambda x: length(x))) AS BIGINT) AS longest FROM f""")
def chunk_structural(t: Tables) -> DataFrame:
    """How many chunks the structural mode cuts a document into, and the longest's length."""
    c = chunkers.chunked(t.documents, "structural", deduplicate=False)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).cast("long").alias("longest"))


@query()
def chunk_semantic(t: Tables) -> DataFrame:
    """Chunks by meaning; sequential, so held against literals in tests."""
    return _digest(chunkers.chunked(t.documents, "semantic"))


@query()
def chunk_contextual(t: Tables) -> DataFrame:
    return _digest(chunkers.chunked(t.documents, "contextual"))


@query()
def chunk_hybrid(t: Tables) -> DataFrame:
    return _digest(chunkers.chunked(t.documents, "hybrid"))


@query()
def chunk_arabic(t: Tables) -> DataFrame:
    return _digest(chunkers.chunked(t.documents, "arabic_semantic"))


_HITS = {name: " + ".join(f"len(regexp_extract_all(text, '(?im){p}'))" for p in signs) for name, signs in (("faq", [r"\b(FAQ|frequently asked|what is|how to|how do)\b", r"\?"]), ("documentation", [r"\b(documentation|manual|guide|reference|overview|introduction)\b", r"^#{1,3}\s"]), ("technical", [r"\b(API|SDK|function|class|method|algorithm|database|server|config|import|def |class )\b", "```", r"\b(pip install|npm install|sudo)\b"]), ("narrative", [r"\b(story|chapter|novel|narrative)\b", "said|replied|whispered"]))}


@query(f"""WITH h AS (SELECT item_id, {', '.join(f'{v} AS {k}' for k, v in _HITS.items())} FROM benchmark), m AS (SELECT *, greatest({', '.join(_HITS)}) AS most FROM h)
SELECT item_id, CASE WHEN most = 0 THEN 'general' {' '.join(f"WHEN {k} = most THEN '{k}'" for k in _HITS)} END AS strategy FROM m""")
def chunk_strategy(t: Tables) -> DataFrame:
    """The strategy of each question's signs, with built-in functions."""
    c = F.col("text")
    hits = {n: sum((F.regexp_count(c, F.lit(f"(?im){p}")) for p in signs), F.lit(0)) for n, signs in chunkers.SIGNS.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "general")
    for n, h in hits.items():
        out = out.when(h == most, n)
    return t.benchmark.select("item_id", out.alias("strategy"))


@query("""WITH s AS (SELECT unnest(['faq', 'documentation', 'technical', 'narrative', 'general']) AS strategy, unnest([256, 768, 400, 1024, 512]) AS size, unnest([32, 128, 80, 200, 128]) AS overlap, unnest(['semantic', 'hybrid', 'adaptive', 'contextual', 'structural']) AS mode) SELECT * FROM s""")
def chunk_strategies(t: Tables) -> DataFrame:
    """What each strategy is cut by."""
    return t.spark.createDataFrame([(n, *v) for n, v in chunkers.STRATEGIES.items()], "strategy string, size int, overlap int, mode string")


@query(f"""{_HARD}, p AS (SELECT doc_id, i - 1 AS pos, len(c) AS total, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)), t AS (SELECT *, {TOKENS.format('chunk')} AS w FROM p)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(least(1.0, 0.4 * CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))) / len(w) END
+ 0.2 * CASE WHEN length(chunk) < 50 THEN 0.2 WHEN length(chunk) < 100 THEN 0.5 WHEN length(chunk) <= 600 THEN 1.0 ELSE greatest(0.5, 1.0 - (length(chunk) - 600) / 2000) END + 0.3 * CASE WHEN total <= 1 THEN 1.0 ELSE greatest(0.5, 1 - abs(pos / (total - 1) - 0.5)) END)::DOUBLE, 6) AS score FROM t""")
def chunk_scores(t: Tables) -> DataFrame:
    """The importance of each chunk of 300 characters."""
    c = chunkers.chunked(t.documents, lambda x: [("words", None, c) for c in chunkers.by_words_hard(x, 300)], deduplicate=False)
    return chunkers.enriched(c).select("doc_id", "pos", "score")
