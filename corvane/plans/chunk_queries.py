"""Chunking strategies over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunks, rows
from corvane.plans.registry import Tables, query
from corvane.plans.text_queries import SENTENCES, WORDS

_S = f"SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents"


def _fold(size: int, overlap: int, parts: str, separator: str = " ") -> str:
    """Greedy packing as a fold in SQL; the state is (packs, parts of the open pack, their length)."""
    keep = f"list_reduce(list_reverse(a.now), lambda b, y: CASE WHEN b.over OR b.n + length(y) > {overlap} THEN {{'keep': b.keep, 'n': b.n, 'over': true}} ELSE {{'keep': list_prepend(y, b.keep), 'n': b.n + length(y), 'over': false}} END, {{'keep': []::VARCHAR[], 'n': 0::BIGINT, 'over': false}})"
    rest = f"{keep}.keep" if overlap else "[]::VARCHAR[]"
    n = f"{keep}.n" if overlap else "0::BIGINT"
    join = f"array_to_string(a.now, '{separator}')"
    return f"""SELECT doc_id, list_reduce({parts}, lambda a, x: CASE WHEN a.n + length(x) > {size} AND len(a.now) > 0 THEN {{'done': list_append(a.done, {join}), 'now': list_append({rest}, x), 'n': {n} + length(x)}} ELSE {{'done': a.done, 'now': list_append(a.now, x), 'n': a.n + length(x)}} END, {{'done': []::VARCHAR[], 'now': []::VARCHAR[], 'n': 0::BIGINT}}) AS f FROM p"""


def _packed(size: int, overlap: int, source: str, parts: str = "s", separator: str = " ") -> str:
    return f"""WITH p AS ({source}), f AS ({_fold(size, overlap, parts, separator)}), c AS (SELECT doc_id, list_filter(list_append(f.done, array_to_string(f.now, '{separator}')), lambda x: trim(x) <> '') AS c FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(len(c) AS INTEGER) AS total, md5(c[i]) AS chunk FROM c, range(1, 100000) r(i) WHERE i <= len(c)"""


def _md5(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", F.md5("chunk"))


@query(f"WITH s AS ({_S}) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(len(s) AS INTEGER) AS total, md5(s[i]) AS chunk FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def chunk_sentences(t: Tables) -> DataFrame:
    return _md5(chunks.numbered(t.documents, tx.sentences(F.col("text"))))


@query(_packed(512, 0, _S).replace("FROM c, range(1, 100000) r(i) WHERE i <= len(c)", "FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)"))
def chunk_pack_sentence(t: Tables) -> DataFrame:
    return _md5(chunks.by_sentence(t.documents))


@query(_packed(512, 128, _S).replace("FROM c, range(1, 100000) r(i) WHERE i <= len(c)", "FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)"))
def chunk_pack_overlap(t: Tables) -> DataFrame:
    return _md5(chunks.by_sentence(t.documents, 512, 128))


@query(_packed(1000, 200, "SELECT doc_id, string_split(text, chr(10)) AS s FROM documents", separator="' || chr(10) || '").replace("array_to_string(a.now, '' || chr(10) || '')", "array_to_string(a.now, chr(10))").replace("array_to_string(f.now, '' || chr(10) || '')", "array_to_string(f.now, chr(10))").replace("FROM c, range(1, 100000) r(i) WHERE i <= len(c)", "FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)"))
def chunk_separator(t: Tables) -> DataFrame:
    return _md5(chunks.by_separator(t.documents))


@query(f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), b AS (SELECT doc_id, w, unnest(range(1, len(w) + 1, 180)) AS i FROM w)
SELECT doc_id, CAST((i - 1) / 180 AS INTEGER) AS pos, CAST(ceil(len(w) / 180) AS INTEGER) AS total, md5(array_to_string(w[i:i + 199], ' ')) AS chunk FROM b""")
def chunk_token_window(t: Tables) -> DataFrame:
    return _md5(chunks.by_words(t.documents))


@query(f"WITH s AS ({_S}) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, md5(s[i]) AS core, md5(array_to_string(s[greatest(i - 2, 1):least(i + 2, len(s))], ' ')) AS chunk FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def chunk_context_window(t: Tables) -> DataFrame:
    return _md5(chunks.with_window(t.documents)).withColumn("core", F.md5("core"))


@query()
def chunk_recursive(t: Tables) -> DataFrame:
    return chunks.recursive(t.documents)


@query()
def chunk_adaptive(t: Tables) -> DataFrame:
    return chunks.adaptive(t.documents)


@query()
def markdown_sections(t: Tables) -> DataFrame:
    return chunks.markdown_sections(t.documents)


@query(f"WITH s AS ({_S}), c AS (SELECT doc_id, unnest(s) AS c FROM s) SELECT doc_id, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars, round(avg(length(c)), 6) AS mean, CAST(min(length(c)) AS BIGINT) AS least, CAST(max(length(c)) AS BIGINT) AS most FROM c GROUP BY 1")
def chunk_stats(t: Tables) -> DataFrame:
    n = F.length("chunk").cast("long")
    return chunks.numbered(t.documents, tx.sentences(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(f"""WITH s AS ({_S}), c AS (SELECT doc_id, i - 1 AS pos, len(s) AS total, s[i] AS c FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s))
SELECT CASE WHEN length(c) < 50 THEN 'short' WHEN length(c) <= 200 THEN 'medium' ELSE 'long' END AS kind, count(*) AS n, round(avg(CASE WHEN total <= 1 THEN 1.0 ELSE greatest(0.5, 1 - abs(pos / (total - 1) - 0.5)) END::DOUBLE), 6) AS position FROM c GROUP BY 1""")
def chunk_type_hist(t: Tables) -> DataFrame:
    c = chunks.numbered(t.documents, tx.sentences(F.col("text")))
    kind = F.when(F.length("chunk") < 50, "short").when(F.length("chunk") <= 200, "medium").otherwise("long")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(tx.position_score(F.col("pos"), F.col("total"))), 6).alias("position"))


@query(f"""WITH s AS ({_S}), c AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract_all(lower(s[i]), '[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
b AS (SELECT doc_id, pos, CAST(('0x' || substr(md5(x), 1, 7)) AS BIGINT) % 256 AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, pos, unnest(w) AS x FROM c) GROUP BY ALL), m AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS m FROM b GROUP BY ALL),
d AS (SELECT y.doc_id, y.pos, sum(x.n * y.n) AS d FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.pos + 1 = y.pos AND x.b = y.b GROUP BY ALL)
SELECT y.doc_id, y.pos, round(coalesce(d.d, 0) / (x.m * y.m), 6) AS similarity FROM m y JOIN m x ON x.doc_id = y.doc_id AND x.pos + 1 = y.pos LEFT JOIN d ON d.doc_id = y.doc_id AND d.pos = y.pos""")
def adjacent_similarity(t: Tables) -> DataFrame:
    return chunks.sentence_similarity(t.documents)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - rank // 2 END AS place FROM r""")
def lost_in_middle(t: Tables) -> DataFrame:
    """The best at both ends, the least in the middle: even ranks from the front, odd ones from the back."""
    sized = t.documents.select("doc_id", "source", F.length("text").alias("length"))
    r = rows.running(sized, "source", [F.desc("length"), F.col("doc_id")], t.once).withColumn("rank", F.col("place") - 1)
    return r.select("doc_id", "source", F.when(F.expr("rank % 2 = 0"), F.expr("rank div 2")).otherwise(F.expr("n - 1 - rank div 2")).alias("place"))


@query("""WITH o AS (SELECT doc_id, source, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS reached FROM documents) SELECT doc_id, source, CAST(reached AS BIGINT) AS reached, reached <= 20000 AS included FROM o""")
def context_budget(t: Tables) -> DataFrame:
    """A running budget that stops at the first overflow."""
    r = rows.running(t.documents.select("doc_id", "source", F.length("text").alias("length")), "source", ["doc_id"], t.once, F.col("length"))
    return r.select("doc_id", "source", "reached", (F.col("reached") <= 20000).alias("included"))


@query("""WITH l AS (SELECT source, list(length(text)::BIGINT ORDER BY doc_id) AS sizes, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1),
f AS (SELECT source, ids, list_reduce(sizes, lambda a, x: CASE WHEN a.used + x <= 20000 THEN {'used': a.used + x, 'fits': list_append(a.fits, true)} ELSE {'used': a.used, 'fits': list_append(a.fits, false)} END, {'used': 0::BIGINT, 'fits': []::BOOLEAN[]}).fits AS fits FROM l)
SELECT source, unnest(ids) AS doc_id, unnest(fits) AS fits FROM f""")
def budget_skip(t: Tables) -> DataFrame:
    """A budget that passes over what does not fit."""
    return rows.within_budget(t.documents.select("source", "doc_id", F.length("text").alias("size")), "source", "doc_id", "size", 20000)
