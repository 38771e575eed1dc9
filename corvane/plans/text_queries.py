"""Text functions, deduplication and enrichment over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import query as qx
from corvane.functions import text as tx
from corvane.operators import rows, search
from corvane.plans.registry import Tables, query
from corvane.sources import files, html

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
HASH = r"sha256(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')))"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '([.!?؟۔])\s+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
USER = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"SELECT doc_id, {HASH} AS hash, md5(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS prompt_hash FROM documents")
def text_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.content_hash(F.col("text")).alias("hash"), tx.prompt_hash(F.col("text")).alias("prompt_hash"))


@query("SELECT doc_id, 'doc_' || substr(sha256(source || ':' || lang || ':' || text), 1, 16) AS id FROM documents")
def document_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.document_id(F.col("source"), F.col("lang"), F.col("text")).alias("id"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {HASH}")
def doc_hash_dedup(t: Tables) -> DataFrame:
    return rows.keep_first(t.documents, tx.content_hash(F.col("text")), ["doc_id"]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(substr(text, 1, 100))")
def doc_prefix_dedup(t: Tables) -> DataFrame:
    return rows.keep_first(t.documents, tx.prefix_key(F.col("text")), ["doc_id"]).select("doc_id")


_SHINGLES = r"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, source, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, source, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
f AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY cls) AS first FROM (SELECT doc_id, count(*) AS n, md5(array_to_string(list(s ORDER BY s), ',')) AS cls FROM s GROUP BY 1)), n AS (SELECT doc_id, n FROM f WHERE doc_id = first),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM (s JOIN n USING (doc_id)) a JOIN (s JOIN n USING (doc_id)) b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT c.a, c.b, round(k / (x.n + y.n - k), 6) AS jaccard FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE round(k / (x.n + y.n - k), 6) >= 0.3"""


@query(_SHINGLES)
def doc_jaccard_pairs(t: Tables) -> DataFrame:
    """Pairs of unlike texts, the first document of each set of shingles standing for its copies (``doc_copies``)."""
    return rows.similar_pairs(t.documents, once=t.once)


@query(_SHINGLES[: _SHINGLES.index(", n AS (SELECT doc_id, n FROM f")] + " SELECT doc_id, first FROM f")
def doc_copies(t: Tables) -> DataFrame:
    return rows.copies(t.documents)


@query()
def doc_greedy_similarity_dedup(t: Tables) -> DataFrame:
    """A document goes if it is alike (0.85) to an earlier one that stays; a sequential rule, so rows-only here and brute force in tests."""
    pairs = rows.similar_pairs(t.documents, least=0.85, once=t.once)
    return rows.drop_similar(t.documents.select("doc_id"), pairs, rows.copies(t.documents))


@query(f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS words, CAST(floor(len({WORDS.format('text')}) * 1.3) AS BIGINT) AS token_estimate, CAST(len({TOKENS.format('text')}) AS BIGINT) AS tokens FROM documents")
def token_counts(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.size(tx.words(c)).cast("long").alias("words"), tx.token_estimate(c).alias("token_estimate"), F.size(tx.tokens(c)).cast("long").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({SENTENCES.format('text')}) AS BIGINT) AS sentences, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?؟\\n]'), lambda x: {STRIP.format('x')}), lambda x: x <> '')) AS BIGINT) AS delimited FROM documents")
def sentence_counts(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.size(tx.sentences(c)).cast("long").alias("sentences"), F.size(tx.delimited_sentences(c)).cast("long").alias("delimited"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)<(html|body|div|p|h[1-6]|ul|ol|li|table)[^>]*>') THEN 'html' WHEN regexp_matches(text, '(?m)^#{1,6}\s') OR contains(text, '```') OR regexp_matches(text, '\*\*.+?\*\*') THEN 'markdown'
WHEN len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) / greatest(length(text), 1) > 0.2 THEN 'arabic' ELSE 'plain_text' END AS kind, 'english' AS script,
CAST(len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]+')) / length(text) AS DOUBLE) AS run_ratio, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) / greatest(length(replace(text, ' ', '')), 1) >= 0.3 AS arabic FROM documents""")
def language_block(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", tx.document_type(c).alias("kind"), tx.script_language(c).alias("script"), tx.arabic_run_ratio(c).alias("run_ratio"), tx.is_arabic(c).alias("arabic"))


@query(rf"""WITH d AS (SELECT doc_id, text, {TOKENS.format('text')} AS w, length(text) AS n FROM documents),
e AS (SELECT doc_id, round(least(least(len(regexp_extract_all(text, '{tx.TECHNICAL}')) / greatest(n / 100, 1), 1) * 0.4 + len(list_distinct(w)) / greatest(len(w), 1) * 0.3 + least(list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1) / 10, 1) * 0.2
+ least(len(regexp_extract_all(text, '{tx.ARABIC_LONG}')) / greatest(n / 200, 1), 1) * 0.1, 1), 6) AS density FROM d) SELECT doc_id, density FROM e""")
def density(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.density(F.col("text")), 6).alias("density"))


@query(r"SELECT doc_id, regexp_matches(text, '" + tx.NOISE + r"') AS noise, length(text) BETWEEN 20 AND 4000 AS fits FROM documents")
def noise_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.is_noise(F.col("text")).alias("noise"), F.length("text").between(20, 4000).alias("fits"))


_LEAK = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in tx.LEAKAGE.items()) + " END"


@query(f"SELECT doc_id, {_LEAK} AS leak, regexp_matches(text, '{tx.INJECTION}') AS injection, regexp_matches(text, '" + tx.HALLUCINATION.replace("'", "''") + "') AS hallucination FROM documents")
def safety_flags(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", tx.leakage(c).alias("leak"), c.rlike(tx.INJECTION).alias("injection"), c.rlike(tx.HALLUCINATION).alias("hallucination"))


_STOP = quoted([*tx.STOP_WORDS_AR, *tx.STOP_WORDS_EN])


@query(f"""WITH d AS (SELECT doc_id, text, {TOKENS.format('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))) / len(w) END, 6) AS density,
round(CASE WHEN length(text) < 50 THEN 0.2 WHEN length(text) < 100 THEN 0.5 WHEN length(text) <= 600 THEN 1.0 ELSE greatest(0.5, 1.0 - (length(text) - 600) / 2000) END::DOUBLE, 6) AS length_score FROM d""")
def keyword_density(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.round(tx.keyword_density(c), 6).alias("density"), F.round(tx.length_score(c), 6).alias("length_score"))


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM w GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, w, round(n / total * (ln((SELECT count(*) FROM documents) + 1) - ln(df + 1) + 1), 6) AS tfidf FROM tf JOIN df USING (w) WHERE length(w) >= 2 AND NOT list_contains({_STOP}, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, w) AS rank FROM s) SELECT doc_id, w AS word, CAST(rank AS INTEGER) AS rank, tfidf AS score FROM r WHERE rank <= 10""")
def keywords_topk(t: Tables) -> DataFrame:
    """Ten words of most tf-idf over the whole table for each document."""
    stop = [*tx.STOP_WORDS_AR, *tx.STOP_WORDS_EN]
    tf = t.once("terms", lambda: search.postings(t.documents, "doc_id", "text").where((F.length("term") >= 2) & ~F.col("term").isin(stop)).select("doc_id", F.col("term").alias("word"), F.col("tf").alias("n"), F.col("length").alias("total")))
    df = search.small(tf.groupBy("word").agg(F.count("*").alias("df")), 1_000_000)
    docs = t.documents.agg(F.count("*").alias("docs"))
    score = F.round(F.col("n") / F.col("total") * (F.log(F.col("docs") + 1) - F.log(F.col("df") + 1) + 1), 6)
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "word")
    scored = tf.join(df, "word").crossJoin(F.broadcast(docs)).withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("doc_id", "word", "rank", "score")


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents) SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def term_statistics(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("word"))
    per = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("docs >= 3")


_INTENT = {k: " + ".join(f"contains(lower(text), '{s}')::INT" for s in v.split("|")) for k, v in qx.INTENTS.items()}
_MOST = "greatest(" + ", ".join(f"i_{k}" for k in _INTENT) + ")"


@query(f"""WITH u AS ({USER}), i AS (SELECT *, {', '.join(f'{v} AS i_{k}' for k, v in _INTENT.items())} FROM u),
c AS (SELECT *, CASE WHEN regexp_matches(text, '{qx.HIGH}') OR len({WORDS.format('text')}) > 20 THEN 'high' WHEN len({WORDS.format('text')}) <= 12 THEN 'low' ELSE 'medium' END AS complexity FROM i)
SELECT conv_id, turn, CASE WHEN {_MOST} = 0 THEN 'factual' {' '.join(f"WHEN i_{k} = {_MOST} THEN '{k}'" for k in _INTENT)} END AS intent, complexity, CASE complexity WHEN 'low' THEN 800 WHEN 'medium' THEN 2000 ELSE 4000 END AS budget,
CASE WHEN regexp_matches(lower({STRIP.format('text')}), '^({'|'.join(qx.WH)})') THEN 'wh-question' WHEN regexp_matches(lower({STRIP.format('text')}), '^({'|'.join(qx.YES_NO)})') THEN 'yes/no' ELSE 'open' END AS question FROM c""")
def query_analysis(t: Tables) -> DataFrame:
    c = F.col("text")
    u = t.conversations.where("role = 'user'").withColumn("complexity", qx.complexity(c))
    return u.select("conv_id", "turn", qx.intent(c).alias("intent"), "complexity", qx.budget(F.col("complexity")).alias("budget"), qx.question_type(c).alias("question"))


@query(rf"""WITH u AS ({USER}), w AS (SELECT conv_id, turn, list_filter({TOKENS.format('text')}, lambda x: length(x) >= 2 AND NOT list_contains({quoted(qx.STOP_EN)}, x)) AS w FROM u),
e AS (SELECT DISTINCT conv_id, turn, x, round(len(list_filter(w, lambda y: y = x)) * (1 + length(x) * 0.05), 6) AS s, list_position(w, x) AS place FROM (SELECT conv_id, turn, w, unnest(w) AS x FROM w)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, place) AS k FROM e)
SELECT conv_id, turn, string_agg(x, ' ' ORDER BY k) AS keywords FROM r WHERE k <= 12 GROUP BY ALL""")
def query_keywords(t: Tables) -> DataFrame:
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.array_join(qx.keywords(F.col("text")), " ").alias("keywords"))
    return u.where("keywords <> ''")


@query()
def entities(t: Tables) -> DataFrame:
    """Word ends are Unicode's, which the SQL engine's patterns lack; held against a plain reading in tests."""
    e = F.regexp_extract_all("text", F.lit(qx.ENTITY), F.lit(0))
    return t.documents.select("doc_id", F.size(F.array_distinct(e)).cast("long").alias("distinct_entities"), F.coalesce(F.try_element_at(e, F.lit(1)), F.lit("")).alias("first"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([.,!?؟،;:])', '\1', 'g')) AS spaced FROM documents")
def punctuation_spacing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.fix_punctuation_spacing(F.col("text")).alias("spaced"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE (CASE WHEN strpos(reverse(substr(text, 1, 197)), ' ') > 0 AND 197 - strpos(reverse(substr(text, 1, 197)), ' ') > 0.7 * 197 THEN substr(text, 1, 197 - strpos(reverse(substr(text, 1, 197)), ' ')) ELSE substr(text, 1, 197) END) || '...' END AS cut FROM documents""")
def hard_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.hard_truncate(F.col("text"), 200).alias("cut"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?is)<html[^>]*\blang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '(?is)<meta\s+(?:name|property)="description"\s+content="([^"]*)"', 1), '') AS description, CAST(len(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"')) AS BIGINT) AS links FROM pages""")
def html_metadata(t: Tables) -> DataFrame:
    h = F.col("html")
    return t.pages.select("page_id", html.title(h).alias("title"), html.language(h).alias("lang"), html.meta(h, "description").alias("description"), F.size(html.links(h)).cast("long").alias("links"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header)\b.*?</(script|style|nav|footer|header)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.visible_text(F.col("html")).alias("text"))


@query()
def html_documents(t: Tables) -> DataFrame:
    """Text and tables by a parser that closes what pages leave open; held against literals in tests."""
    return html.extract(t.pages)


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^(?i)https?://') THEN 'web' ELSE 'unknown' END AS type, regexp_extract(url, '^(?i)https?://([^/?#]+)', 1) AS host FROM pages")
def url_type(t: Tables) -> DataFrame:
    return t.pages.select("page_id", files.source_type(F.col("url")).alias("type"), F.regexp_extract("url", r"^(?i)https?://([^/?#]+)", 1).alias("host"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'k: ' || json_extract_string(props, '$.k') AS text FROM events WHERE props IS NOT NULL")
def json_to_text(t: Tables) -> DataFrame:
    return t.events.where("props IS NOT NULL").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), files.json_text("props").alias("text"))


@query("SELECT c_custkey, 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment AS content FROM customer")
def csv_row_text(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", files.row_text(["c_name", "c_mktsegment"]).alias("content"))


@query("SELECT d.doc_id, d.source, CASE l.quality WHEN 1 THEN 3 WHEN 0 THEN 1 ELSE 0 END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def quality_left_join(t: Tables) -> DataFrame:
    q = t.labels.select("doc_id", F.when(F.col("quality") == 1, 3).when(F.col("quality") == 0, 1).otherwise(0).alias("q"))
    return t.documents.join(q, "doc_id", "left").select("doc_id", "source", F.coalesce("q", F.lit(0)).alias("quality"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def source_rollup(t: Tables) -> DataFrame:
    n = F.length("text").cast("long")
    return t.documents.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean")).select("source", "lang", "n", "chars", "mean")
