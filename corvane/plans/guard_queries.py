"""Queries of guards, plugins, prompts, routes and output mending over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixing as fx
from corvane.operators import guards, plugins, prompting, routing
from corvane.plans.registry import Tables, query

_ATTACK = " OR ".join(f"regexp_matches(text, '{p}')" for p in guards.ATTACKS)


@query("SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN false ELSE length(text) >= 200 END AS passed, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 1 ELSE (length(text) < 200)::INT + (length(text) > 2000)::INT + (NOT (contains(text, '[:') OR contains(text, '[Source:') OR contains(text, '[source:') OR contains(text, '---')))::INT END AS warnings FROM documents")
def context_guard(t: Tables) -> DataFrame:
    """Documents as contexts of 200 to 2000 characters: whether each passes, and how many warnings it gets."""
    c = guards.context_check(F.col("text"), 200, 2000)
    return t.documents.select("doc_id", c["passed"].alias("passed"), F.size(c["warnings"]).alias("warnings"))


@query(f"SELECT doc_id, {_ATTACK} AS attacked FROM documents")
def input_attacks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", guards.attacked(F.col("text")).alias("attacked"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 4 = 0 THEN 'not a number' END AS amount, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'not a choice' END AS status FROM orders")
def input_problems(t: Tables) -> DataFrame:
    """Why orders' amounts, some missing and some words, and statuses are refused."""
    amount = F.when(F.col("o_orderkey") % 9 == 0, None).when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("about "), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", guards.input_problem(amount, "number").alias("amount"), guards.input_problem(F.col("o_orderstatus"), choices=["O", "F"]).alias("status"))


@query("SELECT event_id, event_type <> 'error' AND user_id % 3 <> 0 AND (user_id % 2 = 0 OR event_type = 'view') AS allowed FROM events")
def permissions(t: Tables) -> DataFrame:
    """Which events their user may do: a third of the users have no policy, odd ones may only view, errors are denied to all."""
    kinds = t.events.agg(F.sort_array(F.collect_set("event_type")).alias("all"))
    users = t.events.select("user_id").distinct().where("user_id % 3 <> 0")
    grants = users.crossJoin(F.broadcast(kinds)).select(F.col("user_id").cast("string").alias("plugin"), F.when(F.col("user_id") % 2 == 0, F.col("all")).otherwise(F.array(F.lit("view"))).alias("granted"), F.array(F.lit("error")).alias("denied"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("user"))
    asked = t.events.select("event_id", F.col("user_id").cast("string").alias("plugin"), F.col("event_type").alias("permission"), F.lit("s").alias("session"), F.lit("u").alias("user"))
    return guards.allowed(asked, grants).select("event_id", "allowed")


@query("SELECT user_id, CASE WHEN count(*) >= 10 AND avg(value) * 10 < 1000 THEN greatest(200, CAST(floor(avg(value) * 10 * 1.3) AS INTEGER)) ELSE 2000 END AS budget FROM events GROUP BY 1")
def budget_suggested(t: Tables) -> DataFrame:
    """Each user's budget of 2000 after what was used, ten times the events' values.

    Sums of doubles depend on the order of the rows, which tips a budget that is
    an exact integer; so values are summed as decimals wherever these are exact.
    """
    exact = F.col("value").try_cast("decimal(28,10)")
    told = F.count_if(F.col("value").isNotNull() & ~F.coalesce(exact.cast("double") == F.col("value"), F.lit(False))) == 0
    used = t.events.groupBy("user_id").agg(F.avg(exact).alias("exact"), F.avg("value").alias("mean"), told.alias("told"), F.count("*").alias("n"))
    budget = lambda mean: guards.suggested_budget(F.lit(2000), F.col(mean) * 10, F.col("n"))
    return used.select("user_id", F.when(F.col("told"), budget("exact")).otherwise(budget("mean")).alias("budget"))


@query("WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT count(*) AS queries, round(avg(value), 2) AS mean_ms, round(avg((event_type = 'error')::INT), 3) AS failures FROM l")
def tuning_hints(t: Tables) -> DataFrame:
    return guards.tuning_hints(t.events.select(F.struct("ts", "event_id").alias("at"), F.col("value").alias("ms"), (F.col("event_type") == "error").alias("failed"))).drop("hints")


@query("""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents), r AS (SELECT *, 1500 - length(p[1]) - length(p[len(p)]) - 2 AS room FROM p),
k AS (SELECT *, list_reduce(list_prepend({'kept': []::VARCHAR[], 'used': 0::BIGINT, 'full': false}, list_transform(p[2:len(p) - 1], lambda x: {'kept': [x], 'used': 0::BIGINT, 'full': false})), lambda a, x: CASE WHEN NOT a.full AND a.used + length(x.kept[1]) <= room THEN {'kept': list_append(a.kept, x.kept[1]), 'used': a.used + length(x.kept[1]), 'full': false} ELSE {'kept': a.kept, 'used': a.used, 'full': true} END) AS k FROM r)
SELECT doc_id, CASE WHEN length(text) <= 1500 THEN md5(text) WHEN len(p) > 2 AND room >= 50 THEN md5(array_to_string(list_concat([p[1]], list_append(k.kept, p[len(p)])), chr(10))) ELSE 'cut' END AS digest FROM k""")
def context_compressed(t: Tables) -> DataFrame:
    """Documents within 1500 characters: first and last line and those between that fit; 'cut' where there are too few lines or no room."""
    c, parts = F.col("text"), F.split("text", "\n")
    room = 1500 - F.length(parts[0]) - F.length(F.element_at(parts, -1)) - 2
    cut = (F.length(c) > 1500) & ((F.size(parts) <= 2) | (room < 50))
    return t.documents.select("doc_id", F.when(cut, "cut").otherwise(F.md5(guards.compressed(c, 1500, "\n"))).alias("digest"))


@query("""SELECT conv_id AS query_id, count(*) FILTER (turn % 3 <> 0) AS chunks, count(*) FILTER (turn % 3 = 0) AS left_out, CAST(coalesce(sum(length(text)) FILTER (turn % 3 <> 0), 0) AS BIGINT) AS chars, count(DISTINCT role) FILTER (turn % 3 <> 0) AS sources, round(avg(turn) FILTER (turn % 3 <> 0), 6) AS mean_score, max(turn) FILTER (turn % 3 <> 0) AS best FROM conversations GROUP BY 1""")
def composition_stats(t: Tables) -> DataFrame:
    c = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("role").alias("source"), F.col("turn").alias("score"), F.length("text").alias("n"), (F.col("turn") % 3 != 0).alias("included"))
    return guards.composition_stats(c)


@query("""WITH b AS (SELECT user_id AS session, event_type AS chunk, max(value) AS score, count(*) AS questions FROM events GROUP BY ALL) SELECT session, chunk, score, questions, CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM b QUALIFY rank <= 3""")
def merged_contexts(t: Tables) -> DataFrame:
    return guards.merged_contexts(t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("chunk"), F.col("value").alias("score")), 3)


@query("""WITH r AS (SELECT event_type AS plugin, count(*) AS executions, avg((value > 5)::INT) AS rate, round(avg(value), 1) AS avg_ms, round(max(value), 1) AS max_ms, round(min(value), 1) AS min_ms FROM events GROUP BY 1)
SELECT plugin, executions, round(rate * 100, 1) AS success_rate, avg_ms, max_ms, min_ms, CASE WHEN rate >= 0.95 THEN 'excellent' WHEN rate >= 0.80 THEN 'good' WHEN rate >= 0.60 THEN 'degraded' ELSE 'critical' END AS health, CASE WHEN rate >= 0.95 THEN 100 WHEN rate >= 0.80 THEN 80 WHEN rate >= 0.60 THEN 60 ELSE 30 END AS health_score FROM r""")
def plugin_report(t: Tables) -> DataFrame:
    return plugins.execution_report(_runs(t))


def _runs(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("plugin"), F.col("value").alias("ms"), (F.col("value") > 5).alias("ok"))


@query("SELECT count(*) AS executions, count(*) FILTER (NOT value > 5) AS failures, round(count(*) FILTER (NOT value > 5) / count(*) * 100, 1) AS error_rate FROM events")
def plugin_summary(t: Tables) -> DataFrame:
    return plugins.execution_summary(_runs(t))


def _plugins(t: Tables) -> DataFrame:
    """Nations as plugins: their region, and what they are for by number."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("name"), F.col("r_name").alias("description"), F.array(F.col("n_name")).alias("tags"), F.split("r_name", " ").alias("capabilities"), F.array(F.concat(F.lit("number "), F.col("n_nationkey"))).alias("use_cases"), F.lit("tool").alias("type"), (F.col("n_nationkey") > 5).alias("enabled"))


_W = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_HIT = "len(list_intersect(q.w, " + _W + ")) / greatest(len(q.w), 1)"


@query(f"""WITH q AS (SELECT c_custkey AS query_id, {_W.format("n_name || ' ' || r_name || ' ' || c_mktsegment")} AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), p AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT query_id, n_name AS name, round({_HIT.format('n_name')} * 3 + {_HIT.format('r_name')} * 2 + {_HIT.format('n_name')} * 2.5 + list_sum(list_transform(string_split(r_name, ' '), lambda x: {_HIT.format('x')})) * 2 + {_HIT.format("'number ' || n_nationkey")} * 1.5, 6) AS score FROM q, p)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS INTEGER) AS rank, name, score FROM s WHERE score > 0 QUALIFY rank <= 5""")
def plugin_search(t: Tables) -> DataFrame:
    """The five best plugins for each customer's nation, region and segment."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return plugins.search(_plugins(t), c.select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", "n_name", "r_name", "c_mktsegment").alias("query")))


@query("SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 5 AND contains(lower(r_name), 'a')")
def plugin_filters(t: Tables) -> DataFrame:
    return plugins.selected(_plugins(t), kind="tool", capability="A", enabled=True).select("name")


_U = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"
_KIND = "CASE WHEN contains(l, 'summarize') OR contains(l, 'summarise') OR contains(l, 'summary') OR contains(l, 'overview') THEN 'summarization' WHEN contains(l, 'compare') OR contains(l, 'contrast') OR contains(l, 'difference') OR contains(l, 'versus') OR contains(l, 'vs') THEN 'comparison' WHEN contains(l, 'extract') OR contains(l, 'list all') OR contains(l, 'find all') OR contains(l, 'enumerate') THEN 'extraction' WHEN contains(l, 'why') OR contains(l, 'how') OR contains(l, 'explain') OR contains(l, 'reason') OR contains(l, 'cause') THEN 'reasoning' ELSE 'qa' END"


@query(rf"""WITH u AS ({_U}), l AS (SELECT *, lower(text) AS l, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, turn % 8 AS docs FROM u), k AS (SELECT *, {_KIND} AS kind, CASE WHEN n > 40 OR docs > 5 THEN 'complex' WHEN n > 20 OR docs > 2 THEN 'moderate' ELSE 'simple' END AS complexity FROM l),
s AS (SELECT *, CASE WHEN kind = 'comparison' THEN 'multi_hop' WHEN kind = 'reasoning' OR complexity = 'complex' THEN 'chain_of_thought' ELSE 'simple' END AS strategy FROM k)
SELECT conv_id, turn, strategy, 'safe_output,pii_protection' || CASE WHEN docs > 0 THEN ',grounding,no_fabrication' ELSE '' END || ',uncertainty' || CASE WHEN docs > 0 THEN ',cite_sources' ELSE '' END || ',stay_on_topic' || CASE WHEN strategy <> 'simple' THEN ',show_reasoning' ELSE '' END || CASE WHEN complexity = 'complex' THEN ',self_check' ELSE '' END || ',concise' AS guardrails FROM s""")
def prompt_guardrails(t: Tables) -> DataFrame:
    """Strategy and guardrails of each question, with as many documents as its turn modulo 8."""
    b = prompting.built(_requests(t))
    names = prompting.guardrails(F.col("documents"), F.col("strategy"), F.col("complexity"), F.col("kind"))
    return b.select("conv_id", "turn", "strategy", F.array_join(names, ",").alias("guardrails"))


def _requests(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.lit("facts").alias("context"), F.lit("").alias("memory"), (F.col("turn") % 8).alias("documents"))


@query(rf"""WITH u AS ({_U}), l AS (SELECT *, lower(text) AS l FROM u), k AS (SELECT *, {_KIND} AS kind FROM l)
SELECT conv_id, turn, md5(CASE WHEN kind = 'comparison' THEN '## Context Documents' || chr(10) || 'facts' || chr(10) || chr(10) || '## Main Question' || chr(10) || text || chr(10) || chr(10) || '## Analysis' ELSE '## Context' || chr(10) || 'facts' || chr(10) || chr(10) || '## Question' || chr(10) || text || chr(10) || chr(10) || '## Answer' END) AS prompt FROM k WHERE kind <> 'reasoning' AND turn % 8 <= 5 AND len(string_split(text, ' ')) <= 20 AND NOT regexp_matches(text, '(?i)\b(certainly|great question|of course|absolutely|happy|let me|sure|definitely)')""")
def prompt_sections(t: Tables) -> DataFrame:
    """The user prompts of short questions that are not about reasons, as digests."""
    b = prompting.built(_requests(t)).where("kind <> 'reasoning' AND documents <= 5 AND size(split(query, ' ')) <= 20").where(~F.col("query").rlike(r"(?i)\b(certainly|great question|of course|absolutely|happy|let me|sure|definitely)"))
    return b.select("conv_id", "turn", F.md5("user").alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.8 WHEN o_orderkey % 3 = 1 THEN 0.0 ELSE 0.0 END::DOUBLE AS csv, CASE WHEN o_orderkey % 3 = 1 THEN 0.88 ELSE 0.0 END::DOUBLE AS xml, CASE WHEN o_orderkey % 3 = 0 THEN ';' ELSE ',' END AS delimiter FROM orders")
def format_scores(t: Tables) -> DataFrame:
    """Scores of orders written as semicolon lines, as tags and as a sentence."""
    n = F.col("o_orderkey") % 3
    lines = F.concat_ws("\n", F.lit("key;status;note"), F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit("x")), F.lit("1;F;y"))
    tags = F.concat(F.lit("<key>"), F.col("o_orderkey").cast("string"), F.lit("</key>\n<status>"), F.col("o_orderstatus"), F.lit("</status>"))
    out = F.when(n == 0, lines).when(n == 1, tags).otherwise(F.concat(F.lit("the order is "), F.col("o_orderstatus")))
    return t.orders.select("o_orderkey", fx.csv_score(out).alias("csv"), fx.xml_score(out).alias("xml"), fx.delimiter(out).alias("delimiter"))


@query("SELECT o_orderkey, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS number FROM orders")
def field_values(t: Tables) -> DataFrame:
    """Two fields read from orders written in four ways."""
    n, k, s = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    text = F.when(n == 0, F.concat(F.lit("<status> "), s, F.lit(" </status><number>"), k, F.lit("</number>"))).when(n == 1, F.concat(F.lit("**Status**: "), s, F.lit("\n**Number**: about "), k, F.lit(" items"))).when(n == 2, F.concat(F.lit("status: "), s, F.lit("\nnumber: "), k)).otherwise(F.concat(F.lit("State = "), s, F.lit("\nNo = "), k))
    return t.orders.select("o_orderkey", fx.field_value(text, ["status", "state"]).alias("status"), fx.typed(fx.field_value(text, ["number", "no"]), "int").alias("number"))


@query("WITH s AS (SELECT event_type AS route, user_id % 5 AS grp, value FROM events), g AS (SELECT grp, round(avg(value), 6) AS score FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, grp) AS rank FROM g) SELECT grp, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2")
def route_groups(t: Tables) -> DataFrame:
    """The two best groups of routes by score."""
    g = t.events.groupBy((F.col("user_id") % 5).alias("grp")).agg(F.round(F.avg("value"), 6).alias("score"))
    return routing.best_groups(g.withColumn("query_id", F.lit(1)), 2).select("grp", "score", "rank")


@query("SELECT user_id AS query_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS first, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) FILTER (event_type <> 'error') AS merged, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def route_results(t: Tables) -> DataFrame:
    """What handlers gave for each user: the first that succeeded, all of them put together, and how many failed."""
    r = t.events.select(F.col("user_id").alias("query_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("result"), (F.col("event_type") != "error").alias("ok"))
    return routing.aggregated(r)
