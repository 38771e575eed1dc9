"""Metrics, windows and feedback over events, conversations and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import parsing as px
from corvane.functions import query as qx
from corvane.operators import rows
from corvane.plans.registry import Tables, query
from corvane.plans.text_queries import STRIP
from corvane.streaming import events as ev


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_tumbling(t: Tables) -> DataFrame:
    return ev.tumbling(t.events)


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1")
def hourly_sliding(t: Tables) -> DataFrame:
    return ev.sliding(t.events)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_30m(t: Tables) -> DataFrame:
    return ev.sessions(t.events)


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n, round(sum(value), 6) AS cost FROM events GROUP BY 1")
def requests_per_minute(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("cost"))


_P95 = "list_sort(list(value))[greatest(1, CAST(floor(count(value) * 0.95) AS BIGINT))]"


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, {_P95} AS p95 FROM events GROUP BY 1")
def metrics_snapshot(t: Tables) -> DataFrame:
    """Nearest-rank p95 by place, not by collecting a type's values."""
    # Rows without a value have no place; they count in n alone.
    known = rows.running(t.events.where("value IS NOT NULL").select("event_type", "value", "event_id"), "event_type", ["value", "event_id"], t.once)
    at = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))
    p95 = known.where(F.col("place") == at).select(F.col("event_type").alias("kind"), F.col("value").alias("p95"))
    seen = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return seen.join(p95, F.col("event_type").eqNullSafe(F.col("kind")), "left").drop("kind")


@query("SELECT event_id, user_id, round(sum(value) OVER w, 2) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING)")
def rolling_100(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return t.events.select("event_id", "user_id", F.round(F.sum("value").over(w), 2).alias("total"), F.count("*").over(w).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_60m(t: Tables) -> DataFrame:
    """Requests of the last hour: the window of a rate limit."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("n"))


@query("""WITH o AS (SELECT user_id, (event_type <> 'error')::INT AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT user_id, max(n) AS n, pow(0.9, max(n)) * 0.5 + sum(0.1 * x * pow(0.9, n - i)) AS ema FROM o GROUP BY 1)
SELECT user_id, n, round(ema, 6) AS ema, round(CASE WHEN n >= 10 THEN greatest(-0.3, least(0.3, (ema - 0.5) * 0.6)) ELSE 0 END::DOUBLE, 6) AS bias FROM e""")
def ema_bias(t: Tables) -> DataFrame:
    """The moving average of success in closed form, and the bias that ten outcomes or more give."""
    w = Window.partitionBy("user_id")
    o = t.events.select("user_id", (F.col("event_type") != "error").cast("int").alias("x"), F.row_number().over(w.orderBy("ts", "event_id")).alias("i"), F.count("*").over(w).alias("n"))
    e = o.groupBy("user_id").agg(F.max("n").alias("n"), (F.pow(F.lit(0.9), F.max("n")) * 0.5 + F.sum(0.1 * F.col("x") * F.pow(F.lit(0.9), F.col("n") - F.col("i")))).alias("ema"))
    return e.select("user_id", "n", F.round("ema", 6).alias("ema"), F.round(F.when(F.col("n") >= 10, F.greatest(F.lit(-0.3), F.least(F.lit(0.3), (F.col("ema") - 0.5) * 0.6))).otherwise(0.0), 6).alias("bias"))


@query("SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS valid FROM events")
def ttl_valid(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.crossJoin(F.broadcast(last)).select("event_id", (F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 DAY")).alias("valid"))


@query("SELECT user_id, max(ts) AS used FROM events GROUP BY 1 ORDER BY used DESC, user_id LIMIT 50")
def lru_keep(t: Tables) -> DataFrame:
    """What a cache of 50 keys, least recently used out first, holds in the end."""
    return t.events.groupBy("user_id").agg(F.max("ts").alias("used")).orderBy(F.desc("used"), "user_id").limit(50)


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, grouping(event_type) AS g FROM events GROUP BY CUBE (event_type, day)")
def metrics_grouping_sets(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return t.events.select("event_type", day).cube("event_type", "day").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("g"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def supplier_rollup(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, role FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM p WHERE role = 'user' AND next = 'assistant')
SELECT conv_id, string_agg('Q: ' || text || chr(10) || 'A: ' || answer, chr(10) ORDER BY turn) AS context FROM a WHERE k <= 3 GROUP BY 1""")
def last_n_turns(t: Tables) -> DataFrame:
    """The last three answered questions of each conversation as text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)}).where("role = 'user' AND next = 'assistant'")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 3")
    qa = F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "answer")
    return p.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", qa.alias("qa")))), lambda x: x["qa"]), "\n").alias("context"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS memory FROM m WHERE k <= 6 GROUP BY 1""")
def memory_format(t: Tables) -> DataFrame:
    m = t.conversations.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 6")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text")
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("memory"))


@query("SELECT conv_id, turn, CAST(2000 // n AS BIGINT) + CASE WHEN k = 1 THEN 2000 - n * (2000 // n) ELSE 0 END AS budget FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user')")
def budget_equal(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("k"), F.count("*").over(w).alias("n"))
    return u.select("conv_id", "turn", F.expr("2000 div n + CASE WHEN k = 1 THEN 2000 - n * (2000 div n) ELSE 0 END").alias("budget"))


@query(rf"""WITH u AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{qx.HIGH}') OR len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) > 20 THEN 2.5 WHEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) <= 12 THEN 1.0 ELSE 1.5 END::DOUBLE AS w FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, greatest(1, CAST(floor(2000 * w / sum(w) OVER (PARTITION BY conv_id)) AS BIGINT)) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM u)
SELECT conv_id, turn, CAST(b + CASE WHEN k = 1 THEN 2000 - sum(b) OVER (PARTITION BY conv_id) ELSE 0 END AS BIGINT) AS budget FROM b""")
def budget_weighted(t: Tables) -> DataFrame:
    level = qx.complexity(F.col("text"))
    w = Window.partitionBy("conv_id")
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.when(level == "high", 2.5).when(level == "low", 1.0).otherwise(1.5).alias("w"))
    b = u.select("conv_id", "turn", F.greatest(F.lit(1), F.floor(2000 * F.col("w") / F.sum("w").over(w))).cast("long").alias("b"), F.row_number().over(w.orderBy("turn")).alias("k"))
    return b.select("conv_id", "turn", (F.col("b") + F.when(F.col("k") == 1, 2000 - F.sum("b").over(w)).otherwise(0)).alias("budget"))


@query("""WITH s AS (SELECT l.toxic AS kind, d.source AS strategy, avg(l.quality) AS score, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL HAVING count(*) >= 5)
SELECT kind, strategy, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(score, 6) DESC, strategy) = 1""")
def adaptive_strategy(t: Tables) -> DataFrame:
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy(F.col("toxic").alias("kind"), F.col("source").alias("strategy")).agg(F.round(F.avg("quality"), 6).alias("score"), F.count("*").alias("n")).where("n >= 5")
    return s.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "strategy"))).where("k = 1").select("kind", "strategy", "score")


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'medium' WHEN p_size >= 10 THEN 'low' ELSE 'none' END AS level, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}' AS metadata FROM part")
def sanitize_metadata(t: Tables) -> DataFrame:
    level = F.when(F.col("p_size") >= 40, "high").when(F.col("p_size") >= 20, "medium").when(F.col("p_size") >= 10, "low").otherwise("none")
    return t.part.select("p_partkey", level.alias("level"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("metadata"))


_OUT = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '{"key": ' || o_orderkey || ', "status": "' || o_orderstatus || '"}' WHEN 1 THEN '1. ' || o_orderpriority || chr(10) || '2. ' || o_orderstatus || chr(10) || '3. done' WHEN 2 THEN '- ' || o_orderpriority || chr(10) || '- ' || o_orderstatus || chr(10) || '- done'
WHEN 3 THEN 'Order Key: ' || o_orderkey || chr(10) || 'status = ' || o_orderstatus WHEN 4 THEN 'Thought: look' || chr(10) || 'Action: search' || chr(10) || 'Action Input: {"q": "' || o_orderstatus || '"}' ELSE 'The order was ' || o_orderstatus || ', ' || o_orderpriority END AS output FROM orders"""


def _outputs(t: Tables) -> DataFrame:
    """What a model may have written about each order, in six formats."""
    expression = _OUT[_OUT.index("CASE") : _OUT.index(" AS output FROM")].replace("chr(10)", "char(10)")
    return t.orders.select("o_orderkey", F.expr(expression).alias("output"))


@query(f"""WITH o AS ({_OUT}) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'numbered_list' WHEN 2 THEN 'bulleted_list' WHEN 3 THEN 'key_value' WHEN 4 THEN 'tool_call' ELSE 'plain_text' END AS format FROM o""")
def format_detect(t: Tables) -> DataFrame:
    return _outputs(t).select("o_orderkey", px.detect_format(F.col("output"))["format"].alias("format"))


@query(f"""WITH o AS ({_OUT}), n AS (SELECT o_orderkey, output, regexp_extract_all(output, '(?m)^\\s*(?:\\d+[\\.\\)]|[a-z][\\.\\)])\\s+(.+)$', 1) AS a, regexp_extract_all(output, '(?m)^\\s*[*\\-–•▸]\\s+(.+)$', 1) AS b FROM o),
i AS (SELECT o_orderkey, list_filter(list_transform(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE string_split(regexp_replace(output, '\\s+', ' ', 'g'), ',') END, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS i FROM n)
SELECT o_orderkey, array_to_string(i, '|') AS items FROM i""")
def list_items(t: Tables) -> DataFrame:
    return _outputs(t).select("o_orderkey", F.array_join(px.list_items(F.col("output")), "|").alias("items"))


@query(f"WITH o AS ({_OUT}) SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS order_key, substr(output, strpos(output, 'status = ') + 9) AS status FROM o WHERE o_orderkey % 6 = 3")
def key_values(t: Tables) -> DataFrame:
    kv = px.key_values(F.col("output"))
    return _outputs(t).where("o_orderkey % 6 = 3").select("o_orderkey", F.element_at(kv, "order_key").alias("order_key"), F.element_at(kv, "status").alias("status"))


@query("""SELECT o_orderkey, 'search' AS name, '{"q": "' || o_orderstatus || '"}' AS arguments, 'look' AS thought FROM orders WHERE o_orderkey % 6 = 4""")
def tool_calls(t: Tables) -> DataFrame:
    call = px.tool_call(F.col("output"))
    return _outputs(t).where("o_orderkey % 6 = 4").select("o_orderkey", call["name"].alias("name"), call["arguments"].alias("arguments"), call["thought"].alias("thought"))
