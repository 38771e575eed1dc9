"""Reading the half-structured text that language models write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.let import let

# Patterns and scores of the formats.
YAML_KEY = r"(?m)^[a-zA-Z_][\w\-]*\s*:\s*\S"
YAML_ITEM = r"(?m)^\s*-\s+\S"
TABLE = r"(?m)^\|.+\|\s*\n\s*\|[-| :]+\|"
NUMBERED = r"(?m)^\s*(?:\d+[\.\)]|[a-z][\.\)])\s+\S"
BULLETED = r"(?m)^\s*[*\-–•]\s+\S"
KEY_VALUE = r"(?m)^\s*[\w\s]+\s*[:=]\s*\S"
TOOL = r"(?i)(?:Action|Tool|Function|tool_name)\s*[:\-]\s*[\w\.]+"
ARGUMENTS = r"(?i)(?:Input|Args|Arguments|Action Input)\s*[:\-]"
CALL = r'"name"\s*:\s*"[^"]+"\s*,\s*"arguments"'
PAIR = r"(?m)^\s*\*?\*?([A-Za-z_][\w\s]*?)\*?\*?\s*[:=]\s*(.+?)$"


def json_score(c: Column) -> Column:
    s = tx.strip(c)
    return F.when(F.try_parse_json(s).isNotNull() & s.rlike(r"^[\[{]"), 0.99).when(s.rlike(r"^\{[\s\S]*\}$") | s.rlike(r"^\[[\s\S]*\]$"), 0.65).when(s.rlike(r"\{[\"'][^\"']+[\"']\s*:"), 0.45).otherwise(0.0)


def yaml_score(c: Column) -> Column:
    keys, items = tx.count(c, YAML_KEY), tx.count(c, YAML_ITEM)
    score = F.when(keys >= 3, 0.5).when(keys >= 1, 0.2).otherwise(0.0) + F.when(items >= 2, 0.25).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), score - F.when(tx.strip(c).rlike(r"^[\[{]"), 0.3).otherwise(0.0)), 6)


def table_score(c: Column) -> Column:
    return F.when(c.rlike(TABLE), 0.92).when(tx.strip(c).startswith("|"), 0.5).otherwise(0.0)


def numbered_score(c: Column) -> Column:
    n = tx.count(c, NUMBERED)
    return F.when(n >= 3, 0.85).when(n >= 1, 0.4).otherwise(0.0)


def bulleted_score(c: Column) -> Column:
    n = tx.count(c, BULLETED)
    return F.when(n >= 3, 0.82).when(n >= 1, 0.38).otherwise(0.0)


def key_value_score(c: Column) -> Column:
    return F.when((tx.count(c, KEY_VALUE) >= 2) & (tx.count(c, YAML_ITEM) == 0), 0.6).otherwise(0.0)


def tool_score(c: Column) -> Column:
    return F.when(c.rlike(TOOL), F.when(c.rlike(ARGUMENTS), 0.82).otherwise(0.55)).when(c.rlike(CALL), 0.9).otherwise(0.0)


def plain_score(c: Column) -> Column:
    signs = sum((c.rlike(p).cast("int") for p in (YAML_KEY, NUMBERED, BULLETED)), F.lit(0)) + tx.strip(c).rlike(r"^[\[{]").cast("int")
    return F.round(F.greatest(F.lit(0.1), 0.55 - 0.1 * signs), 6)


def _csv(c: Column) -> Column:
    from corvane.functions.fixing import csv_score

    return csv_score(c)


def _xml(c: Column) -> Column:
    from corvane.functions.fixing import xml_score

    return xml_score(c)


def detect_format(c: Column) -> Column:
    """The likeliest format and its score: struct(format, score); a fence's language goes first."""
    fence = F.lower(F.regexp_extract(c, r"```(\w*)\s*\n[\s\S]*?```", 1))
    named = F.create_map(*[F.lit(x) for p in (("json", "json"), ("yaml", "yaml"), ("yml", "yaml"), ("csv", "csv"), ("xml", "xml"), ("markdown", "markdown_table")) for x in p])
    scores = [("json", json_score(c)), ("yaml", yaml_score(c)), ("csv", _csv(c)), ("markdown_table", table_score(c)), ("numbered_list", numbered_score(c)), ("bulleted_list", bulleted_score(c)), ("key_value", key_value_score(c)), ("xml", _xml(c)), ("tool_call", tool_score(c)), ("plain_text", plain_score(c))]
    fenced = F.element_at(named, fence)
    all_ = F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("format")) for i, (n, s) in enumerate(scores)])
    best = let(F.array_min(all_), lambda r: F.struct(r["format"].alias("format"), (-r["s"]).alias("score")))
    return F.when(fenced.isNotNull(), F.struct(fenced.alias("format"), F.lit(0.95).alias("score"))).otherwise(best)


def list_items(c: Column) -> Column:
    """Numbered or else bulleted lines; else the parts of the text between commas."""
    numbered = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:\d+[\.\)]|[a-z][\.\)])\s+(.+)$"), F.lit(1))
    bulleted = F.regexp_extract_all(c, F.lit(r"(?m)^\s*[*\-–•▸]\s+(.+)$"), F.lit(1))
    commas = F.split(tx.collapse(tx.strip(c)), ",")
    found = F.when(F.size(numbered) > 0, numbered).when(F.size(bulleted) > 0, bulleted).otherwise(commas)
    return F.filter(F.transform(found, tx.strip), lambda x: x != "")


def key_values(c: Column) -> Column:
    """Lines ``key: value`` as a map; of a repeated key the last value counts."""
    keys = F.transform(F.regexp_extract_all(c, F.lit(PAIR), F.lit(1)), lambda k: F.replace(F.lower(tx.strip(k)), F.lit(" "), F.lit("_")))
    values = F.transform(F.regexp_extract_all(c, F.lit(PAIR), F.lit(2)), tx.strip)
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return let(pairs, lambda e: F.map_from_entries(F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.greatest(F.size(e) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))))


def tool_call(c: Column) -> Column:
    """struct(name, arguments, thought) of a text that names an action; arguments is JSON text."""
    name = F.nullif(F.regexp_extract(c, r"(?i)(?:Action|Tool|Function|tool_name)\s*[:\-]\s*([\w\.]+)", 1), F.lit(""))
    raw = F.nullif(F.regexp_extract(c, r"(?i)(?:Action Input|Arguments?|Input|Args?)\s*[:\-]\s*(\{[\s\S]+?\}|\S+)", 1), F.lit(""))
    arguments = F.when(raw.isNull(), "{}").when(F.try_parse_json(raw).isNotNull(), raw).otherwise(F.to_json(F.struct(raw.alias("input"))))
    thought = F.nullif(tx.strip(F.regexp_extract(c, r"(?is)(?:Thought|Reasoning)\s*[:\-]\s*(.+?)(?=\n(?:Action|Tool)|$)", 1)), F.lit(""))
    return F.struct(name.alias("name"), arguments.alias("arguments"), thought.alias("thought"))


def repair_json(c: Column) -> Column:
    """Drops fences and trailing commas, doubles single quotes, quotes bare keys."""
    c = tx.replace(tx.replace(tx.strip(c), r"^```\w*\s*", ""), r"\s*```$", "")
    c = tx.replace(c, r",\s*([}\]])", "$1")
    c = tx.replace(c, "'", '"')
    return tx.replace(c, r"([{,]\s*)([A-Za-z_][\w]*)\s*:", '$1"$2":')


def to_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"-?\d+", 0), F.lit("")).cast("long")


def to_float(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"-?\d+\.?\d*(?:[eE][+-]?\d+)?", 0), F.lit("")).cast("double")


def to_bool(c: Column) -> Column:
    low = F.lower(tx.strip(c))
    return F.when(low.isin("true", "yes", "1", "correct", "y", "on"), True).when(low.isin("false", "no", "0", "incorrect", "n", "off"), False)


def to_list(c: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(c, r"[,;|\n]"), tx.strip), lambda x: x != ""), lambda x: tx.replace(x, r"^['\"]|['\"]$", ""))


def version_within(version: Column, least: Column, most: Column) -> Column:
    """Compares dotted numbers number by number."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    return (parts(version) >= parts(least)) & (parts(version) <= parts(most))
