"""Plugins as tables: search, filters, execution statistics, health, descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.let import let

#: Weights of where a word is found; fixed values.
WEIGHTS = {"name": 3.0, "description": 2.0, "tags": 2.5, "capabilities": 2.0, "use_cases": 1.5}


def _share(words: Column, text: Column) -> Column:
    return F.size(F.array_intersect(words, F.array_distinct(tx.tokens(text)))) / F.greatest(F.size(words), F.lit(1))


def _adding(words: Column, weight: float):
    return lambda total, x: total + _share(words, x) * weight


def keyword_score(query: Column) -> Column:
    """Shares of the query's words found in name, description, and each tag, capability and use case, weighed and added up."""

    def total(words: Column) -> Column:
        out = _share(words, F.col("name")) * WEIGHTS["name"] + _share(words, F.col("description")) * WEIGHTS["description"]
        for c in ("tags", "capabilities", "use_cases"):
            out = out + F.aggregate(F.col(c), F.lit(0.0), _adding(words, WEIGHTS[c]))
        return F.round(out, 6)

    return let(F.array_distinct(tx.tokens(query)), total)


def search(plugins: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, name, score of the k best plugins with a score; plugins are configuration, few enough to broadcast."""
    if plugins.limit(10_001).count() > 10_000:
        raise ValueError("plugins are configuration: 10 000 at most")
    scored = queries.crossJoin(F.broadcast(plugins)).select("query_id", "name", keyword_score(F.col("query")).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "name", "score")


def selected(plugins: DataFrame, kind: str | None = None, tag: str | None = None, capability: str | None = None, enabled: bool | None = None) -> DataFrame:
    """Plugins of a type, with a tag, with a capability that contains a text, enabled or not."""
    out = plugins
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if tag is not None:
        out = out.where(F.exists("tags", lambda x: F.lower(x) == tag.lower()))
    if capability is not None:
        out = out.where(F.exists("capabilities", lambda x: F.contains(F.lower(x), F.lit(capability.lower()))))
    return out if enabled is None else out.where(F.col("enabled") == enabled)


def execution_report(runs: DataFrame) -> DataFrame:
    """executions, success_rate in percent, mean, least and most milliseconds, health and its score of each plugin; runs: plugin, ms, ok."""
    rate = F.avg(F.col("ok").cast("int"))
    r = runs.groupBy("plugin").agg(F.count("*").alias("executions"), rate.alias("rate"), F.round(F.avg("ms"), 1).alias("avg_ms"), F.round(F.max("ms"), 1).alias("max_ms"), F.round(F.min("ms"), 1).alias("min_ms"))
    health = F.when(F.col("rate") >= 0.95, "excellent").when(F.col("rate") >= 0.80, "good").when(F.col("rate") >= 0.60, "degraded").otherwise("critical")
    score = F.when(F.col("rate") >= 0.95, 100).when(F.col("rate") >= 0.80, 80).when(F.col("rate") >= 0.60, 60).otherwise(30)
    return r.select("plugin", "executions", F.round(F.col("rate") * 100, 1).alias("success_rate"), "avg_ms", "max_ms", "min_ms", health.alias("health"), score.alias("health_score"))


def execution_summary(runs: DataFrame) -> DataFrame:
    """executions, failures and error_rate in percent over all plugins."""
    return runs.agg(F.count("*").alias("executions"), F.count_if(~F.col("ok")).alias("failures")).withColumn("error_rate", F.when(F.col("executions") == 0, 0.0).otherwise(F.round(F.col("failures") / F.col("executions") * 100, 1)))


def tool_descriptor(style: str = "tool") -> Column:
    """A plugin's name, description and input schema (JSON) as the JSON that a model's interface takes."""
    schema = F.struct(F.lit("object").alias("type"), F.from_json("inputs", "map<string,string>").alias("properties"))
    if style == "anthropic":
        return F.to_json(F.struct("name", "description", schema.alias("input_schema")))
    return F.to_json(F.struct(F.lit("function").alias("type"), F.struct("name", "description", schema.alias("parameters")).alias("function")))
