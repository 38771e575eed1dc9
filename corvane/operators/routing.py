"""Which route answers a question: keywords, similarity, learnt bias, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of similarity and keywords, without a model's vote, and the least score of each confidence.
SEMANTIC, KEYWORD = 0.7, 0.2
CONFIDENCE = (("high", 0.85), ("medium", 0.60), ("low", 0.40))


def keyword_score(text: Column, required: Column, any_of: Column, excluded: Column) -> Column:
    """0 if a required word is missing or an excluded one is there; else the share of ``any_of`` contained; 0.1 for a route without words."""
    low = F.lower(text)
    has = lambda w: F.contains(low, F.lower(w))
    barred = F.exists(required, lambda w: ~has(w)) | F.exists(excluded, has)
    named = (F.size(required) > 0) | (F.size(excluded) > 0)
    return F.when(barred, 0.0).when(F.size(any_of) == 0, F.when(named, 0.0).otherwise(0.1)).otherwise(F.size(F.filter(any_of, has)) / F.size(any_of))


def confidence(score: Column) -> Column:
    out = None
    for name, least in CONFIDENCE:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("none")


def combined(semantic: Column, keyword: Column, bias: Column) -> Column:
    """Weights add up to one; the bias counts once."""
    total = SEMANTIC + KEYWORD
    return F.round(F.least(F.lit(1.0), semantic * (SEMANTIC / total) + keyword * (KEYWORD / total) + bias), 6)


def route(questions: DataFrame, routes: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, route, score, confidence): the k best enabled routes of each question.

    questions: query_id, text; routes: route, required, any_of, excluded, bias,
    enabled, few enough to broadcast (they are configuration); similarity comes
    in a column ``semantic`` of ``questions`` if there is one, else it is 0.
    """
    if routes.limit(10_001).count() > 10_000:
        raise ValueError("routes are configuration: 10 000 at most")
    semantic = F.col("semantic") if "semantic" in questions.columns else F.lit(0.0)
    pairs = questions.crossJoin(F.broadcast(routes.where("enabled")))
    scored = pairs.withColumn("score", combined(semantic, keyword_score(F.col("text"), F.col("required"), F.col("any_of"), F.col("excluded")), F.col("bias")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "route")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "route", "score", confidence(F.col("score")).alias("confidence"))


def best_groups(scored: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k best groups (query_id, grp, score) of each question that reach ``least``, ranked; ties by name."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "grp")
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def aggregated(results: DataFrame, separator: str = " | ") -> DataFrame:
    """For each question the first result that succeeded, the different ones joined, and how many failed; results: query_id, at, result, ok."""
    good = F.when(F.col("ok"), F.col("result"))
    joined = F.array_join(F.sort_array(F.collect_set(good)), separator)
    return results.groupBy("query_id").agg(F.min_by(good, F.when(F.col("ok"), F.col("at"))).alias("first"), F.nullif(joined, F.lit("")).alias("merged"), F.count_if(~F.col("ok")).alias("failed"))


def with_fallback(questions: DataFrame, routed: DataFrame, fallback: str) -> DataFrame:
    """The best route of each question (query_id), and ``fallback`` with no confidence where none was found."""
    best = routed.where("rank = 1").select("query_id", "route", "score", "confidence")
    out = questions.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.coalesce("route", F.lit(fallback)).alias("route"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", F.lit("none")).alias("confidence"))


# The words of the ready-made group for questions over documents.
RAG_WORDS = ["according", "find", "search", "retrieve", "document", "manual", "policy", "report"]
RAG_EXCLUDED = ["write", "create", "generate", "code"]


def registered(routes: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """``routes`` and ``new`` ones; a name that is taken raises unless it is to be replaced."""
    taken = new.join(routes.select("route"), "route", "left_semi")
    if not replace and not taken.isEmpty():
        raise ValueError(f"route {taken.first().route!r} is there already")
    return routes.join(new.select("route"), "route", "left_anti").unionByName(new)


def selected(routes: DataFrame, tag: str | None = None, enabled: bool | None = None) -> DataFrame:
    """Routes with a tag (column ``tags``), enabled or not."""
    out = routes if tag is None else routes.where(F.array_contains("tags", tag))
    return out if enabled is None else out.where(F.col("enabled") == enabled)


def effective(score: Column, bias: Column) -> Column:
    """A score and its bias, 1 at most."""
    return F.round(F.least(F.lit(1.0), score + bias), 6)


def group_scores(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, grp, score): the share of each group's words that a question holds and its boost if it holds any; 0 with an excluded word. groups: grp, any_of, excluded, boost."""
    if groups.limit(10_001).count() > 10_000:
        raise ValueError("groups are configuration: 10 000 at most")
    pairs = questions.crossJoin(F.broadcast(groups))
    share = keyword_score(F.col("text"), F.expr("cast(array() as array<string>)"), F.col("any_of"), F.col("excluded"))
    return pairs.select("query_id", "grp", F.round(F.least(F.lit(1.0), share + F.when(share > 0, F.col("boost")).otherwise(0.0)), 6).alias("score"))
