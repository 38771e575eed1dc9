"""Checks of context before it is used, of inputs before they are run, and budgets that learn from what was used."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx

# Bounds of a context, marks of a source, and what an injection looks like.
LEAST, MOST, RELEVANT = 10, 20_000, 0.3
SOURCE = r"\[(?:|Source|source):|---"
ATTACKS = [
    r"(?i)(ignore\s+previous|forget\s+instructions|act\s+as\s+if)",
    r"(?i)(system\s*prompt|jailbreak|dan\s+mode)",
    r"(?i)(<script|javascript:|data:text/html|onerror=)",
    r"(?i)(;\s*(rm|dd|mkfs|curl\s+-o|wget|nc\s+-e))",
    r"(?i)(\.\./|\.\.\\|%2e%2e)",
]
LONGEST = 32_768


def context_check(c: Column, least: int = LEAST, most: int = MOST, similarity: Column | None = None) -> Column:
    """struct(passed, warnings): an empty or short context fails, and one unlike its question; a long one or one without a source is warned of."""
    n = F.length(c)
    empty = tx.strip(c) == ""
    said = [F.when(n < least, "short"), F.when(n > most, "long"), F.when(~c.rlike(SOURCE), "no source")]
    passed = n >= least
    if similarity is not None:
        said.append(F.when(similarity < RELEVANT, "not relevant"))
        passed = passed & (similarity >= RELEVANT)
    whole = F.struct(passed.alias("passed"), F.filter(F.array(*said), lambda w: w.isNotNull()).alias("warnings"))
    return F.when(c.isNull() | empty, F.struct(F.lit(False).alias("passed"), F.array(F.lit("empty")).alias("warnings"))).otherwise(whole)


def attacked(c: Column) -> Column:
    """Whether a text holds one of the five kinds of injection."""
    out = F.lit(False)
    for p in ATTACKS:
        out = out | c.rlike(p)
    return out


def input_problem(value: Column, kind: str = "string", required: bool = True, choices: list[str] | None = None) -> Column:
    """Why an input is refused: missing, of another type, too long, an injection, not among the choices; null if it is not."""
    out = F.when(value.isNull(), "missing" if required else None)
    if kind in ("integer", "number", "boolean"):
        out = out.when(value.try_cast({"integer": "bigint", "number": "double", "boolean": "boolean"}[kind]).isNull(), f"not a {kind}")
    else:
        out = out.when(F.length(value) > LONGEST, "too long").when(attacked(value), "injection")
    return out.when(~value.isin(choices), "not a choice") if choices else out


def allowed(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """``requests`` (plugin, permission, session, user) with ``allowed``.

    policies: plugin, granted and denied (arrays), session and user (null: any).
    A denial goes before a grant; what has no policy is refused.
    """
    p = policies.select(F.col("plugin"), F.col("granted"), F.col("denied"), F.col("session").alias("in_session"), F.col("user").alias("of_user"))
    scope = (F.col("in_session").isNull() | F.col("in_session").eqNullSafe(F.col("session"))) & (F.col("of_user").isNull() | F.col("of_user").eqNullSafe(F.col("user")))
    held = F.array_contains("granted", F.col("permission")) & ~F.array_contains("denied", F.col("permission")) & scope
    return requests.join(p, "plugin", "left").withColumn("allowed", F.coalesce(held, F.lit(False))).drop("granted", "denied", "in_session", "of_user")


def suggested_budget(base: Column, mean_used: Column, samples: Column) -> Column:
    """A third over what was used on average if that is below half of the budget and ten samples tell so, 200 at least; exact where the mean is a decimal."""
    less = F.greatest(F.lit(200), (mean_used * F.lit(Decimal("1.3"))).cast("int"))
    return F.when((samples >= 10) & (mean_used < base * F.lit(Decimal("0.5"))), less).otherwise(base)


def tuning_hints(records: DataFrame) -> DataFrame:
    """queries, mean milliseconds, share of failures, and what they suggest, over the last 100 of ``records`` (at, ms, failed)."""
    last = records.orderBy(F.desc("at")).limit(100)
    seen = last.agg(F.count("*").alias("queries"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.round(F.avg(F.col("failed").cast("int")), 3).alias("failures"))
    hints = F.filter(F.array(F.when(F.col("failures") > 0.3, "check retrieval"), F.when(F.col("mean_ms") > 2000, "enable caching")), lambda x: x.isNotNull())
    return seen.withColumn("hints", hints)


def compressed(c: Column, target: int, separator: str = "\n\n") -> Column:
    """First and last part, and of those between as many as fit, in order; a text of two parts or fewer is cut at a blank."""
    parts = F.split(c, f"\\Q{separator}\\E")
    ends = F.length(parts[0]) + F.length(F.element_at(parts, -1)) + 2 * len(separator)
    room = F.lit(target) - ends
    start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))

    def step(a: Column, x: Column) -> Column:
        fits = ~a["full"] & (a["used"] + F.length(x) <= room)
        return F.when(fits, F.struct(F.array_append(a["kept"], x).alias("kept"), (a["used"] + F.length(x)).alias("used"), F.lit(False).alias("full"))).otherwise(F.struct(a["kept"].alias("kept"), a["used"].alias("used"), F.lit(True).alias("full")))

    kept = F.aggregate(middle, start, step, lambda a: a["kept"])
    whole = F.array_join(F.concat(F.array(parts[0]), kept, F.array(F.element_at(parts, -1))), separator)
    return F.when(F.length(c) <= target, c).when(F.size(parts) <= 2, tx.hard_truncate(c, target)).when(room < 50, tx.hard_truncate(parts[0], target)).otherwise(whole)


def composition_stats(contexts: DataFrame) -> DataFrame:
    """For each question: chunks put in and left out, characters used, sources, mean and best score; contexts: query_id, source, score, n, included."""
    used = F.col("included")
    return contexts.groupBy("query_id").agg(F.count_if(used).alias("chunks"), F.count_if(~used).alias("left_out"), F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("chars"), F.count_distinct(F.when(used, F.col("source"))).alias("sources"), F.round(F.avg(F.when(used, F.col("score"))), 6).alias("mean_score"), F.max(F.when(used, F.col("score"))).alias("best"))


def merged_contexts(contexts: DataFrame, k: int) -> DataFrame:
    """One context for several questions of a session: each chunk once, at its best score, the k best; contexts: session, chunk, score."""
    best = contexts.groupBy("session", "chunk").agg(F.max("score").alias("score"), F.count("*").alias("questions"))
    order = Window.partitionBy("session").orderBy(F.desc("score"), "chunk")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
