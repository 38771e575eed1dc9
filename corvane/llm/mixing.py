"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

A document's rate is how often the mix takes it, between 0 and 2. Among all
rates that give each source its target of words, those of least (two-sided,
bounded) entropy to the rate 1 are exponentially tilted by size,

    rate = 2 e^(a x) / (1 + e^(a x)),   x = size / mean size of the source,

with one dual variable ``a`` for each source. The dual is convex; safeguarded
Newton steps find ``a``. All documents of one source and size share a rate, so
after one pass over the table the iterations run on counts by source and size.
Rates are then rounded into copies along the sizes of a source, and what is left
to the target is mended with single documents of fitting size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, fresh, read, shared_dir, written

ROUNDS, CLOSE = 60, 1e-9
#: Single documents by which a source may be mended; it is done before when none brings it closer.
MENDS = 6
#: Parts into which the documents of one source and size are dealt before they are numbered.
PARTS = 64
_UNIT = 1_000_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(counts: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size and target from counts (source, size, n).

    Sources in code-point order, null last, take the weights in turn. A target
    stops at ``cap`` times the source's size and the excess goes to the others
    by weight until none is above: with the level that the others have for each
    unit of weight, sources above their caps are capped, which raises the level,
    until no further one is above. No window spans all sources: places come from
    ranges of sources and the sources before each range.
    """
    sized = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    ranged = written(sized.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    here = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    # A row for each range, of which there are as many as shuffle partitions.
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = ranged.withColumn("here", here).join(before.select("part", "before"), "part").withColumn("place", F.col("before") + F.col("here") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    named = place.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("cap")).checkpoint()
    total = (named.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        r = named.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if r[0] == capped or not r[2]:
            break
        capped, level = r[0], (total - (r[1] or 0.0)) / r[2]
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return named.select("source", "source_size", target.alias("target"), "cap")


def tilts(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """source and its dual variable ``a``, by Newton steps kept inside a bracket."""
    x = F.col("size") / F.col("mean")
    rows = counts.where("size > 0").groupBy(F.col("source").alias("other")).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = goals.where("source_size > 0 AND target < cap AND target > 0").join(rows, F.col("source").eqNullSafe(F.col("other"))).select("source", "target", "mean", F.lit(0.0).alias("a"), F.lit(-1e3).alias("low"), F.lit(1e3).alias("high"), F.lit(1.0).alias("gap")).checkpoint()
    for _ in range(ROUNDS):
        s = state.alias("s")
        # Of the two forms of the logistic function the one that can't overflow.
        e = F.exp(-F.abs(F.col("s.a") * x))
        half = F.when(F.col("s.a") >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
        held = F.col("n") * F.col("size")
        sums = counts.where("size > 0").alias("c").join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("source"))
        sums = sums.agg(F.sum(held * 2 * half).alias("got"), F.sum(held * x * 2 * half * (1 - half)).alias("slope"))
        error = F.col("got") - F.col("target")
        low, high = F.when(error < 0, F.col("a")).otherwise(F.col("low")), F.when(error > 0, F.col("a")).otherwise(F.col("high"))
        step = F.col("a") - error / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low2")) & (step < F.col("high2"))
        moved = state.join(sums.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other"))).withColumns({"low2": low, "high2": high, "gap": F.abs(error) / F.greatest(F.col("target"), F.lit(1.0))})
        moved = moved.withColumn("a", F.when(F.col("gap") < CLOSE, F.col("a")).when(inside, step).otherwise((F.col("low2") + F.col("high2")) / 2))
        state = moved.select("source", "target", "mean", "a", F.col("low2").alias("low"), F.col("high2").alias("high"), "gap").checkpoint()
        if (state.agg(F.max("gap")).first()[0] or 0.0) < CLOSE:
            break
    # Rounded, so that the order in which sums were added up in this run can't show.
    return state.select("source", "mean", F.round("a", 9).alias("a"))


def copies_by_size(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """source, size, n and ``taken``: the copies that the n documents get together, at most 2 n."""
    solved = tilts(counts, goals)
    c, g, t = counts.where("size > 0").alias("c"), goals.alias("g"), solved.alias("t")
    rate = 2 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("t.a") * F.col("c.size") / F.col("t.mean")))))
    full = F.when(F.col("g.target") >= F.col("g.cap"), F.lit(2.0)).when(F.col("g.target") <= 0, F.lit(0.0)).otherwise(rate)
    rated = c.join(g, F.col("c.source").eqNullSafe(F.col("g.source"))).join(t, F.col("c.source").eqNullSafe(F.col("t.source")), "left").select("c.source", "c.size", "c.n", "g.target", F.round(full * _UNIT).cast("long").alias("unit"))
    along = Window.partitionBy("source").orderBy("size")
    reached = F.sum(F.col("n") * F.col("unit")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rated = rated.withColumn("reached", reached).withColumn("before", F.col("reached") - F.col("n") * F.col("unit"))
    up = lambda c: F.expr(f"({c} + {_UNIT // 2}) div {_UNIT}")
    out = rated.select("source", "size", "n", "target", (up("reached") - up("before")).alias("taken")).checkpoint()
    for _ in range(MENDS):
        left = out.groupBy("source").agg((F.first("target") - F.sum(F.col("taken") * F.col("size"))).alias("left"))
        o, r = out.alias("o"), left.alias("r")
        fits = o.join(r, F.col("o.source").eqNullSafe(F.col("r.source"))).select("o.*", "left").where(((F.col("left") > 0) & (F.col("taken") < 2 * F.col("n"))) | ((F.col("left") < 0) & (F.col("taken") > 0)))
        off = F.abs(F.abs(F.col("left")) - F.col("size"))
        best = fits.where(off < F.abs(F.col("left"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "size", F.signum("left").cast("long").alias("by"))).alias("b")).select(F.col("source").alias("s"), F.col("b.size").alias("z"), "b.by")
        best = written(best, "mends")  # a row for each source at most
        if best.isEmpty():
            break
        mended = out.join(best, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
        out = mended.select("source", "size", "n", "target", (F.col("taken") + F.coalesce("by", F.lit(0))).alias("taken")).checkpoint()
    return out.select("source", "size", "n", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source: str = "source", size: str | Column = "size", names: tuple[str, str, str, str] = ("__size", "__source_size", "__target", "__copies")) -> DataFrame:
    """``docs`` with the columns ``names``: size, its source's size and target, and copies, 0 to 2, how often the mix takes the row.

    ``size`` is a column of token counts; null counts as 0. A row of size 0 is
    never taken. A null source is a source of its own, the last. Which of the
    documents of one source and size get the odd copy follows a hash of the id,
    so reruns agree; rows that repeat an id there are interchangeable. An empty
    table gives an empty table. Columns of the names are replaced.
    """
    shared_dir(docs.sparkSession)
    z, part, number, s_, z_, p_, before_, n_, taken_ = fresh([*docs.columns, *names], "z", "part", "number", "s", "z_of", "p_of", "before", "n", "taken")
    kept = [c for c in docs.columns if c not in names]
    sized = F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], sized.alias(z), F.pmod(F.xxhash64(F.col(id_col)), F.lit(PARTS)).alias(part))
    parts = written(rows.groupBy(F.col(source).alias("source"), F.col(z).alias("size"), F.col(part).alias("part")).agg(F.count("*").alias("m")), "sizes")
    counts = parts.groupBy("source", "size").agg(F.sum("m").alias("n")).checkpoint()
    goals = targets(counts, weights, share, cap).checkpoint()
    taken = copies_by_size(counts, goals)
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    p, t, g = parts.withColumn("before", F.coalesce(before, F.lit(0))).alias("p"), taken.alias("t"), goals.alias("g")
    dealt = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.size") == F.col("t.size")), "left").join(F.broadcast(g) if goals.limit(10_001).count() <= 10_000 else g, F.col("p.source").eqNullSafe(F.col("g.source")))
    dealt = dealt.select(F.col("p.source").alias(s_), F.col("p.size").alias(z_), F.col("p.part").alias(p_), F.col("before").alias(before_), F.col("n").alias(n_), F.col("taken").alias(taken_), F.col("source_size").alias(names[1]), F.col("target").alias(names[2]))
    numbers = F.row_number().over(Window.partitionBy(source, z, part).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)))
    numbered = rows.withColumn(number, numbers).join(dealt, F.col(source).eqNullSafe(F.col(s_)) & (F.col(z) == F.col(z_)) & (F.col(part) == F.col(p_)))
    odd = (F.col(before_) + F.col(number) <= F.col(taken_) % F.col(n_)).cast("long")
    copies = F.coalesce(F.floor(F.col(taken_) / F.col(n_)).cast("long") + odd, F.lit(0))
    return numbered.select(*[F.col(f"`{c}`") for c in kept], F.col(z).alias(names[0]), names[1], names[2], copies.alias(names[3]))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(read(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("size")), "counted")
    return mix(docs).select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))
