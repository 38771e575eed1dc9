"""Greedy packing as folds over arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.let import let


def _joined(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def pack(parts: Column, size: int, overlap: int = 0, separator: str = " ") -> Column:
    """Joins parts while their lengths, separators not counted, stay within ``size``.

    A new pack begins with as many of the last pack's final parts as fit in
    ``overlap``. Blank packs go.
    """
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.expr("cast(array() as array<string>)").alias("now"), F.lit(0).alias("n"))

    def tail(now: Column) -> Column:
        """The longest run of final parts that fits, as (parts, length)."""
        start = F.struct(F.expr("cast(array() as array<string>)").alias("keep"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        return F.aggregate(
            F.reverse(now),
            start,
            lambda a, x: F.when(a["full"] | (a["n"] + F.length(x) > overlap), F.struct(a["keep"].alias("keep"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(F.array(x), a["keep"]).alias("keep"), (a["n"] + F.length(x)).alias("n"), F.lit(False).alias("full"))),
        )

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] + F.length(x) > size) & (F.size(a["now"]) > 0)
        carried = tail(a["now"]) if overlap else F.struct(F.expr("cast(array() as array<string>)").alias("keep"), F.lit(0).alias("n"))
        return F.when(full, F.struct(F.array_append(a["out"], _joined(a["now"], separator)).alias("out"), F.array_append(carried["keep"], x).alias("now"), (carried["n"] + F.length(x)).alias("n"))).otherwise(F.struct(a["out"].alias("out"), F.array_append(a["now"], x).alias("now"), (a["n"] + F.length(x)).alias("n")))

    done = F.aggregate(parts, empty, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["out"], _joined(a["now"], separator))).otherwise(a["out"]))
    return F.filter(done, lambda x: F.trim(x) != "")


def word_windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each ``size - overlap`` further on; those at the end are shorter."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        begins = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(begins, lambda i: F.array_join(F.slice(w, i, size), " "))

    return let(words, cut)


def within_budget(sizes: Column, budget: int) -> Column:
    """Whether each item fits: one that does not is passed over and later, smaller ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<boolean>)").alias("fits"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x <= budget
        return F.struct(F.when(fits, a["used"] + x).otherwise(a["used"]).alias("used"), F.array_append(a["fits"], fits).alias("fits"))

    return F.aggregate(sizes, start, step, lambda a: a["fits"])
