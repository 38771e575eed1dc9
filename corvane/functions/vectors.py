"""Vector functions as columns, in double precision, folded inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.let import let


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Higher is better for each metric: cosine, ip, l2 (minus the distance), euclidean (1 / (1 + distance))."""
    return {"cosine": cosine(a, b), "ip": dot(a, b), "l2": -l2(a, b), "euclidean": 1 / (1 + l2(a, b))}[metric]


def normalised(v: Column) -> Column:
    return let(norm(v), lambda n: F.when(n == 0, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / n)))


def term_bucket(term: Column, buckets: int = 256) -> Column:
    """A bucket from the first seven hexadecimal digits of md5, the same in every engine."""
    return (F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("long") % buckets).cast("int")
