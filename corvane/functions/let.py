"""A value that is worked out once though an expression uses it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``. Inside the lambda of a higher-order function a plain expression would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
